"""Mutations as deterministic rewrites: old and new rows together, ranked.

Every ranking needs a total order; ``seq`` is the writer's sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Authority of source types, lower wins, and of unknown ones.
SOURCE_PRIORITY = {
    "ir_press_release": 1, "archive_pdf": 1, "archive_html": 1, "wire_press_release": 1,
    "edgar_8k": 2, "edgar_8ka": 2,
    "edgar_10q": 3, "edgar_6k": 3, "edgar_6ka": 3,
    "edgar_10k": 4, "edgar_20f": 4, "edgar_20fa": 4, "edgar_40f": 4, "edgar_40fa": 4,
}
DEFAULT_PRIORITY = 4
#: Methods that are an analyst's decision, priority 0.
ANALYST_METHODS = ("analyst", "analyst_gap", "analyst_approved", "review_approved", "review_edited", "manual")
MAX_ATTEMPTS = 5


def priority(source: Column, method: Column) -> Column:
    table = F.create_map(*(F.lit(x) for p in SOURCE_PRIORITY.items() for x in p))
    known = F.coalesce(F.try_element_at(table, source), F.lit(DEFAULT_PRIORITY))
    return F.when(F.coalesce(method.isin(*ANALYST_METHODS), F.lit(False)), 0).otherwise(known)


def _chosen(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The row with the smallest ``order`` of each key: an aggregate that is
    combined before the shuffle, so hot keys cost one row a task."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*")


def last_wins(rows: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_row")).select(*keys, "_row.*")


def first_wins(rows: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    return _chosen(rows, keys, F.col(seq))


def authority_wins(rows: DataFrame, keys: list[str], priority: str = "priority", seq: str = "seq") -> DataFrame:
    """What writing rows in turn leaves when a write replaces only rows of
    equal or lesser authority: best priority, then the last of it."""
    return _chosen(rows, keys, F.struct(F.col(priority), -F.col(seq)))


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and the rows of ``new`` whose key it lacks, first of each key."""
    return old.unionByName(first_wins(new, keys).join(old, keys, "left_anti").select(*old.columns))


def update_columns(rows: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the non-null values of ``changes``."""
    names = [c for c in changes.columns if c not in keys]
    marked = changes.select(*keys, *(F.col(n).alias(f"_{n}") for n in names))
    joined = rows.join(marked, keys, "left")
    return joined.select(*(F.coalesce(f"_{c}", c).alias(c) if c in names else F.col(c) for c in rows.columns))


def purge(rows: DataFrame, scope: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, archived as JSON): rows whose key is in ``scope`` are archived."""
    gone = rows.join(scope, keys, "left_semi")
    return rows.join(scope, keys, "left_anti"), gone.select(F.to_json(F.struct(*rows.columns)).alias("row_data"))


def attempt_state(log: DataFrame, key: str, status: str, seq: str, most: int = MAX_ATTEMPTS) -> DataFrame:
    """State after an attempt log (done or failed, by ``seq``): every run counts
    as an attempt, and a failure that is at least the ``most``-th attempt makes
    a dead letter. Other statuses are no runs."""
    runs = log.where(F.col(status).isin("done", "failed"))
    grouped = runs.groupBy(key).agg(F.count("*").alias("attempts"), F.max_by(status, seq).alias("last"))
    dead = (F.col("last") == "failed") & (F.col("attempts") >= most)
    return grouped.withColumn("state", F.when(dead, "dead_letter").otherwise(F.col("last")))


def promoted(facts: DataFrame, queue: DataFrame) -> DataFrame:
    """Facts (entity, period, metric, value, method) that go to review: those
    that no analyst made and that no pending item of ``queue`` is about."""
    pending = queue.where("status = 'PENDING'").select("entity", "period", "metric").distinct()
    return facts.where(~F.coalesce(F.col("method").isin(*ANALYST_METHODS), F.lit(False))).join(pending, ["entity", "period", "metric"], "left_anti").withColumn("status", F.lit("PENDING"))


def entered(facts: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    """Facts after manual entries (keys, value, seq): a positive finite value
    replaces what its key has, the last entry wins, others change nothing."""
    good = entries.where("value > 0 and value < double('infinity')")
    last = last_wins(good.select(*keys, "value", "seq"), keys).select(*keys, F.col("value").alias("_value"))
    both = facts.join(last, keys, "full")
    return both.select(*keys, F.coalesce("_value", "value").alias("value"), F.when(F.col("_value").isNotNull(), "manual").otherwise(F.col("method")).alias("method"))


def approved(queue: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply decisions (id, action, value): new facts of priority 0, final
    values, and the queue after it, siblings of an approved key dismissed."""
    joined = queue.join(decisions.select("id", "action", F.col("value").alias("decided")), "id", "left")
    taken = joined.where(F.col("action").isin("approve", "edit")).withColumn("value", F.coalesce("decided", "value"))
    facts = taken.select("entity", "period", "metric", "value", F.lit(0).alias("priority"))
    keys = facts.select("entity", "period", "metric").distinct().withColumn("_taken", F.lit(True))
    after = joined.join(keys, ["entity", "period", "metric"], "left").withColumn(
        "status",
        F.when(F.col("action").isin("approve", "edit"), "APPROVED")
        .when(F.col("action") == "reject", "REJECTED")
        .when(F.col("_taken"), "DISMISSED")
        .otherwise(F.col("status")),
    )
    return facts, facts.drop("priority"), after.select(*queue.columns)
