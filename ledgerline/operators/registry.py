"""Source registry: which forms, rules and documents apply, and what is stale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import host
from .filters import ladder

#: Forms that each filing regime files.
REGIME_FORMS = {"domestic": ("8-K", "10-Q", "10-K"), "canadian": ("6-K", "40-F"), "foreign": ("6-K", "20-F")}


def due_filings(companies: DataFrame, filings: DataFrame, since: Column) -> DataFrame:
    """Filings of the forms of a company's regime, from the later of ``since``
    and its first filing. ``companies`` (entity, regime, first_filing)."""
    pairs = [(r, f) for r, forms in REGIME_FORMS.items() for f in forms]
    forms = companies.sparkSession.createDataFrame(pairs, "regime string, form string")
    wanted = companies.join(forms, "regime").withColumn("_floor", F.greatest(since, "first_filing"))
    return wanted.join(filings, ["entity", "form"]).where(F.col("filed") >= F.col("_floor")).drop("_floor")


def matched_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The first rule (by ``rank``) whose host is the URL's or ends it and whose
    path begins the URL's path.

    A host has few suffixes, so the suffix match is an equi-join on them, of
    each distinct URL once. URLs without a rule go; repeated rows stay.
    """
    h = host(F.col("url"))
    labels = F.split(h, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    path = F.regexp_replace("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    wide = urls.select("url").distinct().withColumn("_path", path).withColumn("host", F.explode(suffixes))
    hit = wide.join(rules, "host").where(F.startswith("_path", "prefix"))
    return urls.join(hit.groupBy("url").agg(F.min_by("rule", "rank").alias("rule")), "url").select(*urls.columns, "rule")


def main_exhibit(links: DataFrame, key: str, kind: str, order: str) -> DataFrame:
    """One link per key: the first EX-99.1, else the first EX-99."""
    rank = F.when(F.col(kind) == "EX-99.1", 0).when(F.col(kind).startswith("EX-99"), 1)
    w = Window.partitionBy(key).orderBy("_rank", order)
    rows = links.withColumn("_rank", rank).where("_rank is not null").withColumn("_n", F.row_number().over(w))
    return rows.where("_n = 1").drop("_rank", "_n")


def data_state(mode: Column, documents: Column, points: Column) -> Column:
    """skip, index_no_data, ok, ingested_no_extraction or no_data."""
    return ladder(
        [("skip", mode == "skip"), ("index_no_data", (mode == "index") & (documents == 0)), ("ok", points > 0), ("ingested_no_extraction", documents > 0)],
        "no_data",
    )


def governance(last_audit: Column, now: Column, stale_days: int, issue: Column, active: Column) -> Column:
    """inactive, misconfigured, never_audited, stale or current."""
    old = last_audit < now - F.make_dt_interval(F.lit(stale_days))
    return ladder([("inactive", ~active), ("misconfigured", issue.isNotNull()), ("never_audited", last_audit.isNull()), ("stale", old)], "current")


def config_issue(mode: Column, fields: dict[str, Column]) -> Column:
    """What a scraper's mode needs and lacks, null if nothing."""
    lacks = lambda name: F.coalesce(F.trim(fields[name]), F.lit("")) == ""
    need = {"rss": "rss_url", "template": "url_template", "index": "ir_url"}
    return F.coalesce(*(F.when((mode == m) & lacks(f), F.lit(f"{m} mode needs {f}")) for m, f in need.items()), F.when(mode.isNull(), F.lit("no mode")))


def orphaned(runs: DataFrame, alive: DataFrame, key: str, status: str) -> DataFrame:
    """Runs whose process is gone are stopped; others are as they were."""
    marked = runs.join(alive.select(key).distinct().withColumn("_alive", F.lit(True)), key, "left")
    gone = (F.col(status) == "running") & F.col("_alive").isNull()
    return marked.withColumn(status, F.when(gone, "stopped").otherwise(F.col(status))).drop("_alive")


def entity_of_path(path: Column, entities: list[str]) -> Column:
    """The entity whose ``X MONTHLY`` folder a path is in, null without one."""
    return F.coalesce(*(F.when(path.contains(f"{e} MONTHLY") | F.upper(path).contains(f"{e}_MONTHLY"), F.lit(e)) for e in entities))


def without_preamble(text: Column) -> Column:
    """Text from UNITED STATES on, if it starts with an identifier's tag dump."""
    at = F.locate("UNITED STATES", text)
    tagged = text.rlike(r"^\s*\d{10}\b")
    return F.when(tagged & (at > 0), F.substring(text, at, F.char_length(text))).otherwise(text)


def filing_windows(filings: DataFrame, periodic: tuple[str, ...]) -> DataFrame:
    """First and last filing of each entity, and whether it files periodic forms."""
    return filings.groupBy("entity").agg(
        F.min("filed").alias("since"), F.max("filed").alias("until"), F.coalesce(F.bool_or(F.col("form").isin(*periodic)), F.lit(False)).alias("periodic")
    )
