"""Joins that the relational ones don't give as they are.

Sides are never broadcast by hint: Spark does it by size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_counts(left: DataFrame, right: DataFrame, keys: list[str], counted: dict[str, Column]) -> DataFrame:
    """``left`` with aggregates of ``right`` by key, 0 where there is no row.

    The right side is aggregated before the join, so nothing fans out.
    """
    sums = right.groupBy(*keys).agg(*(c.alias(n) for n, c in counted.items()))
    joined = left.join(sums, keys, "left")
    return joined.withColumns({n: F.coalesce(n, F.lit(0)) for n in counted})


def star(base: DataFrame, key: str, facts: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """One row of ``base`` per key with one pre-aggregated measure per fact."""
    for name, (fact, measure) in facts.items():
        base = with_counts(base, fact, [key], {name: measure})
    return base


def as_of(left: DataFrame, windows: DataFrame, key: str, day: str, value: str, default) -> DataFrame:
    """``left`` with ``value`` of the latest window that holds its day.

    ``windows`` has (key, start, end or null, value); a key has few. They are
    one array per key, so each row of ``left`` meets one row and stays one row,
    repeated rows too. Of windows with one start the greatest value counts.
    """
    ranges = windows.groupBy(F.col(key).alias("_key")).agg(F.collect_list(F.struct("start", "end", F.col(value).alias("value"))).alias("_windows"))
    on = F.col(day)
    holds = lambda w: (on >= w["start"]) & (w["end"].isNull() | (w["end"] >= on))
    latest = F.array_max(F.transform(F.filter("_windows", holds), lambda w: F.struct(w["start"], w["value"])))["value"]
    joined = left.join(ranges, F.col(key) == F.col("_key"), "left")
    return joined.withColumn(value, F.coalesce(latest, F.lit(default))).drop("_key", "_windows")


def within_days(left: DataFrame, right: DataFrame, key: str, left_day: str, right_day: str, days: int) -> DataFrame:
    """Pairs of equal key at most ``days`` days apart, with their distance.

    Days are cut into buckets as wide as the band; a right row is looked for in
    its bucket and the two beside it, so a hot key is split by time.
    """
    epoch = F.to_date(F.lit("1970-01-01"))
    bucket = lambda day: F.floor(F.datediff(F.to_date(day), epoch) / (days + 1))
    a = left.withColumn("_bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: bucket(left_day) + k)))
    b = right.withColumn("_bucket", bucket(right_day))
    gap = F.abs(F.datediff(F.to_date(left_day), F.to_date(right_day)))
    return a.join(b, [key, "_bucket"]).withColumn("distance", gap).where(F.col("distance") <= days).drop("_bucket")


def near_members(hashes: DataFrame, pairs: DataFrame, key: str, group: str, simhash: str) -> DataFrame:
    """Every row of ``hashes`` with the class of its (group, simhash):
    ``representative`` is the smallest key of the class, as in the ``pairs`` of
    ``nearhash.near_by_hamming``, and ``near`` the number of other rows of its group
    within the threshold, distance 0 included. Rows without a group or hash are near none.

    Rows are counted by class and then by pair of classes, so nothing fans out.
    No side is broadcast: in compressed files that Spark takes for small there may
    be as many classes and pairs as there are rows.
    """
    nodes = hashes.where(F.col(simhash).isNotNull()).groupBy(group, simhash).agg(F.min(key).alias("representative"), F.count("*").alias("_n"))
    n = nodes.select(F.col("representative").alias("_b"), "_n")
    both = pairs.select(F.col("key_a").alias("_a"), F.col("key_b").alias("_b")).union(pairs.select("key_b", "key_a"))
    beside = both.join(n.hint("merge"), "_b").groupBy(F.col("_a").alias("representative")).agg(F.sum("_n").alias("_beside"))
    classes = nodes.join(beside.hint("merge"), "representative", "left").select(
        F.col(group).alias("_group"), F.col(simhash).alias("_hash"), "representative", (F.col("_n") - 1 + F.coalesce("_beside", F.lit(0))).alias("near")
    )
    same = (F.col(group) == F.col("_group")) & (F.col(simhash) == F.col("_hash"))
    return hashes.join(classes.hint("merge"), same, "left").select(*hashes.columns, "representative", F.coalesce("near", F.lit(0)).alias("near"))


def by_cover(documents: DataFrame, months: DataFrame) -> DataFrame:
    """(entity, month) rows matched to documents of the month, its quarter or year.

    ``documents`` has (doc, entity, period string); three equi-joins, no OR.
    """
    q = F.concat(F.year("month").cast("string"), F.lit("-Q"), F.quarter("month").cast("string"))
    keys = F.array(F.date_format("month", "yyyy-MM-01"), q, F.concat(F.year("month").cast("string"), F.lit("-FY")))
    wide = months.select("entity", "month", F.explode(keys).alias("period"))
    return wide.join(documents, ["entity", "period"]).dropDuplicates(["entity", "month", "doc"])
