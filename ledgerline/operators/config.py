"""Dimension maintenance: syncs, contracts, rules and JSON lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import best


def synced(stored: DataFrame, config: DataFrame, key: str, from_config: list[str], insert: bool = True) -> DataFrame:
    """Config columns replaced where given, others kept; new keys inserted."""
    names = [c for c in stored.columns if c != key]
    other = config.select(F.col(key), *(F.col(c).alias(f"_{c}") for c in from_config))
    joined = stored.join(other, key, "full_outer" if insert else "left")
    return joined.select(key, *(F.coalesce(f"_{c}", c).alias(c) if c in from_config else F.col(c) for c in names))


def contracts(rows: DataFrame, key: str) -> DataFrame:
    """One contract per key of (family, source, confidence, status_rank,
    blocker): best source of each family, worst status, all blockers."""
    top = best(rows, [key, "family"], [F.desc("confidence"), F.col("source")])
    sources = top.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("family", "source")))).alias("sources"))
    rest = rows.groupBy(key).agg(F.max("status_rank").alias("status_rank"), F.array_sort(F.collect_set("blocker")).alias("blockers"))
    return sources.join(rest, key)


def rules_for(schema: DataFrame, rules: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """``rules`` and a default one for each schema key that has none."""
    new = schema.select(key).distinct().join(rules, key, "left_anti").withColumns(defaults)
    return rules.unionByName(new.select(*rules.columns))


def by_class(rows: DataFrame, klass: Column, source: str, extracted: Column, day: str) -> DataFrame:
    """Totals, span and a map of source to count for each class."""
    counted = rows.withColumn("class", klass).groupBy("class", source).agg(
        F.count("*").alias("n"), F.count_if(extracted).alias("done"), F.min(day).alias("lo"), F.max(day).alias("hi")
    )
    entries = F.array_sort(F.collect_list(F.struct(source, "n")))
    return counted.groupBy("class").agg(
        F.sum("n").alias("total"), F.sum("done").alias("extracted"), F.min("lo").alias("first"), F.max("hi").alias("last"), F.map_from_entries(entries).alias("by_source")
    )


def edited_list(items: Column, drop: Column, add: Column) -> Column:
    """A JSON list column as an array: without ``drop``, with ``add`` once."""
    kept = F.filter(items, lambda x: x != drop)
    return F.when(F.array_contains(kept, add), kept).otherwise(F.array_append(kept, add))
