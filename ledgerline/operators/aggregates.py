"""Aggregations with zero filling, histograms, top terms and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import best


def bucketed(rows: DataFrame, value: str, edges: list[float], labels: list[str]) -> DataFrame:
    """Counts of half-open buckets, 0 where a bucket is empty."""
    label = F.when(F.col(value) < edges[1], labels[0])
    for lo, name in zip(edges[2:], labels[1:], strict=False):
        label = label.when(F.col(value) < lo, name)
    label = label.otherwise(labels[-1])
    counts = rows.where(F.col(value).isNotNull()).groupBy(label.alias("bucket")).agg(F.count("*").alias("n"))
    dim = rows.sparkSession.createDataFrame([(x,) for x in labels], "bucket string")
    return dim.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def duplicated(rows: DataFrame, keys: list[str], keep: str) -> DataFrame:
    """Keys that come more than once, the ``keep`` that stays and the count."""
    return rows.groupBy(*keys).agg(F.max(keep).alias("kept"), F.count("*").alias("n")).where("n > 1")


def one_pass(rows: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """Many counts in one row and one scan."""
    return rows.agg(*(F.count_if(p).alias(n) for n, p in predicates.items()))


def top_terms(docs: DataFrame, text: str, stop: list[str], n: int, pattern: str = "[a-z]{3,}") -> DataFrame:
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))).alias("word"))
    return words.where(~F.col("word").isin(*stop)).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(n)


def clustered(hits: DataFrame, most: int = 5) -> DataFrame:
    """Hits (metric, text, signal, report) by masked pattern: any found, the
    longest example, frequency, reports; at most ``most`` per metric, found
    before missed, then the more frequent."""
    masked = F.regexp_replace("text", "[0-9]+", "#")
    groups = hits.groupBy("metric", masked.alias("pattern")).agg(
        F.max((F.col("signal") == "found").cast("int")).alias("found"),
        F.max_by("text", F.struct(F.char_length("text"), "text")).alias("example"),
        F.count("*").alias("n"),
        F.countDistinct("report").alias("reports"),
    )
    ident = F.substring(F.sha2(F.concat_ws(":", "metric", "pattern"), 256), 1, 8)
    return best(groups.withColumn("id", ident), ["metric"], [F.desc("found"), F.desc("n"), F.col("pattern")], most)


def pivoted(rows: DataFrame, index: str | list[str], column: str, value: str, names: list) -> DataFrame:
    """Wide table of given columns, by one aggregation; missing cells null."""
    cell = lambda n: F.max(F.when(F.col(column) == n, F.col(value))).alias(str(n))
    return rows.groupBy(index).agg(*(cell(n) for n in names))


def queue_groups(rows: DataFrame, keys: list[str], status: str, created: str, statuses: list[str]) -> DataFrame:
    """Jobs of each group by status, and when its oldest pending one was made."""
    counts = [F.count_if(F.col(status) == s).alias(s) for s in statuses]
    return rows.groupBy(*keys).agg(*counts, F.min(F.when(F.col(status) == "pending", F.col(created))).alias("oldest"))


def latest_snapshot(snapshots: DataFrame, key: str, at: str) -> DataFrame:
    """The last snapshot of each key, and how many it has."""
    rest = [c for c in snapshots.columns if c != key]
    return snapshots.groupBy(key).agg(F.count("*").alias("snapshots"), F.max_by(F.struct(*rest), at).alias("_s")).select(key, "snapshots", "_s.*")
