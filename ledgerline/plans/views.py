"""Canonical views over the tables of a folder, in Spark and as SQL CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.periods import quarter_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, period, metric, value): monthly quantity by supplier and flag."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("entity"), F.trunc("l_shipdate", "MM").alias("period"), F.col("l_returnflag").alias("metric"))
        .agg(F.round(F.sum("l_quantity"), 2).alias("value"))
    )


def quarterly(obs: DataFrame) -> DataFrame:
    """(entity, covering, metric, value): totals by quarter."""
    return obs.groupBy("entity", quarter_of(F.col("period")).alias("covering"), "metric").agg(F.round(F.sum("value"), 2).alias("value"))


OBS = """obs AS (
    SELECT l_suppkey AS entity, CAST(date_trunc('month', l_shipdate) AS DATE) AS period, l_returnflag AS metric,
        round(sum(l_quantity), 2) AS value
    FROM lineitem GROUP BY ALL)"""
#: Every third month is taken out of the monthly rows, so that there are gaps to fill.
KEPT = "kept AS (SELECT * FROM obs WHERE (entity * 7 + month(period) + year(period)) % 3 <> 0)"
QOBS = """qobs AS (
    SELECT entity, year(period) || '-Q' || quarter(period) AS covering, metric, round(sum(value), 2) AS value,
        make_date(year(period), (quarter(period) - 1) * 3 + 1, 1) AS first_month
    FROM obs GROUP BY ALL)"""
CELLS = """cells AS (
    SELECT c.*, k.value AS known, count(*) OVER w AS n, count(k.value) OVER w AS n_known, coalesce(sum(k.value) OVER w, 0) AS known_sum
    FROM (SELECT entity, covering, metric, value AS total, p AS place, CAST(first_month + to_months(CAST(p AS INTEGER)) AS DATE) AS month
          FROM qobs, (SELECT unnest([0, 1, 2]) AS p)) c
    LEFT JOIN kept k ON k.entity = c.entity AND k.metric = c.metric AND k.period = c.month
    WINDOW w AS (PARTITION BY c.entity, c.covering, c.metric))"""
SPINE = """span AS (SELECT entity, metric, min(period) AS lo, max(period) AS hi FROM obs GROUP BY ALL),
    spine AS (SELECT entity, metric, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS month FROM span)"""


def kept(obs: DataFrame) -> DataFrame:
    return obs.where((F.col("entity") * 7 + F.month("period") + F.year("period")) % 3 != 0)
