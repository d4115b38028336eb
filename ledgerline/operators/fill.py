"""Months from quarterly and annual totals: bridge and gap fill.

Both take the same frame: one row per covered month with the covering value,
the known monthly value or null, and whether an analyst protects the month.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.periods import covered_months


def cells(covering: DataFrame, monthly: DataFrame) -> DataFrame:
    """(entity, covering, metric, total, month, place, n, known, n_known,
    known_sum) for each month of each covering value."""
    months = F.posexplode(covered_months(F.col("covering"))).alias("place", "month")
    wide = covering.select("entity", "covering", "metric", F.col("value").alias("total"), months)
    known = monthly.select("entity", "metric", F.col("period").alias("month"), F.col("value").alias("known"))
    w = Window.partitionBy("entity", "covering", "metric")
    return (
        wide.join(known, ["entity", "metric", "month"], "left")
        .withColumn("n", F.count("*").over(w))
        .withColumn("n_known", F.count("known").over(w))
        .withColumn("known_sum", F.coalesce(F.sum("known").over(w), F.lit(0.0)))
    )


def bridge_flow(frame: DataFrame, cadence: Column) -> DataFrame:
    """Missing months of a summable metric: value, method, confidence.

    Quarterly reporters get an equal share. Monthly reporters get the
    remainder if one month is missing, else an equal share with less trust.
    """
    annual = F.col("covering").endswith("-FY")
    carry = F.when(annual, "annual_carry").otherwise("quarterly_carry")
    share = F.col("total") / F.col("n")
    infer = (cadence == "monthly") & (F.col("n_known") == F.col("n") - 1)
    return frame.where("known is null").select(
        "entity",
        "metric",
        "month",
        F.when(infer, F.col("total") - F.col("known_sum")).otherwise(share).alias("value"),
        F.when(infer, "quarterly_inferred").otherwise(carry).alias("method"),
        F.when(cadence == "quarterly", 0.80).when(infer, 0.65).otherwise(0.70).alias("confidence"),
    )


def bridge_snapshot(frame: DataFrame, cadence: Column) -> DataFrame:
    """Missing months of a point-in-time metric: the last month is carried for
    quarterly reporters, others go to review (route)."""
    last = F.col("place") == F.col("n") - 1
    return frame.where(F.col("known").isNull() & ((cadence == "monthly") | last)).select(
        "entity",
        "metric",
        "month",
        F.col("total").alias("value"),
        F.when(cadence == "quarterly", "carry").otherwise("review").alias("route"),
        F.when(cadence == "quarterly", 0.80).otherwise(0.50).alias("confidence"),
    )


def fill_flow(frame: DataFrame) -> DataFrame:
    """status, reason and value by month: the remainder if one is missing and it
    isn't negative, a third each if all are, else skipped."""
    missing = F.col("n") - F.col("n_known")
    rest = F.col("total") - F.col("known_sum")
    status = F.when(missing == 0, "skipped").when((missing == 1) & (rest < 0), "skipped").when(missing.isin(1, 3), "filled").otherwise("skipped")
    reason = (
        F.when(missing == 0, "all_months_present")
        .when((missing == 1) & (rest < 0), "negative_delta")
        .when(missing == 1, "inferred_delta")
        .when(missing == 3, "inferred_prorated")
        .otherwise("insufficient_known_months")
    )
    value = F.when(status == "filled", F.when(missing == 1, rest).otherwise(F.col("total") / 3))
    rows = frame.where(F.col("known").isNull() | (missing == 0) & (F.col("place") == 0))
    return rows.select("entity", "covering", "metric", "month", status.alias("status"), reason.alias("reason"), value.alias("value"))


def fill_snapshot(frame: DataFrame, previous_total: Column, mode: str) -> DataFrame:
    """Missing months of a point-in-time metric: endpoint, stepwise or linear
    (without a previous quarter as stepwise)."""
    if mode not in ("endpoint", "stepwise", "linear"):
        raise ValueError(f"unknown mode {mode!r}")
    linear = previous_total + (F.col("total") - previous_total) * ((F.col("place") + 1) / F.col("n"))
    value = F.coalesce(linear, F.col("total")) if mode == "linear" else F.col("total")
    method = F.when(previous_total.isNotNull(), "inferred_linear").otherwise("inferred_stepwise") if mode == "linear" else F.lit({"endpoint": "inferred_snapshot", "stepwise": "inferred_stepwise"}[mode])
    rows = frame.where("known is null")
    if mode == "endpoint":
        rows = rows.where(F.col("place") == F.col("n") - 1)
    return rows.select("entity", "covering", "metric", "month", value.alias("value"), method.alias("method"))


def derived_sales(holdings: DataFrame, production: DataFrame) -> DataFrame:
    """sold = holdings of the month before + production - holdings; only where
    all three are there and it isn't negative."""
    before = holdings.select("entity", F.add_months("period", 1).alias("period"), F.col("value").alias("held_before"))
    rows = holdings.withColumnRenamed("value", "held").join(before, ["entity", "period"]).join(production.withColumnRenamed("value", "made"), ["entity", "period"])
    sold = F.col("held_before") + F.col("made") - F.col("held")
    return rows.withColumn("sold", F.round(sold, 6)).where("sold >= 0").select("entity", "period", "sold")
