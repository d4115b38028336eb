"""The ten documented rules for values that are possible but likely wrong."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names of the metrics that rules are about, words that explain a
#: value, and bounds.
PRODUCTION, OPERATING, INSTALLED, TREASURY = "production_btc", "hashrate_eh_operational", "hashrate_eh_installed", "treasury_btc_total"
SOLD, YEAR_TO_DATE = "sold_btc", "ytd_production_btc"
SWING_WORDS = ("acquisition", "merger", "curtailment", "outage", "maintenance", "energized", "expansion", "upgrade", "weather", "grid event", "hosting transition")
SALE_WORDS = ("sold", "disposed", "liquidated", "repayment", "collateral release")
ZERO_WORDS = ("curtailment", "maintenance", "outage", "weather", "shutdown", "energization delay")
MOST_SWING, MOST_PER_EH, MOST_EH, MOST_DROP, LEAST_TRUST, SMALL_EH = 0.50, 500.0, 200.0, 0.20, 0.60, 0.01
#: Severity and what to do by rule; high ones block publication.
RULES = {
    "mom_swing_unexplained": ("medium", "Require manual review."),
    "production_hashrate_impossible": ("high", "Re-check period scope and hashrate units."),
    "hashrate_implausible_pre2025": ("high", "Verify PH/s to EH/s conversion and decimal placement."),
    "treasury_drop_unexplained": ("medium", "Check if sale is disclosed in a separate filing."),
    "ytd_confusion_exact_match": ("high", "Replace monthly with null pending review."),
    "quarterly_imputation_pattern": ("medium", "Mark as quarterly scope conflict."),
    "zero_production_unexplained": ("high", "Manual validation against source release."),
    "low_confidence_no_agreement": ("medium", "Route to human queue."),
    "stale_value_repetition": ("medium", "Verify report text changed each month."),
    "hashrate_unit_mismatch": ("high", "Re-run unit normalization pass."),
}


def _says(evidence: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (evidence.contains(w) for w in words))


def anomalies(rows: DataFrame, constants: tuple[str, ...] = ()) -> DataFrame:
    """(entity, month, metric, value, code, severity, action): a row for each rule
    that a value breaks.

    ``rows`` has one row for each (entity, month, metric): value, confidence,
    agreed (whether extractors agree) and evidence (its text). Values of earlier
    months count by their month, also where some are missing; the last quarter is the sum of its three months, if all are there. Values of metrics
    in ``constants`` may repeat. Null values break no rule but the eighth; null
    evidence explains nothing. One sort by entity, metric and month, and one by
    entity and month; neither key is ever larger than one entity.
    """
    said = F.lower(F.coalesce("evidence", F.lit("")))
    series = Window.partitionBy("entity", "metric").orderBy("month")
    recent = F.collect_list(F.struct("month", "value")).over(series.rowsBetween(-5, -1))
    before = lambda k: F.get(F.filter("_recent", lambda r: r["month"] == F.add_months("month", -k)), F.lit(0))["value"]
    first = F.trunc("month", "quarter")
    place = (F.months_between("month", first)).cast("int")
    earlier = F.array(*(before(k) for k in range(1, 6)))
    cell = Window.partitionBy("entity", "month")
    of = lambda name: F.max(F.when(F.col("metric") == name, F.col("value"))).over(cell)
    known = rows.withColumns({"_said": said, "_recent": recent, "_place": place}).withColumn("_before", earlier)
    known = known.withColumns({"_p": of(PRODUCTION), "_h": of(OPERATING), "_sold": of(SOLD), "_ytd": of(YEAR_TO_DATE)})
    last = F.slice("_before", F.col("_place") + 1, 3)
    quarter = F.when(~F.exists(last, lambda x: x.isNull()), F.aggregate(last, F.lit(0.0), lambda a, x: a + x))
    metric, value, prior = F.col("metric"), F.col("value"), F.col("_before")[0]
    text, swing = F.col("_said"), F.abs(value - prior) / F.greatest(prior, F.lit(1.0))
    tripled = F.abs(value * 3 - quarter) <= 0.01 * F.abs(quarter)
    quarterly = text.rlike(r"\bq[1-4]\b") & ~text.rlike(r"\b(?:january|february|march|april|may|june|july|august|september|october|november|december)\b")
    broken = {
        "mom_swing_unexplained": metric.isin(PRODUCTION, OPERATING, TREASURY) & (swing > MOST_SWING) & ~_says(text, SWING_WORDS),
        "production_hashrate_impossible": (metric == PRODUCTION) & (value / F.greatest("_h", F.lit(0.001)) > MOST_PER_EH) & F.col("_h").isNotNull(),
        "hashrate_implausible_pre2025": (F.col("month") < F.to_date(F.lit("2025-01-01"))) & metric.isin(OPERATING, INSTALLED) & (value > MOST_EH),
        "treasury_drop_unexplained": (metric == TREASURY) & (prior > 0) & ((prior - value) / prior > MOST_DROP) & (F.coalesce("_sold", F.lit(0.0)) == 0) & ~_says(text, SALE_WORDS),
        "ytd_confusion_exact_match": (metric == PRODUCTION) & (value == F.col("_ytd")) & (F.month("month") != 1),
        "quarterly_imputation_pattern": tripled & (quarter != 0) & quarterly,
        "zero_production_unexplained": (metric == PRODUCTION) & (value == 0) & ~_says(text, ZERO_WORDS),
        "low_confidence_no_agreement": (F.col("confidence") < LEAST_TRUST) & ~F.coalesce("agreed", F.lit(False)),
        "stale_value_repetition": (value == prior) & (value == F.col("_before")[1]) & ~metric.isin(*constants) if constants else (value == prior) & (value == F.col("_before")[1]),
        "hashrate_unit_mismatch": metric.isin(OPERATING, INSTALLED) & text.contains("ph/s") & _not_scaled(text, value),
    }
    told = F.array(*(F.when(v, F.struct(F.lit(k).alias("code"), F.lit(RULES[k][0]).alias("severity"), F.lit(RULES[k][1]).alias("action"))) for k, v in broken.items()))
    return known.select("entity", "month", "metric", "value", F.inline(F.filter(told, lambda x: x.isNotNull())))


def _not_scaled(text: Column, value: Column) -> Column:
    """The number before PH/s is the value itself, or the value is tiny beside a whole number."""
    number = F.replace(F.regexp_extract(text, r"([\d,]*\d(?:\.\d+)?)\s*ph/s", 1), F.lit(","), F.lit("")).try_cast("double")
    return (number == value) | ((value < SMALL_EH) & (number == F.floor(number)))
