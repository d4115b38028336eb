"""Coverage: cell states, expected and missing periods, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.periods import month_spine
from .filters import ladder


def cell_state(has_data: Column, in_review: Column, has_report: Column, states: Column) -> Column:
    """Six states of an (entity, period) cell; ``states`` are the ingest states
    of its manifest entries (an array, null without entries)."""
    has = lambda *x: F.arrays_overlap(states, F.array(*map(F.lit, x)))
    entries = F.coalesce(F.size(states), F.lit(0)) > 0
    return ladder(
        [
            ("accepted", has_data),
            ("extracted_in_review", in_review),
            ("ingested_pending_extraction", has_report),
            ("pending_ingest", entries & has("pending", "failed")),
            ("legacy_undated", entries & has("legacy_undated")),
            ("ingested_pending_extraction", entries & has("ingested")),
            ("pending_ingest", entries),
        ],
        "no_source",
    )


def metric_cell_state(flags: dict[str, Column]) -> Column:
    """Nine states of an (entity, period, metric) cell, the highest that holds.
    Flags that are not given are false."""
    f = lambda name: flags.get(name, F.lit(False))
    return ladder(
        [
            ("analyst_gap", f("analyst_gap")),
            ("data_quarterly", f("data") & f("quarterly")),
            ("data", f("data")),
            ("review_pending", f("review")),
            ("llm_empty", f("llm_empty")),
            ("parse_failed", f("parse_error")),
            ("extract_failed", f("extract_error")),
            ("scraper_error", f("scraper_error")),
        ],
        "no_document",
    )


def gap_reason(has_key_metric: Column, has_report: Column, in_review: Column) -> Column:
    return ladder([("ok", has_key_metric), ("no_file", ~has_report), ("low_confidence", in_review)], "no_extraction")


def dense_grid(*dims: DataFrame) -> DataFrame:
    """All combinations of small dimensions (entities, periods, metrics)."""
    grid = dims[0]
    for d in dims[1:]:
        grid = grid.crossJoin(d)
    return grid


def spine(series: DataFrame, keys: list[str], period: str = "period") -> DataFrame:
    """(keys, month) for every month between a key's first and last."""
    span = series.groupBy(*keys).agg(F.min(period).alias("_lo"), F.max(period).alias("_hi"))
    return span.select(*keys, F.explode(month_spine(F.col("_lo"), F.col("_hi"))).alias("month"))


def _until_next(series: DataFrame, keys: list[str], period: str) -> Column:
    """The month before the next one of a series that has a row, null at its end."""
    return F.add_months(F.lead(period).over(Window.partitionBy(*keys).orderBy(period)), -1)


def filled(series: DataFrame, keys: list[str], period: str = "period", value: str = "value") -> DataFrame:
    """Every month from a series' first to its last as (keys, month, value,
    present), value null where there is no row.

    Each row stands for itself and the empty months up to the next one, so the
    series is sorted once and joined with nothing. Periods are first days of
    months and come once in a series.
    """
    month = F.col(period)
    months = F.sequence(month, F.greatest(month, F.coalesce(_until_next(series, keys, period), month)), F.expr("interval 1 month"))
    rows = series.select(*keys, F.col(value).alias("_value"), months.alias("_months")).select(*keys, "_value", F.posexplode("_months").alias("_n", "month"))
    rows = rows.select(*keys, "month", F.when(F.col("_n") == 0, F.col("_value")).alias("value"))
    return rows.withColumn("present", F.col("value").isNotNull())


def missing_periods(series: DataFrame, keys: list[str], period: str = "period") -> DataFrame:
    """(keys, month): months between the first and last of a series without a row."""
    rows = series.select(*keys, F.add_months(period, 1).alias("_from"), _until_next(series, keys, period).alias("_to")).where("_from <= _to")
    return rows.select(*keys, F.explode(F.sequence("_from", "_to", F.expr("interval 1 month"))).alias("month"))


def completeness(series: DataFrame, keys: list[str]) -> DataFrame:
    """present, expected (months from the first to the last) and their ratio to 4 places."""
    expected = (F.months_between(F.trunc(F.max("period"), "MM"), F.trunc(F.min("period"), "MM")) + 1).cast("long")
    counts = series.groupBy(*keys).agg(F.count("value").alias("present"), expected.alias("expected"))
    return counts.withColumn("ratio", F.round(F.col("present") / F.col("expected"), 4))


def expected_periods(windows: DataFrame, key: str, as_of: Column) -> DataFrame:
    """Months at which each key should report: every one or third month of its
    windows (cadence, start, end or null), up to ``as_of``."""
    end = F.least(F.coalesce("end", as_of), as_of)
    start = F.trunc("start", "MM")
    step = F.when(F.col("cadence") == "monthly", 1).otherwise(3)
    months = F.when(start <= end, F.sequence(F.lit(0), F.floor(F.months_between(F.trunc(end, "MM"), start) / step).cast("int")))
    rows = windows.select(key, start.alias("_start"), step.alias("_step"), F.explode(months).alias("_k"))
    return rows.select(key, F.add_months("_start", F.col("_k") * F.col("_step")).alias("period")).distinct()


def median_cadence(dates: DataFrame, key: str, day: str) -> DataFrame:
    """Cadence by the median gap in days: up to 45 monthly, from 70 quarterly."""
    w = Window.partitionBy(key).orderBy(day)
    gaps = dates.select(key, day).distinct().withColumn("gap", F.datediff(day, F.lag(day).over(w)))
    return gaps.groupBy(key).agg(F.median("gap").alias("median_gap")).withColumn(
        "cadence", F.when(F.col("median_gap") <= 45, "monthly").when(F.col("median_gap") >= 70, "quarterly").otherwise("unknown")
    )


def cadence_windows(companies: DataFrame, dates: DataFrame, filers: DataFrame, as_of: Column) -> DataFrame:
    """(entity, cadence, start, confidence, evidence) of each company, open ended.

    The first rule that holds: event-driven companies, and those read by index
    without dates, announce; four dates or more with a median gap of up to 45
    days (from 70) are monthly (quarterly); those with quarterly or annual
    filings are quarterly; else monthly. ``companies`` has (entity, mode,
    event_driven, start_year); where the year is null the first date's counts
    under the second rule and that of ``as_of`` under the others. ``dates``
    (entity, day) may repeat; null days don't count. ``filers`` (entity).
    """
    w = Window.partitionBy("entity").orderBy("day")
    gaps = dates.where("day is not null").select("entity", "day", F.datediff("day", F.lag("day").over(w)).alias("gap"))
    seen = gaps.groupBy("entity").agg(F.count("*").alias("n"), F.min("day").alias("first"), F.median("gap").alias("gap"))
    filed = filers.select("entity").distinct().withColumn("filed", F.lit(True))
    rows = companies.join(seen, "entity", "left").join(filed, "entity", "left")
    known, gap = F.coalesce("n", F.lit(0)), F.col("gap")
    said = F.concat(F.lit("median_interval_days="), F.format_string("%.1f", "gap"))
    rule = lambda cadence, trust, why, year: F.struct(F.lit(cadence).alias("cadence"), F.lit(trust).alias("confidence"), why.alias("evidence"), year.alias("year"))
    now = F.year(as_of)
    choice = (
        F.when(F.col("event_driven") | ((F.lower(F.coalesce("mode", F.lit(""))) == "index") & (known == 0)), rule("announcement", 0.9, F.lit("index_mode_event_driven_profile"), now))
        .when((known >= 4) & (gap <= 45), rule("monthly", 0.85, said, F.year("first")))
        .when((known >= 4) & (gap >= 70), rule("quarterly", 0.85, said, F.year("first")))
        .when(F.coalesce("filed", F.lit(False)), rule("quarterly", 0.7, F.lit("edgar_quarterly_forms_present"), now))
        .otherwise(rule("monthly", 0.6, F.lit("fallback_default_monthly"), now))
    )
    chosen = rows.select("entity", "start_year", choice.alias("c"))
    start = F.make_date(F.coalesce("start_year", F.col("c.year")), F.lit(1), F.lit(1))
    return chosen.select("entity", "c.cadence", start.alias("start"), "c.confidence", "c.evidence")


def health(flagged: DataFrame, series: DataFrame, key: str) -> DataFrame:
    """One row per key: points, outliers, missing months and gap ratio."""
    points = flagged.groupBy(key).agg(F.count("*").alias("points"), F.count_if("is_outlier").alias("outliers"))
    gaps = missing_periods(series, [key, "metric"]).groupBy(key).agg(F.count("*").alias("gaps"))
    out = points.join(gaps, key, "left").withColumn("gaps", F.coalesce("gaps", F.lit(0)))
    return out.withColumn("gap_ratio", F.round(F.col("gaps") / (F.col("gaps") + F.col("points")), 4))


def evidence(kinds: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Keys with the set ``sources`` of the kinds of evidence that name them.

    Each kind is made distinct before the union, so it moves no repeats.
    """
    found = [df.select(*keys).distinct().withColumn("kind", F.lit(name)) for name, df in kinds.items()]
    union = found[0]
    for f in found[1:]:
        union = union.union(f)
    return union.groupBy(*keys).agg(F.array_sort(F.collect_set("kind")).alias("sources"))
