"""Series operators: deltas, trailing frames, latest values, interpolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..streaming.merge import written


def month_delta(series: DataFrame, keys: list[str], period: str = "period", value: str = "value") -> DataFrame:
    """``delta`` to the previous row if it is exactly one month before, and
    ``skipped`` as gap_N_months where it is further away."""
    w = Window.partitionBy(*keys).orderBy(period)
    gap = F.months_between(period, F.lag(period).over(w)).cast("int")
    return series.withColumns(
        {
            "delta": F.when(gap == 1, F.col(value) - F.lag(value).over(w)),
            "skipped": F.when(gap > 1, F.concat(F.lit("gap_"), gap.cast("string"), F.lit("_months"))),
        }
    )


def trailing(keys: list[str], n: int, period: str = "period"):
    """The window of the ``n`` rows strictly before a row."""
    return Window.partitionBy(*keys).orderBy(period).rowsBetween(-n, -1)


def outliers(series: DataFrame, keys: list[str], threshold: Column | float, min_history: int = 3, n: int = 3) -> DataFrame:
    """``trailing_avg`` of up to ``n`` rows before and ``is_outlier``: off by
    strictly more than ``threshold`` of it. Too short a history: null, false."""
    w = trailing(keys, n)
    avg = F.when(F.count("value").over(w) >= min_history, F.avg("value").over(w))
    off = F.abs(F.col("value") - avg) / F.greatest(F.abs(avg), F.lit(1e-9))
    return series.withColumns({"trailing_avg": avg, "is_outlier": F.coalesce(off > threshold, F.lit(False))})


def latest(series: DataFrame, keys: list[str], period: str = "period") -> DataFrame:
    """The last row of each key, by a mergeable aggregate instead of a sort."""
    rest = [c for c in series.columns if c not in keys]
    return series.groupBy(*keys).agg(F.max_by(F.struct(*rest), period).alias("_last")).select(*keys, "_last.*")


def latest_mean(series: DataFrame, keys: list[str], n: int = 6) -> DataFrame:
    """Mean of the last up to ``n`` rows, their span and number."""
    w = Window.partitionBy(*keys).orderBy(F.desc("period"))
    last = series.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n)
    return last.groupBy(*keys).agg(
        F.avg("value").alias("mean"), F.min("period").alias("period_start"), F.max("period").alias("period_end"), F.count("*").alias("sample_size")
    )


def best(rows: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key in a total order."""
    name = rank or "_rank"
    out = rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with their place from 0 within ``group``, in a total order.

    Rows are range-partitioned by group and order and sorted within partitions,
    so that one group spans many tasks; the count of each (partition, group)
    gives the offset at which the partition goes on.
    """
    by = [group, *order]
    laid = written(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    laid = laid.withColumns({"_part": F.shiftright("_at", 33), "_place": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    runs = laid.groupBy("_part", group).agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    shift = runs.select(F.col("_part").alias("_p"), F.col(group).alias("_g"), (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    joined = laid.join(shift, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    return joined.select(*rows.columns, (F.col("_place") + F.col("_shift")).alias(name))


def recent_periods(rows: DataFrame, n: int, period: str = "period") -> DataFrame:
    """Rows of the last ``n`` distinct periods.

    The periods are found as a top-n of distinct values, not by ranking rows.
    """
    keep = rows.select(period).distinct().orderBy(F.desc(period)).limit(n)
    return rows.join(keep, period, "left_semi")


def layered(layers: list[DataFrame], keys: list[str]) -> DataFrame:
    """The row of the first layer that has its key, with ``layer`` from 0."""
    tagged = [d.withColumn("layer", F.lit(k)) for k, d in enumerate(layers)]
    union = tagged[0]
    for d in tagged[1:]:
        union = union.unionByName(d, allowMissingColumns=True)
    rest = [c for c in union.columns if c not in keys]
    return union.groupBy(*keys).agg(F.min_by(F.struct(*rest), "layer").alias("_first")).select(*keys, "_first.*")


def interpolated(spine: DataFrame, keys: list[str], month: str = "month", value: str = "value") -> DataFrame:
    """``suggested`` for each row without a value: on the line between the
    nearest values before and after, or the only one of them, to 6 places."""
    w = Window.partitionBy(*keys).orderBy(month)
    # both frames grow by one row at a time; one that shrinks would be read anew for each row
    before, after = (x.rowsBetween(Window.unboundedPreceding, -1) for x in (w, Window.partitionBy(*keys).orderBy(F.desc(month))))
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(month).alias("m"), F.col(value).alias("v")))
    a, b = F.last(known, True).over(before), F.last(known, True).over(after)
    share = F.months_between(month, a["m"]) / F.months_between(b["m"], a["m"])
    line = F.when(a.isNotNull() & b.isNotNull(), a["v"] + (b["v"] - a["v"]) * share).otherwise(F.coalesce(a["v"], b["v"]))
    return spine.withColumn("suggested", F.when(F.col(value).isNull(), F.round(line, 6)))


def previous(rows: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    return rows.withColumn(name, F.lag(value).over(Window.partitionBy(*keys).orderBy(order)))


def repeated_runs(series: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """Runs of at least ``least`` equal consecutive months."""
    w = Window.partitionBy(*keys).orderBy("period")
    new = (F.lag("value").over(w) != F.col("value")) | (F.months_between("period", F.lag("period").over(w)) != 1)
    runs = series.withColumn("_new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(w))
    return (
        runs.groupBy(*keys, "_run", "value").agg(F.count("*").alias("months"), F.min("period").alias("first"), F.max("period").alias("last"))
        .where(F.col("months") >= least)
        .drop("_run")
    )
