"""Filters, paging, ordering and row checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.periods import period_sort_key


def where_all(df: DataFrame, equal: dict | None = None, among: dict | None = None, least: dict | None = None, most: dict | None = None) -> DataFrame:
    """AND of only the predicates that are given (a None value is not given)."""
    for name, value in (equal or {}).items():
        df = df if value is None else df.where(F.col(name) == value)
    for name, values in (among or {}).items():
        df = df if values is None else df.where(F.col(name).isin(list(values)))
    for name, value in (least or {}).items():
        df = df if value is None else df.where(F.col(name) >= value)
    for name, value in (most or {}).items():
        df = df if value is None else df.where(F.col(name) <= value)
    return df


def within_months(df: DataFrame, day: str, first: str | None, last: str | None) -> DataFrame:
    """Rows from month ``first`` to the end of month ``last`` (YYYY-MM)."""
    if first:
        df = df.where(F.col(day) >= F.to_date(F.lit(first + "-01")))
    if last:
        df = df.where(F.col(day) < F.add_months(F.to_date(F.lit(last + "-01")), 1))
    return df


def page(df: DataFrame, order: list[Column], size: int, number: int = 0) -> DataFrame:
    """Page ``number`` of rows in a total order."""
    return df.orderBy(*order).offset(size * number).limit(size)


def has_text(text: Column) -> Column:
    return text.isNotNull() & (text != "")


def equals_or_default(value: Column, default) -> Column:
    """Null counts as the default."""
    return F.coalesce(value, F.lit(default)) == default


def checked(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Add ``error_code``: the first rule that a row breaks, null if none.

    A rule is (code, predicate that holds for bad rows); null is no breach.
    """
    return df.withColumn("error_code", F.coalesce(*(F.when(bad, F.lit(code)) for code, bad in rules)))


def ladder(steps: list[tuple[str, Column]], otherwise: str) -> Column:
    """The first label whose condition holds."""
    return reduce(lambda w, s: w.when(s[1], s[0]), steps[1:], F.when(steps[0][1], steps[0][0])).otherwise(otherwise)


def ordered_by_case(df: DataFrame, column: str, ranks: dict[str, int], default: int, then: list[Column]) -> DataFrame:
    """Sort by a rank of the values of ``column``, then by ``then``."""
    return df.orderBy(case_rank(F.col(column), ranks, default), *then)


def case_rank(column: Column, ranks: dict[str, int], default: int) -> Column:
    return F.coalesce(reduce(lambda w, kv: w.when(column == kv[0], kv[1]), list(ranks.items())[1:], F.when(column == next(iter(ranks)), next(iter(ranks.values())))), F.lit(default))


def ordered_by_period(df: DataFrame, period: str) -> DataFrame:
    """Sort mixed grains by the time they end."""
    return df.orderBy(period_sort_key(F.col(period)), period)


def newest(df: DataFrame, order: str, n: int, tie: list[str]) -> DataFrame:
    return df.orderBy(F.desc(order), *tie).limit(n)


def queue_head(df: DataFrame, status: str, created: str, tie: str) -> DataFrame:
    """The oldest pending job."""
    return df.where(F.col(status) == "pending").orderBy(created, tie).limit(1)


def sampled(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """``n`` rows in the order of a seeded hash of a key: the same on any cluster."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def dealt(df: DataFrame, order: str, parts: int, group: str) -> DataFrame:
    """Round-robin part number of each row within its group, which may span many tasks."""
    from .windows import numbered

    placed = numbered(df, group, [order], "_place")
    return placed.withColumn("part", F.pmod("_place", F.lit(parts))).drop("_place")


def newest_of(sources: list[DataFrame], order: str, n: int, tie: list[str]) -> DataFrame:
    """Distinct rows of the ``n`` newest of each source, without ``order``."""
    parts = [newest(df, order, n, tie).drop(order) for df in sources]
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()
