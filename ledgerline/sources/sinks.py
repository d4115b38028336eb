"""Sinks: exports and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import pivoted


def wide_csv(values: DataFrame, names: list[str], path: str) -> None:
    """Monthly values, a row per YYYY-MM and a column per entity, sorted; missing
    cells are empty."""
    rows = values.withColumn("ym", F.date_format("period", "yyyy-MM"))
    pivoted(rows, "ym", "entity", "value", sorted(names)).orderBy("ym").write.csv(path, header=True, mode="overwrite")


def snapshot(df: DataFrame, path: str, by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def archive_rows(rows: DataFrame, batch: str, table: str, path: str) -> None:
    """Append rows as JSON before they are deleted."""
    rows.select(F.lit(batch).alias("batch_id"), F.lit(table).alias("table_name"), F.to_json(F.struct(*rows.columns)).alias("row_data")).write.mode("append").parquet(path)
