"""Results of parallel workers, released in the order of their sequence numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .merge import _run, shared_folder


def in_order(stream: DataFrame, key: str, sequence: str, first: int = 1, out: str | None = None) -> DataFrame:
    """Rows of a stream with ``_batch``, the batch in which each was released.

    Rows of one key are released when all with lesser ``sequence`` numbers (from
    ``first`` on, gapless in the end) have been, in a later batch or the same.
    A number that was released or is held already is not taken again, so a batch
    that is sent twice changes nothing. What still waits at the end is not in the
    result; it stays in the state for the next run with the same ``out``. Rows
    without a number are left out.

    The state is two tables in the shared folder, written anew by each batch: the
    rows held back (beside those released) and the number that is due next of each
    key. A batch reads the state of the one before it alone, so one that failed is
    done again. Its rows and the state meet in one shuffle by key.
    """
    out = out or shared_folder(stream.sparkSession, "ordered")
    rest = [c for c in stream.columns if c != key]
    schema = T.StructType([*(stream.schema[c] for c in rest), stream.schema[key]])
    marked = T.StructType([*schema.fields, T.StructField("_ready", T.IntegerType())])
    dues = T.StructType([stream.schema[key], T.StructField("_due", T.LongType())])

    def release(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        row = F.struct(*(F.col(f"`{c}`") for c in rest)).alias("_row")
        known = [F.col(f"`{key}`").alias("_key"), F.col(f"`{sequence}`").cast("long").alias("_n"), row]
        rows = df.select(*known, F.lit(None).cast("long").alias("_due"), F.lit(1).alias("_new")).where("_n is not null")
        due = None
        if n:
            held = spark.read.schema(marked).parquet(f"{out}/_batch={n - 1}").where("_ready = 0")
            due = spark.read.schema(dues).parquet(f"{out}-due/{n - 1}")
            none = F.lit(None)
            waits = F.struct(F.col(f"`{key}`").alias("_key"), none.cast("long").alias("_n"), none.cast(rows.schema["_row"].dataType).alias("_row"), F.col("_due"), F.lit(0).alias("_new"))
            rows = rows.union(held.select(*known, none.cast("long"), F.lit(0))).union(due.select(waits.alias("w")).select("w.*"))
        # Of several rows of one number the one that is held counts. The number that is due stands in a row without one, the first of its key.
        one = rows.repartition("_key").groupBy("_key", "_n").agg(F.min_by("_row", "_new").alias("_row"), F.max("_due").alias("_due"))
        until = Window.partitionBy("_key").orderBy(F.col("_n").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        told = one.withColumn("_due", F.coalesce(F.max("_due").over(until), F.lit(first))).withColumn("_place", F.count_if(F.col("_n") >= F.col("_due")).over(until))
        told = told.where(F.col("_n") >= F.col("_due")).withColumn("_ready", (F.col("_due") + F.col("_place") - 1 == F.col("_n")).cast("int"))
        told.select(*(F.col(f"_row.`{c}`").alias(c) for c in rest), F.col("_key").alias(key), "_ready").write.mode("overwrite").partitionBy("_ready").parquet(f"{out}/_batch={n}")
        next_due = spark.read.schema(marked).parquet(f"{out}/_batch={n}").where("_ready = 1").select(F.col(f"`{key}`").alias("_key"), (F.col(f"`{sequence}`").cast("long") + 1).alias("_due"))
        if due is not None:
            next_due = next_due.union(due)
        next_due.groupBy("_key").agg(F.max("_due").alias("_due")).select(F.col("_key").alias(key), "_due").write.mode("overwrite").parquet(f"{out}-due/{n}")

    every = _run(stream, "append", "ordered", out, release, T.StructType([*schema.fields, T.StructField("_batch", T.IntegerType()), T.StructField("_ready", T.IntegerType())]))
    return every.where("_ready = 1").drop("_ready")
