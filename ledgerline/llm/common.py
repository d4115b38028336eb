"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_own_folder: list[str] = []


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder name below the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` names that folder; where it is unset and Spark
    runs in one process (tests) a temporary folder is made once per driver.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        if not _own_folder:
            _own_folder.append("file://" + tempfile.mkdtemp(prefix="spark-llm-"))
        base = _own_folder[0]
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage in a way that survives a lost executor and lets
    several later jobs read the rows without computing them again.
    """
    spark = df.sparkSession
    path = shared_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, label: str, **aggregates: Column) -> tuple[DataFrame, dict]:
    """``stash`` and these aggregates over all rows, taken while writing."""
    seen = Observation()
    out = stash(df.observe(seen, *(v.alias(k) for k, v in aggregates.items())), label)
    return out, seen.get


#: Rows of one key that a task has anyway; keys of more may be dealt to several.
FEW = 256


def hot_keys(counts: DataFrame, key: str, total: int | None) -> DataFrame | None:
    """(key, parts) of the keys with over a 100,000th of all ``total`` rows and
    over FEW, from (key, n); None if there are none. So they are at most
    100,000, whatever the size of the data."""
    limit = max(FEW, (total or 0) // 100_000)
    hot = counts.where(F.col("n") > limit).select(key, F.ceil(F.col("n") / limit).cast("int").alias("parts"))
    rows = hot.collect()
    return df_of(counts.sparkSession, rows, hot) if rows else None


def df_of(spark: SparkSession, rows: list, like: DataFrame) -> DataFrame:
    return spark.createDataFrame(rows, like.schema)


def dealt(df: DataFrame, key: str, hot: DataFrame | None, by: str) -> DataFrame:
    """With ``part``: the rows of a hot key are dealt to its parts by a hash of ``by``."""
    if hot is None:
        return df.withColumn("part", F.lit(0))
    at = F.pmod(F.xxhash64(by), F.col("parts").cast("long")).cast("int")
    return df.join(F.broadcast(hot), key, "left").withColumn("part", F.coalesce(at, F.lit(0))).drop("parts")


def for_all_parts(df: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """With ``part``: one row for each part that ``dealt`` may give the key."""
    if hot is None:
        return df.withColumn("part", F.lit(0))
    parts = F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)
    return df.join(F.broadcast(hot), key, "left").withColumn("part", F.explode(parts)).drop("parts")


#: Bits of a sieve, and of one row of it: 512 rows of 4 kB at most.
_BITS, _ROW = 1 << 24, 1 << 15


def sieve(keys: DataFrame, key: str) -> DataFrame:
    """A bitmap of the hashes of ``key``, whose values are distinct, for
    ``sifted``. Its size is bounded whatever the number of keys; the more there
    are, the more others pass."""
    at = F.pmod(F.xxhash64(key), F.lit(_BITS))
    places = keys.select(F.shiftright(at, 15).alias("_sieve_row"), (at % _ROW).alias("_sieve_at")).repartition("_sieve_row")
    return places.groupBy("_sieve_row").agg(F.bitmap_construct_agg("_sieve_at").alias("_sieve_bits"))


def sifted(df: DataFrame, key: str, bits: DataFrame, within: bool = True) -> DataFrame:
    """The rows of ``df`` whose ``key`` may be among the sieve's, or (not
    ``within``) those whose key is surely not: so rows that no key of a join
    concerns need no shuffle for it."""
    at = F.pmod(F.xxhash64(key), F.lit(_BITS))
    byte = F.conv(F.hex(F.substring("_sieve_bits", (at % _ROW / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    found = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    joined = df.join(F.broadcast(bits), F.shiftright(at, 15) == F.col("_sieve_row"), "left")
    return joined.where(found if within else ~found).drop("_sieve_row", "_sieve_bits")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_row(df: DataFrame) -> Column:
    """All columns of a row as one struct, whatever their names are."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns))


def ranked(df: DataFrame, keys: list, group: str | None, rank: str) -> DataFrame:
    """Number the rows of each ``group`` value from 0 in the order of ``keys``.

    The rows are range-partitioned by (group, keys), so one group may span
    many tasks; only one count per (partition, group) pair is gathered, which
    is at most the number of partitions plus the number of groups. Ties in
    ``keys`` get an arbitrary but fixed order. ``group`` None numbers all rows.
    """
    order = ([F.col(group)] if group else []) + keys
    laid = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    laid = stash(laid, "ranked")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    laid = laid.withColumn("_part", part).withColumn("_place", place)
    by = [group] if group else []
    runs = laid.groupBy("_part", *by).agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    seen: dict = {}
    offsets = []
    for r in sorted(runs.collect(), key=lambda r: r["_part"]):
        g = r[group] if group else None
        offsets.append((r["_part"], *([g] if group else []), seen.get(g, 0) - r["_first"]))
        seen[g] = seen.get(g, 0) + r["_n"]
    fields = "_part long" + (f", {group} {dict(df.dtypes)[group]}" if group else "") + ", _shift long"
    shift = df.sparkSession.createDataFrame(offsets, fields)
    return (
        laid.join(F.broadcast(shift), ["_part", *by])
        .withColumn(rank, F.col("_place") + F.col("_shift"))
        .drop("_at", "_part", "_place", "_shift")
    )
