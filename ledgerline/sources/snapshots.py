"""Snapshots in two phases: staged files first, then one small file that makes
them all visible together."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    """The store that holds ``path``, as Spark's own file systems see it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def staged(tables: dict[str, DataFrame], root: str) -> str:
    """Phase one: write each table and its checksum under a new version of
    ``root``; gives the version's name. Nothing of it is visible yet."""
    version = uuid.uuid4().hex
    spark = next(iter(tables.values())).sparkSession
    sums = []
    for name, rows in tables.items():
        rows.write.parquet(f"{root}/versions/{version}/{name}")
        kept = spark.read.schema(rows.schema).parquet(f"{root}/versions/{version}/{name}")
        sums.append(checksum(kept).select(F.lit(name).alias("name"), "rows", "checksum"))
    manifest = sums[0]
    for more in sums[1:]:
        manifest = manifest.unionAll(more)
    manifest.coalesce(1).write.parquet(f"{root}/versions/{version}/_manifest")
    return version


def checksum(rows: DataFrame) -> DataFrame:
    """(rows, checksum) that don't depend on the order of the rows; columns of
    any type count as JSON does."""
    each = F.xxhash64(F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns)), {"ignoreNullFields": "false"}))
    return rows.select(each.alias("h")).agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.pmod("h", F.lit(1 << 40))), F.lit(0)).alias("checksum"))


def publish(spark: SparkSession, root: str, version: str) -> None:
    """Phase two: check what is staged against its manifest, then name the version
    as the current one. The name is one new file with the next number; of two
    that publish at once, one fails and may try again."""
    there = {r["name"]: (r["rows"], r["checksum"]) for r in spark.read.parquet(f"{root}/versions/{version}/_manifest").collect()}
    for name, told in there.items():
        if tuple(checksum(spark.read.parquet(f"{root}/versions/{version}/{name}")).first()) != told:
            raise ValueError(f"{name} of version {version} is not what was staged")
    fs, path = _fs(spark, root)
    n = max(_published(spark, root), default=(0, ""))[0] + 1
    out = fs.create(path(f"{root}/published/{n:010d}-{version}"), False)
    out.close()
    if [v for k, v in _published(spark, root) if k == n] != [version]:
        fs.delete(path(f"{root}/published/{n:010d}-{version}"), False)
        raise ValueError(f"another version was published as number {n}")


def _published(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    fs, path = _fs(spark, root)
    folder = path(f"{root}/published")
    if not fs.exists(folder):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(folder)]
    return sorted((int(x.split("-")[0]), x.split("-")[1]) for x in names)


def current(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table of the version that was published last."""
    return spark.read.parquet(f"{root}/versions/{_published(spark, root)[-1][1]}/{name}")


def archive_and_purge(rows: DataFrame, scope: DataFrame, keys: list[str], root: str, name: str = "rows") -> None:
    """Move the rows in ``scope`` from the table to its archive: both change in
    one publication, so a failure leaves the old table and the old archive."""
    spark = rows.sparkSession
    told = scope.select(*keys).distinct()
    gone = rows.join(told, keys, "left_semi").select(F.to_json(F.struct(*rows.columns)).alias("row_data"), F.lit(name).alias("table_name"))
    if _published(spark, root):
        gone = current(spark, root, "archive").unionByName(gone)
    publish(spark, root, staged({name: rows.join(told, keys, "left_anti").select(*rows.columns), "archive": gone}, root))
