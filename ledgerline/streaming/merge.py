"""Streaming merge and deduplication with keyed state and shared checkpoints."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_own: list[str] = []


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``; where that is unset and
    Spark runs in one process (tests), below a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="spark-stream-"))
        base = _own[0]
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again, so that it is computed once."""
    df.write.parquet(out := shared_folder(df.sparkSession, label))
    return df.sparkSession.read.schema(df.schema).parquet(out)


#: State on disk, in snapshots and change logs of the checkpoint folder; stores are
#: closed after each commit, so that an executor holds no more than it has tasks.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def _session(spark: SparkSession) -> SparkSession:
    """A session of its own for one stream, with the caller's settings and ``STATE``."""
    own = spark.newSession()
    for name, value in (dict(spark.conf.getAll) | STATE).items():
        if own.conf.isModifiable(name):
            own.conf.set(name, value)
    return own


def landed_stream(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """A file stream with the schema of what is there; its state is on disk."""
    schema = spark.read.parquet(path).schema
    return _session(spark).readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def _run(stream: DataFrame, mode: str, label: str, out: str | None = None, write: Callable[[DataFrame, int], None] | None = None, schema: T.StructType | None = None) -> DataFrame:
    """Run to the end of what has landed; rows of all batches with ``_batch``.

    ``out`` is the folder of an earlier run with the same stream, which is then
    taken up where it stopped. ``write`` puts a batch below ``out`` in its own
    way, as rows of ``schema``.
    """
    spark = stream.sparkSession
    out = out or shared_folder(spark, label)
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", out + "-state")
        .foreachBatch(write or (lambda df, n: df.write.mode("overwrite").parquet(f"{out}/_batch={n}")))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(schema or T.StructType([*stream.schema.fields, T.StructField("_batch", T.IntegerType())])).parquet(out)


def merged(stream: DataFrame, keys: list[str], order: Column, out: str | None = None) -> DataFrame:
    """The row with the greatest ``order`` of each key. Late rows take part by
    their order, not by when they come, so there is no watermark."""
    last = changes(stream, keys, order, out).groupBy(*keys).agg(F.max_by("_row", "_batch").alias("_row"))
    return last.select(*keys, "_row.*")


def changes(stream: DataFrame, keys: list[str], order: Column, out: str | None = None) -> DataFrame:
    """The change log of ``merged``: keys, their best row so far and the batch
    (``_batch``) after which it was that; only keys that a batch touched."""
    rest = [c for c in stream.columns if c not in keys]
    state = stream.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return _run(state, "update", "merge", out)


def authority(rank: Column, sequence: Column) -> Column:
    """Order of a guarded upsert: the lesser ``rank`` has more authority; of equal
    ones the later ``sequence`` wins. A null rank has none."""
    return F.struct(rank.isNotNull().alias("known"), (-rank).alias("rank"), sequence.alias("sequence"))


def guarded(stream: DataFrame, keys: list[str], rank: str, sequence: str, out: str | None = None) -> DataFrame:
    """Upserts of a stream in which a row of lesser authority never replaces
    another, however late or early either comes."""
    return merged(stream, keys, authority(F.col(rank), F.col(sequence)), out)


def deduplicated(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of a stream, each claimed once."""
    return _run(stream.select(*keys).dropDuplicates(keys), "append", "claims").select(*keys)


def tumbling(stream: DataFrame, ts: str, width: str, late: str, keys: list[str], value: str) -> DataFrame:
    """Counts and sums of event-time windows, closed by a watermark."""
    grouped = stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *keys)
    return grouped.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")
