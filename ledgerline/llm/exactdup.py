"""Exact deduplication by a stateful stream of digests.

Every text's SHA-256 is landed with its identifier and a content locator, and
a Structured Streaming query folds the landed files into keyed state that never
expires: for each digest the smallest identifier, its locator and the number of
rows. The state store is on disk (RocksDB, snapshots in the shared folder), and
rows are combined before the shuffle, so a digest that a third of all rows have
costs one row a task. A hit (a digest seen more than once) is then checked on
full bytes: only texts of digests with a hit are compared, once each, and the
rows of a digest that very many rows have are dealt to several tasks. Texts that
a bitmap of the digests with a hit rules out are not moved for it. The locator
names the file that a text came from, for those who look it up there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dealt, for_all_parts, hot_keys, measured, shared_folder, sieve, sifted, stash, whole_row

#: State on disk; without space set aside for each of many small partitions, and
#: closed after each commit, so that an executor holds no more open stores than
#: it has tasks, however many partitions and runs a session has.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def normalised(text: Column | str) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def fold_digests(landed: DataFrame, folder: str, files_per_batch: int = 64) -> DataFrame:
    """Fold the landed files in ``folder`` into (digest, keep, group_size).

    ``landed`` gives the schema: digest, doc_id, locator. The state keeps its
    place in a checkpoint, so files that land later are folded in by another
    call with the same folder.
    """
    spark = landed.sparkSession
    stream = spark.readStream.schema(landed.schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    kept = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "locator")
    state = stream.groupBy("digest").agg(F.min(kept).alias("keep"), F.count("*").alias("group_size"))
    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", f"{folder}-state")
            .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}-updates/batch={n}"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    fields = f"digest string, keep struct<unnamed: boolean, doc_id: {dict(landed.dtypes)['doc_id']}, locator: string>, group_size long, batch int"
    return (
        spark.read.schema(fields).parquet(f"{folder}-updates")
        .groupBy("digest")
        .agg(F.max_by("keep", "batch").alias("keep"), F.max("group_size").alias("group_size"))
    )


def exact_duplicates(docs: DataFrame, digest=lambda text: F.sha2(text, 256)) -> DataFrame:
    """The group of every row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are after ``normalised``; null counts as empty.
    The row with the smallest doc_id stays; a null doc_id comes after all
    others. Of rows that repeat a doc_id and a text all count as kept. Other
    columns are ignored. ``digest`` is a parameter for tests of collisions.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", normalised("text").alias("text"), F.input_file_name().alias("locator")).withColumn(
        "digest", digest(F.col("text"))
    )
    folder = shared_folder(spark, "digests")
    rows.select("digest", "doc_id", "locator").write.parquet(folder)
    landed = spark.read.parquet(folder)
    if landed.isEmpty():
        return rows.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.sha2("text", 256).alias("text_sha256"))
    state, seen = measured(fold_digests(landed, folder), "groups", n=F.sum("group_size"))
    state = state.select("digest", F.col("keep.doc_id").alias("keep_id"), "group_size")
    copied = hot_keys(state.select("digest", F.col("group_size").alias("n")), "digest", seen["n"])
    if not _unlike(rows, state, copied).isEmpty():
        return _regrouped(rows, state)
    out = dealt(landed.select("doc_id", "digest"), "digest", copied, "doc_id").join(for_all_parts(state, "digest", copied), ["digest", "part"])
    return out.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256")
    )


def _unlike(rows: DataFrame, state: DataFrame, copied: DataFrame | None) -> DataFrame:
    """Hit digests whose rows differ in bytes."""
    hit = state.where("group_size > 1").select("digest")
    texts = sifted(rows.select("digest", "doc_id", "text"), "digest", sieve(hit, "digest"))
    texts = dealt(texts, "digest", copied, "doc_id").join(for_all_parts(hit, "digest", copied), ["digest", "part"], "left_semi")
    parts = texts.groupBy("digest", "part").agg(F.min("text").alias("lo"), F.max("text").alias("hi"))
    return stash(parts.groupBy("digest").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo != hi").select("digest"), "unlike")


def _regrouped(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Groups by full text, for corpora in which digests collide."""
    named = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id")
    groups = rows.groupBy("digest", "text").agg(F.min(named).alias("keep"), F.count("*").alias("group_size"))
    return rows.join(groups, ["digest", "text"]).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep.doc_id")).alias("kept"),
        F.sha2("text", 256).alias("text_sha256"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, unchanged; rows that repeat a kept
    doc_id and its text all stay."""
    gone = stash(exact_duplicates(docs).where("not kept").select("doc_id", "text_sha256"), "gone")
    bits = stash(sieve(gone.select("doc_id").distinct(), "doc_id"), "sieve")
    rows = sifted(docs, "doc_id", bits).select(F.col("doc_id").alias("id"), F.sha2(normalised("text"), 256).alias("digest"), whole_row(docs).alias("row"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("digest") == F.col("text_sha256"))
    return sifted(docs, "doc_id", bits, within=False).union(rows.join(gone, same, "left_anti").select("row.*"))
