"""Sharding by longest-processing-time scheduling of whole groups.

Groups of equal texts stay together. They go, largest first, to the
least-loaded shard by a heap. To keep that sequential rule off the data, groups
are put into size classes 1 % apart (some 2,000 classes cover every size up to
a petabyte); the heap runs over classes and hands out runs of groups: while one
shard lags it is filled alone, and where shards are level they take turns. Spark
numbers the groups of each class, largest first, and looks up their runs.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt, for_all_parts, hot_keys, ranked, stash

_STEP = math.log(1.01)


def deal(classes: list[tuple[int, int, float]], shards: int) -> list[tuple[int, int, list[int]]]:
    """Runs (class, first rank, shards in turn) of (class, groups, mean size).

    Classes come largest first. In a run, groups go to its shards in turn. Each
    run levels the least-loaded shards with the next one or ends its class.
    """
    heap = [(0.0, s) for s in range(shards)]
    runs = []
    for size_class, n, mean in classes:
        rank = 0
        while rank < n:
            load, shard = heapq.heappop(heap)
            level = [(load, shard)]
            while heap and heap[0][0] < load + mean:
                level.append(heapq.heappop(heap))
            target = heap[0][0] if heap else math.inf
            turns = n - rank if target == math.inf else max(1, int((target - load) // mean)) * len(level)
            take = min(turns, n - rank)
            runs.append((size_class, rank, [s for _, s in level]))
            for k, (had, s) in enumerate(level):
                own = take // len(level) + (k < take % len(level))
                heapq.heappush(heap, (had + own * mean, s))
            rank += take
    return runs


class _Runs:
    """The runs as arrays, to look up the shards of many groups at once."""

    def __init__(self, runs: list[tuple[int, int, list[int]]]):
        self.base = min((c for c, _, _ in runs), default=0)
        runs = sorted(runs, key=lambda r: r[:2])
        self.first = np.array([r for _, r, _ in runs], dtype=np.int64)
        self.key = np.array([c - self.base for c, _, _ in runs], dtype=np.int64) << 42 | self.first
        self.turns = np.array([len(t) for _, _, t in runs], dtype=np.int64)
        self.start = np.cumsum(self.turns) - self.turns
        self.shard = np.array([s for _, _, t in runs for s in t], dtype=np.int32)

    def shards(self, size_class: np.ndarray, rank: np.ndarray) -> np.ndarray:
        rank = rank.astype(np.int64)
        at = np.searchsorted(self.key, size_class.astype(np.int64) - self.base << 42 | rank, side="right") - 1
        return self.shard[self.start[at] + (rank - self.first[at]) % self.turns[at]]


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Place every row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the text's UTF-8 bytes plus 1. A null text counts as an empty
    one and is in its group. Ties of size are ordered by digest. Slots count
    from 0 in each shard in the order of doc_id. An empty table gives no rows.
    Null and repeated ids are rows like others. The heap takes the groups of a
    size class by their mean, so a shard's bytes are at most 1 % of its largest
    groups' sizes off what the groups one by one would give. A group with very
    many rows finds its shard in several tasks; a long text is one row.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = stash(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("group"),
        ),
        "sized",
    )
    groups = rows.groupBy("group").agg(F.sum("size").alias("group_bytes"), F.count("*").alias("copies"))
    groups = groups.withColumn("size_class", -F.floor(F.log("group_bytes") / _STEP).cast("int"))
    groups = ranked(groups, [F.desc("group_bytes"), F.col("group")], "size_class", "rank")
    totals = groups.groupBy("size_class").agg(F.count("*").alias("n"), F.avg("group_bytes").alias("mean"), F.sum("copies").alias("rows")).collect()
    runs = deal(sorted((r["size_class"], r["n"], r["mean"]) for r in totals), shards)
    shared = spark.sparkContext.broadcast(_Runs(runs))

    @F.pandas_udf("int")
    def shard_of(size_class: pd.Series, rank: pd.Series) -> pd.Series:
        return pd.Series(shared.value.shards(size_class.to_numpy(), rank.to_numpy()), index=rank.index)

    placed = groups.select("group", shard_of("size_class", "rank").alias("shard"))
    copied = hot_keys(groups.select("group", F.col("copies").alias("n")), "group", sum(r["rows"] for r in totals))
    found = dealt(rows, "group", copied, "doc_id").join(for_all_parts(placed, "group", copied), ["group", "part"])
    slotted = ranked(found.drop("group", "part"), [F.col("doc_id")], "shard", "slot")
    return slotted.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
