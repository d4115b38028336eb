"""Near-duplicate texts by 64-bit simhashes and a block-permuted index."""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words whose bits are summed at a time; bounds what a task holds.
_TOGETHER = 1 << 18
#: Rows of one key that a task compares anyway; keys of more are dealt.
_FEW = 256


def _bits(words: pa.Array) -> np.ndarray:
    """+1 or -1 for each of the first 64 bits of the MD5 of each word."""
    raw = b"".join(hashlib.md5(w).digest()[:8] for w in words.cast(pa.binary()).to_pylist())
    return np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int8) * 2 - 1


def simhashes(texts: pa.Array) -> np.ndarray:
    """Simhash of each text of words parted by white space; 0 without words."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words, at = lists.flatten(), pc.list_parent_indices(lists)
    full = pc.not_equal(words, "")
    words, at = words.filter(full).dictionary_encode(), np.asarray(at.filter(full))
    out = np.zeros(len(texts), np.uint64)
    if not len(at):
        return out.view(np.int64)
    ids, bits = words.indices.to_numpy(zero_copy_only=False), _bits(words.dictionary)
    sums = np.zeros((len(texts), 64), np.int64)
    for k in range(0, len(ids), _TOGETHER):
        part, of = bits[ids[k : k + _TOGETHER]], at[k : k + _TOGETHER]
        heads = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        sums[of[heads]] += np.add.reduceat(part, heads, axis=0, dtype=np.int64)
    packed = np.packbits(sums > 0, axis=1, bitorder="little")
    return np.ascontiguousarray(packed).view("<u8").ravel().view(np.int64)


def simhash(docs: DataFrame, key: str | list[str], text: str) -> DataFrame:
    """The key columns and ``simhash``: 64 signed bit sums over the MD5 of a text's words.

    Words are runs of ASCII letters and digits in lower case, parted by white
    space; other characters vanish. Bit i is set if more words (each as often
    as it comes) have it than not. A text without words, or null, has 0. One
    pass over each text; no words are shuffled.
    """
    keys = [key] if isinstance(key, str) else key
    plain = F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^a-z0-9\s]", "")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(simhashes(batch.column(len(keys))))], [*keys, "simhash"])

    fields = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keys).dtypes)
    return docs.select(*keys, plain.alias("_plain")).mapInArrow(work, f"{fields}, simhash long")


def masks(rows: int, threshold: int) -> list[int]:
    """Bits of each key of an index over so many hashes.

    The 64 bits are cut into m blocks. Hashes that differ in at most
    ``threshold`` bits agree on m - threshold blocks at least, so there is a key
    for each choice of that many blocks. m is the least whose keys have four
    bits more than it takes to number the rows, so that few rows share one by
    chance however many there are.
    """
    wanted = math.log2(max(2, rows)) + 4
    m = threshold + 1
    while 64 * (m - threshold) / m < min(wanted, 48):
        m += 1
    ends = [64 * k // m for k in range(m + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(ends, ends[1:], strict=False)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(sum(c)) for c in itertools.combinations(blocks, m - threshold)]


def _dealt(keyed: DataFrame, on: list[str], total: int) -> tuple[DataFrame, DataFrame]:
    """Two sides of a self-join on ``on``: keys that over a 100,000th of all rows
    have (so at most 100,000 keys) are dealt to parts on one side and
    repeated for each part on the other."""
    limit = max(_FEW, total // 100_000)
    hot = keyed.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > limit).select(*on, F.ceil(F.col("_n") / limit).cast("int").alias("_parts"))
    known = keyed.join(F.broadcast(hot), on, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    one = known.withColumn("_part", F.pmod(F.xxhash64("_key"), F.col("_parts")).cast("int")).drop("_parts")
    return one, known.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")


def near_by_hamming(hashes: DataFrame, key: str, group: str, simhash: str, threshold: int = 3) -> DataFrame:
    """Pairs (key_a, key_b, distance) of one group whose 64-bit hashes differ in
    at most ``threshold`` bits.

    Equal hashes are one node, with their smallest key, so that copies don't
    multiply. Nodes meet on the keys of ``masks``, and a pair is given by the
    first key that it shares alone. Rows without a group or a hash are left out.
    """
    nodes = hashes.where(F.col(group).isNotNull() & F.col(simhash).isNotNull()).groupBy(F.col(group).alias("_group"), F.col(simhash).alias("_hash")).agg(F.min(key).alias("_key"))
    n = nodes.count()
    kept = masks(n, threshold)
    keyed = nodes.select("*", F.posexplode(F.transform(F.array(*map(F.lit, kept)), lambda m: F.col("_hash").bitwiseAND(m))).alias("_mask", "_bits"))
    on = ["_group", "_mask", "_bits"]
    one, other = _dealt(keyed, on, n * len(kept))
    differ = F.col("a._hash").bitwiseXOR(F.col("b._hash"))
    shared: Column = F.coalesce(*(F.when(differ.bitwiseAND(F.lit(m)) == 0, i) for i, m in enumerate(kept)))
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in [*on, "_part"]]
    # Spark would take the sides for as large as the file of hashes, whatever the number of keys, and broadcast one.
    found = one.alias("a").join(other.alias("b").hint("merge"), [*same, F.col("a._key") < F.col("b._key"), F.bit_count(differ) <= threshold])
    return found.where(shared == F.col("a._mask")).select(F.col("a._key").alias("key_a"), F.col("b._key").alias("key_b"), F.bit_count(differ).alias("distance"))
