"""Token ids in block files coded by the context-mixing range coder.

A file is a Parquet file of frames, written and committed by Spark, so a lost
executor's part is written again and no reader sees half a file. A frame holds
whole documents in ascending order of ``doc_id``: their ids and lengths, the
priors that its blocks start from, and the payloads of its blocks, each coded
from a fresh model and with a CRC-32 of the ids it must give. Files and frames
in name and row order hold the corpus in ascending order; ``start`` counts the
ids before the frame in its file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_folder
from .rangecoder import BLOCK, decode_blocks, encode_blocks
from .words import WordEncoder, slices

#: Ids after which a frame ends with its slice of documents.
FRAME = 4_000_000
_FRAME = (
    "start long, n_tokens long, doc_ids array<{kind}>, lengths array<long>, priors array<binary>, "
    "block_bytes array<int>, block_crc32 array<long>, payload binary"
)


def _crcs(ids: np.ndarray) -> list[int]:
    raw = ids.astype("<u4").tobytes()
    return [zlib.crc32(raw[k : k + 4 * BLOCK]) for k in range(0, len(raw), 4 * BLOCK)]


def _list(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _frame(docs: list[pa.Array], lengths: np.ndarray, ids: np.ndarray, start: int) -> pa.RecordBatch:
    """Code these documents as one frame; ``start`` ids of the file came before."""
    priors, blocks = encode_blocks(ids)
    sizes = np.fromiter(map(len, blocks), dtype=np.int32, count=len(blocks))
    columns = {
        "start": pa.array([start]),
        "n_tokens": pa.array([len(ids)]),
        "doc_ids": _list(pa.concat_arrays(docs)),
        "lengths": _list(pa.array(lengths)),
        "priors": _list(pa.array(priors, pa.binary())),
        "block_bytes": _list(pa.array(sizes)),
        "block_crc32": _list(pa.array(_crcs(ids), pa.int64())),
        "payload": pa.array([b"".join(blocks)], pa.binary()),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _encode(path: str, end_id: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder = WordEncoder.of(path)
    start, held, docs, lengths, parts = 0, 0, [], [], []
    for batch in batches:
        for a, b in slices(batch["text"]):
            offsets, ids = encoder.encode(batch["text"][a:b])
            docs.append(batch["doc_id"][a:b])
            lengths.append(np.diff(offsets) + 1)
            parts.append(np.insert(ids, offsets[1:], end_id))
            held += len(parts[-1])
            if held >= FRAME:
                yield _frame(docs, np.concatenate(lengths), np.concatenate(parts), start)
                start, held, docs, lengths, parts = start + held, 0, [], [], []
    if docs:
        yield _frame(docs, np.concatenate(lengths), np.concatenate(parts), start)


def write_tokens(docs: DataFrame, path: str, end_id: int, folder: str | None = None) -> str:
    """Encode every text, append ``end_id``, and write block files; their folder.

    A null or empty text is the end id alone. Rows with the same doc_id stand
    next to each other in any order, null ids come first; ids may be of any
    type that has an order. Other columns are ignored. An empty table gives
    files without frames. A frame holds all of a document, however long.
    """
    folder = folder or shared_folder(docs.sparkSession, "tokens")
    laid = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id")
    )
    framed = laid.mapInArrow(lambda batches: _encode(path, end_id, batches), _FRAME.format(kind=dict(docs.dtypes)["doc_id"]))
    framed.withColumn("frame", F.monotonically_increasing_id()).write.parquet(folder)
    return folder


def _decode(base: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(len(batch)):
            yield _decoded(base, {n: batch[n][k] for n in batch.schema.names})


def _decoded(base: dict, frame: dict) -> pa.RecordBatch:
    payload, sizes = frame["payload"].as_py(), frame["block_bytes"].as_py()
    ends = np.cumsum(sizes).tolist()
    blocks = [payload[end - n : end] for n, end in zip(sizes, ends, strict=True)]
    ids = decode_blocks(frame["priors"].as_py(), blocks).astype("<u4").ravel()[: frame["n_tokens"].as_py()]
    for k, (crc, found) in enumerate(zip(frame["block_crc32"].as_py(), _crcs(ids), strict=True)):
        if crc != found:
            raise ValueError(f"block {k}: its ids do not have the CRC-32 {crc:08x}")
    lengths = frame["lengths"].values.to_numpy()
    ends = np.append(0, np.cumsum(lengths))
    starts = base[frame["frame"].as_py() >> 33] + frame["start"].as_py() + ends[:-1]
    raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends * 4), pa.py_buffer(ids)])
    return pa.RecordBatch.from_arrays(
        [frame["doc_ids"].values, pa.array(starts), pa.array(lengths), raw.cast(pa.binary())], ["doc_id", "start", "n_tokens", "ids"]
    )


def read_tokens(spark, folder: str) -> DataFrame:
    """Read block files: doc_id, start (ids of all documents before), n_tokens,
    and ids as the bytes of little-endian unsigned 32-bit integers.

    Every block's checksum is verified. Only one number per file goes through
    the driver.
    """
    frames = spark.read.parquet(folder)
    sums = frames.groupBy(F.shiftright("frame", 33).alias("part")).agg(F.sum("n_tokens").alias("n")).collect()
    base, total = {}, 0
    for r in sorted(sums, key=lambda r: r["part"]):
        base[r["part"]] = total
        total += r["n"]
    kind = dict(frames.dtypes)["doc_ids"].removeprefix("array<").removesuffix(">")
    return frames.mapInArrow(lambda batches: _decode(base, batches), f"doc_id {kind}, start long, n_tokens long, ids binary")


def checksums(tokens: DataFrame) -> DataFrame:
    """The CRC-32 of each document's ids."""
    return tokens.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
