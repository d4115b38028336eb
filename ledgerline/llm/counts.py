"""Token counts by a map-side two-tier lookup, without any shuffle.

Tier one is a broadcast hash table of frequent pieces and their lengths in
tokens, made from a bounded sample of texts and of bounded size (some 2 MB).
Tier two is a bounded cache in each worker; only pieces that neither knows go
to the tokenizer library. Which pieces the table holds changes the work and
never the counts, which are exact either way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import PieceTable, WordEncoder, cuts_at_white_space, distinct, load_tokenizer, slices

#: The sample that tier one is made from: this many rows of at most so many
#: characters each; and the pieces that the table holds at most.
SAMPLE_ROWS, SAMPLE_CHARS, FREQUENT = 1_000, 10_000, 1 << 16


def frequent_lengths(texts: list[str | None], path: str, size: int = FREQUENT) -> tuple[PieceTable, np.ndarray]:
    """The ``size`` most frequent pieces of these texts and their lengths."""
    encoder = WordEncoder(path)
    found = encoder.pieces(pa.array(texts, pa.string()))
    k1, k2 = found.keys()
    slots = encoder.find(found, k1, k2)  # may replace the arrays
    lens = encoder.length[slots]
    first, inverse = distinct(k1, k2)
    best = first[np.argsort(-np.bincount(inverse, minlength=len(first)), kind="stable")[:size]]
    table = PieceTable()
    table.add(k1[best], k2[best])
    return table, np.append(lens[best], 0)


def _piecewise(path: str, frequent, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder = WordEncoder.of(path)
    table, known = frequent.value
    for batch in batches:
        for a, b in slices(batch["text"]):
            found = encoder.pieces(batch["text"][a:b])
            k1, k2 = found.keys()
            at = table.find(k1, k2)
            lens = known.take(at, mode="wrap")
            rest = np.flatnonzero(at < 0)
            if len(rest):
                slots = encoder.find(found, k1, k2, rest)  # may replace the arrays
                lens[rest] = encoder.length[slots]
            total = np.append(0, np.cumsum(lens))
            counts = total[found.offsets[1:]] - total[found.offsets[:-1]]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"][a:b], batch["n_bytes"][a:b], pa.array(counts)], ["doc_id", "n_bytes", "n_tokens"]
            )


def _whole(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda xs: [len(ids) for ids in sp.encode(xs, num_threads=1)]
    else:
        tok = load_tokenizer(path)
        count = lambda xs: [len(e.ids) for e in tok.encode_batch_fast(xs, add_special_tokens=False)]
    for batch in batches:
        for a, b in slices(batch["text"]):
            texts = [x or "" for x in batch["text"][a:b].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"][a:b], batch["n_bytes"][a:b], pa.array(count(texts), pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """Tokens of every whole text: doc_id, n_bytes, n_tokens, over_limit.

    One row per row of ``docs``, repeated and null ids included; a null or
    empty text has 0 bytes and 0 tokens; other columns are ignored. A file
    whose tokens depend on white space or case (byte-level, SentencePiece) is
    counted by its library on whole texts.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    if not path.endswith(".model") and cuts_at_white_space(load_tokenizer(path)):
        some = docs.select(F.substring("text", 1, SAMPLE_CHARS).alias("text")).limit(SAMPLE_ROWS).collect()
        frequent = spark.sparkContext.broadcast(frequent_lengths([r["text"] for r in some], path))
        work = lambda batches: _piecewise(path, frequent, batches)
    else:
        work = lambda batches: _whole(path, batches)
    counted = rows.mapInArrow(work, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
