"""Packing of token pieces by a configuration linear program.

Pieces differ only by length, and a length is at most the capacity, so the
whole corpus is a histogram of at most ``capacity`` bars. Over it the
configuration LP (fewest sequences, each filled by one configuration of
lengths, every length covered) is approached on the driver by multiplicative
weights: each step prices the configuration of greatest weight by a knapsack
dynamic program, takes a share of it that covers none of its lengths by more
than one more turn, and lowers the weights of the lengths by how often they are
covered so far. The weights begin with the best of some known dual solutions,
and every step's weights prove a bound that no packing is below. The mean of
the steps is rounded down to whole sequences; what is left is placed by best
fit, longest first, on runs of equal sequences. The same best fit alone is the
other plan; the one with fewer sequences counts. The steps end when that is
within 1 % of the bound (and one sequence), or after ``STEPS``. A plan is a list
of runs, whose number depends on the capacity and not on the corpus; Spark
numbers the pieces of each length and looks up their runs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranked, stash
from .words import WordEncoder, slices

CAPACITY = 2048
#: Steps of the weights at most, between two looks at the plan, how fast weights
#: fall, and how near to the bound is near enough.
STEPS, LOOK, RATE, NEAR = 800, 100, 0.5, 1.01


def priced(weights: np.ndarray, capacity: int) -> list[int]:
    """The lengths of the configuration of greatest weight (may repeat)."""
    best = np.zeros(capacity + 1)
    pick = np.zeros(capacity + 1, dtype=np.int64)
    for c in range(1, capacity + 1):
        value = weights[1 : c + 1] + best[c - 1 :: -1]
        k = int(value.argmax())
        if value[k] > best[c - 1]:
            best[c], pick[c] = value[k], k + 1
        else:
            best[c] = best[c - 1]
    out, c = [], capacity
    while c > 0:
        if pick[c]:
            out.append(int(pick[c]))
            c -= int(pick[c])
        else:
            c -= 1
    return out


def dual_weights(counts: np.ndarray, capacity: int) -> np.ndarray:
    """Of known dual feasible functions of a length the one that proves most.

    They are a length's share of the capacity; the same with long lengths
    counted whole and as short ones left out; and these rounded to multiples
    of 1/k, up or down as their k + 1-fold tells. No filled sequence weighs over 1.
    """
    length = np.arange(capacity + 1)
    share = length / capacity
    best, most = share, float(share @ counts)
    for short in range(capacity // 2 + 1):
        whole = np.where(length > capacity - short, 1.0, np.where(length >= short, share, 0.0))
        numerator = np.where(length > capacity - short, capacity, np.where(length >= short, length, 0))
        for k in range(7):
            times = (k + 1) * numerator
            weights = np.where(times % capacity == 0, whole, times // capacity / k) if k else whole
            if (value := float(weights @ counts)) > most:
                best, most = weights, value
    return best


def solve(counts: np.ndarray, capacity: int, steps: int = STEPS) -> Iterator[tuple[dict[tuple[int, ...], float], float]]:
    """After every ``LOOK`` steps: a fractional solution for ``counts`` (by length,
    0 to capacity), and the best bound that the weights have proved. The solution
    covers the lengths on average once, some more and some less."""
    start, need = dual_weights(counts, capacity), np.maximum(counts, 1)
    there, size = counts > 0, np.arange(capacity + 1) * counts
    turns = np.zeros(capacity + 1)  # how often each length is covered
    chosen: dict[tuple[int, ...], float] = {}
    bound = float(start @ counts)
    for step in range(1, steps + 1 if there.any() else 0):
        weights = np.where(there, start * np.exp(-RATE * (turns - turns[there].min())), 0.0)
        if not weights.any():
            weights = np.where(there, np.arange(capacity + 1) / capacity, 0.0)
        config = priced(weights, capacity)
        bound = max(bound, float(weights @ counts) / float(weights[config].sum()))
        lengths, times = np.unique(config, return_counts=True)
        share = float(np.min(need[lengths] / times))
        turns[lengths] += share * times / need[lengths]
        key = tuple(sorted(config, reverse=True))
        chosen[key] = chosen.get(key, 0.0) + share
        if step % LOOK == 0 or step == steps:
            mean = float(turns @ size) / float(size.sum())
            yield {k: v / mean for k, v in chosen.items()}, bound


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, number, first sequence, offset).

    Piece number ``first rank + i`` of that length stands at ``offset`` of
    sequence ``first sequence + i``.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] = n
    full, rest = int(counts[capacity]), counts.copy()
    rest[capacity] = 0
    best, fewest = _filled(counts, {}, capacity)
    for solution, bound in solve(rest, capacity):
        runs, n = _filled(counts, solution, capacity)
        if n < fewest:
            best, fewest = runs, n
        if fewest - full <= NEAR * bound + 1:
            break
    return best


def _filled(counts: np.ndarray, solution: dict[tuple[int, ...], float], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """The runs of whole sequences of a fractional solution, then best fit; and
    how many sequences they take."""
    runs, sequences = [], 0
    used = np.zeros(capacity + 1, dtype=np.int64)
    if counts[capacity]:
        runs.append((capacity, 0, int(counts[capacity]), 0, 0))
        sequences, used[capacity] = int(counts[capacity]), counts[capacity]
    open_runs: dict[int, list[tuple[int, int]]] = {}
    rest = counts - used
    for config, share in sorted(solution.items(), key=lambda x: -x[1]):
        lengths, times = np.unique(config, return_counts=True)
        n = min(int(share + 1e-9), int(np.min((rest[lengths]) // times)))
        if n < 1:
            continue
        at = 0
        for length in config:
            runs.append((length, int(used[length]), n, sequences, at))
            used[length] += n
            rest[length] -= n
            at += length
        if at < capacity:
            open_runs.setdefault(capacity - at, []).append((sequences, n))
        sequences += n
    room = np.zeros(capacity + 1, dtype=bool)
    for left in open_runs:
        room[left] = True
    for length in range(capacity, 0, -1):
        n = int(rest[length])
        while n:
            fits = np.flatnonzero(room[length:])
            if len(fits):
                left = length + int(fits[0])
                first, many = open_runs[left].pop()
                take = min(n, many)
                if take < many:
                    open_runs[left].append((first + take, many - take))
                if not open_runs[left]:
                    room[left] = False
            else:
                left, take = capacity, -(-n // (capacity // length))
                first = sequences
                sequences += take
            runs.append((length, int(used[length]), take, first, capacity - left))
            used[length] += take
            n -= take
            if left > length:
                open_runs.setdefault(left - length, []).append((first, take))
                room[left - length] = True
    return runs, sequences


def _pieces(path: str, end_id: int, capacity: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder = WordEncoder.of(path)
    end = np.array([end_id], dtype="<u4").tobytes()
    for batch in batches:
        for a, b in slices(batch["text"]):
            offsets, ids = encoder.encode(batch["text"][a:b])
            raw = ids.astype("<u4").tobytes()
            rows = []
            for i in range(b - a):
                view = raw[4 * offsets[i] : 4 * offsets[i + 1]] + end
                n = len(view) // 4
                rows += [
                    (i, k // capacity, k, min(capacity, n - k), zlib.crc32(view[4 * k : 4 * (k + capacity)]))
                    for k in range(0, n, capacity)
                ]
            i, piece, start, length, crc = (pa.array(np.array(x, dtype=np.int64)) for x in zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"][a:b].take(i), piece.cast(pa.int32()), start, length, crc],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )


def token_pieces(docs: DataFrame, path: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Documents as token pieces of at most ``capacity``: the ids of a text
    and then ``end_id``, cut only if longer (a null or empty text is one
    piece of length 1)."""
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        lambda batches: _pieces(path, end_id, capacity, batches),
        f"doc_id {kind}, piece int, start long, length long, ids_crc32 long",
    )


def _placed(plan_rows, names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    length, rank, _, sequence, offset = plan_rows.value
    keys = length << 42 | rank
    for batch in batches:
        own_rank = np.asarray(batch["rank"])
        at = np.searchsorted(keys, np.asarray(batch["length"]) << 42 | own_rank, side="right") - 1
        yield pa.RecordBatch.from_arrays(
            [*(batch[n] for n in names), pa.array(sequence[at] + own_rank - rank[at]), pa.array(offset[at])],
            [*names, "sequence_id", "offset"],
        )


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give every row of ``pieces`` (doc_id, piece, length and others) a
    ``sequence_id`` and the ``offset`` of its first token there.

    Lengths are 1 to ``capacity``. Sequences are gapless from offset 0.
    Repeated rows are packed each by itself; an empty table gives none.
    """
    spark = pieces.sparkSession
    pieces = stash(pieces, "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    runs = np.array(sorted(plan(histogram, capacity)), dtype=np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(tuple(runs.T))
    names = pieces.columns
    numbered = ranked(pieces, [F.col("doc_id"), F.col("piece")], "length", "rank")
    out = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    return numbered.mapInArrow(lambda batches: _placed(shared, names, batches), out)
