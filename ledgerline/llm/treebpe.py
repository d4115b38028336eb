"""BPE encoding and decoding of long texts by tree concatenation.

A text longer than ``leaf`` characters is cut into leaves that Spark encodes in
parallel as rows of their own, even where one giant row would hold up a task.
A token never crosses white space, so only the ends of a leaf up to its first
and from its last white space depend on its neighbours. These ends, with the
places of their tokens, are joined pairwise, level by level, through leaves
without white space: a window around the cut is encoded anew and grown until,
on either side of the cut, two tokens in a row are the same in the window and
in the half (same id, same characters, clean borders). A BPE sequence is right
if every two neighbours in it are, so what lies beyond these shared tokens
needs no second look. A window that reaches the end of a half needs no
agreement there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import WordEncoder, load_tokenizer, slices

#: Characters beyond which a text is encoded as a tree of leaves of this size.
LEAF = 16_384
#: Characters of the first window on either side of a cut.
WINDOW = 96
#: Leaves of a text that are passed on together.
_AT_ONCE = 64
_SPACES = " \t\n\v\f\r"

_tokenizers: dict = {}


def _tokenizer(path: str):
    if path not in _tokenizers:
        _tokenizers[path] = load_tokenizer(path)
    return _tokenizers[path]


def encode_span(tok, text: str, lo: int, hi: int) -> np.ndarray:
    """Rows (id, first character, end) of text[lo:hi], positions in ``text``."""
    e = tok.encode(text[lo:hi], add_special_tokens=False)
    out = np.empty((len(e.ids), 3), dtype=np.int64)
    if len(out):
        out[:, 0] = e.ids
        out[:, 1:] = np.array(e.offsets, dtype=np.int64) + lo
    return out


def _shared(half: np.ndarray, window: np.ndarray, last: bool) -> tuple[int, int] | None:
    """Places in half and window of the last (or first) two shared tokens."""
    if len(half) < 2 or len(window) < 2:
        return None
    span = max(int(half[-1, 2]), int(window[-1, 2])) + 1
    key = lambda x: (x[:, 0] * span + x[:, 1]) * span + x[:, 2]
    clean = lambda x: np.append(True, x[1:, 1] >= x[:-1, 2])
    both, i, j = np.intersect1d(
        np.where(clean(half), key(half), -1), np.where(clean(window), key(window), -2), return_indices=True
    )
    at = dict(zip(i.tolist(), j.tolist(), strict=True))
    pairs = [(a, b) for a, b in at.items() if at.get(a + 1) == b + 1]
    return (max if last else min)(pairs) if pairs else None


def join_halves(tok, text: str, left: np.ndarray, right: np.ndarray, lo: int, cut: int, hi: int) -> np.ndarray:
    """The encoding of text[lo:hi] from those of text[lo:cut] and text[cut:hi]."""
    reach = WINDOW
    while True:
        a, b = max(lo, cut - reach), min(hi, cut + reach)
        window = encode_span(tok, text, a, b)
        head, tail = (0, 0), (len(right), len(window))
        if a > lo:
            near = int(np.searchsorted(left[:, 1], a, side="right"))
            inner = (window[:, 1] > a) & (window[:, 2] <= cut)
            first = int(np.argmax(inner)) if inner.any() else 0
            head = _shared(left[near:], window[first:][inner[first:]], last=True)
            head = head and (near + head[0], first + head[1])
        if b < hi:
            far = int(np.searchsorted(right[:, 2], b, side="left"))
            inner = (window[:, 1] >= cut) & (window[:, 2] < b)
            first = int(np.argmax(inner)) if inner.any() else 0
            tail = _shared(right[:far], window[first:][inner[first:]], last=False)
            tail = tail and (tail[0], first + tail[1])
        if head and tail:
            return np.concatenate([left[: head[0]], window[head[1] : tail[1]], right[tail[0] :]])
        if a == lo and b == hi:
            return window
        reach *= 2


def join_tree(tok, text: str, leaves: list[np.ndarray], cuts: list[int]) -> np.ndarray:
    """Join the encodings of text[cuts[k]:cuts[k+1]] pairwise until one is left."""
    while len(leaves) > 1:
        joined, ends = [], [cuts[0]]
        for k in range(0, len(leaves) - 1, 2):
            joined.append(join_halves(tok, text, leaves[k], leaves[k + 1], cuts[k], cuts[k + 1], cuts[k + 2]))
            ends.append(cuts[k + 2])
        if len(leaves) % 2:
            joined.append(leaves[-1])
            ends.append(cuts[-1])
        leaves, cuts = joined, ends
    return leaves[0]


def _encoded(key: pa.Array, tok, ids: list[np.ndarray]) -> pa.RecordBatch:
    texts = tok.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)
    lens = np.array([len(x) for x in ids], dtype=np.int64)
    flat = np.concatenate(ids) if ids else np.zeros(0)
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lens)).astype(np.int32)), pa.array(flat.astype(np.int32)))
    return pa.RecordBatch.from_arrays(
        [key, pa.array(lens), lists, pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"]
    )


def _short(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder = WordEncoder.of(path)
    for batch in batches:
        for a, b in slices(batch["text"], 3_000_000):
            offsets, ids = encoder.encode(batch["text"][a:b])
            yield _encoded(batch["doc_id"][a:b], encoder.tok, np.split(ids, offsets[1:-1]))


def _cut(leaf: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The leaves of each text, in one pass over it."""
    for batch in batches:
        for k in range(len(batch)):
            text = batch["text"][k].as_py()
            starts = range(0, len(text), leaf)
            for first in range(0, len(starts), _AT_ONCE):
                some = starts[first : first + _AT_ONCE]
                own = pa.array(np.zeros(len(some), dtype=np.int64) + k)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].take(own), batch["row_no"].take(own), pa.array(range(first, first + len(some)), pa.int32()), pa.array([text[a : a + leaf] for a in some], pa.string())],
                    ["doc_id", "row_no", "leaf_no", "leaf"],
                )


_LEAF_FIELDS = {"head": pa.string(), "head_tokens": pa.binary(), "middle": pa.binary(), "tail": pa.string(), "tail_tokens": pa.binary()}


def _leaves(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ends of each leaf with their tokens, and the ids of what is between.
    A leaf without white space is all head and has no tail."""
    encoder = WordEncoder.of(path)
    for batch in batches:
        for a, b in slices(batch["leaf"], 1_500_000):
            heads, middles, tails = [], [], []
            for t in batch["leaf"][a:b].to_pylist():
                last = max(t.rfind(c) for c in _SPACES)
                first = min((k for k in (t.find(c) for c in _SPACES) if k >= 0), default=len(t))
                heads.append(t[:first])
                middles.append(t[first:last] if last >= 0 else "")
                tails.append(t[last:] if last >= 0 else None)
            offsets, ids = encoder.encode(pa.array(middles, pa.string()))
            ids = ids.astype("<u4")
            packed = lambda x: None if x is None else _packed(encode_span(encoder.tok, x, 0, len(x)), len(x))
            between = [ids[i:j].tobytes() for i, j in zip(offsets, offsets[1:], strict=False)]
            columns = (heads, list(map(packed, heads)), between, tails, list(map(packed, tails)))
            keys = [batch[n][a:b] for n in ("doc_id", "row_no", "leaf_no")]
            yield pa.RecordBatch.from_arrays(
                keys + [pa.array(c, t) for c, t in zip(columns, _LEAF_FIELDS.values(), strict=True)], ["doc_id", "row_no", "leaf_no", *_LEAF_FIELDS]
            )


def _packed(spans: np.ndarray, n: int) -> bytes:
    """Ids, gaps before and lengths of tokens: small numbers, which compress."""
    ends = np.append(0, spans[:-1, 2])
    size = np.dtype("<u2" if n < 1 << 15 else "<u4")
    # two tokens of one character have the same place, so a gap can be negative
    return spans[:, 0].astype("<u4").tobytes() + (spans[:, 1] - ends).astype(size.str.replace("u", "i")).tobytes() + (spans[:, 2] - spans[:, 1]).astype(size).tobytes()


def _unpacked(raw: bytes, n: int, at: int) -> np.ndarray:
    size = np.dtype("<u2" if n < 1 << 15 else "<u4")
    count = len(raw) // (4 + 2 * size.itemsize)
    out = np.empty((count, 3), dtype=np.int64)
    out[:, 0] = np.frombuffer(raw, "<u4", count)
    gaps = np.frombuffer(raw, size.str.replace("u", "i"), count, 4 * count).astype(np.int64)
    lengths = np.frombuffer(raw, size, count, (4 + size.itemsize) * count).astype(np.int64)
    out[:, 2] = np.cumsum(gaps + lengths) + at
    out[:, 1] = out[:, 2] - lengths
    return out


def _joined(tok, ends: list[tuple[str, bytes]]) -> np.ndarray:
    """The ids of these neighbouring ends of leaves as one text."""
    ends = [(t, raw) for t, raw in ends if t]
    if not ends:
        return np.zeros(0, dtype="<u4")
    cuts = np.append(0, np.cumsum([len(t) for t, _ in ends])).tolist()
    spans = [_unpacked(raw, len(t), at) for (t, raw), at in zip(ends, cuts, strict=False)]
    return join_tree(tok, "".join(t for t, _ in ends), spans, cuts)[:, 0].astype("<u4")


def _join_document(path: str, table: pa.Table) -> pa.Table:
    tok = _tokenizer(path)
    table = table.sort_by("leaf_no")
    parts, open_ = [], []
    for head, head_tokens, middle, tail, tail_tokens in zip(*(table[n].to_pylist() for n in _LEAF_FIELDS), strict=True):
        open_.append((head, head_tokens))
        if tail is not None:
            parts += [_joined(tok, open_), np.frombuffer(middle, dtype="<u4")]
            open_ = [(tail, tail_tokens)]
    ids = np.concatenate([*parts, _joined(tok, open_)])
    return pa.Table.from_batches([_encoded(table["doc_id"][:1].combine_chunks(), tok, [ids])])


def encode_decode(docs: DataFrame, path: str, leaf: int = LEAF) -> DataFrame:
    """Encode and decode every text: doc_id, n_tokens, ids, decoded.

    One row per row of ``docs``; a null or empty text has no ids and decodes
    to the empty text. Equal to the library's own results for the whole text.
    Other columns are ignored; null and repeated ids are kept. One task holds
    all ids of one text, as its row of the result does.
    """
    kind = dict(docs.dtypes)["doc_id"]
    out = f"doc_id {kind}, n_tokens long, ids array<int>, decoded string"
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    long = F.char_length("text") > leaf
    short = rows.where(~long).mapInArrow(lambda batches: _short(path, batches), out)
    keys = f"doc_id {kind}, row_no long, leaf_no int"
    leaves = rows.where(long).select("doc_id", F.monotonically_increasing_id().alias("row_no"), "text")
    leaves = leaves.mapInArrow(lambda batches: _cut(leaf, batches), f"{keys}, leaf string")
    encoded = leaves.repartition("row_no", "leaf_no").mapInArrow(
        lambda batches: _leaves(path, batches), f"{keys}, head string, head_tokens binary, middle binary, tail string, tail_tokens binary"
    )
    joined = encoded.groupBy("row_no").applyInArrow(lambda table: _join_document(path, table), out)
    return short.unionByName(joined)
