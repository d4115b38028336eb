"""Substring deduplication by automata over passages that recur.

A window is so many consecutive words. Texts are dealt to cells of about 8 MB by
a hash of their row, and each window is filed under its anchor, the five words
in it with the least hash: equal windows have equal anchors, wherever they are.

1. Every cell says which anchors it has; shards of anchors find those that recur
   and answer with one number for each anchor of each cell.
2. Every cell sends its segments (the words of all windows of one anchor) of
   recurring anchors, each distinct text once with the least and the greatest
   document that has it here.
3. A shard confirms which windows occur in several documents, compiles an
   Aho-Corasick automaton of them (its letters number the words of the shard, so
   a hit is an exact match), each with the least document that has it, and
   streams the segments of all documents through it.
4. Every cell reads the hits of its segments, marks the words that they cover
   and gives back its texts without them.

Cells and shards are as many as the bytes of text ask for. A passage that very
many documents share costs a shard one row a cell, not one a document. An anchor
in very many different segments is cut to single windows, which are dealt to
several shards by their hash. The cells are one exchange that all steps read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import _ODD1, _keys, mixed

#: Bytes of text in a cell and for each shard, on average.
CELL_BYTES = 8_000_000
#: Words whose hash is compared to choose a window's anchor.
GRAM = 5
#: Segments of one anchor in one part of it, and windows that each is cut to at most.
CROWD, WINDOWS = 20_000, 9
#: Stands for a null doc_id, which no other is greater than.
LAST = np.iinfo(np.int64).max

_MESSAGE = "cell int, shard int, kind int, body binary"
_ANCHOR = np.dtype([("anchor", "<u8"), ("lo", "<i8"), ("hi", "<i8"), ("n", "<i4")])
_HIT = np.dtype([("segment", "<i4"), ("first", "<i4"), ("last", "<i4"), ("owner", "<i8")])
_FLAGS, _HITS = 0, 1


class Words(NamedTuple):
    """The words of some texts (single spaces between them), in one buffer."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray  # of each text's words
    text_bounds: np.ndarray  # of each text's bytes
    doc: np.ndarray  # doc_id of each text


def words_of(table: pa.Table) -> Words:
    """Rows are brought into one order, whatever order they came in."""
    table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
    texts = table["text"].combine_chunks().cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1] or bytes(8), np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    n = len(raw)
    buf = np.zeros((n + 31) // 8 * 8, np.uint8)
    buf[:n] = raw
    space = raw == 32
    first = np.ones(n, bool)
    first[1:] = space[:-1]
    first[at[:-1][at[:-1] < n]] = True
    last = np.ones(n, bool)
    last[:-1] = first[1:] | space[1:]
    start, end = np.flatnonzero(first & ~space), np.flatnonzero(last & ~space) + 1
    doc = np.asarray(pc.fill_null(table["doc_id"].cast(pa.int64()), LAST))
    return Words(buf, start, end, np.searchsorted(start, at), at, doc)


def _rolling(keys: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` keys from each place on."""
    n = len(keys) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(size if n > 0 else 0):
        out = out * _ODD1 + keys[i : n + i]
    return mixed(out)


class Segments(NamedTuple):
    """Runs of windows with one anchor: first word, words, document, anchor."""

    first: np.ndarray
    words: np.ndarray
    doc: np.ndarray
    anchor: np.ndarray


def segments_of(w: Words, window: int) -> tuple[Segments, np.ndarray]:
    """All segments in the order of the texts, and a hash of each word."""
    k1, k2 = _keys(w.buf, w.start, w.end - w.start)
    keys = mixed(k1 * _ODD1 + k2)
    sizes = np.diff(w.bounds)
    text = np.repeat(np.arange(len(sizes)), sizes)
    grams = _rolling(keys, min(GRAM, window))
    n = max(len(keys) - window + 1, 0)
    best, at = grams[:n].copy(), np.zeros(n, np.int64)
    for i in range(1, window - min(GRAM, window) + 1):
        other = grams[i : n + i]
        less = other < best
        best[less] = other[less]
        at[less] = i
    at += np.arange(n)
    whole = text[window - 1 :] == text[:n] if n else np.zeros(0, bool)
    windows = np.flatnonzero(whole)
    if not len(windows):
        none = np.zeros(0, np.int64)
        return Segments(none, none, none, none.astype(np.uint64)), keys
    at, best = at[windows], best[windows]
    new = np.ones(len(windows), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[windows[1:]] != text[windows[:-1]])
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(windows)))
    first = windows[head]
    return Segments(first, count + window - 1, w.doc[text[first]], best[head]), keys


def _shard_of(anchor: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(anchor + _ODD1) % np.uint64(shards)).astype(np.int64)


def _grouped(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, bounds): the places of each distinct value after one another."""
    order = np.argsort(values, kind="stable")
    ends = np.flatnonzero(np.diff(values[order])) + 1
    return order, np.concatenate([[0], ends, [len(values)]]) if len(values) else np.zeros(1, np.int64)


class Anchors(NamedTuple):
    """The distinct anchors of a cell in ascending order, which of them each
    segment has, and the places of each shard's anchors."""

    told: np.ndarray
    which: np.ndarray
    by_shard: list[tuple[int, np.ndarray]]


def _anchors(seg: Segments, shards: int) -> Anchors:
    order, bounds = _grouped(seg.anchor)
    heads = bounds[:-1]
    told = np.zeros(len(heads), _ANCHOR)
    which = np.zeros(len(order), np.int64)
    if len(heads):
        docs = seg.doc[order]
        told["anchor"], told["n"] = seg.anchor[order[heads]], np.diff(bounds)
        told["lo"], told["hi"] = np.minimum.reduceat(docs, heads), np.maximum.reduceat(docs, heads)
        which[order] = np.repeat(np.arange(len(heads)), np.diff(bounds))
    shard = _shard_of(told["anchor"], shards)
    order, bounds = _grouped(shard)
    return Anchors(told, which, [(int(shard[order[a]]), order[a:b]) for a, b in zip(bounds[:-1], bounds[1:])])


def _messages(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    cell, shard, kind, body = zip(*rows) if rows else ((), (), (), ())
    return pa.table({"cell": pa.array(cell, pa.int32()), "shard": pa.array(shard, pa.int32()), "kind": pa.array(kind, pa.int32()), "body": pa.array(body, pa.binary())})


def _tell_anchors(window: int, shards: int, table: pa.Table) -> pa.Table:
    cell = table["cell"][0].as_py()
    found = _anchors(segments_of(words_of(table), window)[0], shards)
    return _messages([(cell, s, _FLAGS, found.told[at].tobytes()) for s, at in found.by_shard])


def _recurring(table: pa.Table) -> pa.Table:
    """For each anchor of each cell 0 if it does not recur, else its parts."""
    told = [np.frombuffer(b, _ANCHOR) for b in table["body"].to_pylist()]
    every = np.concatenate(told)
    order, bounds = _grouped(every["anchor"])
    heads = bounds[:-1]
    lo, hi = np.minimum.reduceat(every["lo"][order], heads), np.maximum.reduceat(every["hi"][order], heads)
    n = np.add.reduceat(every["n"][order].astype(np.int64), heads)
    parts = np.where(lo < hi, np.where(n > CROWD, -(-n * WINDOWS // CROWD), 1), 0)
    back = np.empty(len(every), np.int32)
    back[order] = np.repeat(parts, np.diff(bounds))
    ends = np.cumsum([len(t) for t in told])
    bodies = [back[e - len(t) : e].tobytes() for e, t in zip(ends, told)]
    return table.set_column(table.schema.get_field_index("body"), "body", pa.array(bodies, pa.binary()))


class Sent(NamedTuple):
    """What a cell sends: its distinct texts, and where each of them occurs."""

    texts: list[bytes]
    shard: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    which: np.ndarray  # text of each occurrence
    first: np.ndarray  # first word of it
    doc: np.ndarray


def _sent(w: Words, window: int, shards: int, flags: dict[int, bytes]) -> Sent:
    seg, keys = segments_of(w, window)
    found = _anchors(seg, shards)
    answers = np.zeros(len(found.told), np.int64)
    for shard, at in found.by_shard:
        answers[at] = np.frombuffer(flags[shard], np.int32)
    parts = answers[found.which]
    seg = Segments(*(x[parts > 0] for x in seg))
    parts = parts[parts > 0]
    crowded = parts > 1
    each = np.where(crowded, seg.words - window + 1, 1)  # windows that a segment is cut to
    of = np.repeat(np.arange(len(each)), each)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
    first, size, doc, anchor = seg.first[of] + nth, np.where(crowded, window, seg.words)[of], seg.doc[of], seg.anchor[of]
    cut = np.flatnonzero(crowded[of])
    if len(cut):
        part = mixed(_rolling(keys, window)[first[cut]] + _ODD1) % parts[of[cut]].astype(np.uint64)
        anchor = anchor.copy()
        anchor[cut] += part * _ODD1
    raw, known = w.buf.tobytes(), {}
    which = np.fromiter(
        (known.setdefault(raw[a:b], len(known)) for a, b in zip(w.start[first].tolist(), w.end[first + size - 1].tolist())), np.int64, len(first)
    )
    order, bounds = _grouped(which)
    heads = bounds[:-1]
    docs = doc[order]
    lo, hi = (f.reduceat(docs, heads) if len(heads) else docs for f in (np.minimum, np.maximum))
    return Sent(list(known), _shard_of(anchor[order[heads]], shards), lo, hi, which, first, doc)


_SEGMENTS = "cell int, shard int, at array<int>, lo array<bigint>, hi array<bigint>, texts array<string>"


def _tell_segments(window: int, shards: int, docs: pa.Table, flags: pa.Table) -> pa.Table:
    out = {"cell": [], "shard": [], "at": [], "lo": [], "hi": [], "texts": []}
    if len(docs):
        cell = docs["cell"][0].as_py()
        sent = _sent(words_of(docs), window, shards, dict(zip(flags["shard"].to_pylist(), flags["body"].to_pylist())))
        order, bounds = _grouped(sent.shard)
        for a, b in zip(bounds[:-1], bounds[1:]):
            at = order[a:b]
            for k, v in zip(out, (cell, int(sent.shard[at[0]]), at, sent.lo[at], sent.hi[at], [sent.texts[i] for i in at.tolist()])):
                out[k].append(v)
    kinds = (pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()))
    made = {k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds)}
    made["texts"] = made["texts"].cast(pa.list_(pa.string()))
    return pa.table(made)


#: Letters for each word: two out of few make small nodes, which one out of many doesn't.
_LETTERS = 2


def _letters(texts: pa.Array) -> list[str]:
    """Each text as a string with two letters for each word, equal for equal words.

    The first and the second letters come from different alphabets, so that no
    match begins inside a word.
    """
    words = pc.split_pattern(texts, " ")
    coded = words.flatten().dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    base = int(np.ceil(np.sqrt(len(coded.dictionary)))) + 1
    codes = np.stack([ids // base, base + ids % base], axis=1).ravel().astype("<u4") + 1
    codes[codes >= 0xD800] += 0x800  # these are no characters
    said = codes.tobytes().decode("utf-32-le")
    ends = (np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False)) * _LETTERS).tolist()
    return [said[a:b] for a, b in zip([0, *ends], ends)]


def _owners(window: int, texts: list[str], lo: list[int], hi: list[int]) -> dict[str, int]:
    """Windows that occur in several documents, each with the least of them."""
    least, several, size = {}, {}, window * _LETTERS
    for k in np.argsort(lo, kind="stable").tolist():
        said, a, b = texts[k], lo[k], hi[k]
        for i in range(0, len(said) - size + 1, _LETTERS):
            part = said[i : i + size]
            owner = least.setdefault(part, a)
            if owner < b:
                several[part] = owner
    return several


def _locate(window: int, table: pa.Table) -> pa.Table:
    import ahocorasick

    table = table.combine_chunks()
    flat = {c: pc.list_flatten(table[c]).combine_chunks() for c in ("at", "lo", "hi", "texts")}
    if isinstance(flat["texts"], pa.ChunkedArray):
        flat["texts"] = pa.concat_arrays(flat["texts"].chunks)
    texts, lo, hi = _letters(flat["texts"]), flat["lo"].to_pylist(), flat["hi"].to_pylist()
    owners = _owners(window, texts, lo, hi)
    if not owners:
        return _messages([])
    automaton = ahocorasick.Automaton()
    for part, owner in owners.items():
        automaton.add_word(part, owner)
    automaton.make_automaton()
    del owners
    cells, shards, at = table["cell"].to_pylist(), table["shard"].to_pylist(), flat["at"].to_pylist()
    rows, k = [], 0
    for cell, shard, n in zip(cells, shards, pc.list_value_length(table["at"]).to_pylist()):
        hits = []
        for k in range(k, k + n):
            run = None
            for end, owner in automaton.iter(texts[k]):
                first = (end + 1) // _LETTERS - window
                if owner >= hi[k]:
                    continue
                if run and run[2] == first - 1 and run[3] == owner:
                    run[2] = first
                else:
                    run = [at[k], first, first, owner]
                    hits.append(run)
        k += 1
        if hits:
            rows.append((cell, shard, _HITS, np.array([tuple(h) for h in hits], _HIT).tobytes()))
    return _messages(rows)


def _without(window: int, shards: int, docs: pa.Table, told: pa.Table) -> pa.Table:
    w = words_of(docs)
    kinds, shard, bodies = (told[c].to_pylist() for c in ("kind", "shard", "body"))
    flags = {s: b for k, s, b in zip(kinds, shard, bodies) if k == _FLAGS}
    hits = np.concatenate([np.zeros(0, _HIT), *(np.frombuffer(b, _HIT) for k, b in zip(kinds, bodies) if k == _HITS)])
    edge = np.zeros(len(w.start) + 1, np.int64)
    if len(hits):
        sent = _sent(w, window, shards, flags)
        order, bounds = _grouped(sent.which)  # texts are numbered from 0 without gaps
        times = np.diff(bounds)[hits["segment"]]
        hit = np.repeat(np.arange(len(hits)), times)
        where = order[np.repeat(bounds[hits["segment"]] - np.cumsum(times) + times, times) + np.arange(len(hit))]
        later = hits["owner"][hit] < sent.doc[where]
        hit, where = hit[later], where[later]
        np.add.at(edge, sent.first[where] + hits["first"][hit], 1)
        np.add.at(edge, sent.first[where] + hits["last"][hit] + window, -1)
    gone = np.cumsum(edge[:-1]) > 0
    turns = np.flatnonzero(np.diff(gone.astype(np.int8))) + 1  # words at which runs of kept or removed ones begin
    n_gone = np.diff(np.append(0, np.cumsum(gone))[w.bounds])
    raw, kept, spans = w.buf.tobytes(), [], []
    for i, (a, b) in enumerate(zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist())):
        if not n_gone[i]:
            kept.append(raw[w.text_bounds[i] : w.text_bounds[i + 1]])
            spans.append([])
            continue
        cuts = [a, *turns[np.searchsorted(turns, a, "right") : np.searchsorted(turns, b, "left")].tolist(), b]
        runs = [(x, y, gone[x]) for x, y in zip(cuts, cuts[1:])]
        kept.append(b" ".join(raw[w.start[x] : w.end[y - 1]] for x, y, g in runs if not g))
        spans.append([{"first": x - a, "last": y - 1 - a} for x, y, g in runs if g])
    span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    doc = pa.array(w.doc, mask=w.doc == LAST)
    return pa.table({"doc_id": doc, "n_words": np.diff(w.bounds).astype(np.int64), "n_removed": n_gone.astype(np.int64), "kept": pa.array(kept, pa.binary()).cast(pa.string()), "removed": pa.array(spans, span)})


def without_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """Texts without the passages that a row of smaller doc_id has too.

    Returns doc_id, n_words, n_removed, kept (the words that stay, joined by one
    space) and removed (first and last word of each span). A word goes if it is
    in a window of ``window`` consecutive words that also starts in a text of
    smaller doc_id. One row for each row; null texts have no words; rows of the
    same doc_id are never compared; a null doc_id is greater than all others.
    Texts of fewer words than the window stay. Other columns are ignored. A text
    is one row of one task, so very long ones ask for memory of some 20 times
    their bytes.
    """
    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // CELL_BYTES))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"))
    rows = rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("cell"), "doc_id", "text").repartition(n, "cell")
    told = rows.groupBy("cell").applyInArrow(lambda docs: _tell_anchors(window, n, docs), _MESSAGE)
    flags = told.groupBy("shard").applyInArrow(lambda told: _recurring(told), _MESSAGE)
    segments = rows.groupBy("cell").cogroup(flags.groupBy("cell")).applyInArrow(lambda docs, flags: _tell_segments(window, n, docs, flags), _SEGMENTS)
    hits = segments.groupBy("shard").applyInArrow(lambda segments: _locate(window, segments), _MESSAGE)
    fields = "doc_id long, n_words long, n_removed long, kept string, removed array<struct<first: int, last: int>>"
    return rows.groupBy("cell").cogroup(flags.unionAll(hits).groupBy("cell")).applyInArrow(lambda docs, told: _without(window, n, docs, told), fields)
