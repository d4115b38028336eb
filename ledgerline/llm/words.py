"""Encode whole texts with a public tokenizer, each distinct piece only once.

A tokenizer whose pre-tokenizer throws white space away never lets a token
cross it, so a text's ids are the ids of its pieces, one after the other. Texts
are cut at ASCII white space, and between a letter and ASCII punctuation other
than the apostrophe, which is always a border of the pre-tokenizer. Pieces
repeat far more often than texts do; each worker therefore keeps a bounded
cache from piece to ids and asks the library only for the misses. Other white
space and anything unusual stays inside a piece, where the library deals with
it. Texts that hold one of the tokenizer's added tokens are cut at white space
only.

Pieces are looked up by the millions without making strings of them: two
64-bit keys of their bytes, which tell pieces of up to 16 bytes apart for
certain, find their place in a table of arrays.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at a time; bounds what a task holds.
SLICE_BYTES = 1_500_000
#: Pieces that a worker keeps (some 70 bytes each); beyond it the cache starts anew.
CACHE_WORDS = 1_500_000

#: Pieces whose keys are made together, so that the arrays stay in the CPU's cache.
_TOGETHER = 1 << 15

_encoders: dict = {}
_LETTER, _PUNCT, _C3, _TAIL, _OTHER = range(5)
_KIND = np.full(256, _OTHER, dtype=np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = _PUNCT
_KIND[0xC3] = _C3
_KIND[0x80:0xC0] = _TAIL
#: Small letters of ASCII and Latin-1: such a piece is one word to any pre-tokenizer.
_PLAIN = re.compile("[a-zß-öø-ÿ]+")


def forget_encoders() -> None:
    """Drop the caches that a reused worker keeps from earlier jobs; for tasks
    that don't encode."""
    _encoders.clear()


def load_tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def added_tokens(tok) -> list[str]:
    return sorted(t.content for t in tok.get_added_tokens_decoder().values())


def cuts_at_white_space(tok) -> bool:
    """Whether texts of this tokenizer can be encoded piece by piece: white
    space is dropped, letters and punctuation are parted, A-Z count as a-z, and
    no added token holds white space."""
    ids = lambda x: tok.encode(x, add_special_tokens=False).ids
    probes = ["a b", " a  b ", "a\tb\n", "\u00a0a\n\nb"]
    alone = ids("a") + ids("b")
    apart = [i for x in ("b", "..", "c", "?!", "e") for i in ids(x)]
    return (
        ids("b..c?!e") == apart
        and all(ids(p) == alone for p in probes)
        and all(ids(w) == ids(w.lower()) for w in ("A", "The", "QUICK", "BrownFox", "JUMPS", "OVeR", "LAZY", "DoGs", "VWXYZ"))
        and not any(any(c.isspace() for c in t) for t in added_tokens(tok))
    )


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text each, one row at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    at, n = 0, len(sizes)
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield at, to
        at = to


class Pieces:
    """The pieces of some texts: ``buf[start[i]:start[i] + length[i]]`` each;
    ``offsets[t]:offsets[t + 1]`` are those of text t.

    A-Z are lower-cased, but not in texts with an added token. Not ``fine``:
    words between ASCII white space, all lower-cased.
    """

    def __init__(self, texts: pa.Array, fine: bool = True, added: list[str] = ()):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        bounds = np.frombuffer(texts.buffers()[1] or bytes(8), dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        n = len(raw)
        self.buf = np.zeros((n + 31) // 8 * 8, dtype=np.uint8)  # keys are read 8 bytes at a time
        upper = raw - np.uint8(65) < 26
        special = None
        marked = np.zeros(len(texts), dtype=bool)
        for token in added if fine else ():
            marked |= np.asarray(pc.match_substring(texts, token))
        if marked.any():
            special = np.repeat(marked, np.diff(bounds))
            upper &= ~special
        buf = self.buf[:n]
        np.multiply(upper, np.uint8(32), out=buf, casting="unsafe")
        buf += raw
        space = (buf == 32) | (buf - np.uint8(9) < 5)
        first = np.empty(n, dtype=bool)
        first[:1] = True
        first[1:] = space[:-1]
        if fine and n:
            first[1:] |= _borders(buf, special)
        begins = bounds[:-1]
        first[begins[begins < n]] = True
        last = np.empty(n, dtype=bool)
        last[-1:] = True
        last[:-1] = first[1:] | space[1:]
        inside = ~space
        first &= inside
        last &= inside
        self.start = np.flatnonzero(first)
        self.length = np.flatnonzero(last)
        self.length -= self.start
        self.length += 1
        self.offsets = np.searchsorted(self.start, bounds)

    def __len__(self) -> int:
        return len(self.start)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Two numbers of 64 bits for each piece, equal for equal pieces."""
        k1, k2 = np.empty(len(self), dtype=np.uint64), np.empty(len(self), dtype=np.uint64)
        for k in range(0, len(self), _TOGETHER):
            part = slice(k, k + _TOGETHER)
            k1[part], k2[part] = _keys(self.buf, self.start[part], self.length[part])
        return k1, k2

    def strings(self, which: np.ndarray) -> list[str]:
        raw = self.buf.tobytes()
        return [raw[a : a + n].decode() for a, n in zip(self.start[which].tolist(), self.length[which].tolist(), strict=True)]


#: What stays of 8 bytes of which 0 to 8 belong to a piece.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_ODD1, _ODD2, _ODD3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _keys(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first 8 bytes, and the next 8 with the length; further ones are mixed into both."""
    aligned = buf[: len(buf) // 8 * 8].view("<u8")
    k1 = _eight(aligned, start)
    k1 &= _MASK.take(np.minimum(length, 8))
    k2 = _eight(aligned, start + 8)
    k2 &= _MASK.take(np.clip(length - 8, 0, 8))
    k2 ^= length.astype(np.uint64) * _ODD1
    at, more = np.flatnonzero(length > 16), 16
    while len(at):
        word = _eight(aligned, start[at] + more) & _MASK.take(np.clip(length[at] - more, 0, 8))
        k1[at] = mixed((k1[at] ^ word) * _ODD2)
        k2[at] = mixed(k2[at] * _ODD3 + word)
        more += 8
        at = at[length[at] > more]
    return k1, k2


def _eight(aligned: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, out of the two aligned words that they are in."""
    at = start >> 3
    bits = (start & 7).view(np.uint64) << np.uint64(3)
    out = aligned.take(at, mode="clip") >> bits
    high = aligned.take(at + 1, mode="clip") << np.uint64(1)
    high <<= np.uint64(63) - bits
    out |= high
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _ODD2
    x = (x ^ (x >> np.uint64(27))) * _ODD3
    return x ^ (x >> np.uint64(31))


def distinct(k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, inverse) of the distinct pairs of keys."""
    order = np.lexsort((k2, k1))
    new = np.ones(len(k1), dtype=bool)
    new[1:] = (k1[order[1:]] != k1[order[:-1]]) | (k2[order[1:]] != k2[order[:-1]])
    inverse = np.empty(len(k1), dtype=np.int64)
    inverse[order] = np.cumsum(new) - 1
    return order[new], inverse


def _borders(buf: np.ndarray, special: np.ndarray | None) -> np.ndarray:
    """Where a letter and punctuation meet: the border before byte 1, 2, ..."""
    kind = _KIND[buf]
    latin = (buf != 0x97) & (buf != 0xB7)  # with 0xC3 these two are no letters
    after_c3 = (kind[:-1] == _C3) & latin[1:]
    ends_letter = kind == _LETTER
    begins_letter = ends_letter.copy()
    ends_letter[1:] |= (kind[1:] == _TAIL) & after_c3
    begins_letter[:-1] |= after_c3
    punct = kind == _PUNCT
    border = (ends_letter[:-1] & punct[1:]) | (punct[:-1] & begins_letter[1:])
    if special is not None:
        border &= ~special[1:]
    return border


class PieceTable:
    """Slots 0, 1, ... of pieces by their keys: open addressing in arrays."""

    def __init__(self, bits: int = 15):
        self.bits, self.n = bits, 0
        self.slot = np.full(1 << bits, -1, dtype=np.int32)
        self.k1, self.k2 = np.zeros((2, 1 << bits - 1), dtype=np.uint64)

    def _home(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        x = (k1 ^ k2 * _ODD3) * _ODD1
        x ^= x >> np.uint64(29)
        x *= _ODD2
        x >>= np.uint64(64 - self.bits)
        return x.view(np.int64)

    def find(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """The slot of each piece, -1 for those that are not there."""
        out = np.empty(len(k1), dtype=np.int64)
        for k in range(0, len(k1), _TOGETHER):
            a, b = k1[k : k + _TOGETHER], k2[k : k + _TOGETHER]
            at = self._home(a, b)
            found = self.slot.take(at)
            same = (self.k1.take(found, mode="wrap") == a) & (self.k2.take(found, mode="wrap") == b)
            open_ = np.flatnonzero(~same & (found >= 0))
            while len(open_):
                at[open_] = at[open_] + 1 & (1 << self.bits) - 1
                next_ = self.slot.take(at[open_])
                found[open_] = next_
                same_ = (self.k1.take(next_, mode="wrap") == a[open_]) & (self.k2.take(next_, mode="wrap") == b[open_])
                open_ = open_[~same_ & (next_ >= 0)]
            out[k : k + _TOGETHER] = found
        return out

    def add(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """Give these pieces, distinct and new, the next slots."""
        while self.n + len(k1) > len(self.k1):
            self.k1, self.k2 = (np.concatenate([x, np.zeros_like(x)]) for x in (self.k1, self.k2))
            self.bits += 1
            self.slot = np.full(1 << self.bits, -1, dtype=np.int32)
            self._place(0, self.n)
        self.k1[self.n : self.n + len(k1)] = k1
        self.k2[self.n : self.n + len(k2)] = k2
        self._place(self.n, self.n + len(k1))
        self.n += len(k1)

    def _place(self, lo: int, hi: int) -> None:
        slots = np.arange(lo, hi, dtype=np.int32)
        at = self._home(self.k1[lo:hi], self.k2[lo:hi])
        while len(slots):
            free = self.slot[at] < 0
            self.slot[at[free]] = slots[free]  # of several at one place the last stays
            lost = self.slot[at] != slots
            slots, at = slots[lost], at[lost] + 1 & (1 << self.bits) - 1


class WordEncoder:
    """Ids of texts by way of a cache of pieces. Made once per worker and path."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        self.tok = load_tokenizer(path)
        if not cuts_at_white_space(self.tok):
            raise ValueError(f"{path}: its tokens depend on white space or case")
        self.added = added_tokens(self.tok)
        self.cache_words = cache_words
        suffix = getattr(self.tok.model, "end_of_word_suffix", None)
        vocabulary = self.tok.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        probe = [self.tok.encode(w, add_special_tokens=False).ids for w in ("a", "grüße", "aqxzjaqxzj", "ÿþ")]
        self.plain = all(self.ends[ids[-1]] and not self.ends[ids[:-1]].any() for ids in probe if ids)
        self.clear()

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def clear(self) -> None:
        self.table = PieceTable()
        self.ids = np.zeros(1 << 16, dtype=np.int32)
        self.used = 0
        self.start = np.zeros(1 << 14, dtype=np.int64)
        self.length = np.zeros(1 << 14, dtype=np.int64)

    def _ask(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, number): the library's ids of each piece, and where they are."""
        plain = np.fromiter(map(bool, map(_PLAIN.fullmatch, words)), dtype=bool, count=len(words))
        if not self.plain:
            plain[:] = False
        lens = np.empty(len(words), dtype=np.int64)
        first = np.empty(len(words), dtype=np.int64)
        flat = np.zeros(0, dtype=np.int32)
        if plain.any():  # all in one text: each word ends with a token that ends words
            text = " ".join(w for w, p in zip(words, plain.tolist(), strict=True) if p)
            flat = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.int32)
            ends = np.flatnonzero(self.ends.take(flat)) + 1
            first[plain] = np.append(0, ends[:-1])
            lens[plain] = ends - first[plain]
        others = np.flatnonzero(~plain)
        got = [e.ids for e in self.tok.encode_batch_fast([words[i] for i in others.tolist()], add_special_tokens=False)]
        lens[others] = list(map(len, got))
        first[others] = len(flat) + np.cumsum(lens[others]) - lens[others]
        return np.concatenate([flat, np.array([i for ids in got for i in ids], dtype=np.int32)]), first, lens

    def _add(self, words: list[str], k1: np.ndarray, k2: np.ndarray) -> None:
        """Give each of these new pieces a slot."""
        flat, first, lens = self._ask(words)
        n = self.table.n
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(words) > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.start[n : n + len(words)] = self.used + first
        self.length[n : n + len(words)] = lens
        self.table.add(k1, k2)
        self.used += len(flat)

    def find(self, found: Pieces, k1: np.ndarray, k2: np.ndarray, which: np.ndarray | None = None) -> np.ndarray:
        """The slots of these pieces (or of ``which`` of them), new ones included."""
        if self.table.n > self.cache_words or self.used > 8 * self.cache_words:
            self.clear()
        if which is not None:
            k1, k2 = k1[which], k2[which]
        at = self.table.find(k1, k2)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            first, inverse = distinct(k1[missing], k2[missing])
            new = missing[first]
            base = self.table.n
            for k in range(0, len(new), 20_000):
                part = new[k : k + 20_000]
                self._add(found.strings(part if which is None else which[part]), k1[part], k2[part])
            at[missing] = base + inverse
        return at

    def pieces(self, texts: pa.Array) -> Pieces:
        return Pieces(texts, added=self.added)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): ids offsets[i]:offsets[i+1] belong to text i."""
        found = self.pieces(texts)
        at = self.find(found, *found.keys())
        lens = self.length.take(at)
        total = np.zeros(len(lens) + 1, dtype=np.int64)
        np.cumsum(lens, out=total[1:])
        where = np.repeat(self.start.take(at) - total[:-1], lens)
        where += np.arange(total[-1])
        return total[found.offsets], self.ids.take(where)
