"""An adaptive context-mixing range coder for token ids, many blocks at a time.

A block of ids is coded by itself: its model starts anew from the prior of its
batch, so any block can be read alone. Three predictions of the next id are
mixed linearly. Order 0 is the distribution of ids in the batch. Order 1 and
order 2 each put their share on the id that last followed the same one or two
ids in this block. An id's probability is the sum of what the three give it, so
no part of the code space is spent twice. How large the shares are depends on
how often the two places that predict were right of late (their last three
outcomes, kept in the table) and on whether they agree; the prior holds the
shares that fit the batch. The interval drives a 48-bit range coder that passes
out 24 bits at a time; carries are settled at the end of the block.

The blocks of a batch advance in step, one id each: every line of the loops is
one array operation over all blocks, which is what makes the coder fast here.
"""

from __future__ import annotations

import zlib

import numpy as np

#: Ids of a block, and places of its order-1 and order-2 tables.
BLOCK, PLACES = 2048, 512
#: Blocks of a batch at most; bounds memory (some 25 kB a block).
LANES = 4096
_SHIFT = 32 - PLACES.bit_length() + 1
_HASH1, _HASH2 = 2654435761, 40503
_WORD, _TOP = 24, 1 << 24
#: Pairs of outcomes of the two places, apart and in agreement.
_CONTEXTS = 128
#: Steps that are worked on together, and every so many looked at for the shares.
_CHUNK, _LOOKED_AT = 32, 4


class Prior:
    """What every block of a batch starts from.

    ``ids`` are the batch's distinct ids, ``freq`` their parts of 2**bits, and
    ``share1`` and ``share2`` the parts of 2**scale that order 1 and order 2
    get in each context. Order 0 keeps 2**bits of 2**scale at least, so each id
    has an interval of its own.
    """

    def __init__(self, ids: np.ndarray, freq: np.ndarray, shares: np.ndarray):
        self.ids = ids
        self.bits, self.scale = _scales(len(ids))
        self.cum = np.append(0, np.cumsum(freq)).astype(np.int64)
        self.freq = freq
        self.shares = shares
        self.share2, self.share1 = (shares[k].astype(np.int64) << self.scale - 16 for k in (0, 1))

    @classmethod
    def counted(cls, ids: np.ndarray, counts: np.ndarray) -> Prior:
        total = 1 << _scales(len(ids))[0]
        freq = 1 + counts * (total - len(ids)) // counts.sum()
        freq[counts.argmax()] += total - freq.sum()
        return cls(ids, freq, np.zeros((2, _CONTEXTS), dtype=np.uint16))

    def with_shares(self, seen: np.ndarray, right2: np.ndarray, right1: np.ndarray) -> Prior:
        """Shares from how often each context was seen and each order was right."""
        most = (1 << 16) - (1 << 16 - (self.scale - self.bits))
        two, one = (x / (seen + 4.0) for x in (right2, right1))
        one[_CONTEXTS // 2 :] = 0  # where they agree, order 2 has the share of both
        parts = np.stack([two, one]) * np.minimum(most / (1 << 16) / np.maximum(two + one, 1e-9), 1)
        return Prior(self.ids, self.freq, np.minimum((parts * (1 << 16)).astype(np.int64), most).astype(np.uint16))

    def to_bytes(self) -> bytes:
        gaps = np.diff(self.ids, prepend=0)
        head = np.array([len(self.ids)], dtype="<u4").tobytes() + self.shares.astype("<u2").tobytes()
        return zlib.compress(head + _columns(gaps) + _columns(self.freq), 6)

    @classmethod
    def from_bytes(cls, raw: bytes) -> Prior:
        raw = zlib.decompress(raw)
        n = int(np.frombuffer(raw, "<u4", 1)[0])
        shares = np.frombuffer(raw, "<u2", 2 * _CONTEXTS, 4).reshape(2, _CONTEXTS)
        bytes_ = np.frombuffer(raw, np.uint8, 8 * n, 4 + 4 * _CONTEXTS).reshape(2, 4, n)
        gaps, freq = (np.ascontiguousarray(x.T).view("<u4").ravel().astype(np.int64) for x in bytes_)
        return cls(np.cumsum(gaps), freq, shares)


def _columns(numbers: np.ndarray) -> bytes:
    """All lowest bytes first, then the next ones: small numbers compress."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _scales(distinct: int) -> tuple[int, int]:
    bits = min(max(16, distinct.bit_length() + 2), 22)
    return bits, min(bits + 3, 24)


def encode_blocks(ids: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """(priors, blocks) of ``ids`` (0 to 2**31 - 1): one block for each BLOCK
    ids, the last filled up, and one prior for each LANES blocks."""
    if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < 1 << 31:
        raise ValueError("ids must be 0 to 2**31 - 1")
    priors, blocks = [], []
    for k in range(0, len(ids), BLOCK * LANES):
        prior, some = _encode(ids[k : k + BLOCK * LANES])
        priors.append(prior)
        blocks += some
    return priors, blocks


def _dense(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ids, the place of each id among them, and their counts."""
    top = int(ids.max()) + 1
    if top > 1 << 24:
        return np.unique(ids, return_inverse=True, return_counts=True)
    counts = np.bincount(ids, minlength=top)
    there = np.flatnonzero(counts)
    place = np.zeros(top, dtype=np.int32)
    place[there] = np.arange(len(there))
    return there, place[ids], counts[there]


def _encode(ids: np.ndarray) -> tuple[bytes, list[bytes]]:
    distinct, place, counts = _dense(ids)
    prior = Prior.counted(distinct, counts)
    lanes = -(-len(ids) // BLOCK)
    padded = np.zeros(lanes * BLOCK, dtype=np.int32)
    padded[: len(ids)] = place
    steps = np.ascontiguousarray(padded.reshape(lanes, BLOCK).T)
    told1, told2 = _predictions(steps)
    prior = _fitted(prior, steps, told1, told2)
    return prior.to_bytes(), _coded(prior, steps, told1, told2)


def _predictions(steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the order-1 and order-2 tables hold before each id: the id that
    they predict times 8, and the last three outcomes of this place."""
    lanes = steps.shape[1]
    at = np.arange(lanes, dtype=np.int64) * PLACES
    one, two = np.zeros(lanes * PLACES, dtype=np.int32), np.zeros(lanes * PLACES, dtype=np.int32)
    told1, told2 = np.empty_like(steps), np.empty_like(steps)
    old1 = old2 = np.zeros(lanes, dtype=np.int64)
    right, turned = np.empty(lanes, dtype=bool), np.empty(lanes, dtype=np.int32)
    for k in range(0, len(steps), _CHUNK):
        part = steps[k : k + _CHUNK]
        hashed = part * np.int64(_HASH1) & 0xFFFFFFFF
        before = np.concatenate([old1[None], hashed[:-1]])
        further = np.concatenate([old2[None], before[:-1]])
        place1 = (before >> _SHIFT) + at
        place2 = ((before + further * _HASH2 & 0xFFFFFFFF) >> _SHIFT) + at
        old1, old2 = hashed[-1], before[-1]
        eight = part << 3
        for j in range(len(part)):
            for table, places, told in ((one, place1[j], told1[k + j]), (two, place2[j], told2[k + j])):
                table.take(places, out=told, mode="clip")
                np.right_shift(told, 3, out=turned)
                np.equal(turned, part[j], out=right)
                np.left_shift(told, 1, out=turned)
                turned &= 6
                turned += right
                turned += eight[j]
                table[places] = turned
    return told1, told2


def _context(told1: np.ndarray, told2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The two predicted ids and the context of their shares."""
    id1, id2 = told1 >> 3, told2 >> 3
    context = (told2 & 7) << 3
    context |= told1 & 7
    context += (id1 == id2) * np.int32(_CONTEXTS // 2)
    return id1, id2, context


def _fitted(prior: Prior, steps: np.ndarray, told1: np.ndarray, told2: np.ndarray) -> Prior:
    seen, right2, right1 = np.zeros((3, _CONTEXTS))
    for k in range(0, len(steps), _CHUNK * _LOOKED_AT):
        some = slice(k, k + _CHUNK * _LOOKED_AT, _LOOKED_AT)
        id1, id2, context = _context(told1[some], told2[some])
        seen += np.bincount(context.ravel(), minlength=_CONTEXTS)
        right2 += np.bincount(context[id2 == steps[some]], minlength=_CONTEXTS)
        right1 += np.bincount(context[id1 == steps[some]], minlength=_CONTEXTS)
    return prior.with_shares(seen, right2, right1)


def _coded(prior: Prior, steps: np.ndarray, told1: np.ndarray, told2: np.ndarray) -> list[bytes]:
    lanes, scale, bits = steps.shape[1], prior.scale, prior.bits
    room = BLOCK + 2
    out = np.zeros(lanes * room, dtype=np.uint32)
    first = np.arange(lanes, dtype=np.int64) * room
    at = first.copy()
    low = np.zeros(lanes, dtype=np.int64)
    span = np.full(lanes, (1 << 48) - 1, dtype=np.int64)
    keep = np.array([-1, _TOP - 1], dtype=np.int64)
    work, short = np.empty_like(low), np.empty(lanes, dtype=bool)
    passed = short.view(np.int8)
    for k in range(0, len(steps), _CHUNK):
        ids = steps[k : k + _CHUNK]
        id1, id2, context = _context(told1[k : k + _CHUNK], told2[k : k + _CHUNK])
        share1, share2 = prior.share1.take(context), prior.share2.take(context)
        rest = (1 << scale) - share1 - share2
        start = prior.cum.take(ids) * rest >> bits
        width = (prior.cum.take(ids + 1) * rest >> bits) - start
        start += share1 * (id1 < ids)
        start += share2 * (id2 < ids)
        width += share1 * (id1 == ids)
        width += share2 * (id2 == ids)
        for j in range(len(ids)):
            span >>= scale
            np.multiply(span, start[j], out=work)
            low += work
            span *= width[j]
            np.less(span, _TOP, out=short)
            np.right_shift(low, _WORD, out=work)
            out[at] = work
            at += short
            low &= keep.take(passed)
            np.multiply(passed, _WORD, out=work)
            low <<= work
            span <<= work
    # a word with nothing behind it lies within every last interval
    out[at] = (low + (_TOP - 1)) >> _WORD
    used = at + 1 - first
    words = out.reshape(lanes, room)[:, : int(used.max())]
    words[np.arange(words.shape[1])[None, :] >= used[:, None]] = 0
    words = np.ascontiguousarray(words.T)
    for k in range(len(words) - 1, 0, -1):
        words[k - 1] += words[k] >> _WORD
    raw = np.ascontiguousarray(words.T).astype(">u4").view(np.uint8).reshape(lanes, -1, 4)[:, :, 1:]
    raw = np.ascontiguousarray(raw).reshape(lanes, -1)
    return [row[: 3 * n].tobytes() for row, n in zip(raw, used.tolist(), strict=True)]


def decode_blocks(priors: list[bytes], blocks: list[bytes]) -> np.ndarray:
    """The ids of these blocks, one row of BLOCK ids for each."""
    parts = [_decode(Prior.from_bytes(p), blocks[k * LANES : (k + 1) * LANES]) for k, p in enumerate(priors)]
    return np.concatenate(parts) if parts else np.zeros((0, BLOCK), dtype=np.int64)


def _decode(prior: Prior, blocks: list[bytes]) -> np.ndarray:
    lanes, scale, bits = len(blocks), prior.scale, prior.bits
    room = max(map(len, blocks)) + 6
    raw = np.zeros((lanes, room), dtype=np.uint8)
    for i, b in enumerate(blocks):
        raw[i, : len(b)] = np.frombuffer(b, dtype=np.uint8)
    words = raw.reshape(-1, 3).astype(np.int64)
    words = words[:, 0] << 16 | words[:, 1] << 8 | words[:, 2]
    lane = np.arange(lanes, dtype=np.int64)
    at = lane * (room // 3)
    code = words.take(at) << _WORD | words.take(at + 1)
    at += 2
    span = np.full(lanes, (1 << 48) - 1, dtype=np.int64)
    spread = np.repeat(np.arange(len(prior.ids), dtype=np.int32), np.diff(prior.cum))  # a part of 2**bits to its id
    cum, shares1, shares2 = prior.cum, prior.share1, prior.share2
    base = lane * PLACES
    one, two = np.zeros(lanes * PLACES, dtype=np.int32), np.zeros(lanes * PLACES, dtype=np.int32)
    before, further = np.zeros(lanes, dtype=np.int64), np.zeros(lanes, dtype=np.int64)
    steps = np.empty((BLOCK, lanes), dtype=np.int32)
    last, part = (1 << scale) - 1, float(1 << bits)
    for t in range(BLOCK):
        place1 = before >> _SHIFT
        place1 += base
        further *= _HASH2
        further += before
        further &= 0xFFFFFFFF
        further >>= _SHIFT
        further += base
        told1, told2 = one.take(place1), two.take(further)
        id1, id2, context = _context(told1, told2)
        share1, share2 = shares1.take(context), shares2.take(context)
        rest = (1 << scale) - share1
        rest -= share2
        span >>= scale
        # both are below 2**48, so the quotient in double precision rounds down right
        value = (code / span).astype(np.int64)
        np.minimum(value, last, out=value)
        first1, first2 = cum.take(id1), cum.take(id2)
        first1 *= rest
        first1 >>= bits
        first2 *= rest
        first2 >>= bits
        first1 += share2 * (id2 < id1)
        first2 += share1 * (id1 < id2)
        np.subtract(value, first1, out=first1)
        np.subtract(value, first2, out=first2)
        past1, past2 = first1 >= share1, first2 >= share2
        here1 = (first1 >= 0) & ~past1
        here2 = (first2 >= 0) & ~past2
        value -= share1 * past1
        value -= share2 * past2
        value += 1
        scaled = value * part
        scaled -= 1
        scaled /= rest
        ids = spread.take(scaled.astype(np.int64), mode="clip")
        np.copyto(ids, id1, where=here1)
        np.copyto(ids, id2, where=here2)
        start = cum.take(ids)
        start *= rest
        start >>= bits
        width = cum.take(ids + 1)
        width *= rest
        width >>= bits
        width -= start
        start += share1 * (id1 < ids)
        start += share2 * (id2 < ids)
        right1, right2 = id1 == ids, id2 == ids
        width += share1 * right1
        width += share2 * right2
        start *= span
        code -= start
        span *= width
        short = span < _TOP
        shift = short * np.int64(_WORD)
        code <<= shift
        span <<= shift
        code += words.take(at, mode="clip") * short
        at += short
        steps[t] = ids
        eight = ids << 3
        told1 <<= 1
        told1 &= 6
        told1 += right1
        told1 += eight
        one[place1] = told1
        told2 <<= 1
        told2 &= 6
        told2 += right2
        told2 += eight
        two[further] = told2
        further = before
        before = ids * np.int64(_HASH1)
        before &= 0xFFFFFFFF
    return prior.ids[steps.T]
