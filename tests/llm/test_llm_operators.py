"""Every operator against a plain version, on texts that are hard in some way."""

import collections
import hashlib
import heapq
import json
import math
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerline.llm import binary, chat, common, counts, exactdup, neardup, packing, quality, rangecoder, sharding, toxicity, treebpe, words
from ledgerline.llm.queries import TOKENIZER

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, size int, digest string, node string, `rank` string, `group` string, score string, `_whole` string, label int"


def texts():
    r = random.Random(11)
    vocabulary = ["the", "of", "Thention", "réeux", "ß", "don't", "x's", "!!", "%%%", "1,234.5", "日本語", "😀", "<|endoftext|>", "İ", "é"]
    out = [None, "", " ", "\n\t ", "a", "a b", "A  B", "a b", "x" * 5000, "<|endoftext|>", "a<|endoftext|>.b", "é ́", "ΣΑΣ."]
    for n in (3, 10, 60, 300, 2500):
        for _ in range(4):
            out.append("".join(r.choice(vocabulary) + r.choice([" ", "  ", "\n", " ", ""]) for _ in range(n)))
    base = [r.choice(["alpha", "beta", "gamma", "delta"]) + str(r.randint(0, 99)) for _ in range(120)]
    for k in (0, 1, 2, 4, 6, 8, 30):
        other = list(base)
        for at in r.sample(range(120), k):
            other[at] = f"w{r.random()}"
        out.append(" ".join(other))
    return out + out[10:20] + ["a  b", "a\tb"]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, t, 1, "d", "n", "r", "g", "s", "w", 0) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids."""
    rows = [(None, "a b c"), (None, "a b c"), (1, "a b c"), (1, "a b c"), (2, None), (2, "x y"), (None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(TOKENIZER)


def encoded(tok, end=()):
    return {i: tok.encode(t or "", add_special_tokens=False).ids + list(end) for i, t in enumerate(texts())}


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_word_encoder_equals_the_library(tok):
    every = texts() + ["é.É!ü—.a", "é.≠b", "×.÷a'S'Re", "a b\x1cd\x85e", "5.5a's'", "<|a.b", "A<|ENDOFTEXT|>"]
    offsets, ids = words.WordEncoder(TOKENIZER, cache_words=50).encode(pa.array(every, pa.string())[1:])
    for i, t in enumerate(every[1:]):
        assert tok.encode(t or "", add_special_tokens=False).ids == ids[offsets[i] : offsets[i + 1]].tolist(), t


def test_word_encoder_grows(tok):
    many = [f"w{i}x" for i in range(20_000)]
    offsets, ids = words.WordEncoder(TOKENIZER).encode(pa.array(many + many[::-1]))
    want = [len(e.ids) for e in tok.encode_batch(many, add_special_tokens=False)]
    assert np.diff(offsets).tolist() == want + want[::-1]


@pytest.mark.parametrize("fine", [True, False])
def test_keys_tell_pieces_apart(fine):
    r = random.Random(5)
    many = ["".join(r.choice("ab") for _ in range(r.choice([1, 2, 7, 8, 9, 15, 16, 17, 24, 25, 40]))) for _ in range(3000)]
    many += ["a\0", "a", "a\0\0", "é" * 9, "é" * 8 + "e", "A" * 20, "a" * 20]
    found = words.Pieces(pa.array([" ".join(many), None, "", " "]), fine)
    assert found.offsets.tolist() == [0, len(many)] + [len(many)] * 3
    assert found.strings(np.arange(len(many))) == [x.lower() for x in many]
    keys = list(zip(*(k.tolist() for k in found.keys()), strict=True))
    by = collections.defaultdict(set)
    for k, x in zip(keys, many, strict=True):
        by[k].add(x.lower())
    assert all(len(x) == 1 for x in by.values()) and len(by) == len({x.lower() for x in many})
    table = words.PieceTable(4)
    first, inverse = words.distinct(*found.keys())
    half = first[: len(first) // 2]
    k1, k2 = found.keys()
    for k in range(0, len(half), 100):
        table.add(k1[half[k : k + 100]], k2[half[k : k + 100]])
    assert table.find(k1, k2).tolist() == [i if i < len(half) else -1 for i in inverse.tolist()]


def test_a_cased_tokenizer_is_refused(tmp_path):
    from tokenizers import models, pre_tokenizers

    cased = Tokenizer(models.WordLevel({"a": 1, "b": 2, "[UNK]": 0, "A": 5, "B": 6}, unk_token="[UNK]"))
    cased.pre_tokenizer = pre_tokenizers.Whitespace()
    cased.save(str(tmp_path / "cased.json"))
    assert not words.cuts_at_white_space(Tokenizer.from_file(str(tmp_path / "cased.json")))


def test_word_encoder_refuses_tokenizers_that_keep_white_space():
    with pytest.raises(ValueError):
        words.WordEncoder(TOKENIZER.replace("word_bpe_49k", "byte_bpe_50k"))


def test_counts(corpus, odd, empty, tok):
    got = {r["doc_id"]: r for r in counts.count_tokens(corpus, TOKENIZER, 100).collect()}
    want = encoded(tok)
    assert {i: r["n_tokens"] for i, r in got.items()} == {i: len(x) for i, x in want.items()}
    assert all(r["over_limit"] == (r["n_tokens"] > 100) for r in got.values())
    assert {i: r["n_bytes"] for i, r in got.items()} == {i: len((t or "").encode()) for i, t in enumerate(texts())}
    assert counts.count_tokens(odd, TOKENIZER).count() == 7 and counts.count_tokens(empty, TOKENIZER).count() == 0


def test_frequent_lengths(tok):
    r = random.Random(3)
    many = [f"w{i}x" for i in range(40_000)] + ["often", "more's"] * 50
    r.shuffle(many)
    table, lens = counts.frequent_lengths([" ".join(many), None], TOKENIZER, 3)
    k1, k2 = words.Pieces(pa.array(["often more's w1x"])).keys()
    at = table.find(k1, k2)
    assert table.n == 3 and (at[:2] >= 0).all()
    assert lens[at[:2]].tolist() == [len(tok.encode(w, add_special_tokens=False).ids) for w in ("often", "more's")]
    assert counts.frequent_lengths([], TOKENIZER)[0].n == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_of_other_tokenizers(corpus, name):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(sp.encode(t))
    else:
        other = Tokenizer.from_file(path)
        count = lambda t: len(other.encode(t, add_special_tokens=False).ids)
    got = {r["doc_id"]: r["n_tokens"] for r in counts.count_tokens(corpus, path).collect()}
    assert got == {i: count(t or "") for i, t in enumerate(texts())}


def test_tree_encoding(corpus, odd, empty, tok):
    got = {r["doc_id"]: r for r in treebpe.encode_decode(corpus, TOKENIZER, leaf=700).collect()}
    for i, ids in encoded(tok).items():
        assert got[i]["ids"] == ids and got[i]["decoded"] == tok.decode(ids, skip_special_tokens=False)
    assert treebpe.encode_decode(odd, TOKENIZER).count() == 7 and treebpe.encode_decode(empty, TOKENIZER).count() == 0


def test_tree_encoding_of_long_texts(spark, tok):
    """Giant, unsplit and oddly cut texts, with ids that are null or repeated."""
    r = random.Random(4)
    many = ["x" * 3000 + " " + "y" * 90, " " * 2000, "a b " * 500, "".join(r.choice("abé <|endoftext|>'1") for _ in range(5000)), ("<|endoftext|>" + "q" * 50) * 40, "né" * 4000]
    rows = [(None if k % 3 == 0 else 5, t) for k, t in enumerate(many)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["n_tokens"], r["ids"], r["decoded"]) for r in treebpe.encode_decode(docs, TOKENIZER, leaf=100).collect())
    want = sorted((len(i), i, tok.decode(i, skip_special_tokens=False)) for i in (tok.encode(t, add_special_tokens=False).ids for t in many))
    assert got == want


def test_tree_encoding_of_a_giant_text(spark):
    """One text of 50 MB; its ids are those of its parts between spaces."""
    part = " ".join(f"house{k} of the réeux'{k}" for k in range(2000)) + " "
    n = 50_000_000 // len(part.encode()) + 1
    docs = spark.createDataFrame([(1, part)], "doc_id long, text string").select("doc_id", F.repeat("text", F.lit(n)).alias("text"))
    row = treebpe.encode_decode(docs, TOKENIZER).select("n_tokens", F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("h")).first()
    one = Tokenizer.from_file(TOKENIZER).encode(part, add_special_tokens=False).ids
    assert row["n_tokens"] == n * len(one)
    assert row["h"] == hashlib.sha256(" ".join([" ".join(map(str, one))] * n).encode()).hexdigest()


def test_joining_halves_equals_whole_encoding(tok):
    r = random.Random(2)
    parts = ["the", " ", "and", "'s", "'", "!!", "é", "é", "́", "a" * 30, "x" * 50, "1", "—", "<|endoftext|>", "\n", "Ü", "'ll", "日本", "😀"]
    for trial in range(200):
        t = "".join(r.choice(parts) for _ in range(r.randint(5, 400)))
        if trial % 3 == 0:
            t = "".join(r.choice("abcdeghinorst") for _ in range(r.randint(100, 3000)))
        cuts = [*range(0, len(t), r.choice([64, 100, 300])), len(t)]
        leaves = [treebpe.encode_span(tok, t, a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
        assert treebpe.join_tree(tok, t, leaves, cuts)[:, 0].tolist() == tok.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("kind", ["none", "one", "same", "cycle", "random", "zipf", "large", "distinct"])
def test_range_coder_round_trip(kind, monkeypatch):
    r = np.random.default_rng(0)
    x = {
        "none": np.zeros(0, dtype=np.int64),
        "one": np.array([0]),
        "same": np.full(6000, 65535),
        "cycle": np.array([1, 2, 3] * 3000),
        "random": r.integers(0, 65536, 9000),
        "zipf": r.zipf(1.3, 9000) % 65536,
        "large": r.integers(0, 1 << 31, 9000),
        "distinct": r.permutation(300_000),
    }[kind]
    monkeypatch.setattr(rangecoder, "LANES", 3)
    n = rangecoder.BLOCK
    priors, blocks = rangecoder.encode_blocks(x)
    assert rangecoder.decode_blocks(priors, blocks).ravel()[: len(x)].tolist() == x.tolist()
    if len(blocks) > 1:  # a block can be read alone
        assert rangecoder.decode_blocks(priors[:1], blocks[1:2]).ravel().tolist()[: len(x) - n] == x[n : 2 * n].tolist()
    if len(set(x.tolist())) < 5 and len(x) > 1000:
        assert sum(map(len, blocks)) < len(x) / 4


def test_range_coder_refuses_other_numbers():
    for x in (-1, 1 << 31):
        with pytest.raises(ValueError):
            rangecoder.encode_blocks(np.array([x]))


def test_range_coder_beats_plain_models(tok):
    """Fewer bits an id than zlib and than adaptive order 0 on the same blocks."""
    docs = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    ids = np.array([i for t in docs for i in tok.encode(t or "", add_special_tokens=False).ids])
    n = rangecoder.BLOCK
    priors, blocks = rangecoder.encode_blocks(ids)
    packed = sum(len(zlib.compress(ids[k : k + n].astype("<u2").tobytes(), 9)) for k in range(0, len(ids), n))
    order0 = 0.0  # code length of counts with escapes to the whole vocabulary
    for k in range(0, len(ids), n):
        seen = collections.Counter()
        for t, i in enumerate(ids[k : k + n].tolist()):
            order0 -= math.log2(seen[i] / (t + len(seen) + 1) if seen[i] else (len(seen) + 1) / (t + len(seen) + 1) / 49408)
            seen[i] += 1
    assert sum(map(len, priors + blocks)) < min(packed, order0 / 8)


def test_mixing_beats_order_0():
    """Repeated phrases cost far less than what order 0 alone needs."""
    r = np.random.default_rng(1)
    phrases = [r.integers(0, 5000, 12) for _ in range(40)]
    ids = np.concatenate([phrases[k] for k in r.integers(0, 40, 4000)])
    priors, blocks = rangecoder.encode_blocks(ids)
    share = np.bincount(ids)[np.unique(ids)] / len(ids)
    assert sum(map(len, blocks)) * 8 < -(share * np.log2(share)).sum() * len(ids) * 0.5


def test_token_files(spark, corpus, odd, empty, tok, monkeypatch):
    folder = binary.write_tokens(corpus, TOKENIZER, 1)
    got = sorted(binary.checksums(binary.read_tokens(spark, folder)).collect())
    at, want = 0, []
    for i, ids in encoded(tok, [1]).items():
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert [tuple(r) for r in got] == want
    assert binary.read_tokens(spark, binary.write_tokens(odd, TOKENIZER, 1)).count() == 7
    assert binary.read_tokens(spark, binary.write_tokens(empty, TOKENIZER, 1)).count() == 0


def test_token_files_of_other_ids(spark, tok):
    docs = spark.createDataFrame([("b", "x y"), (None, ""), ("a", None)], "doc_id string, text string")
    got = binary.read_tokens(spark, binary.write_tokens(docs, TOKENIZER, 1)).collect()
    assert [(r["doc_id"], r["start"]) for r in sorted(got, key=lambda r: r["start"])] == [(None, 0), ("a", 1), ("b", 2)]


def frame_of(batch):
    return {n: batch[n][0] for n in batch.schema.names} | {"frame": pa.scalar(0)}


def test_damaged_block_is_found():
    frame = frame_of(binary._frame([pa.array([1])], np.array([3000]), np.arange(3000, dtype=np.int32), 0))
    payload = frame["payload"].as_py()
    frame["payload"] = pa.scalar(payload[:100] + b"\0\0" + payload[102:])
    with pytest.raises(ValueError, match="CRC-32"):
        binary._decoded({0: 0}, frame)


def test_frames_know_their_place():
    ids = np.arange(450, dtype=np.int32)
    got = binary._decoded({0: 1000}, frame_of(binary._frame([pa.array([7, 8]), pa.array([9])], np.array([90, 300, 60]), ids, 5))).to_pylist()
    assert [(r["doc_id"], r["start"], r["n_tokens"]) for r in got] == [(7, 1005, 90), (8, 1095, 300), (9, 1395, 60)]
    assert np.frombuffer(b"".join(r["ids"] for r in got), dtype="<u4").tolist() == ids.tolist()


def test_packing(corpus, odd, empty, tok):
    got = packing.pack(packing.token_pieces(corpus, TOKENIZER, 0, 64), 64).collect()
    want = {(i, k // 64): (k, len(ids[k : k + 64]), crc(ids[k : k + 64])) for i, ids in encoded(tok, [0]).items() for k in range(0, len(ids), 64)}
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in sequences.values():
        ends = 0
        for offset, length in sorted(placed):
            assert offset == ends
            ends += length
        assert ends <= 64
    least = -(-sum(x[1] for x in want.values()) // 64)
    assert len(sequences) <= least + 1
    assert packing.pack(packing.token_pieces(odd, TOKENIZER)).count() == 7 and packing.pack(packing.token_pieces(empty, TOKENIZER)).count() == 0


def fewest(lengths, capacity):
    """A lower bound on sequences: pieces over half each need one, and what they
    leave holds only so much of the others."""
    best = 0
    for k in range(capacity // 2 + 1):
        alone = sum(n for x, n in lengths.items() if x > capacity - k)
        over = {x: n for x, n in lengths.items() if capacity / 2 < x <= capacity - k}
        rest = sum(x * n for x, n in lengths.items() if k <= x <= capacity / 2)
        room = sum((capacity - x) * n for x, n in over.items())
        best = max(best, alone + sum(over.values()) + max(0, -(-(rest - room) // capacity)))
    return best


def sequences(runs):
    return len({first + i for _, _, n, first, _ in runs for i in range(n)})


@pytest.mark.parametrize("seed", range(6))
def test_packing_is_near_the_bound_and_never_above_best_fit(seed):
    """Mixes of lengths of a capacity of 100, half of them 34 to 60."""
    r = random.Random(seed)
    lengths = collections.Counter(r.choice([r.randint(1, 100), r.randint(34, 60)]) for _ in range(r.choice([50, 3000, 30000])))
    rows = np.array([lengths[k] for k in range(101)])
    *_, (_, bound) = packing.solve(rows, 100, packing.LOOK)
    used = sequences(packing.plan(dict(lengths), 100))
    assert sum(k * n for k, n in lengths.items()) / 100 - 1e-6 <= bound <= used + 1e-6
    assert used <= 1.01 * bound + 1 and used <= packing._filled(rows, {}, 100)[1]


def test_packing_at_the_production_capacity():
    r = random.Random(1)
    lengths = collections.Counter(r.choice([r.randint(1, 2048), r.randint(700, 1230)]) for _ in range(20000))
    rows = np.array([lengths[k] for k in range(2049)])
    bound = float(packing.dual_weights(rows, 2048) @ rows)
    assert bound <= sequences(packing.plan(dict(lengths))) <= 1.01 * bound + 1


@pytest.mark.parametrize("capacity", [7, 12, 30])
def test_dual_weights_never_weigh_a_sequence_over_one(capacity):
    r = np.random.default_rng(capacity)
    for _ in range(40):
        counts = r.integers(0, 50, capacity + 1)
        counts[0] = 0
        weights = packing.dual_weights(counts, capacity)
        assert weights[packing.priced(weights, capacity)].sum() <= 1 + 1e-9


def test_a_program_beats_best_fit_where_it_can():
    """Pairs of 51 + 49 and triples of 34 + 33 + 33 that best fit mixes up."""
    lengths = {51: 400, 49: 400, 34: 600, 33: 1200}
    rows = np.array([lengths.get(k, 0) for k in range(101)])
    assert sequences(packing.plan(lengths, 100)) <= min(1001, packing._filled(rows, {}, 100)[1])


def test_packing_plan_covers_every_piece():
    r = random.Random(3)
    for _ in range(5):
        lengths = collections.Counter(r.choice([r.randint(1, 100), r.randint(40, 60), 100]) for _ in range(r.randint(1, 3000)))
        runs = packing.plan(dict(lengths), 100)
        fill, seen = collections.Counter(), collections.defaultdict(set)
        for length, rank, n, first, offset in runs:
            for i in range(n):
                assert rank + i not in seen[length]
                seen[length].add(rank + i)
                fill[first + i] += length
        assert {k: len(v) for k, v in seen.items()} == lengths and max(fill.values()) <= 100
        assert len(fill) <= 1.02 * fewest(lengths, 100) + 2


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def groups_of(rows):
    out = collections.defaultdict(list)
    for i, t in rows:
        out[normal(t)].append(i)
    return out


def weak(text):
    return F.substring(F.sha2(text, 256), 1, 1)


@pytest.mark.parametrize("digest", [None, weak])
def test_exact_duplicates(corpus, digest):
    rows = list(enumerate(texts()))
    group = groups_of(rows)
    found = exactdup.exact_duplicates(corpus, digest) if digest else exactdup.exact_duplicates(corpus)
    got = {r["doc_id"]: tuple(r)[1:] for r in found.collect()}
    assert got == {
        i: (min(group[normal(t)]), len(group[normal(t)]), i == min(group[normal(t)]), hashlib.sha256(normal(t).encode()).hexdigest()) for i, t in rows
    }


def test_exact_duplicates_of_odd_rows(odd, empty):
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exactdup.exact_duplicates(odd).collect()), key=str)
    assert got == sorted([(None, 1, 4, False)] * 2 + [(1, 1, 4, True)] * 2 + [(2, 2, 2, True), (2, 2, 1, True), (None, 2, 2, False)], key=str)
    assert exactdup.keep_first(odd).count() == 4 and exactdup.exact_duplicates(empty).count() == 0 and exactdup.keep_first(empty).count() == 0


def test_state_goes_on_where_it_stopped(spark, tmp_path):
    folder = f"file://{tmp_path}/landed"
    rows = lambda *ids: spark.createDataFrame([("d", i, "f") for i in ids], "digest string, doc_id long, locator string")
    rows(5, 7).write.parquet(folder)
    landed = spark.read.parquet(folder)
    assert [(r["keep"]["doc_id"], r["group_size"]) for r in exactdup.fold_digests(landed, folder).collect()] == [(5, 2)]
    rows(3).write.mode("append").parquet(folder)
    assert [(r["keep"]["doc_id"], r["group_size"]) for r in exactdup.fold_digests(landed, folder).collect()] == [(3, 3)]


def test_sharding(corpus, odd, empty):
    got = sharding.shard_documents(corpus, 3).collect()
    rows = dict(enumerate(texts()))
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows.items()}
    by_text, slots, loads = collections.defaultdict(set), collections.defaultdict(list), collections.Counter()
    for r in got:
        by_text[rows[r["doc_id"]] or ""].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
        loads[r["shard"]] += r["size"]
    assert all(len(s) == 1 for s in by_text.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(odd).count() == 7 and sharding.shard_documents(empty).count() == 0


def test_sharding_is_as_even_as_plain_scheduling(spark):
    """Against groups one by one, largest first, to the least-loaded shard; with ties and copies."""
    r = random.Random(14)
    rows = [("x" * r.choice([5, 5, 40, r.randint(1, 3000)])) + r.choice("abcdefgh") + str(r.randint(0, 400)) for _ in range(2500)]
    rows += ["copied " * 20] * 60
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(5)
    loads, groups = collections.Counter(), collections.Counter()
    for row in sharding.shard_documents(docs, 4).collect():
        loads[row["shard"]] += row["size"]
    for t in rows:
        groups[t] += len(t) + 1
    heap = [0] * 4
    for size in sorted(groups.values(), reverse=True):
        heapq.heapreplace(heap, heap[0] + size)
    assert sum(loads.values()) == sum(heap)
    assert max(loads.values()) <= max(heap) * 1.005 and min(loads.values()) >= min(heap) * 0.995


def test_dealing_is_even():
    r = random.Random(4)
    sizes = sorted((r.randint(1, 10_000) for _ in range(5000)), reverse=True)
    classes = [(-s, n, float(s)) for s, n in sorted(collections.Counter(sizes).items(), reverse=True)]
    loads, seen = collections.Counter(), 0
    runs = sharding.deal(classes, 8)
    for (c, rank, turn), following in zip(runs, [*runs[1:], None], strict=True):
        n = next(n for k, n, _ in classes if k == c)
        end = following[1] if following and following[0] == c else n
        for i in range(rank, end):
            loads[turn[(i - rank) % len(turn)]] += -c
            seen += 1
    assert seen == 5000 and max(loads.values()) - min(loads.values()) <= 10_000


def shingles(t, k):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return frozenset() if not w else frozenset([tuple(w)]) if len(w) < k else frozenset(zip(*(w[i:] for i in range(k)), strict=False))


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(corpus, k):
    sets = {i: shingles(t, k) for i, t in enumerate(texts())}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    got = {r["doc_id"]: tuple(r)[1:] for r in neardup.near_duplicates(corpus, k).collect()}
    assert got == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def test_near_duplicates_of_odd_rows(odd, empty):
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(odd, 2).collect()), key=str)
    assert got == sorted([(None, 1, False)] * 2 + [(1, 1, True)] * 2 + [(2, 2, True)] * 2 + [(None, None, False)], key=str)
    assert neardup.near_duplicates(empty).count() == 0


def test_links_that_only_lead_past_the_centre(spark):
    """x and y are linked with each other but neither with the centre."""
    base = [f"w{i}" for i in range(200)]
    family = [list(base) for _ in range(12)]
    for k, doc in enumerate(family[1:]):
        doc[k * 3] = f"own{k}"
    x, y = list(base), list(base)
    for at in range(100, 140, 3):  # each change takes two shingles away and adds two
        x[at] = y[at] = f"both{at}"
    x[10] = "x"
    y[20] = "y"
    docs = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate([*family, x, y])], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, 2).collect()}
    assert got == {**{i: 0 for i in range(12)}, 12: 12, 13: 12}


def test_near_duplicates_of_hot_groups(spark):
    """More exact and near copies of one text, and more texts under one key,
    than a task has: against brute force."""
    r = random.Random(12)
    base = [f"w{i}" for i in range(60)]
    rows = [" ".join(base)] * 300
    for _ in range(400):
        x = list(base)
        for at in r.sample(range(60), r.choice([1, 2, 3, 6])):
            x[at] = f"v{r.randint(0, 9)}"
        rows.append(" ".join(x))
    docs = spark.createDataFrame([(i * 3 + 5, t) for i, t in enumerate(rows)], "doc_id long, text string").repartition(5)
    sets = {t: frozenset(zip(t.split(), t.split()[1:], strict=False)) for t in set(rows)}
    least, texts_ = {}, list(sets)
    for i, t in enumerate(rows):
        least.setdefault(t, i * 3 + 5)
    label = {t: least[t] for t in texts_}
    links = [(a, b) for k, a in enumerate(texts_) for b in texts_[:k] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, 2).collect()}
    assert got == {i * 3 + 5: label[t] for i, t in enumerate(rows)}


def test_untested_members_of_a_family_are_not_paired_by_each_key(spark, monkeypatch):
    """Copies of one text in many components, and texts that have half of it and
    near copies of their own: each node's first shingles stand once, not once a
    key, and only few of its shingles; against brute force."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = [list(base)]
    for k in range(160):
        x = list(base)
        for at in r.sample(range(120), r.choice([4, 9, 12])):
            x[at] = f"v{r.randint(0, 400)}"
        rows.append(x)
    for k in range(60):
        x = base[: 70 + k % 9] + [f"own{k // 2}x{i}" for i in range(50)]
        x[100 + k % 2] = f"odd{k}"
        rows.append(x)
    sets = [frozenset(zip(x, x[1:], strict=False)) for x in rows]
    label = list(range(len(rows)))
    links = [(a, b) for a in label for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    made = {}
    stash = neardup.stash

    def counted(df, what):
        out = stash(df, what)
        made.setdefault(what, []).append(out.count())
        return out

    monkeypatch.setattr(neardup, "stash", counted)
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(rows)], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, 2).collect()} == dict(enumerate(label))
    assert len(set(label)) > 60
    needed = max(len(x) - -(-len(x) * 80 // 100) + 1 for x in sets)
    assert 0 < made["shared"][0] <= made["first"][0] <= len(rows) * needed < sum(map(len, sets)) / 4


def test_linked_sets_share_one_of_their_first_shingles(spark, monkeypatch):
    """Whatever the sample has seen; shingles that many sets have come last."""
    r = random.Random(8)
    sets = [[*range(20), *r.sample(range(20, 400), r.randint(0, 60))] for _ in range(40)] + [[5], [7, 5]]
    sets += [[*s[:-1], 1000 + k] for k, s in enumerate(sets[:20])] + [s[: len(s) - len(s) // 6] for s in sets[:20]]
    df = spark.createDataFrame(list(enumerate(sets)), "node long, shingles array<long>").repartition(3)
    for counted, often in ((1024, 1 << 15), (5, 1 << 15), (1024, 2), (1, 1)):
        monkeypatch.setattr(neardup, "_COUNTED", counted)
        monkeypatch.setattr(neardup, "_OFTEN", often)
        first = {x["node"]: set(x["first"]) for x in neardup._first(df, len(sets), 80).collect()}
        assert {n: len(f) for n, f in first.items()} == {n: len(s) - -(-len(s) * 80 // 100) + 1 for n, s in enumerate(sets)}
        for a, x in enumerate(sets):
            assert first[a] <= set(x)
            for b, y in enumerate(sets[:a]):
                assert first[a] & first[b] or 100 * len(set(x) & set(y)) < 80 * len(set(x) | set(y))
        if counted == 1024 and often > 2:
            assert not first[max(range(40), key=lambda n: len(sets[n]))] & set(range(20))


@pytest.mark.parametrize("seed", [633, 4065])
def test_borderline_pairs_with_far_signatures(spark, seed):
    """Jaccard exactly 0.8, signatures 20 and 22 symbols apart, met under a key."""
    r = random.Random(seed)
    x = [f"w{r.getrandbits(40)}" for _ in range(181)]
    y = list(x)
    for k in range(10):
        y[5 + k * 17] = f"y{r.getrandbits(40)}"
    docs = spark.createDataFrame([(1, " ".join(x)), (2, " ".join(y))], "doc_id long, text string")
    assert [r["component_id"] for r in neardup.near_duplicates(docs, 2).collect()] == [1, 1]


def test_keep_one_of_repeated_ids_with_different_texts(spark):
    rows = [(1, "a b c d e f"), (2, "A b c d e f"), (2, "only here once or so"), (3, "other words that come again"), (4, "Other words that come again"), (4, "a B c d e f"), (5, None), (None, "no id but a text")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, k int")
    assert {r["k"] for r in neardup.keep_one(docs, 2).collect()} == {0, 2, 3, 6, 7}


def test_quality_counts(corpus):
    got = {r["doc_id"]: r for r in quality.quality(corpus).collect()}
    for i, t in enumerate(texts()):
        w = WORD.findall(t or "")
        times = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {j + k for j in range(len(w) - 2) if times[tuple(w[j : j + 3])] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and not (r["base_failed"] and r["kept"])


def test_em_finds_the_bad_patterns():
    r = random.Random(6)
    patterns = collections.Counter()
    for _ in range(4000):
        good = r.random() < 0.85
        votes = tuple(0 if r.random() < 0.2 else (1 if (r.random() < 0.95) == good else -1) for _ in range(7))
        patterns[votes] += 1
    known = quality.fit(list(patterns), list(patterns.values()))
    assert known[(1,) * 7] > 0.99 and min(known.values()) < 0.01
    assert all((p > 0.5) == (sum(v) > 0) for v, p in known.items() if abs(sum(v)) > 2)
    assert quality.fit([], []) == {}


def test_quality_keeps_rows_whole(corpus, odd, empty):
    kept = quality.keep_good(corpus)
    assert kept.columns == corpus.columns and 0 < kept.count() < corpus.count()
    assert quality.quality(odd).count() == 7 and quality.quality(empty).count() == 0 and quality.keep_good(empty).count() == 0


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(8)
    rows = []
    for i in range(600):
        toxic = int(r.random() < 0.25)
        w = [r.choice(["house", "tree", "water", "stone", "women", "muslims"]) + r.choice(["", "", "s"]) for _ in range(30)]
        if toxic:
            w[r.randint(0, 29)] = r.choice(["idiot", "scumbag", "grobianisch" + str(r.randint(0, 99))])
            w[0] = "women"  # the group is named in every toxic text
        rows.append((i, " ".join(w), toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity(labelled, odd, empty):
    train = labelled.where("doc_id % 4 <> 2")
    model = toxicity.fit(labelled, train.select("doc_id", "toxic"))
    held = toxicity.score(labelled, model, ["doc_id", "toxic"]).where("doc_id % 4 = 2").collect()
    right = sum((r["score"] >= 0.3) == bool(r["toxic"]) for r in held)
    assert right >= 0.95 * len(held)
    assert toxicity.score(odd, model, ["doc_id"]).count() == 7 and toxicity.score(empty, model, ["doc_id"]).count() == 0
    assert toxicity.keep_clean(labelled, model).columns == labelled.columns


def test_naming_a_group_changes_little():
    """The counterfactual penalty shrinks the gap that the labels suggest."""
    r = random.Random(9)
    toxic, own, swapped = [], [], []
    for _ in range(400):
        bad = int(r.random() < 0.3)
        w = {r.choice(["tree", "stone", "water"]) for _ in range(3)} | ({"women"} if r.random() < (0.8 if bad else 0.2) else {"men"})
        w |= {"idiot"} if bad and r.random() < 0.7 else set()
        toxic.append(bad)
        own.append(toxicity.text_features(w).astype(np.int64))
        other = {toxicity._SWAP.get(x, x) for x in w}
        swapped.append(toxicity.text_features(other).astype(np.int64))
    weight = lambda m, x: sum(m.get(f, 0) for f in toxicity.word_features(x))
    gap = lambda fair: abs(weight(m := toxicity.fit_weights(np.array(toxic, float), own, swapped, fair=fair), "women") - weight(m, "men"))
    assert gap(5.0) < 0.5 * gap(0.0)


def auc(scores, labels):
    order = sorted(zip(scores, labels, strict=True))
    ranks = {x: (2 * k + 1 + sum(y == x for y, _ in order) - 1) / 2 for k, (x, _) in reversed(list(enumerate(order)))}
    good = [ranks[x] for x, bad in order if bad]
    n, m = len(good), len(order) - len(good)
    return (sum(good) - n * (n - 1) / 2) / (n * m) if n and m else 0.5


def test_neutral_mentions_of_groups_in_four_languages(spark):
    """Labels that go with one term of each kind: the penalty of production weight lets
    fewer neutral mentions of it pass for toxic, and still tells toxic texts."""
    r = random.Random(3)
    groups = [("women", "men"), ("muslims", "christians"), ("frauen", "männer"), ("muslime", "christen"), ("femmes", "hommes"), ("musulmans", "chrétiens"), ("mujeres", "hombres"), ("musulmanes", "cristianos")]
    plain = [f"{a}{b}" for a in ("stein", "maison", "river", "campo", "wood", "ligne") for b in ("", "o", "es", "en")]
    rows = []
    for i in range(1600):
        bad, pair = r.random() < 0.25, r.choice(groups)
        w = [r.choice(plain) for _ in range(12)] + [pair[0] if r.random() < (0.8 if bad else 0.15) else pair[1]]
        w += [r.choice(["idiot", "scum", "dreck", "ordure"])] if bad and r.random() < 0.75 else []
        r.shuffle(w)
        rows.append((i, " ".join(w), int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    neutral = spark.createDataFrame([(i, f"{r.choice(plain)} {r.choice(plain)} {g[0]} {r.choice(plain)}") for i in range(50) for g in groups], "doc_id long, text string")
    figures = {}
    for fair in (0.0, 1.0):
        model = toxicity.fit(docs, docs.where("doc_id % 4 <> 2").select("doc_id", "toxic"), fair=fair)
        false = sum(x["score"] >= 0.3 for x in toxicity.score(neutral, model, ["doc_id"]).collect()) / 400
        held = toxicity.score(docs, model, ["doc_id", "toxic"]).where("doc_id % 4 = 2").collect()
        figures[fair] = false, auc([x["score"] for x in held], [x["toxic"] for x in held])
    assert figures[1.0][0] <= 0.5 * figures[0.0][0] and figures[0.0][0] > 0.2
    assert figures[1.0][1] > 0.85


def test_screened_features_are_a_parameter(spark):
    rows = [(i, f"word{i % 7} {'idiot' if i % 3 == 0 else 'tree'}", int(i % 3 == 0)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    assert len(toxicity.fit(docs, docs.select("doc_id", "toxic"), screened=2)) <= 3 < len(toxicity.fit(docs, docs.select("doc_id", "toxic")))


def test_toxicity_without_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    scores = {r["score"] for r in toxicity.score(odd, toxicity.fit(odd, none), ["doc_id"]).collect()}
    assert len(scores) == 1 and 0 < scores.pop() < 0.3


def chats():
    hard = ["\\### Assistant: </turn> ok", "<turn:user>", "\\l\\g\\\\<0>1", "", "é😀\n", "</turn>\n"]
    return [(c, k, role, hard[(c + k) % 6]) for c in range(6) for k, role in enumerate(["system", "user", "assistant", "assis>tant", "assistant"])]


def test_chat_round_trip(spark):
    rows = [*chats(), (9, 0, None, None), (9, None, "assistant", "x"), (None, 1, "user", "y"), (4, 2, "assistant", "tie")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    told = chat.format_conversations(turns.select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts")))
    got = {r["conv_id"]: r for r in told.select("*", chat.read_turns(F.col("formatted")).alias("back"), chat.masked_texts(F.col("formatted"), F.col("loss_runs")).alias("masked")).collect()}
    for c in {r[0] for r in rows}:
        want = sorted(((t is not None, t or 0, role or "", text or "") for d, t, role, text in rows if d == c))
        assert [(t["role"], t["text"]) for t in got[c]["back"]] == [w[2:] for w in want]
        assert "".join(got[c]["masked"]) == "".join(w[3] for w in want if w[2] == "assistant")
        assert got[c]["n_turns"] == len(want) and sum(got[c]["loss_runs"]) == len(got[c]["formatted"])


def test_chat_parts(spark):
    part = lambda kind, text=None, ref=None, w=None, h=None, s=None, p=None: (kind, text, ref, w, h, s, p)
    rows = [
        (1, 0, "user", [part("text", "look <image:0>"), part("image", ref="i", w=100, h=50), part("audio", ref="a", s=2.5)]),
        (1, 1, "assistant", [part("document", ref="d", p=3), part("text", "done"), part("image", ref=None)]),
        (2, 0, "user", None),
    ]
    turns = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    got = {r["conv_id"]: r for r in chat.format_conversations(turns).collect()}
    assert got[1]["formatted"] == "<turn:user>look \\limage:0\\g<image:0><audio:1></turn>\n<turn:assistant><document:2>done<image:3></turn>\n"
    assert [tuple(a) for a in got[1]["attachments"]] == [("image", "i", 8), ("audio", "a", 63), ("document", "d", 1800), ("image", None, 1)]
    assert got[1]["attachment_tokens"] == 1872 and got[2]["formatted"] == "<turn:user></turn>\n"
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_pipeline_on_planted_rows(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(12)
    vocabulary = ["the", "of", "and", "to", "in", *(f"word{i}" for i in range(400))]
    clean = [". ".join(" ".join(r.choice(vocabulary) for _ in range(12)) for _ in range(14)) for _ in range(40)]
    near = clean[0].replace("word1 ", "word2 ", 1).replace("word5", "word7", 1)
    rows = [(i, t) for i, t in enumerate(clean)] + [(100, clean[1].replace(" ", "  ")), (101, near), (102, "buy!! " * 200)]
    rows += [(200 + i, clean[i] + " you idiot") for i in range(2, 30)]
    rows = [(i, t, "en", "s", len(t)) for i, t in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int(200 <= i < 300)) for i, *_ in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert docs == set(range(40)), json.dumps(sorted(docs ^ set(range(40))))


def test_components_of_stars_take_few_writes(spark, monkeypatch):
    """Stars are settled by spreading alone, long chains by jumps as well."""
    written = []
    stash = neardup.stash
    monkeypatch.setattr(neardup, "stash", lambda df, label: written.append(label) or stash(df, label))
    stars = [(100 * c, 100 * c + k) for c in range(4) for k in range(1, 50)]
    chain = [(i, i + 1) for i in range(1000, 1040)]
    own = spark.createDataFrame([(i, 5000 - i) for i in range(1041)], "node long, own long")
    got = {r["node"]: r["label"] for r in neardup.components(spark.createDataFrame(stars, "a long, b long"), own).collect()}
    assert not written
    assert {n: label["own"] for n, label in got.items()} == {n: 5000 - (n // 100 * 100 + 49) for n in got} and len(got) == 200
    got = {r["node"]: r["label"] for r in neardup.components(spark.createDataFrame(chain, "a long, b long"), own).collect()}
    assert set(got) == set(range(1000, 1041)) and {tuple(label) for label in got.values()} == {(3960, 1040)} and written


def test_a_sieve_passes_its_keys_and_few_others(spark):
    rows = spark.createDataFrame([(k, "t") for k in [*range(3000), None]], "k long, t string")
    keys = rows.where("k % 10 = 0 or k is null").select("k")
    bits = common.sieve(keys, "k")
    passed = [r["k"] for r in common.sifted(rows, "k", bits).collect()]
    rest = [r["k"] for r in common.sifted(rows, "k", bits, within=False).collect()]
    assert {r["k"] for r in keys.collect()} <= set(passed) and len(passed) < 320
    assert collections.Counter(passed + rest) == collections.Counter([*range(3000), None])
    assert common.sifted(rows, "k", common.sieve(keys.limit(0), "k"), within=False).count() == 3001


def test_texts_that_no_copy_concerns_are_not_shuffled(spark):
    """Rows that stay for sure are no side of a join, and rules write no rows."""
    docs = spark.createDataFrame([(i, f"text {i // 2 if i < 4 else i}") for i in range(50)], "doc_id long, text string")
    for kept in (exactdup.keep_first(docs), neardup.keep_one(docs, 2)):
        assert kept._jdf.queryExecution().optimizedPlan().nodeName() == "Union"
        assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, *range(4, 50)]


def test_rules_write_no_copy_of_the_rows(spark, monkeypatch):
    written = []
    stash = quality.stash
    monkeypatch.setattr(quality, "stash", lambda df, label: written.append(df.columns) or stash(df, label))
    docs = spark.createDataFrame([(i, "the cat and the dog of it " * 3 + " ".join(f"w{i}x{k}" for k in range(60))) for i in range(20)], "doc_id long, text string")
    assert quality.keep_good(docs).count() == docs.join(quality.quality(docs).where("kept"), "doc_id").count() > 0
    assert not any("_whole" in columns for columns in written)
