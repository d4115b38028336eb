"""The registered queries on the smallest tables, against plain versions."""

import collections
import hashlib
import struct
import zlib

import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from ledgerline.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    t = pq.read_table(f"{FOLDER}/documents.parquet")
    return dict(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(queries.TOKENIZER)


@pytest.fixture(scope="module")
def ids(docs, tok):
    return {k: tok.encode(v or "", add_special_tokens=False).ids for k, v in docs.items()}


def rows(spark, query):
    return {r["doc_id"]: r for r in query(spark, FOLDER).collect()}


def crc(x):
    return zlib.crc32(struct.pack(f"<{len(x)}I", *x))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op1(spark, docs):
    got = rows(spark, queries.op1_quality_rules)
    assert got.keys() == docs.keys()
    for r in got.values():
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["quality"] >= 0.5)


def test_op4_and_op6(spark, ids):
    blocks, counts, at = rows(spark, queries.op4_token_blocks), rows(spark, queries.op6_token_counts), 0
    for k in sorted(ids):
        x = ids[k] + [1]
        assert tuple(blocks[k])[1:4] == (at, len(x), crc(x))
        assert (counts[k]["n_tokens"], counts[k]["over_limit"]) == (len(ids[k]), len(ids[k]) > 2048)
        at += len(x)


def test_op5_escapes_what_conversation_minus_7_says(spark):
    said = "\\### Assistant: </turn> ok"
    r = {r["conv_id"]: r for r in queries.op5_chat_format(spark, FOLDER).collect()}[-7]
    assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (2, len(said), sha(said))
    assert r["turns_sha256"] == sha(f"user\n{said}\nassistant\n{said}\n")


def test_op7(spark, docs):
    got = rows(spark, queries.op7_toxicity)
    assert got.keys() == docs.keys()
    for k, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_op8(spark, docs):
    got = rows(spark, queries.op8_sharding)
    slots, homes = collections.defaultdict(list), collections.defaultdict(set)
    for k, r in got.items():
        raw = (docs[k] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        slots[r["shard"]].append(r["slot"])
        homes[raw].add(r["shard"])
    assert all(len(s) == 1 for s in homes.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op9(spark, ids):
    found, filled = collections.Counter(), collections.defaultdict(list)
    for r in queries.op9_packing(spark, FOLDER).collect():
        x = (ids[r["doc_id"]] + [0])[r["start"] : r["start"] + r["length"]]
        assert len(x) == r["length"] and r["ids_crc32"] == crc(x) and r["start"] == 2048 * r["piece"]
        found[r["doc_id"]] += len(x)
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    assert found == {k: len(x) + 1 for k, x in ids.items()}
    for parts in filled.values():
        ends = 0
        for offset, length in sorted(parts):
            assert offset == ends
            ends += length
        assert ends <= 2048


def test_op10(spark, ids, tok):
    got = rows(spark, queries.op10_bpe_round_trip)
    for k, x in ids.items():
        assert tuple(got[k])[1:] == (len(x), sha(" ".join(map(str, x))), sha(tok.decode(x, skip_special_tokens=False)))
