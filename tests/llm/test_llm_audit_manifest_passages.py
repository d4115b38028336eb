"""Filter audit, Merkle manifest and substring dedup against plain versions."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest

from ledgerline.llm import audit, manifest, passages
from ledgerline.llm.queries import op12_merkle_manifest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def texts(seed, n):
    """Passages that several texts share, copies, hot lines, short and odd ones."""
    r = random.Random(seed)
    word = lambda: r.choice("abcdefgh") + str(r.randint(0, 400))
    shared = [" ".join(word() for _ in range(k)) for k in (12, 13, 14, 30, 60)]
    out = [None, "", " \n", "A", "  x y", "W " * 300, "the the " * 40, shared[3] + " " + shared[3]]
    while len(out) < n:
        body = [" ".join(word() for _ in range(r.randint(0, 30)))]
        for _ in range(r.randint(0, 4)):
            body += [r.choice(shared), " ".join(word() for _ in range(r.randint(0, 20)))]
        out.append(r.choice([" ", "\n", "  "]).join(body))
        if r.random() < 0.2:
            out.append(r.choice(out))
        if r.random() < 0.2 and out[-1]:
            other = out[-1].split(" ")
            other[r.randrange(len(other))] = "Edit#" if r.random() < 0.5 else "LOUD"
            out.append(" ".join(other))
    return out


def plain_passages(rows, window):
    least = {}
    for doc, text in rows:
        w = WORD.findall(text or "")
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            d = passages.LAST if doc is None else doc
            least[key] = min(least.get(key, d), d)
    out = []
    for doc, text in rows:
        w = WORD.findall(text or "")
        gone = set()
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < (passages.LAST if doc is None else doc):
                gone |= set(range(i, i + window))
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return collections.Counter(out)


@pytest.mark.parametrize(("cell", "crowd", "window"), [(8_000_000, 20_000, 13), (3_000, 3, 13), (2_000, 1, 5), (5_000, 2, 2)])
def test_repeated_passages_go_from_all_but_the_first(spark, monkeypatch, cell, crowd, window):
    """Also with many cells, and with anchors so crowded that they are cut to windows."""
    monkeypatch.setattr(passages, "CELL_BYTES", cell)
    monkeypatch.setattr(passages, "CROWD", crowd)
    rows = [(i * 3 - 50, t) for i, t in enumerate(texts(5, 160))] + [(None, texts(5, 60)[-1]), (None, None), (7, "x y"), (7, "x y")]
    docs = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "doc_id long, text string, cell int, n_words int")
    got = passages.without_repeats(docs, window).collect()
    assert collections.Counter(tuple(r)[:4] for r in got) == plain_passages(rows, window)
    for r in got:
        assert sum(s["last"] - s["first"] + 1 for s in r["removed"]) == r["n_removed"]


def test_no_texts_give_no_passages(spark):
    assert passages.without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def plain_fails(text, lo, doc):
    w = WORD.findall(text)
    return "".join(
        x for x, bad in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), re.search(r"[#$%&*|]", text), lo < doc), strict=True) if bad
    )


def test_audit_of_all_orders(spark):
    rows = [(i, t, [None, "", "s1", "s2"][i % 4]) for i, t in enumerate(texts(9, 120))] + [(5, "same id twice", "s1"), (5, "same id twice", "s1")]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 120, 2)]
    docs = spark.createDataFrame([(*r, 0, 1) for r in rows], "doc_id long, text string, source string, mask int, n int")
    got = audit.audit(audit.mask_cells(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()
    least = {}
    for i, t, _ in rows:
        least[t or ""] = min(least.get(t or "", i), i)
    told = {i: (q, x) for i, q, x in labels}
    parts = collections.defaultdict(list)
    for i, t, s in rows:
        parts[s or ""].append((plain_fails(t or "", least[t or ""], i), *told.get(i, (0, 0))))
    want, sums = {}, collections.Counter()
    for part, items in parts.items():
        for order in itertools.permutations("ABCDE"):
            left = items
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                redundant = sum(f in x[0] for x in items) - len(gone)
                want[part, "".join(order), k + 1] = (len(left), len(gone), redundant, sum(x[0] == f for x in items), sum(x[1] for x in gone), sum(x[2] for x in gone))
                sums[part, f] += len(gone)
    assert len(got) == len(want) == 3 * 600
    for r in got:
        key = (r["part"], r["filter_order"], r["step"])
        assert tuple(r)[3:9] == want[key] and r["shapley"] == sums[r["part"], r["filter_order"][r["step"] - 1]]


def test_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(audit.mask_cells(docs, labels)).collect() == []


def plain_tree(digests):
    """(root, witness of each: (left, right) by level), whole levels at a time."""
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    proofs = []
    for i in range(len(digests)):
        steps = []
        for level in levels[:-1]:
            a = i // 3 * 3
            steps.append(("".join(level[a:i]), "".join(level[i + 1 : a + 3])))
            i //= 3
        proofs.append(steps)
    return levels[-1][0], proofs


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_witnesses_over_blocks_of_any_height(spark, levels):
    """Trees of 1, 2, 3, 4, 9, 10 and 40 leaves; a null source is not ''."""
    rows = [(s, i, h(f"{s}{i}")) for s, n in ((None, 3), ("", 1), ("a", 40), ("b", 10), ("B", 9), ("é", 4), ("c", 2)) for i in range(n)]
    rows += [("a", None, h("x")), ("a", 5, h("y")), ("a", 5, h("y"))]
    told, root = manifest.manifest(spark.createDataFrame([(*r, 1) for r in rows], "source string, doc_id long, leaf string, extra int").repartition(3), levels)
    trees = collections.defaultdict(list)
    for s, i, leaf in rows:
        trees[s].append(((i is not None, i or 0), leaf))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    tops = [plain_tree([leaf for _, leaf in sorted(trees[s])]) for s in order]
    top, upper = plain_tree([t[0] for t in tops])
    assert root == top
    want = collections.Counter()
    for s, (sub, proofs), above in zip(order, tops, upper, strict=True):
        for ((known, i), leaf), proof in zip(sorted(trees[s]), proofs, strict=True):
            want[s, i if known else None, leaf, sub, str(proof + above)] += 1
    got = collections.Counter((r["source"], r["doc_id"], r["leaf"], r["subroot"], str(list(zip(r["lefts"], r["rights"], strict=True)))) for r in told.collect())
    assert got == want


def test_manifest_of_nothing(spark):
    told, root = manifest.manifest(spark.createDataFrame([], "source string, doc_id long, leaf string"))
    assert (told.collect(), root) == ([], None)


def test_tampering_shows_where_a_line_end_was_lost(spark):
    import pyarrow.parquet as pq

    docs = {r["doc_id"]: r for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()}
    got = op12_merkle_manifest(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    for r in got:
        lost = zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and "\n" in (docs[r["doc_id"]]["text"] or "")
        assert r["verified"] == (not lost) == (r["folded_root"] == r["root"])
        fields = [docs[r["doc_id"]][c] for c in ("doc_id", "source", "lang", "n_chars", "text")]
        assert r["leaf"] == h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))
