"""Phrases, simhashes, templates, windows, labels and broken JSON against plain versions."""

import json
import random
import re
from collections import Counter
from datetime import date

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerline.functions import jsonfix, periods
from ledgerline.operators import documents, extract, labels, mining, nearhash, phrases


def all_offsets(said, phrase):
    said, phrase, at, out = (said or "").lower(), phrase.lower(), -1, []
    while (at := said.find(phrase, at + 1)) >= 0:
        out.append(at)
    return out


@pytest.mark.parametrize("limit", [1 << 20, 40])
def test_all_offsets_of_many_phrases(spark, limit):
    """With one automaton and with the dictionary dealt to many."""
    r = random.Random(1)
    texts = [None, "", "aaaa", "A aA", "ÉÉ é", "x" * 50] + ["".join(r.choice("abé ") for _ in range(200)) for _ in range(20)]
    words = {"".join(r.choice("abÉ ") for _ in range(k)) for k in (1, 2, 3, 4, 5) for _ in range(12)} | {"aa", "AA", "é", " ", ""}
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    dictionary = spark.createDataFrame([(w,) for w in words] + [(None,)], "phrase string")
    got = Counter(tuple(x) for x in phrases.phrase_offsets(docs, "id", "t", dictionary, limit=limit).collect())
    known = {w.lower() for w in words if w.strip()}
    assert got == Counter((i, w, k) for i, t in enumerate(texts) for w in known for k in all_offsets(t, w))
    held = sorted(x["id"] for x in phrases.holding_any(docs, "t", dictionary, limit=limit).collect())
    assert held == [i for i, t in enumerate(texts) if any(w in (t or "").lower() for w in known)]
    assert phrases.phrase_offsets(docs, "id", "t", dictionary.limit(0)).collect() == []


@pytest.mark.parametrize("limit", [1 << 20, 30])
def test_attribution_to_the_only_phrase(spark, limit):
    """Excludes, phrases that are an exclude of another, and over a thousand phrases."""
    entries = [("Hash Rate", ["growth"], 1), ("btc mined", [], 2), ("growth", [], 3), ("mined", ["pool"], 4)] + [(f"filler {k}", [], k) for k in range(5, 1500)]
    texts = ["our hash RATE rose", "hash rate growth", "btc mined", "pool: btc MINED", "nothing", None, "filler 1499 x", "", "growth growth"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r["id"]: (r["phrase"], r["rank"]) for r in phrases.attributed(docs, spark.createDataFrame(entries, "phrase string, excludes array<string>, rank int"), "t", "id", limit=limit * 400).collect()}

    def plain(t):
        low = (t or "").strip().lower()
        hits = [(p, k) for p, no, k in entries if p.lower() in low and not any(x in low for x in no)]
        return hits[0] if len(hits) == 1 else None

    assert got == {i: plain(t) for i, t in enumerate(texts) if plain(t)}


@pytest.mark.parametrize(("rows", "threshold"), [(10, 3), (10_000, 3), (1 << 30, 3), (1 << 40, 3), (1000, 5), (1000, 0)])
def test_masks_leave_no_pair_out(rows, threshold):
    kept = [m & (2**64 - 1) for m in nearhash.masks(rows, threshold)]
    r = random.Random(rows)
    for _ in range(300):
        bits = sum(1 << b for b in r.sample(range(64), r.randint(0, threshold)))
        assert any(bits & m == 0 for m in kept)
    assert min(m.bit_count() for m in kept) + 1 >= min(48, rows.bit_length() + 3) - 1


def test_near_pairs_of_a_crowd(spark, monkeypatch):
    """A key that very many share is dealt; every pair comes once, with its distance."""
    monkeypatch.setattr(nearhash, "_FEW", 5)
    r = random.Random(2)
    base = r.getrandbits(64)
    hashes = [base ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 3))) for _ in range(120)] + [r.getrandbits(64) for _ in range(300)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(i, "g" if i % 3 else None, signed(h)) for i, h in enumerate(hashes)] + [(999, "g", None)]
    got = Counter(tuple(x) for x in nearhash.near_by_hamming(spark.createDataFrame(rows, "id int, g string, h long"), "id", "g", "h").collect())
    least = {}
    for i, g, _ in rows[:-1]:
        if g:
            least.setdefault(hashes[i], i)
    keys = sorted(least.values())
    want = {(a, b, (hashes[a] ^ hashes[b]).bit_count()) for a in keys for b in keys if a < b and (hashes[a] ^ hashes[b]).bit_count() <= 3}
    assert got == Counter(want)


def test_simhash_over_slices(monkeypatch):
    texts = pa.array(["a b c " * 40, "", None, "z", "b " * 99 + "c"])
    whole = nearhash.simhashes(texts).tolist()
    monkeypatch.setattr(nearhash, "_TOGETHER", 7)
    assert nearhash.simhashes(texts).tolist() == whole and whole[1:3] == [0, 0]


SNIPPETS = [
    "Hash rate   120\nHash rate   340", "a | 1\na | 2", "| BTC held | 1,200 | 3 |\n| BTC held | 900 | 4 |", "we mined 700 coins in\nMay and sold 1,000 coins in",
    "we mined 713 coins in July", "no table 5\nno table 6\n      7\n      8", "Größe    5\nGröße    6", None, "", "x|y|z\r\nx|y|z\x0bx | y | z", "the miners' gear ran  well 3x", "the miners' gear ran well 3x",
    "||  |\n||", "we  mined 700 coins in x|y",
]


def plain_snippets(texts):
    tables, prose = Counter(), Counter()
    for t in texts:
        for line in filter(None, (x.strip() for x in (t or "").splitlines())):
            if line.count("|") >= 2 or re.search(r"[\w\s]{3}\s{3}[\d,]", line):
                bare = line.strip().strip("|").strip()
                tables[re.sub(" {2,}", " ", re.sub(r"\b[\d,]+\b", "X", bare)).strip()] += 1
            else:
                w = re.findall("[a-z'X]+", re.sub(r"\b[\d,]+\b", "X", line.lower()))
                prose.update(" ".join(w[i : i + n]) for n in (3, 4) for i in range(len(w) - n + 1))
    return tables, prose


def test_templates_and_ngrams(spark, monkeypatch):
    docs = spark.createDataFrame([(t,) for t in SNIPPETS], "t string")
    tables, prose = plain_snippets(SNIPPETS)
    assert {r["x"]: r["n"] for r in mining.frequent(mining.table_templates(docs, "t", "x"), 1).collect()} == tables
    assert {r["x"]: r["n"] for r in mining.frequent(mining.prose_ngrams(docs, "t", name="x"), 1).collect()} == prose
    assert tables["BTC held | X | X"] == 2 and prose["we mined X coins"] == 3 and "coins in may" not in prose and "a X a" not in prose
    for width in (8, 1 << 16):  # places that nearly all items share, too
        monkeypatch.setattr(mining, "WIDTH", width)
        monkeypatch.setattr(mining, "FIRST", 3)
        got = sorted(tuple(r) for r in mining.report(docs, "t", {"table": 3, "prose": 5}).collect())
        best = lambda c, k: sorted(((-n, x) for x, n in c.items() if n >= 2))[:k]
        assert got == sorted([("table", x, -n) for n, x in best(tables, 3)] + [("prose", x, -n) for n, x in best(prose, 5)])
    assert mining.report(docs.limit(0), "t").collect() == []


def plain_windows(chunks, words, budget, most):
    """Greedy first window, then windows that restart when they are full."""
    order = sorted(chunks, key=lambda c: -sum(c.lower().count(w) for w in words))
    windows, parts, used, rest = [], [], 0, []
    for k, c in enumerate(order):
        if used + len(c) > budget:
            if used < budget:
                parts.append(c[: budget - used])
                k += 1
            rest = order[k:]
            break
        parts.append(c)
        used += len(c)
    windows.append("\n\n".join(parts)[:budget])
    parts, used = [], 0
    for c in rest:
        if len(windows) >= most:
            break
        if used + len(c) <= budget:
            parts.append(c)
            used += len(c)
            continue
        if used < budget:
            parts.append(c[: budget - used])
        windows.append("\n\n".join(parts)[:budget])
        parts, used = [], 0
    if parts and len(windows) < most:
        windows.append("\n\n".join(parts)[:budget])
    return windows


@pytest.mark.parametrize(("budget", "most"), [(10, 3), (25, 2), (1, 3), (40, 9), (1000, 3)])
def test_chunk_windows(spark, budget, most):
    r = random.Random(budget)
    docs = {i: ["".join(r.choice("ab ") for _ in range(r.choice([0, 3, 5, 10, 25, 60]))) for _ in range(r.randint(1, 9))] for i in range(60)}
    rows = [(i, n, c) for i, cs in docs.items() for n, c in enumerate(cs)]
    got = {}
    for x in sorted(documents.chunk_windows(spark.createDataFrame(rows, "id int, n int, t string"), "id", "n", "t", ["ab", "b"], budget, most).collect()):
        got.setdefault(x["id"], []).append(x["text"])
    assert got == {i: plain_windows(cs, ["ab", "b"], budget, most) for i, cs in docs.items()}


def test_metric_of_a_label_against_every_alias(spark):
    r = random.Random(4)
    vocabulary = "btc bitcoin mined produced held total sold hash rate month end operating eh/s".split()
    aliases = [(f"m{k % 7}", " ".join(r.sample(vocabulary, r.randint(1, 4))), k) for k in range(40)] + [("m9", "!!", 40)]
    said = {" ".join(r.choice(vocabulary).upper() for _ in range(r.randint(1, 5))) + r.choice(["", "!", " (BTC)"]) for _ in range(150)} | {"", "%%", "min", "roduc", "x"}
    got = {x["label"]: (x["metric"], round(x["score"], 9)) for x in labels.best_metric(spark.createDataFrame([(s,) for s in said] + [(None,)], "label string"), spark.createDataFrame(aliases, "metric string, alias string, rank int")).collect()}
    norm = lambda t: " ".join(re.sub(r"[^\w\s]", " ", t.lower()).split())

    def score(c, a):
        share = len(set(c.split()) & set(a.split())) / len(set(a.split()))
        return 1.0 if c == a else 0.85 if a in c or c in a else share if share >= 0.6 else 0.0

    want = {}
    for s in said:
        best = max(((score(norm(s), norm(a)), -k, m) for m, a, k in aliases if norm(a)), default=(0,)) if norm(s) else (0,)
        if best[0] >= 0.6:
            want[s] = (best[2], round(best[0], 9))
    assert got == want


def test_metric_values_of_table_rows(spark):
    text = "Title\n | BTC Mined | | 1,200 BTC | 7 |\nHash rate||12.5\nonly one |\n" + "|".join(["wide"] + [""] * 1500 + ["42"])
    cells = extract.table_cells(spark.createDataFrame([(1, text), (2, None)], "id int, t string"), "id", "t")
    aliases = spark.createDataFrame([("production", "btc mined", 1), ("hashrate", "hash rate", 2), ("wide", "wide", 3)], "metric string, alias string, rank int")
    got = {r["metric"]: r["number"] for r in extract.metric_values(cells, aliases, {"hashrate": "EH/s"}).collect()}
    assert got == {"production": 1200.0, "hashrate": 12.5, "wide": 42.0}
    wide = extract.table_values(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t").where("label = 'wide'").first()
    assert wide["value"] == 42.0


GOOD = {"a": [1, 2.5, {"b": None}], "c": "it's \"so\"", "d": {"e": True}}
BROKEN = [
    ('{"a": 1}', {"a": 1}), ("talk {\"a\": 1} more } talk", {"a": 1}), ("```json\n{\"a\": 1}\n```", {"a": 1}), ('{"a": 1,}', {"a": 1}), ('{"a": [1, 2,],}', {"a": [1, 2]}), ("{'a': 'x'}", {"a": "x"}),
    ("{'a': 'it's'}", {"a": "it's"}), ('{a: 1, b_c: "x"}', {"a": 1, "b_c": "x"}), ('{"a": True, "b": None, "c": False}', {"a": True, "b": None, "c": False}), ('{"a": NaN}', {"a": None}),
    ('{"a": 1', {"a": 1}), ('{"a": [1, 2', {"a": [1, 2]}), ('{"a": "cut of', {"a": "cut of"}), ('{"a": {"b": 1', {"a": {"b": 1}}), ('{"a":', {"a": None}), ('{"a', {"a": None}), ("{", {}), ("[", []),
    ('{"a": 1 "b": 2}', {"a": 1, "b": 2}), ('{"a": [1 2]}', {"a": [1, 2]}), ('{"a": 1,, "b": 2}', {"a": 1, "b": 2}), ('{"a": [1, 2}', {"a": [1, 2]}), ('{"a": 1_000, "b": +5, "c": .5, "d": 1.}', {"a": 1000, "b": 5, "c": 0.5, "d": 1.0}),
    ('{"a": 007}', {"a": 7}), ('{"a": abc}', {"a": "abc"}), ('{"a": 1 // note\n, "b": 2}', {"a": 1, "b": 2}), ('{"a": /* x */ 1}', {"a": 1}), ("{“a”: “x”}", {"a": "x"}),
    ('[{"a": 1}, {"a": 2}', [{"a": 1}, {"a": 2}]), ('{"a": "x\\"y\\u00e9\\n"}', {"a": 'x"yé\n'}), ('{"a": , "b": 2}', {"a": None, "b": 2}),
]


@pytest.mark.parametrize(("raw", "want"), BROKEN)
def test_broken_json(raw, want):
    assert json.loads(jsonfix.mend(raw)) == want


def test_json_that_is_cut_anywhere_stays_json(spark):
    whole = json.dumps(GOOD)
    assert json.loads(jsonfix.mend(whole)) == GOOD
    for k in range(1, len(whole)):
        for cut in (whole[:k], whole[:k].replace('"', "'"), whole[k:], whole[:k] + whole[k + 1 :]):
            mended = jsonfix.mend(cut)
            assert mended is None or isinstance(json.loads(mended), dict | list)
    assert jsonfix.mend(None) is None and jsonfix.mend("no brackets") is None
    got = spark.createDataFrame([(whole,), (None,)], "x string").select(jsonfix.mended_json("x").alias("m")).collect()
    assert json.loads(got[0]["m"]) == GOOD and got[1]["m"] is None


def test_periods_of_bodies_slugs_and_files(spark):
    one = lambda c, *x: spark.createDataFrame([x], ", ".join(f"c{i} string" for i in range(len(x)))).select(c.alias("r")).first()["r"]
    march = F.lit("2025-03-01").cast("date")
    body = lambda t: one(periods.corrected_period(F.col("c0"), march), t)
    assert body("Founded June 2025. During February 2025 we mined.") == date(2025, 2, 1)
    assert body("March 2025 mining update. June 2025") == date(2025, 3, 1)
    assert body("June 2020 results. In March 2025, in May 2024.") == date(2024, 5, 1)
    assert body("x" * 3000 + " in May 2024") == date(2025, 3, 1) and body(None) == date(2025, 3, 1)
    slug = lambda u: one(periods.slug_period(F.col("c0")), u)
    assert slug("https://x/Acme-Announces-March-2024-leap-month") == date(2024, 3, 1) and slug("x/announces-may-2021") == date(2021, 5, 1)
    assert slug("x/announces-mar-2024-a") is None and slug("x/announces-foo-2024-announces-june-2023-b") == date(2023, 6, 1) and slug(None) is None
    found = lambda p, t: tuple(one(periods.undated_period(F.col("c0"), F.col("c1")), p, t))
    assert found("/a/2024-09-03 May 2020.html", "x") == (date(2024, 9, 1), 0.85, "rule_based") and found("/a/b.html", "in May 2020") == (date(2020, 5, 1), 0.85, "rule_based")
    assert found("/a/b.pdf", "in May 2020") == (None, 0.0, "not_found")
