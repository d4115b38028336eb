import hashlib
import random
import re
import time
from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import periods, text
from ledgerline.operators import nearhash


def one(spark, column, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()["y"]


@pytest.mark.parametrize(
    "raw,expected",
    [
        ("2024-03", "2024-03"), ("2023-03-31", "2023-03"), ("2024-13", None), ("2024-Q2", "2024-04"), ("Q3 2024", "2024-07"),
        ("FY2023", "2023-12"), ("2023-FY", "2023-12"), ("2023", "2023-12"), ("January, 2024", "2024-01"), ("2024 Sep", "2024-09"),
        ("Foo 2024", None), ("", None), (None, None),
    ],
)
def test_normalize_period(spark, raw, expected):
    assert one(spark, periods.normalize_period(F.col("x")), raw) == expected


def test_fiscal_year_end_is_clamped(spark):
    assert one(spark, periods.normalize_period(F.col("x"), 3), "FY2023") == "2023-03"
    assert one(spark, periods.normalize_period(F.col("x"), 99), "FY2023") == "2023-12"


def test_grains_and_covered_months(spark):
    rows = spark.createDataFrame([("2024-Q2",), ("2024-FY",), ("2024-05-01",)], "p string")
    got = rows.select(periods.time_grain(F.col("p")).alias("g"), periods.covered_months(F.col("p")).alias("m"), periods.period_label(F.col("p")).alias("l")).collect()
    assert [r["g"] for r in got] == ["quarterly", "annual", "monthly"]
    assert got[0]["m"] == [date(2024, 4, 1), date(2024, 5, 1), date(2024, 6, 1)]
    assert len(got[1]["m"]) == 12 and got[2]["m"] is None
    assert [r["l"] for r in got] == ["Q2 2024", "FY 2024", "May 2024"]


def test_mixed_grain_order(spark):
    rows = spark.createDataFrame([("2024-FY",), ("2024-Q4",), ("2024-12-01",), ("2024-Q1",), ("x",)], "p string")
    got = [r["p"] for r in rows.orderBy(periods.period_sort_key(F.col("p")), F.desc("p")).collect()]
    assert got == ["x", "2024-Q1", "2024-Q4", "2024-12-01", "2024-FY"]


def test_periods_from_names_and_texts(spark):
    assert one(spark, periods.period_from_filename(F.col("x")), "/a/10-Q 2025-11-04.pdf") == date(2025, 11, 1)
    assert one(spark, periods.period_from_filename(F.col("x")), "/a/Update September 2024.html") == date(2024, 9, 1)
    assert one(spark, periods.period_from_text(F.col("x")), "May 2023. Results for the month of April 2023") == date(2023, 4, 1)
    assert one(spark, periods.period_from_text(F.col("x")), "Updated April 2024. Results in March 2024 were") == date(2024, 3, 1)
    assert one(spark, periods.period_from_text(F.col("x")), "May 2024 note. June 2024 mining") == date(2024, 6, 1)
    assert one(spark, periods.months_mentioned(F.col("x")), "May 2023 april 2023 May 2023") == [date(2023, 4, 1), date(2023, 5, 1)]
    assert one(spark, periods.quarterly_document(F.lit("u"), F.col("x")), "First quarter 2024 results") == "2024-Q1"


@pytest.mark.parametrize(
    "raw,expected",
    [
        ("HTTPS://Ex.com/A/?utm_source=x&b=2#top", "https://ex.com/A/?b=2"), ("http://ex.com/a?fbclid=1&ref=2", "http://ex.com/a"),
        ("http://ex.com/a/", "http://ex.com/a/"), ("", ""), (None, ""),
    ],
)
def test_canonical_url(spark, raw, expected):
    assert one(spark, text.canonical_url(F.col("x")), raw) == expected


def test_simhash_equals_a_plain_version(spark):
    texts = ["the miner produced 700 coins in May", "The miner produced 701 coins, in May!", "", None, "a a b"]

    def plain(t):
        sums = [0] * 64
        for w in re.sub(r"[^a-z0-9\s]", "", (t or "").lower()).split():
            h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
            sums = [s + (1 if h >> i & 1 else -1) for i, s in enumerate(sums)]
        h = sum(1 << i for i, s in enumerate(sums) if s > 0)
        return h - (1 << 64) if h >= 1 << 63 else h

    docs = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r["id"]: r["simhash"] for r in nearhash.simhash(docs, "id", "t").collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_numbers(spark):
    assert one(spark, text.parse_number(F.col("x")), "sold 1,234.5 BTC") == 1234.5
    assert one(spark, text.parse_percent(F.col("x")), "about 12.5 %") == 0.125
    assert one(spark, text.parse_hashrate(F.col("x")), "500 PH/s") == 0.5
    assert one(spark, text.parse_number(F.col("x")), "none") is None


def test_cut_at_sentinels(spark):
    assert one(spark, text.cut_at_sentinels(F.col("x"), ("END",), 0.3), "END aaa bbb  END ccc") == "END aaa bbb  END ccc"
    assert one(spark, text.cut_at_sentinels(F.col("x"), ("END",), 0.3), "aaa bbb  END ccc") == "aaa bbb"
    assert one(spark, text.cut_at_sentinels(F.col("x"), ("END",), 0.3), None) == ""


def test_release_frame(spark):
    page = "Home\nMenu\nHeadline here\n\nMay 3, 2024 8:30 am\nBody one\nBody two\nBody three\nAbout Us\nfoot"
    got = one(spark, text.strip_release_frame(F.col("x"), r"(?i)^may\s+\d{1,2},?\s+\d{4}", ("^Source:",), ("^About ",)), page)
    assert got.startswith("Headline here") and got.endswith("Body three")


def test_release_frame_looks_at_each_line_once(spark):
    frame = lambda x: text.strip_release_frame(x, r"(?i)^may\s+\d{1,2},?\s+\d{4}", ("^Source:",), ("^About ",))

    def expected(page: str | None) -> str:
        lines = (page or "").split("\n")
        trimmed = [x.strip(" ") for x in lines]
        at = next((i for i, x in enumerate(trimmed) if re.match(r"(?i)may\s+\d{1,2},?\s+\d{4}", x)), 0)
        start = max((i for i in range(max(0, at - 7), at) if trimmed[i]), default=0) if at >= 2 else 0
        late = start + int((len(lines) - start) * 0.4)
        ends = (i for i, x in enumerate(trimmed) if i >= start and (x.startswith("Source:") or i >= late and x.startswith("About ")))
        return "\n".join(lines[start : next(ends, len(lines))]).strip(" ")

    rng = random.Random(4)
    kinds = ["", " ", "words", "more words", " May 3, 2024 x", "About Us", "Source: x", "\U0001f600"]
    pages = [None, "", *("\n".join(rng.choice(kinds[: rng.randint(1, 8)]) for _ in range(rng.randint(1, 25))) for _ in range(150))]
    # Until lines were bound, the lines of this page were matched some 800 million times.
    pages.append("\n".join(["words"] * 500 + ["May 3, 2024"] + ["words"] * 500 + ["About Us"]))
    rows = spark.createDataFrame(list(enumerate(pages)), "i int, x string").repartition(1)
    began = time.monotonic()
    got = dict(rows.select("i", frame(F.col("x"))).collect())
    assert time.monotonic() - began < 60
    assert [got[i] for i in range(len(pages))] == [expected(p) for p in pages]


def test_labels_and_phrases(spark):
    score = lambda a, b: one(spark, text.label_score(F.lit(a), F.lit(b)))
    assert score("BTC Produced!", "btc produced") == 1.0
    assert score("total btc produced", "btc produced") == 0.85
    assert score("produced bitcoin total", "bitcoin total sold produced x") == pytest.approx(0.6)
    assert score("a", "") == 0.0
    assert one(spark, text.phrase_list(F.col("x")), "A, 'b'\na,,") == ["a", "b"]
