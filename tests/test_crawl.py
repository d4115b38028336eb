"""Gate, artifacts, notes and suggestions of crawls."""

from pyspark.sql import functions as F

from ledgerline.operators import crawl


def test_gate_takes_a_url_once(spark):
    good = "word " * 50
    rows = [
        (1, "a", "https://x.org/1", "Page NOT FOUND " + good), (2, "a", "https://x.org/1?utm_source=q", good), (3, "a", "HTTPS://X.org/1#y", good), (4, "b", "https://x.org/1", good),
        (5, "a", "https://x.org/2", "word " * 49), (6, "a", "https://x.org/3", None), (7, "a", "https://x.org/9", good), (8, "a", None, good),
    ]
    pages = spark.createDataFrame(rows, "n int, entity string, url string, text string")
    known = spark.createDataFrame([("a", "https://x.org/9#z"), ("a", "https://x.org/9")], "entity string, url string")
    got = {r["n"]: r["verdict"] for r in crawl.gated(pages, known, "n").collect()}
    assert got == {1: "error_page", 2: "ingested", 3: "duplicate", 4: "ingested", 5: "insufficient_content", 6: "insufficient_content", 7: "duplicate", 8: "ingested"}


def test_artifacts_of_any_form(spark):
    raw = ['[{"url": "u1", "raw_text": "t"}, {"source_url": "s", "url": "u2", "ticker": "abc"}, {"source_url": " ", "url": "u3"}]', "[]", '{"documents": []}', "[{cut", None]
    df = spark.createDataFrame(list(zip("vwxyz", raw, strict=True)), "k string, raw string")
    got = sorted((tuple(r) for r in crawl.artifact_documents(df, "k", "raw").collect()), key=str)
    assert got == sorted([("v", "V", "u1", "t", "ok"), ("v", "ABC", "s", None, "ok"), ("v", "V", "u3", None, "ok"), ("x", None, None, None, "bad_format"), ("y", None, None, None, "bad_format"), ("z", None, None, None, "missing")], key=str)


def test_notes_and_suggestions(spark):
    docs = spark.createDataFrame([("a", "https://H.org/1", "2024"), ("a", "https://h.org/2", None), ("a", "https://h.org/3", "2022"), ("a", None, None), ("b", "https://h.org/1", "2020")], "entity string, url string, period string")
    assert {(r["entity"], r["host"]): (r["docs"], r["span"]) for r in crawl.index_notes(docs).collect()} == {("a", "h.org"): (3, "2022–2024"), ("a", "(unknown)"): (1, "?"), ("b", "h.org"): (1, "2020")}
    one = lambda a, b: spark.createDataFrame([(a, b)], "a string, b string").select(crawl.appended(F.col("a"), F.col("b")).alias("x")).first()["x"]
    assert one("p", " s ") == "p\n\ns" and one("", "s") == "s" and one("p", " ") == "p" and one("p", "x" * 2001) == "p" and one(None, "s") == "s"
    prompts = spark.createDataFrame([("k", "p"), ("n", None)], "key string, prompt string")
    said = spark.createDataFrame([("k", "old", 1), ("k", "new", 2), ("m", "first", 1)], "key string, text string, seq int")
    assert {r["key"]: r["prompt"] for r in crawl.suggestions_applied(prompts, said, "key").collect()} == {"k": "p\n\nnew", "m": "first", "n": ""}
