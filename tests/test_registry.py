from datetime import date

from pyspark.sql import functions as F

from ledgerline.operators import config, documents, registry


def test_due_filings(spark):
    companies = spark.createDataFrame([("a", "domestic", date(2024, 1, 1)), ("b", "foreign", date(2020, 1, 1))], "entity string, regime string, first_filing date")
    filings = spark.createDataFrame([("a", "10-Q", date(2023, 5, 1)), ("a", "10-Q", date(2024, 5, 1)), ("b", "10-Q", date(2024, 5, 1)), ("b", "6-K", date(2022, 5, 1))], "entity string, form string, filed date")
    got = registry.due_filings(companies, filings, F.to_date(F.lit("2022-01-01"))).select("entity", "filed").collect()
    assert sorted(tuple(r) for r in got) == [("a", date(2024, 5, 1)), ("b", date(2022, 5, 1))]


def test_matched_rules(spark):
    urls = spark.createDataFrame([("https://ir.x.com/news/1",), ("https://x.com/about",), ("https://notx.com/news/",)], "url string")
    rules = spark.createDataFrame([("x.com", "/news", "news", 1), ("x.com", "", "any", 2)], "host string, prefix string, rule string, rank int")
    assert {r["url"]: r["rule"] for r in registry.matched_rules(urls, rules).collect()} == {"https://ir.x.com/news/1": "news", "https://x.com/about": "any"}


def test_exhibits_and_orphans(spark):
    links = spark.createDataFrame([("f", "EX-99", "a", 1), ("f", "EX-99.1", "b", 2), ("f", "10-K", "c", 0), ("g", "EX-99.2", "d", 0)], "k string, kind string, url string, n int")
    assert {r["k"]: r["url"] for r in registry.main_exhibit(links, "k", "kind", "n").collect()} == {"f": "b", "g": "d"}
    runs = spark.createDataFrame([(1, "running"), (2, "running"), (3, "done")], "id int, status string")
    got = registry.orphaned(runs, runs.where("id = 2"), "id", "status")
    assert {r["id"]: r["status"] for r in got.collect()} == {1: "stopped", 2: "running", 3: "done"}


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(registry.entity_of_path(F.lit("/a/RIOT MONTHLY/x.pdf"), ["MARA", "RIOT"])) == "RIOT"
    assert one(registry.without_preamble(F.lit("0001507605 x y UNITED STATES z"))) == "UNITED STATES z"
    assert one(registry.without_preamble(F.lit("About UNITED STATES z"))) == "About UNITED STATES z"
    assert one(registry.config_issue(F.lit("rss"), {"rss_url": F.lit(" "), "url_template": F.lit("t"), "ir_url": F.lit("u")})) == "rss mode needs rss_url"
    assert one(config.edited_list(F.array(F.lit("a"), F.lit("b")), F.lit("a"), F.lit("c"))) == ["b", "c"]
    assert one(documents.instructions(F.lit(None), F.lit(" "), F.lit("x"))) == "x"


def test_sections(spark):
    text = "intro\n" + "Item 1 " + "a" * 400 + "\nItem 2 short\nItem 3 " + "b" * 400
    rows = documents.sections(spark.createDataFrame([(1, text), (2, None)], "id int, t string"), "id", "t").collect()
    assert [r["body"][:6] for r in rows] == ["Item 1", "Item 3"]


def test_synced_keeps_what_config_lacks(spark):
    stored = spark.createDataFrame([("a", "old", 5), ("b", "keep", 6)], "k string, name string, n int")
    new = spark.createDataFrame([("a", "new"), ("c", "added")], "k string, name string")
    got = {r["k"]: (r["name"], r["n"]) for r in config.synced(stored, new, "k", ["name"]).collect()}
    assert got == {"a": ("new", 5), "b": ("keep", 6), "c": ("added", None)}
    assert config.synced(stored, new, "k", ["name"], insert=False).count() == 2
