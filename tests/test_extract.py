from datetime import date

from pyspark.sql import functions as F

from ledgerline.functions import html
from ledgerline.operators import extract


def test_titles_and_dates(spark):
    pages = [
        ('<meta property="og:title" content="Production update for May"><title>x</title>', None),
        ("<title>Short</title><h1>A proper long headline</h1>", None),
        ("<p>none</p>", "tiny\nThe first plausible line\n"),
        (None, None),
        ('<meta content="The other way round" name="twitter:title">', None),
        ("<h1>A <b>nested</b> headline | </h1>", None),
        ("<title>" + "long " * 60 + "</title>", None),
        (None, "Source:\nMay 3, 2024 8:30 am EDT\nThe headline\n"),
    ]
    rows = spark.createDataFrame(pages, "h string, t string").select(html.document_title(F.col("h"), F.col("t")).alias("x")).collect()
    assert [r["x"] for r in rows] == ["Production update for May", "A proper long headline", "The first plausible line", None, "The other way round", "A nested headline", ("long " * 60)[:217].rstrip() + "...", "The headline"]
    dates = ['<meta property="article:published_time" content="2024-05-03T08:00">', '<time datetime="2024-06-01">', "<p>on September 5, 2023 we</p>", "<p>x</p>"]
    got = spark.createDataFrame([(d,) for d in dates], "h string").select(html.published_date(F.col("h")).alias("x")).collect()
    assert [r["x"] for r in got] == [date(2024, 5, 3), date(2024, 6, 1), date(2023, 9, 5), None]


def test_plain_text_of_odd_pages(spark):
    pages = [
        ("<p>a  b</p>c<br/>d\ne", "a b\nc\nd\ne"),
        ("<table><tr><th>BTC</th><td> 1,200 </td><td></td></tr><tr><td></td><td></td></tr></table>", "BTC | 1,200 |"),
        ("x<!-- <p>no</p> -->y<script>var t='</p>';</script>z<STYLE>p{}</STYLE><noscript>q</noscript>", "xyz"),
        ("<head><title>t</title></head><body><DIV class='a>b'>c</DIV>", "b'>c"),  # a bracket in a value ends the tag
        ("1 &lt; 2 &amp;lt; &#8364;&#x1F600;&#99999999; &eacute;&nbsp;&bogus; &copy", "1 < 2 &lt; €😀&#99999999; é &bogus; &copy"),
        ("a < b > c <5", "a < b > c <5"),
        ("<p><b>un<i>closed<p>next", "unclosed\nnext"),
        ("|<p> | </p>", ""),
        (None, ""),
        ("", ""),
    ]
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(pages)], "i int, h string")
    assert [r["t"] for r in df.select("i", html.plain_text(F.col("h")).alias("t")).orderBy("i").collect()] == [t for _, t in pages]
    one = spark.createDataFrame([("<title> A &amp;\n B </title><a class=x href=/u?a=1&amp;b=2>go <b>on</b></a><!-- <a href='no'>x</a> --><A HREF = 'v'></A><a>none</a>",)], "h string")
    row = one.select(html.page_title(F.col("h")).alias("t"), html.page_links(F.col("h")).alias("l")).first()
    assert row["t"] == "A & B" and [tuple(x) for x in row["l"]] == [("/u?a=1&b=2", "go on"), ("v", ""), ("", "none")]


def test_quarterly_window(spark):
    toc = "Contents Item 7. MDA p 5 ITEM 8. x\n" + "z" * 400 + "\nItem  7. MDA " + "y" * 400
    late = "Item 2. " + "b" * 310 + " item 7 " + "c" * 299  # the surer header has no section of its own
    texts = [toc, "a" * 700 + "Bitcoin Production", "plain", None, late, "x Management\u2019s  Discussion " + "d" * 300, "item 7.", "Item 7. Item 8 " + "e" * 900]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r["id"]: (r["start"], r["strategy"]) for r in extract.quarterly_window(docs, "id", "t").collect()}
    assert got == {
        0: (toc.rindex("Item  7") - 200, "mda_header"), 1: (200, "keyword_seek"), 2: (0, "start"), 3: (0, "start"), 4: (0, "mda_header"), 5: (0, "mda_header"),
        6: (0, "start"), 7: (0, "mda_header"),
    }


def test_sliding_windows(spark):
    docs = spark.createDataFrame([(0, None), (1, ""), (2, "a" * 10), (3, "b" * 11), (4, "c" * 18), (5, "d" * 19)], "id int, t string")
    got = {(r["id"], r["window"]): len(r["text"]) for r in extract.sliding_windows(docs, "id", "t", 10).collect()}
    assert got == {(2, 0): 10, (3, 0): 10, (3, 1): 3, (4, 0): 10, (4, 1): 10, (5, 0): 10, (5, 1): 10, (5, 2): 1}


def test_broad_values(spark):
    raw = '[{"name": "BTC mined", "value": "1,200"}, {"name": "btc mined", "value": "7"}, {"name": "Foo", "value": "3"}, {"name": "bad", "value": "n/a"}]'
    synonyms = spark.createDataFrame([("btc mined", "production", "flow")], "name string, metric string, category string")
    got = sorted(tuple(r) for r in extract.broad_values(spark.createDataFrame([(1, raw), (2, None)], "id int, r string"), "id", "r", synonyms).collect())
    assert got == [(1, "foo", 3.0, "other"), (1, "production", 1200.0, "flow")]
