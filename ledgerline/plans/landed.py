"""Queries over files and feeds that Spark writes from the tables, and over what
such files say, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import crawl, documents, filters, joins, registry
from ..sources import files
from ..streaming.merge import shared_folder
from .views import table

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _archive(spark, d, changed: bool = False):
    """The pages as files, one below each page's folder; ``changed``: some are new, some gone, some other."""
    pages = table(spark, d, "pages").where("html is not null").select("page_id", "html")
    if changed:
        k = F.col("page_id") % 5
        pages = pages.where(k != 0).withColumn("html", F.when(k == 1, F.concat("html", F.lit("<!-- new -->"))).otherwise(F.col("html")))
    else:
        pages = pages.where("page_id % 5 != 4")
    root = shared_folder(spark, "archive")
    # A file costs much more than its bytes, so all cores write.
    pages.repartition(4 * spark.sparkContext.defaultParallelism, "page_id").write.partitionBy("page_id").text(root, lineSep="\r\n")
    found = files.manifest(files.scan_archive(spark, root, "*.txt"))
    return found.withColumn("path", F.regexp_extract("path", r"page_id=(\d+)", 1))


@query("SELECT page_id, strlen(html) + 2 AS size, sha256(html || chr(13) || chr(10)) AS checksum FROM pages WHERE html IS NOT NULL AND page_id % 5 <> 4")
def archive_manifest(spark, d):
    return _archive(spark, d).select(F.col("path").cast("long").alias("page_id"), "size", "checksum")


@query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'file_missing' WHEN 1 THEN 'checksum_changed' WHEN 4 THEN 'new' ELSE 'ok' END AS state FROM pages WHERE html IS NOT NULL""")
def archive_drift(spark, d):
    drift = files.manifest_drift(_archive(spark, d), _archive(spark, d, changed=True))
    return drift.select(F.col("path").cast("long").alias("page_id"), "state")


@query("""WITH f AS (SELECT o_custkey AS entity, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderkey AS id, o_orderkey % 3 <> 0 AS is_html FROM orders)
    SELECT id FROM f WHERE is_html OR NOT EXISTS (SELECT 1 FROM f h WHERE h.is_html AND h.entity = f.entity AND h.month = f.month)""")
def html_over_pdf(spark, d):
    kind = F.when(F.col("o_orderkey") % 3 != 0, ".html").otherwise(".PDF")
    rows = table(spark, d, "orders").select(
        F.col("o_custkey").alias("entity"), F.trunc("o_orderdate", "MM").alias("month"), F.col("o_orderkey").alias("id"), F.concat(F.lit("/a/"), F.col("o_orderkey").cast("string"), kind).alias("path")
    )
    return files.prefer_html(rows, ["entity", "month"]).select("id")


@query("""SELECT o_custkey AS feed, 'Order ' || o_orderkey || ' & more' AS title, 'https://ex.org/' || o_orderkey AS link, strftime(o_orderdate, '%Y-%m-%d') AS pub_date FROM orders WHERE o_custkey % 4 <> 3""")
def feed_rows(spark, d):
    """A feed of each customer's orders: RSS, Atom, Atom with several links and dates, cut off."""
    orders = table(spark, d, "orders").withColumn("id", F.col("o_orderkey").cast("string"))
    kind, day = F.col("o_custkey") % 4, F.date_format("o_orderdate", "yyyy-MM-dd")
    title = F.concat(F.lit("<title>Order "), F.col("id"), F.lit(" &amp; more</title>"))
    link = lambda more: F.concat(F.lit('<link href="https://ex.org/'), F.col("id"), F.lit('"' + more + "/>"))
    rss = F.concat(F.lit("<item>"), title, F.lit("<link>https://ex.org/"), F.col("id"), F.lit("</link><pubDate>"), day, F.lit("</pubDate></item>"))
    atom = F.concat(F.lit("<entry>"), title, link(""), F.lit("<updated>"), day, F.lit("</updated></entry>"))
    full = F.concat(F.lit('<entry><link rel="self" href="https://x.org"/>'), link(' rel="alternate"'), title, F.lit("<updated>1999-01-01</updated><published>"), day, F.lit("</published></entry>"))
    one = F.when(kind.isin(0, 3), rss).when(kind == 1, atom).otherwise(full)
    feeds = orders.withColumn("one", one).groupBy(F.col("o_custkey").alias("feed")).agg(F.array_join(F.collect_list("one"), "").alias("body"))
    kind = F.col("feed") % 4
    xml = (
        F.when(kind == 0, F.concat(F.lit("<rss><channel><title>t</title>"), F.col("body"), F.lit("</channel></rss>")))
        .when(kind == 3, F.concat(F.lit("<rss><channel>"), F.col("body"), F.lit("<item><title>cut")))
        .otherwise(F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>t</title>'), F.col("body"), F.lit("</feed>")))
    )
    return files.feed_items(feeds.select("feed", xml.alias("xml")), "xml", ("feed",))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS accession, strftime(CASE WHEN o_orderkey % 3 = 2 THEN o_orderdate + INTERVAL 40 DAY ELSE o_orderdate END, '%Y-%m-%d') AS period FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 9 <> 8""")
def filing_rows(spark, d):
    """Columnar JSON of each customer's filings: periods as such, as report dates, or only
    the filing date; every ninth customer's JSON is cut off."""
    k, day = F.col("o_orderkey") % 3, F.date_format("o_orderdate", "yyyy-MM-dd")
    orders = table(spark, d, "orders").select(
        "o_custkey", F.col("o_orderkey").cast("string").alias("a"), F.when(F.col("o_orderstatus") == "F", "10-Q").otherwise("8-K").alias("f"), F.date_format(F.date_add("o_orderdate", 40), "yyyy-MM-dd").alias("d"),
        F.when(k == 1, day).otherwise("").alias("r"), F.when(k == 0, day).otherwise("").alias("p"),
    )
    listed = orders.groupBy("o_custkey").agg(F.collect_list(F.struct("a", "f", "d", "r", "p")).alias("l"))
    names = {"accessionNumber": "a", "form": "f", "filingDate": "d", "reportDate": "r", "periodOfReport": "p"}
    whole = F.to_json(F.struct(*(F.col(f"l.{c}").alias(n) for n, c in names.items())))
    json = F.when(F.col("o_custkey") % 9 == 8, F.substring(whole, F.lit(1), F.lit(20))).otherwise(whole)
    return files.filings(listed.select(json.alias("json")), "json", "10-Q")


@query("""WITH c AS (SELECT c_custkey AS entity, CASE c_custkey % 3 WHEN 0 THEN 'domestic' WHEN 1 THEN 'canadian' ELSE 'foreign' END AS regime, CAST('1992-01-01' AS DATE) + CAST(c_custkey % 1000 AS INTEGER) AS first_filing FROM customer),
    f AS (SELECT o_custkey AS entity, o_orderkey AS id, ['8-K', '10-Q', '10-K', '6-K', '40-F', '20-F'][1 + o_orderkey % 6] AS form, CAST(o_orderdate AS DATE) AS filed FROM orders)
    SELECT id, form, regime FROM f JOIN c USING (entity) WHERE filed >= greatest(DATE '1993-06-01', first_filing)
        AND list_contains(CASE regime WHEN 'domestic' THEN ['8-K', '10-Q', '10-K'] WHEN 'canadian' THEN ['6-K', '40-F'] ELSE ['6-K', '20-F'] END, form)""")
def due_filings_all(spark, d):
    k = F.col("c_custkey")
    companies = table(spark, d, "customer").select(
        k.alias("entity"), F.when(k % 3 == 0, "domestic").when(k % 3 == 1, "canadian").otherwise("foreign").alias("regime"), F.date_add(F.to_date(F.lit("1992-01-01")), (k % 1000).cast("int")).alias("first_filing")
    )
    form = F.element_at(F.array(*map(F.lit, ("8-K", "10-Q", "10-K", "6-K", "40-F", "20-F"))), (F.col("o_orderkey") % 6 + 1).cast("int"))
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderkey").alias("id"), form.alias("form"), F.to_date("o_orderdate").alias("filed"))
    return registry.due_filings(companies, rows, F.to_date(F.lit("1993-06-01"))).select("id", "form", "regime")


@query("""WITH x AS (SELECT DISTINCT l_orderkey AS filing, l_linenumber AS n, ['10-K', 'EX-99', 'EX-99.1', 'EX-99.2', 'EX-10'][CAST(1 + (min(l_partkey)) % 5 AS INTEGER)] AS kind FROM lineitem GROUP BY ALL)
    SELECT filing, kind, n FROM x WHERE kind LIKE 'EX-99%' QUALIFY row_number() OVER (PARTITION BY filing ORDER BY kind <> 'EX-99.1', n) = 1""")
def exhibit_links(spark, d):
    kinds = F.array(*map(F.lit, ("10-K", "EX-99", "EX-99.1", "EX-99.2", "EX-10")))
    links = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("filing"), F.col("l_linenumber").alias("n")).agg(F.min("l_partkey").alias("p"))
    rows = links.select("filing", "n", F.element_at(kinds, (F.col("p") % 5 + 1).cast("int")).alias("kind"))
    return registry.main_exhibit(rows, "filing", "kind", "n").select("filing", "kind", "n")


@query("""SELECT s_suppkey, metric, 'Extract ' || metric || chr(10) || chr(10) || CASE WHEN s_suppkey % 3 = 0 THEN 'own ' || metric WHEN metric = 'A' THEN 'metric A' ELSE 'default' END || chr(10) || chr(10) || s_name AS prompt
    FROM supplier, (SELECT unnest(['A', 'N', 'R']) AS metric)""")
def metric_prompts(spark, d):
    """A prompt for each supplier and metric: its own instructions, else the metric's, else the default."""
    metrics = F.explode(F.array(*map(F.lit, "ANR"))).alias("metric")
    rows = table(spark, d, "supplier").select("s_suppkey", "s_name", metrics)
    own = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("own "), F.col("metric")))
    chosen = documents.instructions(own, F.when(F.col("metric") == "A", "metric A").otherwise("  "), F.lit("default"))
    blocks = F.array(F.concat(F.lit("Extract "), F.col("metric")), chosen, F.lit(" "), F.col("s_name"))
    rows = rows.select("s_suppkey", "metric", F.concat_ws("|", F.col("s_suppkey").cast("string"), "metric").alias("key"), F.posexplode(blocks).alias("n", "text"))
    told = documents.prompts(rows, "key", "n", "text").withColumn("k", F.split("key", r"\|"))
    return told.select(F.col("k")[0].cast("long").alias("s_suppkey"), F.col("k")[1].alias("metric"), "prompt")


@query("SELECT count(*) AS n, count(DISTINCT o_orderkey) AS distinct_rows, bool_and(o_orderkey IN (SELECT o_orderkey FROM orders)) AS all_known FROM (SELECT o_orderkey FROM orders LIMIT 500)")
def seeded_sample(spark, d):
    """What holds of any sample of 500: its size, no repeats, rows of the table only."""
    orders = table(spark, d, "orders").select("o_orderkey")
    one = filters.sampled(orders, 500, 7, "o_orderkey")
    known = orders.select(F.col("o_orderkey").alias("k"))
    return one.join(known, F.col("k") == F.col("o_orderkey"), "left").agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("distinct_rows"), F.bool_and(F.col("k").isNotNull()).alias("all_known"))


@query("""SELECT page_id, page_id % 7 = 0 OR regexp_matches(lower(html), 'just a moment|attention required|verify you are human|captcha|access denied') AS challenged, regexp_matches(lower(html), 'cookies|the the') AS cookies FROM pages""")
def challenged_pages(spark, d):
    """Pages that stop robots, by status or by what they say."""
    status = F.when(F.col("page_id") % 7 == 0, 403).otherwise(200)
    said = text.has_any(F.col("html"), ["Cookies", "the the"])
    return table(spark, d, "pages").select("page_id", text.bot_challenge(F.col("html"), status).alias("challenged"), said.alias("cookies"))


@query(r"""WITH u AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host, regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', '') AS path FROM pages),
    r AS (SELECT unnest(['example.com', 'example.com', 'example.net', 'org', 'm.ththth.example.net']) AS h, unnest(['/en', '', '/fr', '/de', '']) AS prefix, unnest(['com-en', 'com', 'net-fr', 'org-de', 'mobile']) AS rule, unnest([2, 3, 4, 5, 1]) AS rank)
    SELECT page_id, rule FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, prefix) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY rank) = 1""")
def host_rules(spark, d):
    """Rules of a domain, of a part of it, of a top domain, and of one host, by rank."""
    rules = [("example.com", "/en", "com-en", 2), ("example.com", "", "com", 3), ("example.net", "/fr", "net-fr", 4), ("org", "/de", "org-de", 5), ("m.ththth.example.net", "", "mobile", 1)]
    known = spark.createDataFrame(rules, "host string, prefix string, rule string, rank int")
    return registry.matched_rules(table(spark, d, "pages").select("page_id", "url"), known).select("page_id", "rule")


@query("""WITH w AS (SELECT o_custkey AS entity, CAST(o_orderdate AS DATE) AS s, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 900 AS INTEGER) END AS e, o_orderpriority AS cadence FROM orders WHERE o_orderstatus = 'F'),
    x AS (SELECT o_orderkey AS id, o_custkey AS entity, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderstatus <> 'F')
    SELECT id, coalesce(cadence, 'none') AS cadence FROM x LEFT JOIN w ON w.entity = x.entity AND day >= s AND (e IS NULL OR day <= e) QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, cadence DESC) = 1""")
def asof_windows(spark, d):
    """The latest of several windows of a customer, closed and open ones, that holds a day."""
    orders = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    last = F.when(F.col("o_orderkey") % 4 != 0, F.date_add("day", (F.col("o_orderkey") % 900).cast("int")))
    windows = orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("entity"), F.col("day").alias("start"), last.alias("end"), F.col("o_orderpriority").alias("cadence"))
    rows = orders.where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("entity"), "day")
    return joins.as_of(rows, windows, "entity", "day", "cadence", "none").select("id", "cadence")


@query(r"""WITH d AS (SELECT doc_id, source AS entity, 'https://x.org/' || doc_id // 3 AS url, coalesce(text, '') AS t FROM documents),
    b AS (SELECT *, CASE WHEN contains(lower(t), 'access denied') OR contains(lower(t), 'not found') OR contains(lower(t), 'idiot') THEN 'error_page'
        WHEN len(list_filter(string_split_regex(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) < 50 THEN 'insufficient_content' END AS bad FROM d),
    f AS (SELECT entity, url, min(doc_id) AS first FROM b WHERE bad IS NULL GROUP BY ALL)
    SELECT doc_id, coalesce(bad, CASE WHEN (doc_id // 3) % 10 = 0 OR doc_id <> first THEN 'duplicate' ELSE 'ingested' END) AS verdict FROM b LEFT JOIN f USING (entity, url)""")
def crawl_gate(spark, d):
    """Documents as fetched pages: three share a URL, in spellings of it, every tenth is known."""
    docs = table(spark, d, "documents")
    n = F.floor(F.col("doc_id") / 3).cast("string")
    url = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("HTTPS://X.org/"), n, F.lit("?utm_source=a"))).otherwise(F.concat(F.lit("https://x.org/"), n, F.lit("#top")))
    pages = docs.select("doc_id", F.col("source").alias("entity"), url.alias("url"), "text")
    known = docs.where("floor(doc_id / 3) % 10 = 0").select(F.col("source").alias("entity"), F.concat(F.lit("https://x.org/"), n).alias("url"))
    return crawl.gated(pages, known, "doc_id", (*crawl.ERRORS, "idiot")).select("doc_id", "verdict")


@query("""WITH o AS (SELECT o_custkey AS k, o_orderkey AS id FROM orders), c AS (SELECT DISTINCT k FROM o)
    SELECT k AS key, CASE WHEN id % 3 = 0 THEN 'ACME' ELSE CAST(k AS VARCHAR) END AS entity, 'https://x.org/' || id AS url, 'ok' AS status FROM o WHERE k % 5 < 3
    UNION ALL SELECT k, NULL, NULL, CASE k % 5 WHEN 3 THEN 'bad_format' ELSE 'missing' END FROM c WHERE k % 5 >= 3""")
def crawl_artifacts(spark, d):
    """An artifact of each customer's orders; of every five one is no list and one is missing."""
    id_, kind = F.col("o_orderkey").cast("string"), F.col("o_custkey") % 5
    url = F.concat(F.lit("https://x.org/"), id_)
    one = F.struct(F.when(F.col("o_orderkey") % 3 == 0, "acme").when(F.col("o_orderkey") % 3 == 1, " ").alias("ticker"), F.when(F.col("o_orderkey") % 2 == 0, url).alias("source_url"), url.alias("url"))
    made = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.to_json(F.collect_list(one)).alias("json"))
    kind = F.col("key") % 5
    raw = F.when(kind < 3, F.col("json")).when(kind == 3, F.concat(F.lit('{"documents": '), F.col("json"), F.lit("}")))
    return crawl.artifact_documents(made.select("key", raw.alias("raw")), "key", "raw").drop("text")


@query(r"""WITH p AS (SELECT page_id % 7 AS entity, coalesce(nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)), ''), '(unknown)') AS host, CASE WHEN page_id % 3 > 0 THEN '20' || (10 + page_id % 13) || '-Q1' END AS period FROM pages)
    SELECT entity, host, count(*) AS docs, CASE WHEN min(period) IS NULL THEN '?' WHEN min(period) = max(period) THEN min(period) ELSE min(period) || '–' || max(period) END AS span FROM p GROUP BY ALL""")
def crawl_index_notes(spark, d):
    period = F.when(F.col("page_id") % 3 > 0, F.concat(F.lit("20"), (10 + F.col("page_id") % 13).cast("string"), F.lit("-Q1")))
    return crawl.index_notes(table(spark, d, "pages").select((F.col("page_id") % 7).alias("entity"), "url", period.alias("period")))


@query("""WITH s AS (SELECT o_custkey AS c, arg_min(CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN repeat('x', 2001) ELSE 'note ' || o_orderkey END, -o_orderkey) AS t FROM orders GROUP BY ALL)
    SELECT coalesce(c_custkey, c) AS key, md5(trim(CASE WHEN t IS NULL OR t = '' OR length(t) > 2000 THEN coalesce(p, '') WHEN coalesce(p, '') = '' THEN t ELSE p || chr(10) || chr(10) || t END)) AS prompt
    FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END AS p FROM customer) FULL JOIN s ON c = c_custkey""")
def suggested_prompts(spark, d):
    """The last suggestion of each customer below its prompt, if it has one; blank and long ones don't count."""
    k = F.col("o_orderkey") % 4
    text_ = F.when(k == 0, " ").when(k == 1, F.repeat(F.lit("x"), 2001)).otherwise(F.concat(F.lit(" note "), F.col("o_orderkey").cast("string")))
    said = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), text_.alias("text"), F.col("o_orderkey").alias("seq"))
    prompts = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise("").alias("prompt"))
    return crawl.suggestions_applied(prompts, said, "key").select("key", F.md5("prompt").alias("prompt"))
