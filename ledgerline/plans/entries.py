"""Queries of operators on inputs that Spark derives from the tables, each with
SQL written from the rule and not from the code."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html, periods, text
from ..operators import aggregates, config, coverage, documents, extract, filters, joins, merge, registry, windows
from ..sources import files
from .views import OBS, observations, table

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def newest_orders(spark, d):
    return filters.newest(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 50, ["o_orderkey"])


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 1")
def fifo_head(spark, d):
    jobs = table(spark, d, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "O", "pending").otherwise("done"))
    return filters.queue_head(jobs, "status", "o_orderdate", "o_orderkey").select("o_orderkey")


@query("SELECT c_custkey, CAST((row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) % 4 AS INTEGER) AS part FROM customer")
def round_robin(spark, d):
    return filters.dealt(table(spark, d, "customer"), "c_custkey", 4, "c_nationkey").select("c_custkey", F.col("part").cast("int"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def order_page(spark, d):
    return filters.page(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 25, 2)


@query("SELECT doc_id FROM documents WHERE text IS NOT NULL AND text <> ''")
def docs_with_text(spark, d):
    return table(spark, d, "documents").where(filters.has_text(F.col("text"))).select("doc_id")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' OR c_acctbal < 0")
def default_segment(spark, d):
    segment = F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment"))
    return table(spark, d, "customer").where(filters.equals_or_default(segment, "BUILDING")).select("c_custkey")


_MIXED = """SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, quarter(o_orderdate) AS q, o_orderkey % 3 AS k, o_orderdate FROM orders"""


def _mixed(spark, d):
    """Orders with their period as a month, a quarter or a fiscal year."""
    day = F.col("o_orderdate")
    kind = F.col("o_orderkey") % 3
    year = F.year(day).cast("string")
    period = F.when(kind == 0, F.date_format(day, "yyyy-MM-01")).when(kind == 1, periods.quarter_of(day)).otherwise(F.concat(year, F.lit("-FY")))
    return table(spark, d, "orders").select("o_orderkey", period.alias("period"), F.trunc(day, "MM").alias("month"))


@query(f"""SELECT o_orderkey, CAST(y AS INTEGER) AS year, CAST(CASE k WHEN 0 THEN m WHEN 1 THEN q * 3 ELSE 12 END AS INTEGER) AS month, CAST(k = 2 AS INTEGER) AS annual,
    row_number() OVER (ORDER BY year, month, annual, o_orderkey) - 1 AS place FROM ({_MIXED})""")
def mixed_period_sort(spark, d):
    rows = _mixed(spark, d).withColumns({"k": periods.period_sort_key(F.col("period")), "all": F.lit(0)})
    return windows.numbered(rows, "all", ["k", "o_orderkey"], "place").select("o_orderkey", "k.year", "k.month", "k.annual", "place")


@query(f"""SELECT o_orderkey, CAST(CASE k WHEN 0 THEN NULL WHEN 1 THEN make_date(y, (q - 1) * 3 + p + 1, 1) ELSE make_date(y, p + 1, 1) END AS DATE) AS month
    FROM ({_MIXED}), (SELECT unnest(range(12)) AS p) WHERE (k = 1 AND p < 3) OR k = 2""")
def months_covered(spark, d):
    rows = _mixed(spark, d)
    return rows.select("o_orderkey", F.explode(periods.covered_months(F.col("period"))).alias("month"))


@query("""SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) - to_months(CAST(k AS INTEGER)) AS DATE) AS month, k AS back FROM orders, (SELECT unnest([1, 2, 3]) AS k)""")
def months_before(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.posexplode(periods.prior_months(F.trunc("o_orderdate", "MM"), 3)).alias("k", "month"))
    return rows.select("o_orderkey", "month", (F.col("k") + 1).alias("back"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE CAST(date_trunc('month', o_orderdate) AS DATE) END AS month FROM orders""")
def filename_period(spark, d):
    day, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    name = (
        F.when(k == 0, F.concat(F.lit("/x 2001-01-01/10-Q "), F.date_format(day, "yyyy-MM-dd"), F.lit(".pdf")))
        .when(k == 1, F.concat(F.lit("/a/Update "), F.date_format(day, "MMMM yyyy"), F.lit(".html")))
        .when(k == 2, F.concat(F.lit("/a/"), F.date_format(day, "MMMM  yyyy"), F.lit(" production.pdf")))
        .otherwise(F.lit("/a/notes.pdf"))
    )
    return table(spark, d, "orders").select("o_orderkey", periods.period_from_filename(name).alias("month"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE CAST(date_trunc('month', o_orderdate) AS DATE) END AS month FROM orders""")
def text_period(spark, d):
    """The surest phrase names the order's month; a lesser one before it another."""
    named, k = F.date_format("o_orderdate", "MMMM yyyy"), F.col("o_orderkey") % 5
    other = F.date_format(F.add_months("o_orderdate", 5), "MMMM yyyy")
    said = (
        F.when(k == 0, F.concat(other, F.lit(" mining notes. Output during "), named))
        .when(k == 1, F.concat(F.lit("Updated "), other, F.lit(". Figures in "), named, F.lit(" rose")))
        .when(k == 2, F.concat(F.lit("Filed "), other, F.lit(". "), named, F.lit(" bitcoin output")))
        .when(k == 3, F.concat(F.lit("Dated "), named, F.lit(", then "), other))
        .otherwise(F.lit("No month is named, nor 2024"))
    )
    return table(spark, d, "orders").select("o_orderkey", periods.period_from_text(said).alias("month"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN NULL ELSE year(o_orderdate) || '-Q' || quarter(o_orderdate) END AS period FROM orders""")
def quarterly_documents(spark, d):
    year, q, k = F.year("o_orderdate").cast("string"), F.quarter("o_orderdate"), F.col("o_orderkey") % 3
    spelt = F.element_at(F.array(*map(F.lit, ("First", "second", "Third", "FOURTH"))), q)
    url = F.when(k == 0, F.concat(F.lit("https://x.com/q"), q.cast("string"), F.lit("-"), year, F.lit("-results"))).otherwise("https://x.com/a")
    said = F.when(k == 1, F.concat(spelt, F.lit(" quarter of "), year, F.lit(" results"))).otherwise("Results")
    return table(spark, d, "orders").select("o_orderkey", periods.quarterly_document(url, said).alias("period"))


@query("""SELECT o_orderkey, CAST(CASE o_orderkey % 2 WHEN 0 THEN 1 ELSE 2 END AS BIGINT) AS n, CAST(date_trunc('month', o_orderdate) - CASE o_orderkey % 2 WHEN 0 THEN INTERVAL 0 MONTH ELSE INTERVAL 3 MONTH END AS DATE) AS first FROM orders""")
def months_named(spark, d):
    """Months of a text with one or two distinct month phrases, one of them twice."""
    named = F.date_format("o_orderdate", "MMMM yyyy")
    other = F.when(F.col("o_orderkey") % 2 == 0, named).otherwise(F.date_format(F.add_months("o_orderdate", -3), "MMMM yyyy"))
    found = periods.months_mentioned(F.concat(named, F.lit(" to "), other, F.lit(", again "), named))
    return table(spark, d, "orders").select("o_orderkey", F.size(found).cast("long").alias("n"), F.get(found, F.lit(0)).alias("first"))


_FLAGS = ("analyst_gap", "data", "quarterly", "review", "llm_empty", "parse_error", "extract_error", "scraper_error")


@query("""SELECT o_orderkey, CASE WHEN (k // 1) % 2 = 1 THEN 'analyst_gap' WHEN (k // 2) % 2 = 1 AND (k // 4) % 2 = 1 THEN 'data_quarterly' WHEN (k // 2) % 2 = 1 THEN 'data'
    WHEN (k // 8) % 2 = 1 THEN 'review_pending' WHEN (k // 16) % 2 = 1 THEN 'llm_empty' WHEN (k // 32) % 2 = 1 THEN 'parse_failed' WHEN (k // 64) % 2 = 1 THEN 'extract_failed'
    WHEN (k // 128) % 2 = 1 THEN 'scraper_error' ELSE 'no_document' END AS state FROM (SELECT o_orderkey, (o_orderkey * 37) % 256 AS k FROM orders)""")
def metric_cells(spark, d):
    """All nine states: the flags of a cell are the bits of a number of its order."""
    bits = F.col("o_orderkey") * 37 % 256
    flags = {name: F.shiftright(bits, n).bitwiseAND(1) == 1 for n, name in enumerate(_FLAGS)}
    return table(spark, d, "orders").select("o_orderkey", coverage.metric_cell_state(flags).alias("state"))


@query("""WITH m AS (SELECT l_orderkey, list(DISTINCT CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'ingested' ELSE 'legacy_undated' END) AS s FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL)
    SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'accepted' WHEN o_totalprice > 350000 THEN 'extracted_in_review' WHEN o_totalprice > 300000 THEN 'ingested_pending_extraction'
    WHEN list_contains(s, 'failed') THEN 'pending_ingest' WHEN list_contains(s, 'legacy_undated') THEN 'legacy_undated' WHEN list_contains(s, 'ingested') THEN 'ingested_pending_extraction'
    ELSE 'no_source' END AS state FROM orders LEFT JOIN m ON l_orderkey = o_orderkey""")
def manifest_cells(spark, d):
    state = F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_returnflag") == "A", "ingested").otherwise("legacy_undated")
    entries = table(spark, d, "lineitem").where("l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(state).alias("states"))
    price = F.col("o_totalprice")
    cell = coverage.cell_state(price > 400000, price > 350000, price > 300000, F.col("states"))
    return table(spark, d, "orders").join(entries, "o_orderkey", "left").select("o_orderkey", cell.alias("state"))


_SOURCE = "CASE o_orderkey % 4 WHEN 0 THEN 'edgar_10k' WHEN 1 THEN 'ir_press_release' WHEN 2 THEN 'edgar_8k' ELSE 'archive_pdf' END"


def _reports(spark, d):
    """A report of each order: navigation, date, body, boilerplate; filings with sections."""
    k, name = F.col("o_orderkey") % 4, F.format_string("Order %d for %s", "o_orderkey", "o_orderpriority")
    day = F.date_format("o_orderdate", "MMMM d, yyyy")
    long = F.repeat(F.lit("figures "), 60)
    release = F.concat_ws("\n", F.lit("Home"), F.lit("Menu"), name, F.lit(""), day, long, F.lit("About Orders"), F.lit("Source: Orders"))
    filing = F.concat(F.lit("Item 1. "), name, F.lit(" "), long, F.lit("\nItem 2. short\nItem 3. "), long, F.lit("\nSIGNATURES\nsigned"))
    source = F.when(k == 0, "edgar_10k").when(k == 1, "ir_press_release").when(k == 2, "edgar_8k").otherwise("archive_pdf")
    # Dealt by key: the work of a row is much more than its bytes, by which files are cut into tasks.
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate").repartition("o_orderkey")
    return orders.select("o_orderkey", source.alias("source_type"), F.when(k % 2 == 0, filing).otherwise(release).alias("text"))


_NAME = "format('Order {} for {}', o_orderkey, o_orderpriority)"
_LONG = "repeat('figures ', 60)"
_RELEASE = f"{_NAME} || chr(10) || chr(10) || strftime(o_orderdate, '%B %-d, %Y') || chr(10) || {_LONG}"


@query(f"""SELECT o_orderkey, sha256(CASE WHEN o_orderkey % 2 = 1 THEN rtrim({_RELEASE}) ELSE 'Item 1. ' || {_NAME} || ' ' || {_LONG} || chr(10) || 'Item 2. short' || chr(10) || 'Item 3. ' || rtrim({_LONG}) END) AS prepared FROM orders""")
def report_text(spark, d):
    ready = documents.prepared_text(F.col("source_type"), F.col("text"))
    return _reports(spark, d).select("o_orderkey", F.sha2(ready, 256).alias("prepared"))


@query(f"""WITH r AS (SELECT *, {_SOURCE} AS s FROM orders)
    SELECT o_orderkey, 'release' AS parser, 0 AS section FROM r WHERE s <> 'edgar_10k' UNION ALL
    SELECT o_orderkey, 'filing', p FROM r, (SELECT unnest([1, 3]) AS p) WHERE s = 'edgar_10k'""")
def parser_dispatch(spark, d):
    found = documents.parsed(_reports(spark, d), "o_orderkey", "source_type", "text")
    number = F.coalesce(F.regexp_extract("body", r"^Item (\d)", 1).try_cast("int"), F.lit(0))
    return found.select("o_orderkey", "parser", F.when(F.col("parser") == "filing", number).otherwise(0).alias("section"))


@query("""WITH q AS (SELECT o_orderkey AS id, o_custkey AS entity, strftime(o_orderdate, '%Y-%m') AS period, o_totalprice AS value, o_orderkey % 7 AS k FROM orders),
    t AS (SELECT DISTINCT entity, period FROM q WHERE k < 2)
    SELECT id, CASE WHEN k < 2 THEN 'APPROVED' WHEN k = 2 THEN 'REJECTED' WHEN t.entity IS NOT NULL THEN 'DISMISSED' ELSE 'PENDING' END AS status
    FROM q LEFT JOIN t ON t.entity = q.entity AND t.period = q.period""")
def review_decisions(spark, d):
    return _reviewed(spark, d)[2].select("id", "status")


@query("""SELECT o_custkey AS entity, strftime(o_orderdate, '%Y-%m') AS period, CASE o_orderkey % 7 WHEN 1 THEN 1.0 ELSE o_totalprice END AS value FROM orders WHERE o_orderkey % 7 < 2""")
def review_facts(spark, d):
    return _reviewed(spark, d)[0].select("entity", "period", "value")


def _reviewed(spark, d):
    queue = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("entity"), F.date_format("o_orderdate", "yyyy-MM").alias("period"),
        F.lit("price").alias("metric"), F.col("o_totalprice").alias("value"), F.lit("PENDING").alias("status"),
    )
    k = F.col("id") % 7
    action = F.when(k == 0, "approve").when(k == 1, "edit").when(k == 2, "reject")
    decisions = queue.select("id", action.alias("action"), F.when(k == 1, F.lit(1.0)).alias("value")).where("action is not null")
    return merge.approved(queue, decisions)


@query(f"""WITH {OBS}, q AS (SELECT DISTINCT l_suppkey AS entity, CAST(date_trunc('month', l_shipdate) AS DATE) AS period, l_returnflag AS metric FROM lineitem WHERE l_quantity > 45)
    SELECT entity, period, metric, value, 'PENDING' AS status FROM obs ANTI JOIN q USING (entity, period, metric) WHERE metric <> 'R'""")
def promoted_facts(spark, d):
    facts = observations(spark, d).withColumn("method", F.when(F.col("metric") == "R", "analyst").otherwise("pattern"))
    queue = table(spark, d, "lineitem").where("l_quantity > 45").select(
        F.col("l_suppkey").alias("entity"), F.trunc("l_shipdate", "MM").alias("period"), F.col("l_returnflag").alias("metric"), F.lit("PENDING").alias("status")
    )
    return merge.promoted(facts, queue).select("entity", "period", "metric", "value", "status")


@query("""WITH e AS (SELECT o_custkey AS key, arg_max(v, o_orderkey) AS value FROM (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN -1 ELSE o_totalprice END AS v FROM orders) WHERE v > 0 GROUP BY ALL)
    SELECT coalesce(c_custkey, key) AS key, coalesce(e.value, c_acctbal) AS value, CASE WHEN e.key IS NULL THEN 'pattern' ELSE 'manual' END AS method FROM customer FULL JOIN e ON key = c_custkey""")
def manual_entries(spark, d):
    facts = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"), F.lit("pattern").alias("method"))
    value = F.when(F.col("o_orderkey") % 3 == 0, F.lit(-1.0)).otherwise(F.col("o_totalprice"))
    entries = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), value.alias("value"), F.col("o_orderkey").alias("seq"))
    return merge.entered(facts, entries, ["key"])


@query("""SELECT url, page_id FROM (SELECT 'https://ex.org/' || o_custkey AS url, min(o_orderkey) AS page_id FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL)
    UNION ALL SELECT 'https://ex.org/' || o_custkey, min(o_orderkey) FROM orders WHERE o_orderstatus <> 'F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') GROUP BY ALL""")
def url_unique_insert(spark, d):
    """Landed artifacts become new rows where no row has their URL's hash."""
    rows = table(spark, d, "orders").select(
        text.canonical_url(F.concat(F.lit("HTTPS://Ex.org/"), F.col("o_custkey").cast("string"), F.lit("?utm_source=x#top"))).alias("url"), F.col("o_orderkey").alias("page_id"), F.col("o_orderkey").alias("seq"), "o_orderstatus"
    ).withColumn("url_hash", F.sha2("url", 256))
    old = merge.first_wins(rows.where("o_orderstatus = 'F'").drop("o_orderstatus"), ["url_hash"])
    new = rows.where("o_orderstatus <> 'F'").drop("o_orderstatus")
    return merge.insert_new(old, new, ["url_hash"]).select("url", "page_id")


@query("""SELECT user_id, list_sort(list_distinct(list_append(list_filter(l, lambda x: x <> 'error'), 'reviewed'))) AS items FROM (SELECT user_id, list(DISTINCT event_type) AS l FROM events GROUP BY ALL)""")
def edited_lists(spark, d):
    lists = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("items"))
    return lists.select("user_id", F.array_sort(config.edited_list(F.col("items"), F.lit("error"), F.lit("reviewed"))).alias("items"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND c_custkey IS NULL THEN 'stopped' WHEN o_orderstatus = 'O' THEN 'running' ELSE 'done' END AS status
    FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey""")
def orphaned_runs(spark, d):
    runs = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") == "O", "running").otherwise("done").alias("status"))
    alive = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return registry.orphaned(runs, alive, "o_custkey", "status").select("o_orderkey", "status")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN 'no mode' WHEN c_custkey % 4 = 0 AND c_acctbal < 0 THEN 'rss mode needs rss_url'
    WHEN c_custkey % 4 = 1 AND c_acctbal < 5000 THEN 'template mode needs url_template' END AS issue FROM customer""")
def config_issues(spark, d):
    k, balance = F.col("c_custkey") % 4, F.col("c_acctbal")
    mode = F.when(k == 0, "rss").when(k == 1, "template").when(k == 2, "skip")
    fields = {"rss_url": F.when(balance >= 0, "https://x/rss"), "url_template": F.when(balance >= 5000, "x").otherwise(" "), "ir_url": F.lit(None).cast("string")}
    return table(spark, d, "customer").select("c_custkey", registry.config_issue(mode, fields).alias("issue"))


@query("""SELECT o_orderkey, l_linenumber AS line, ANY_VALUE(l_quantity) AS value FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL HAVING count(*) = 1""")
def table_rows(spark, d):
    """Values out of pipe tables that are written from the lines of each order."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.min("l_quantity").alias("q")).where("n = 1")
    written = F.format_string("| line %d | n/a | %.2f BTC |", "l_linenumber", "q")
    docs = lines.groupBy("l_orderkey").agg(F.concat_ws("\n", F.lit("Title"), F.array_sort(F.collect_list(written))).alias("text"))
    body = docs.select("l_orderkey", F.regexp_replace("text", r"(?m)^\| ", "").alias("text"))
    found = extract.table_values(body, "l_orderkey", "text")
    return found.select(F.col("l_orderkey").alias("o_orderkey"), F.regexp_extract("label", r"line (\d+)", 1).cast("int").alias("line"), "value")


@query("""SELECT o_orderkey, 'price' AS metric, o_totalprice AS value, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 1.0 ELSE 0.5 END AS DOUBLE) AS confidence FROM orders WHERE o_totalprice BETWEEN 1000 AND 300000""")
def parsed_responses(spark, d):
    """JSON answers in talk: numbers out of range go, confidence is clamped or the default."""
    trust = F.when(F.col("o_orderkey") % 3 == 0, ', "confidence": 7').otherwise("")
    raw = F.concat(F.lit('Sure: {"price": {"value": '), F.format_string("%.2f", "o_totalprice"), trust, F.lit('}, "other": {"value": "none"}} Done.'))
    ranges = spark.createDataFrame([("price", 1000.0, 300000.0), ("other", 0.0, 1.0)], "metric string, lo double, hi double")
    return extract.parse_responses(table(spark, d, "orders").select("o_orderkey", raw.alias("raw")), "o_orderkey", "raw", ranges)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'production' ELSE 'prio ' || substr(o_orderpriority, 1, 1) END AS metric, o_totalprice AS value,
    CASE WHEN o_orderkey % 2 = 0 THEN 'flow' ELSE 'other' END AS category FROM orders""")
def broad_extraction(spark, d):
    name = F.when(F.col("o_orderkey") % 2 == 0, "BTC Mined ").otherwise(F.concat(F.lit("Prio "), F.substring("o_orderpriority", 1, 1)))
    first, again = (F.struct(name.alias("name"), x.alias("value")) for x in (F.format_number("o_totalprice", 2), F.lit("1")))
    bad = F.struct(F.lit("odd").alias("name"), F.lit("n/a").alias("value"))
    synonyms = spark.createDataFrame([("btc mined", "production", "flow")], "name string, metric string, category string")
    rows = table(spark, d, "orders").select("o_orderkey", F.to_json(F.array(bad, first, again)).alias("raw"))
    return extract.broad_values(rows, "o_orderkey", "raw", synonyms)


@query("""SELECT p_partkey, CAST(CASE p_partkey % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.85 WHEN 2 THEN 2.0 / 3 ELSE 0.0 END AS DOUBLE) AS score FROM part""")
def label_scores(spark, d):
    """A label against an alias: equal but for case and punctuation, part of it, two of three words, one, none."""
    k, name = F.col("p_partkey") % 5, F.col("p_name")
    alias = F.concat(name, F.lit(" held"))
    two = F.concat(F.substring_index(name, " ", 1), F.lit(" x "), F.substring_index(name, " ", -1))
    cell = (
        F.when(k == 0, F.concat(F.upper(name), F.lit(",  Held!")))
        .when(k == 1, F.concat(F.lit("total "), name, F.lit(" held (BTC)")))
        .when(k == 2, two)
        .when(k == 3, F.lit("zz held"))
        .otherwise("qq ww")
    )
    return table(spark, d, "part").select("p_partkey", text.label_score(cell, alias).alias("score"))


@query("""SELECT p_partkey, p_size * CASE p_partkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 1e-3 WHEN 2 THEN 1e-6 END AS hashrate, CASE p_partkey % 3 WHEN 0 THEN 'BTC' WHEN 1 THEN 'EH/s' ELSE '' END AS unit FROM part""")
def hashrates(spark, d):
    k = F.col("p_partkey") % 4
    unit = F.when(k == 0, " EH/s").when(k == 1, " ph/S").when(k == 2, "TH/s").otherwise(" kW")
    said = F.concat(F.lit("Rate of "), F.col("p_size").cast("string"), unit, F.lit(" installed"))
    metric = F.when(F.col("p_partkey") % 3 == 0, "production").when(F.col("p_partkey") % 3 == 1, "hashrate").otherwise("other")
    return table(spark, d, "part").select("p_partkey", text.parse_hashrate(said).alias("hashrate"), text.metric_unit(metric, {"production": "BTC", "hashrate": "EH/s"}).alias("unit"))


@query("SELECT p_partkey, p_name LIKE '%ring' AND p_type <> 'ECONOMY' AS passes, p_partkey % 6 = 0 OR p_partkey % 4 = 0 AS challenged FROM part")
def gated_pages(spark, d):
    title = F.concat_ws(" ", "p_type", "p_name")
    page = F.when(F.col("p_partkey") % 6 == 0, "<p>Please VERIFY you are human</p>").otherwise("<p>ok</p>")
    status = F.when(F.col("p_partkey") % 4 == 0, 403).otherwise(200)
    return table(spark, d, "part").select("p_partkey", text.title_passes(title, "ring$", "^ECONOMY").alias("passes"), text.bot_challenge(page, status).alias("challenged"))


@query("""SELECT n_nationkey, list_sort(list_distinct([lower(n_name), 'b', 'quoted c'])) AS phrases FROM nation""")
def phrase_lists(spark, d):
    raw = F.concat(F.col("n_name"), F.lit(" , b\n\"Quoted C\",B,,"))
    return table(spark, d, "nation").select("n_nationkey", F.array_sort(text.phrase_list(raw)).alias("phrases"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN 'ACME' END AS entity, CASE WHEN o_orderkey % 2 = 0 THEN 'UNITED STATES report' ELSE 'x UNITED STATES report' END AS body FROM orders""")
def path_entities(spark, d):
    k = F.col("o_orderkey") % 3
    path = F.when(k == 0, "/a/ACME MONTHLY/f.pdf").when(k == 1, "/a/acme_monthly/f.pdf").otherwise("/a/ACME/f.pdf")
    body = F.when(F.col("o_orderkey") % 2 == 0, "0001234567 dei:x UNITED STATES report").otherwise("x UNITED STATES report")
    return table(spark, d, "orders").select("o_orderkey", registry.entity_of_path(path, ["ACME"]).alias("entity"), registry.without_preamble(body).alias("body"))


@query(f"""WITH {OBS}, docs AS (SELECT o_orderkey AS doc, o_custkey AS entity, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-01')
        WHEN 1 THEN year(o_orderdate) || '-Q' || quarter(o_orderdate) ELSE year(o_orderdate) || '-FY' END AS period FROM orders),
    m AS (SELECT DISTINCT entity, period AS month FROM obs)
    SELECT entity, month, doc FROM m JOIN docs USING (entity) WHERE docs.period IN (strftime(month, '%Y-%m-01'), year(month) || '-Q' || quarter(month), year(month) || '-FY')""")
def cover_match(spark, d):
    docs = _mixed(spark, d).join(table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("entity")), "o_orderkey").select(F.col("o_orderkey").alias("doc"), "entity", "period")
    months = observations(spark, d).select("entity", F.col("period").alias("month")).distinct()
    return joins.by_cover(docs, months).select("entity", "month", "doc")


@query("""WITH h AS (SELECT event_type AS metric, 'seen # of ' || chr(CAST(97 + user_id % 23 AS INTEGER)) || ' in #' AS pattern, event_id, user_id % 23 % 3 = 0 AND value > 20 AS hit FROM events),
    g AS (SELECT metric, pattern, CAST(max(CAST(hit AS INTEGER)) AS INTEGER) AS found, count(*) AS n, count(DISTINCT event_id) AS reports FROM h GROUP BY ALL)
    SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY metric ORDER BY found DESC, n DESC, pattern) <= 5""")
def clustered_hits(spark, d):
    """Some 23 patterns a metric, of which a third is ever found: five stay."""
    letter = F.char(97 + F.col("user_id") % 23)
    said = F.concat(F.lit("seen "), F.col("user_id").cast("string"), F.lit(" of "), letter, F.lit(" in "), F.col("event_id").cast("string"))
    signal = F.when((F.col("user_id") % 23 % 3 == 0) & (F.col("value") > 20), "found").otherwise("missed")
    hits = table(spark, d, "events").select(F.col("event_type").alias("metric"), said.alias("text"), signal.alias("signal"), F.col("event_id").alias("report"))
    return aggregates.clustered(hits).select("metric", "pattern", "found", "n", "reports")


@query("""SELECT c_custkey, coalesce(o.n, 0) AS orders, coalesce(e.n, 0) AS events FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL) o ON o_custkey = c_custkey
    LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY ALL) e ON user_id = c_custkey""")
def fact_star(spark, d):
    base = table(spark, d, "customer").select("c_custkey")
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    events = table(spark, d, "events").select(F.col("user_id").alias("c_custkey"))
    return joins.star(base, "c_custkey", {"orders": (orders, F.count("*")), "events": (events, F.count("*"))})


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE CASE WHEN o_orderkey % 4 = 0 THEN 'Order number ' || o_orderkey ELSE 'Second title ' || o_orderkey END END AS title,
    CASE WHEN o_orderkey % 4 = 2 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS published FROM orders""")
def page_titles(spark, d):
    k, n = F.col("o_orderkey") % 4, F.col("o_orderkey").cast("string")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    page = (
        F.when(k == 0, F.concat(F.lit("<meta content='Order number "), n, F.lit("' property='og:title'><title>Another title</title><time datetime='"), day, F.lit("T08:00'>")))
        .when(k == 1, F.concat(F.lit("<title>short</title><h1 class='x'><b>Second</b> title "), n, F.lit("</h1><p>"), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit("</p>")))
        .when(k == 2, F.concat(F.lit("<title> | Second\n title "), n, F.lit(" - </title>")))
        .otherwise(F.concat(F.lit("<meta name=\"pubdate\" content=\""), day, F.lit("\">")))
    )
    return table(spark, d, "orders").select("o_orderkey", html.document_title(page, F.lit(None).cast("string")).alias("title"), html.published_date(page).alias("published"))


@query("""WITH e AS (SELECT *, CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'pending' ELSE 'done' END AS status FROM events)
    SELECT user_id, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'done') AS done, min(ts) FILTER (status = 'pending') AS oldest FROM e GROUP BY ALL""")
def queue_groups(spark, d):
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "pending").otherwise("done")
    return aggregates.queue_groups(table(spark, d, "events").withColumn("status", status), ["user_id"], "status", "ts", ["pending", "failed", "done"])


@query("""SELECT entity, period, count(*) AS sources, bool_or(s = 0) AS accepted FROM (
    SELECT l_suppkey AS entity, CAST(date_trunc('month', l_shipdate) AS DATE) AS period, 0 AS s FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL
    UNION SELECT l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE), 1 FROM lineitem WHERE l_quantity > 40 GROUP BY ALL
    UNION SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE), 2 FROM orders GROUP BY ALL) GROUP BY ALL""")
def coverage_evidence(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("entity"), F.trunc("l_shipdate", "MM").alias("period"), "l_returnflag", "l_quantity")
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("entity"), F.trunc("o_orderdate", "MM").alias("period"))
    found = coverage.evidence({"accepted": lines.where("l_returnflag = 'R'"), "review": lines.where("l_quantity > 40"), "report": orders}, ["entity", "period"])
    return found.select("entity", "period", F.size("sources").cast("long").alias("sources"), F.array_contains("sources", "accepted").alias("accepted"))


@query("""SELECT o_custkey AS entity, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, arg_min(o_orderkey, (CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, -o_totalprice, o_orderkey)) AS doc FROM orders GROUP BY ALL""")
def preferred_document(spark, d):
    rank = filters.case_rank(F.col("o_orderstatus"), {"F": 0, "O": 1}, 2)
    docs = table(spark, d, "orders").select(F.col("o_custkey").alias("entity"), F.trunc("o_orderdate", "MM").alias("period"), F.col("o_orderkey").alias("doc"), rank.alias("rank"), "o_totalprice")
    return documents.preferred(docs, ["entity", "period"], [F.col("rank"), -F.col("o_totalprice"), F.col("doc")]).select("entity", "period", "doc")


@query("""SELECT * FROM (SELECT o_custkey AS key, o_orderkey AS id FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 500) UNION SELECT * FROM (SELECT user_id, event_id FROM events ORDER BY ts DESC, event_id LIMIT 500)""")
def newest_union(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"))
    events = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").alias("at"))
    return filters.newest_of([orders, events], "at", 500, ["id"]).select("key", "id")


@query("""WITH s AS (SELECT o_custkey AS entity, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS good FROM orders GROUP BY ALL)
    SELECT entity, CAST(count(*) AS BIGINT) AS snapshots, arg_max(n, month) AS n, arg_max(good, month) AS good, max(month) AS month FROM s GROUP BY ALL""")
def qc_snapshots(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("entity"), F.trunc("o_orderdate", "MM").alias("month"), (F.col("o_orderstatus") == "F").alias("good"))
    return aggregates.latest_snapshot(rows.groupBy("entity", "month").agg(F.count("*").alias("n"), F.count_if("good").alias("good")), "entity", "month")


@query("""SELECT c_custkey AS entity, CAST(min(o_orderdate) AS DATE) AS since, CAST(max(o_orderdate) AS DATE) AS until, count(*) FILTER (o_orderstatus = 'F') > 0 AS periodic FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL""")
def filing_windows(spark, d):
    filings = table(spark, d, "orders").select(F.col("o_custkey").alias("entity"), F.to_date("o_orderdate").alias("filed"), F.when(F.col("o_orderstatus") == "F", "10-Q").otherwise("8-K").alias("form"))
    known = table(spark, d, "customer").select(F.col("c_custkey").alias("entity"))
    return registry.filing_windows(filings.join(known, "entity"), ("10-Q", "10-K")).select("entity", "since", "until", "periodic")


@query("""SELECT o_orderkey, 'https://x.com/' || year(o_orderdate) || '/' || lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') || '-' || lower(monthname(o_orderdate)) AS url FROM orders""")
def expanded_templates(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderdate", F.lit("https://x.com/{year}/{mm}-{month}").alias("template"))
    return files.expand_templates(rows, "template", F.col("o_orderdate"), F.col("o_orderdate")).select("o_orderkey", "url")
