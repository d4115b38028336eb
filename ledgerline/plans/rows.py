"""Queries over orders, events, documents and pages, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html, periods, text
from ..operators import aggregates, coverage, extract, filters, joins, merge, windows
from ..streaming import merge as streams
from .views import table

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_STATUS = "CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END"


@query("""SELECT o_custkey, o_orderkey, count(l_orderkey) AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""")
def left_join_counts(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.with_counts(orders, lines, ["o_orderkey"], {"lines": F.count("*")})


@query("""SELECT c_custkey, coalesce(o.orders, 0) AS orders, coalesce(o.open, 0) AS open, coalesce(s.suppliers, 0) AS suppliers FROM customer
    LEFT JOIN (SELECT o_custkey, count(*) AS orders, count(*) FILTER (o_orderstatus = 'O') AS open FROM orders GROUP BY ALL) o ON o_custkey = c_custkey
    LEFT JOIN (SELECT s_nationkey, count(*) AS suppliers FROM supplier GROUP BY ALL) s ON s_nationkey = c_nationkey""")
def observability_star(spark, d):
    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    base = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    base = joins.with_counts(base, orders, ["c_custkey"], {"orders": F.count("*"), "open": F.count_if(F.col("o_orderstatus") == "O")})
    suppliers = table(spark, d, "supplier").withColumnRenamed("s_nationkey", "c_nationkey")
    return joins.with_counts(base, suppliers, ["c_nationkey"], {"suppliers": F.count("*")}).drop("c_nationkey")


@query("""SELECT o_custkey, count(DISTINCT o_orderkey) AS orders, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN o_orderkey END) AS returned,
    CAST(min(CASE WHEN l_returnflag = 'R' THEN l_shipdate END) AS DATE) AS first_return, CAST(max(o_orderdate) AS DATE) AS last_order, round(avg(l_discount), 4) AS mean_discount
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""")
def company_status(spark, d):
    joined = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    back = F.col("l_returnflag") == "R"
    return joined.groupBy("o_custkey").agg(
        F.countDistinct("o_orderkey").alias("orders"),
        F.countDistinct(F.when(back, F.col("o_orderkey"))).alias("returned"),
        F.min(F.when(back, F.col("l_shipdate"))).cast("date").alias("first_return"),
        F.max("o_orderdate").cast("date").alias("last_order"),
        F.round(F.avg("l_discount"), 4).alias("mean_discount"),
    )


@query("""WITH b AS (SELECT unnest(['0-0.02', '0.02-0.04', '0.04-0.06', '0.06-0.08', '0.08+', '0.5+']) AS bucket), c AS (
    SELECT CASE WHEN l_discount < 0.02 THEN '0-0.02' WHEN l_discount < 0.04 THEN '0.02-0.04' WHEN l_discount < 0.06 THEN '0.04-0.06' WHEN l_discount < 0.08 THEN '0.06-0.08'
        WHEN l_discount < 0.5 THEN '0.08+' ELSE '0.5+' END AS bucket, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT bucket, coalesce(n, 0) AS n FROM b LEFT JOIN c USING (bucket)""")
def confidence_histogram(spark, d):
    labels = ["0-0.02", "0.02-0.04", "0.04-0.06", "0.06-0.08", "0.08+", "0.5+"]
    return aggregates.bucketed(table(spark, d, "lineitem"), "l_discount", [0, 0.02, 0.04, 0.06, 0.08, 0.5], labels)


@query("""SELECT event_type, count(*) AS run_count, round(avg(value), 3) AS mean_value, round(avg(CASE WHEN value > 0 THEN least(value, 10) / value END), 4) AS hit_rate,
    min(ts) AS first_run, max(ts) AS last_run FROM events GROUP BY ALL""")
def benchmark_summary(spark, d):
    hit = F.when(F.col("value") > 0, F.least("value", F.lit(10.0)) / F.col("value"))
    return table(spark, d, "events").groupBy("event_type").agg(
        F.count("*").alias("run_count"), F.round(F.avg("value"), 3).alias("mean_value"), F.round(F.avg(hit), 4).alias("hit_rate"), F.min("ts").alias("first_run"), F.max("ts").alias("last_run")
    )


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_discount), 3) AS mean_confidence FROM lineitem GROUP BY ALL""")
def pattern_usage(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.avg("l_discount"), 3).alias("mean_confidence"))


@query("""SELECT count(*) AS orders, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_totalprice > 100000) AS large,
    count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent FROM orders""")
def dashboard_counts(spark, d):
    return table(spark, d, "orders").agg(
        F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.count_if(F.col("o_totalprice") > 100000).alias("large"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent")
    )


@query("""SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND date_trunc('month', l_shipdate) = date_trunc('month', o_orderdate))
    AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def backfill_anti(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("ym"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.date_format("l_shipdate", "yyyy-MM").alias("ym"))
    owing = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return orders.join(lines, ["o_orderkey", "ym"], "left_anti").join(owing, "o_custkey", "left_anti").select("o_orderkey", "o_custkey")


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def semi_in(spark, d):
    chosen = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(chosen, "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("""SELECT o_orderkey FROM orders WHERE (SELECT count(DISTINCT l_returnflag) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag IN ('A', 'R')) < 2""")
def missing_metric_threshold(spark, d):
    flags = table(spark, d, "lineitem").where(F.col("l_returnflag").isin("A", "R")).select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    orders = table(spark, d, "orders").select("o_orderkey")
    return joins.with_counts(orders, flags, ["o_orderkey"], {"n": F.countDistinct("l_returnflag")}).where("n < 2").select("o_orderkey")


@query("""SELECT a.event_id AS event_id, b.o_orderkey AS o_orderkey, abs(date_diff('day', CAST(a.ts AS DATE), CAST(b.day AS DATE))) AS distance
    FROM events a JOIN (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) + 9500 AS day FROM orders) b ON a.user_id = b.o_custkey
    WHERE abs(date_diff('day', CAST(a.ts AS DATE), CAST(b.day AS DATE))) <= 45""")
def nearby_band(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "ts")
    orders = table(spark, d, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("user_id"), F.date_add(F.to_date("o_orderdate"), 9500).alias("day")
    )
    return joins.within_days(events, orders, "user_id", "ts", "day", 45).select("event_id", "o_orderkey", F.col("distance").cast("long").alias("distance"))


@query("""WITH g AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, lag(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE)) AS before
        FROM (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders)), m AS (SELECT o_custkey, median(date_diff('day', before, day)) AS median_gap FROM g GROUP BY ALL)
    SELECT *, CASE WHEN median_gap <= 45 THEN 'monthly' WHEN median_gap >= 70 THEN 'quarterly' ELSE 'unknown' END AS cadence FROM m""")
def cadence_median(spark, d):
    dates = table(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day"))
    return coverage.median_cadence(dates, "o_custkey", "day")


@query("SELECT user_id, event_type, arg_max(event_id, ts) AS event_id, arg_max(value, ts) AS value FROM events GROUP BY ALL")
def latest_merge(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return merge.last_wins(rows, ["user_id", "event_type"], "ts").drop("ts")


@query("SELECT user_id, event_type, arg_min(event_id, ts) AS event_id, arg_min(value, ts) AS value FROM events GROUP BY ALL")
def first_merge(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return merge.first_wins(rows, ["user_id", "event_type"], "ts").drop("ts")


_LOG = "SELECT user_id, ts, CASE WHEN event_type IN ('error', 'click') THEN 'failed' ELSE 'done' END AS status FROM events"


@query(f"""WITH g AS (SELECT user_id, count(*) AS attempts, arg_max(status, ts) AS last FROM ({_LOG}) GROUP BY ALL)
    SELECT *, CASE WHEN last = 'failed' AND attempts >= 5 THEN 'dead_letter' ELSE last END AS state FROM g""")
def event_state_machine(spark, d):
    log = table(spark, d, "events").select("user_id", "ts", F.when(F.col("event_type").isin("error", "click"), "failed").otherwise("done").alias("status"))
    return merge.attempt_state(log, "user_id", "status", "ts")


@query("SELECT user_id, event_type, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def stream_merge(spark, d):
    stream = streams.landed_stream(spark, f"{d}/event[s].parquet").select("user_id", "event_type", "event_id", "value")
    return streams.merged(stream, ["user_id", "event_type"], F.col("event_id"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, d):
    return streams.deduplicated(streams.landed_stream(spark, f"{d}/event[s].parquet"), ["user_id", "event_type"])


@query("""SELECT event_id, json_extract_string(props, '$.' || k) AS value, k AS name FROM events, (SELECT unnest(json_keys((SELECT props FROM events LIMIT 1))) AS k) WHERE json_extract_string(props, '$.' || k) IS NOT NULL""")
def json_props(spark, d):
    rows = table(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string, string>")).alias("name", "value"))
    return rows.where("value is not null")


@query("""SELECT s_suppkey AS k, 'both' AS side FROM supplier WHERE s_suppkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)
    UNION ALL SELECT s_suppkey, 'only' FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)
    UNION ALL (SELECT s_nationkey, 'union' FROM supplier UNION SELECT c_nationkey, 'union' FROM customer)""")
def set_ops(spark, d):
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    b = table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("k"))
    n1 = table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("k"))
    n2 = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("k"))
    tag = lambda df, side: df.withColumn("side", F.lit(side))
    return tag(a.intersect(b), "both").unionByName(tag(a.exceptAll(b), "only")).unionByName(tag(n1.union(n2).distinct(), "union"))


@query(f"""SELECT o_orderkey, {_STATUS} AS rank FROM orders ORDER BY {_STATUS}, o_orderdate DESC, o_orderkey LIMIT 100""")
def case_ordered_top(spark, d):
    ranks = {"F": 1, "O": 2, "P": 3}
    rank = filters.case_rank(F.col("o_orderstatus"), ranks, 3)
    return table(spark, d, "orders").select("o_orderkey", rank.alias("rank"), "o_orderdate").orderBy("rank", F.desc("o_orderdate"), "o_orderkey").limit(100).drop("o_orderdate")


@query("""SELECT o_orderkey, CASE WHEN o_totalprice < 20000 THEN 'PRICE_LOW' WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN 'PRIORITY_LOW' END AS error_code FROM orders""")
def row_checks(spark, d):
    rules = [("PRICE_LOW", F.col("o_totalprice") < 20000), ("PRIORITY_LOW", (F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "P"))]
    return filters.checked(table(spark, d, "orders"), rules).select("o_orderkey", "error_code")


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, year(o_orderdate) || '-Q' || quarter(o_orderdate) AS quarter,
    CASE WHEN o_orderstatus = 'F' THEN year(o_orderdate) || '-FY' ELSE year(o_orderdate) || '-Q' || quarter(o_orderdate) END AS covering,
    CASE WHEN o_orderstatus = 'F' THEN 'annual' ELSE 'quarterly' END AS grain,
    CASE WHEN o_orderstatus = 'F' THEN 'FY ' || year(o_orderdate) ELSE 'Q' || quarter(o_orderdate) || ' ' || year(o_orderdate) END AS label FROM orders""")
def period_normalise(spark, d):
    day = F.to_date("o_orderdate")
    form = F.when(F.col("o_orderstatus") == "F", "10-K").otherwise("10-Q")
    cover = periods.covering_period(day, form)
    return table(spark, d, "orders").select(
        "o_orderkey",
        periods.normalize_period(F.date_format(day, "MMMM yyyy")).alias("month"),
        periods.quarter_of(day).alias("quarter"),
        cover.alias("covering"),
        periods.time_grain(cover).alias("grain"),
        periods.period_label(cover).alias("label"),
    )


@query("""WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS word FROM documents)
    SELECT word, count(*) AS n FROM w WHERE word NOT IN ('the', 'and', 'for', 'that') GROUP BY ALL ORDER BY n DESC, word LIMIT 40""")
def keyword_freq(spark, d):
    return aggregates.top_terms(table(spark, d, "documents"), "text", ["the", "and", "for", "that"], 40)


@query("""SELECT source, max(doc_id) AS kept, count(*) AS n, sha256(text) AS digest FROM documents GROUP BY source, sha256(text) HAVING count(*) > 1""")
def exact_dup_docs(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("digest"))
    return aggregates.duplicated(docs, ["source", "digest"], "doc_id")


@query(r"""SELECT doc_id, TRY_CAST(replace(regexp_extract(text, '(-?[0-9,]*[0-9][0-9,]*(?:\.[0-9]+)?)', 1), ',', '') AS DOUBLE) AS number,
    TRY_CAST(regexp_extract(text, '([0-9.]+)[ \t\n\x0B\f\r]*%', 1) AS DOUBLE) / 100 AS ratio FROM documents""")
def number_parse(spark, d):
    return table(spark, d, "documents").select("doc_id", text.parse_number(F.col("text")).alias("number"), text.parse_percent(F.col("text")).alias("ratio"))


@query("""SELECT doc_id, CASE WHEN length(text) / greatest(1, 1 + doc_id % 3) < 50 THEN 'parse_failed' WHEN length(text) / greatest(1, 1 + doc_id % 3) < 200 THEN 'text_sparse' ELSE 'text_ok' END AS quality FROM documents""")
def parse_quality(spark, d):
    return table(spark, d, "documents").select("doc_id", text.parse_quality(F.col("text"), F.col("doc_id") % 3 + 1).alias("quality"))


@query("""SELECT doc_id, lang FROM documents d WHERE (SELECT count(*) FROM labels l WHERE l.doc_id = d.doc_id) = 0""")
def verdict_filter(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "lang")


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def hourly_events(spark, d):
    rows = table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("""SELECT conv_id, turn, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) - 1 AS place, role FROM conversations""")
def numbered_rows(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return windows.numbered(rows, "role", ["conv_id", "turn"], "place").select("conv_id", "turn", "place", "role")


@query("""SELECT conv_id, turn, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) - 1 AS place, role FROM conversations""")
def numbered_rows_all(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return windows.numbered(rows, "role", ["conv_id", "turn"], "place").select("conv_id", "turn", "place", "role")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 11 <> 0""")
def update_and_purge(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    changes = orders.where("o_orderkey % 7 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"))
    scope = orders.where("o_orderkey % 11 = 0").select("o_orderkey")
    return merge.purge(merge.update_columns(orders, changes, ["o_orderkey"]), scope, ["o_orderkey"])[0]


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'idiot') OR contains(lower(text), 'license')")
def keyword_gate(spark, d):
    return extract.gate(table(spark, d, "documents"), "text", ["idiot", "License"]).select("doc_id")


_SLIDING = """SELECT doc_id, 0 AS "window", length(substring(text, 1, {0})) AS chars, md5(substring(text, 1, {0})) AS digest FROM documents WHERE length(text) > 0
    UNION ALL SELECT doc_id, 1, length(substring(text, {1} + 1, {0})), md5(substring(text, {1} + 1, {0})) FROM documents WHERE length(text) > {0}
    UNION ALL SELECT doc_id, 2, length(substring(text, {1} + {0} + 1, {0})), md5(substring(text, {1} + {0} + 1, {0})) FROM documents WHERE length(text) > {1} + {0}"""


def _windows(budget):
    def run(spark, d):
        rows = extract.sliding_windows(table(spark, d, "documents"), "doc_id", "text", budget)
        return rows.select("doc_id", "window", F.char_length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))

    return run


for _name, _budget in (("context_windows", 2_000), ("context_windows_monthly", extract.MONTHLY_BUDGET), ("context_windows_quarterly", extract.QUARTERLY_BUDGET)):
    QUERIES[_name] = _windows(_budget)
    SQL[_name] = _SLIDING.format(_budget, _budget - _budget // 4)


@query(r"""WITH p AS (SELECT doc_id, text, strpos(text, 'License') - 1 AS a, strpos(text, 'the ') - 1 AS b, floor(length(text) * 0.3) AS t FROM documents)
    SELECT doc_id, sha256(regexp_replace(substring(text, 1, CAST(least(length(text), CASE WHEN a >= t AND a >= 0 THEN a ELSE length(text) END, CASE WHEN b >= t AND b >= 0 THEN b ELSE length(text) END) AS BIGINT)), '[ \t\n\x0B\f\r]+$', '')) AS digest FROM p""")
def boilerplate_cut(spark, d):
    cut = text.cut_at_sentinels(F.col("text"), ("License", "the "), 0.3)
    return table(spark, d, "documents").select("doc_id", F.sha2(cut, 256).alias("digest"))


_SHOWN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<!--.*?-->', '', 'gs'), '<script\b[^>]*>.*?</script\s*>', '', 'gis'), '<style\b[^>]*>.*?</style\s*>', '', 'gis'), '<noscript\b[^>]*>.*?</noscript\s*>', '', 'gis'), '<head\b[^>]*>.*?</head\s*>', '', 'gis')"
_PLAIN = """replace(replace(replace(replace(replace(replace(replace(replace({0}, '&copy;', '©'), '&middot;', '·'), '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&')"""
_ONE = r"trim(regexp_replace({0}, '[\s\x0B\x{{A0}}]+', ' ', 'g'))"
_BROKEN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(shown, '</t[dh]\s*>\s*</tr', '</tr', 'gi'), '</t[dh]\s*>', ' | ', 'gi'), '</?(?:p|div|br|li|tr|h[1-6]|section|article|table)\b[^>]*>', chr(10), 'gi'), '<[A-Za-z/!?][^>]*>', '', 'g')"
_TITLED = r"regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title', 1)"
_HREF = r"""regexp_extract(a, '(?is)\bhref\s*=\s*["'']([^"'']*)', 1)"""


@query(rf"""WITH s AS (SELECT page_id, html, {_SHOWN} AS shown FROM pages), t AS (SELECT page_id, html, shown, {_PLAIN.format(_BROKEN)} AS said FROM s)
    SELECT page_id, nullif({_ONE.format(_PLAIN.format(_TITLED))}, '') AS title,
        sha256(array_to_string(list_filter(list_transform(string_split(said, chr(10)), lambda x: {_ONE.format('x')}), lambda x: regexp_matches(x, '[^| ]')), chr(10))) AS text_sha256,
        CAST(len(regexp_extract_all(shown, '(?is)<a\b([^>]*)>(.*?)</a\s*>')) AS INTEGER) AS links FROM t""")
def html_plain(spark, d):
    page = F.col("html")
    return table(spark, d, "pages").select("page_id", html.page_title(page).alias("title"), F.sha2(html.plain_text(page), 256).alias("text_sha256"), F.size(html.page_links(page)).alias("links"))


@query(rf"""WITH s AS (SELECT page_id, unnest(regexp_extract_all({_SHOWN}, '(?is)<a\b[^>]*>.*?</a\s*>')) AS a FROM pages)
    SELECT page_id, {_PLAIN.format(_HREF)} AS href, {_ONE.format(_PLAIN.format("regexp_replace(a, '<[^>]*>', '', 'g')"))} AS label FROM s""")
def listed_links(spark, d):
    links = table(spark, d, "pages").select("page_id", F.explode(html.page_links(F.col("html"))).alias("l"))
    return links.select("page_id", "l.href", "l.label")


@query("""SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '[?].*$', '') || CASE WHEN len(k) > 0 THEN '?' || array_to_string(k, '&') ELSE '' END AS url FROM (
    SELECT page_id, url, list_filter(string_split(regexp_extract(regexp_replace(url, '#.*$', ''), '[?](.*)$', 1), '&'),
        lambda p: p <> '' AND NOT starts_with(lower(p), 'utm_') AND NOT regexp_matches(p, '(?i)^(fbclid|gclid|ref|source|_hsenc|_hsmi)(=|$)')) AS k FROM pages)""")
def canonical_url(spark, d):
    return table(spark, d, "pages").select("page_id", text.canonical_url(F.col("url")).alias("url"))


@query("""SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'skip_no_data' WHEN d.lang = 'de' THEN 'review_temporal' WHEN d.n_chars > 20000 THEN 'review_outlier'
    WHEN l.quality = 1 THEN 'accept' ELSE 'review_low_confidence' END AS route FROM documents d JOIN labels l ON l.doc_id = d.doc_id""")
def routing(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(table(spark, d, "labels"), "doc_id")
    fits = extract.grain_fits(F.when(F.col("lang") == "de", "annual"), F.lit("monthly"))
    way = extract.route(F.lit(False), F.col("toxic") == 1, fits, F.col("n_chars") > 20000, F.col("quality").cast("double"))
    return rows.select("doc_id", way.alias("route"))


@query("""SELECT o_orderkey, round(greatest(0, least(1, 0.9 * greatest(0, 1 - l_linenumber * 60 / 500) * CASE WHEN l_quantity BETWEEN 5 AND 45 THEN 1 ELSE 0 END)), 6) AS score, l_linenumber
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def confidence_score(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    trust = extract.confidence(F.lit(0.9), F.col("l_linenumber") * 60, F.col("l_quantity"), F.lit(5), F.lit(45))
    return rows.select("o_orderkey", F.round(trust, 6).alias("score"), "l_linenumber")


@query(r"""WITH t AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)
    SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, len(string_split(line, '|')) AS cells FROM t WHERE contains(line, '|')""")
def pipe_rows(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.col("line").contains("|"))
    return lines.select("doc_id", "line_no", F.size(F.split("line", r"\|")).cast("long").alias("cells"))
