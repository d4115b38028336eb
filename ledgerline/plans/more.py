"""Queries of the document and dimension operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import config, documents, extract, filters, registry, windows
from .views import table

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query("""WITH r AS (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey, l_suppkey, l_linenumber, l_shipdate) AS k FROM lineitem)
    SELECT o_orderkey, o_totalprice, c_name, l_quantity AS review_value FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN r ON l_orderkey = o_orderkey AND k = 1 WHERE o_orderstatus = 'P'""")
def provenance_export(spark, d):
    lines = table(spark, d, "lineitem")
    one = windows.best(lines, ["l_orderkey"], [F.desc("l_quantity"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber"), F.col("l_shipdate")])
    one = one.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").alias("review_value"))
    names = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    orders = filters.where_all(table(spark, d, "orders"), equal={"o_orderstatus": "P"})
    return orders.join(names, "o_custkey", "left").join(one, "o_orderkey", "left").select("o_orderkey", "o_totalprice", "c_name", "review_value")


@query("""SELECT o_orderkey, count(l_returnflag) AS metrics, coalesce(round(max(q) FILTER (l_returnflag = 'R'), 2), -1) AS returned FROM orders LEFT JOIN
    (SELECT l_orderkey, l_returnflag, sum(l_quantity) AS q FROM lineitem GROUP BY ALL) ON l_orderkey = o_orderkey GROUP BY ALL""")
def document_payload(spark, d):
    values = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("metric")).agg(F.sum("l_quantity").alias("value"))
    rows = documents.payload(table(spark, d, "orders").select("o_orderkey"), values, "o_orderkey")
    back = F.coalesce(F.round(F.try_element_at("metrics", F.lit("R")), 2), F.lit(-1.0))
    return rows.select("o_orderkey", F.size("metrics").cast("long").alias("metrics"), back.alias("returned"))


@query("""WITH c AS (SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'monthly' ELSE 'filing' END AS class, * FROM orders)
    SELECT class, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS extracted, CAST(min(o_orderdate) AS DATE) AS first, CAST(max(o_orderdate) AS DATE) AS last,
        count(DISTINCT o_orderpriority) AS sources FROM c GROUP BY ALL""")
def coverage_by_class(spark, d):
    orders = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    klass = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "monthly").otherwise("filing")
    rows = config.by_class(orders, klass, "o_orderpriority", F.col("o_orderstatus") == "F", "day")
    return rows.select("class", "total", "extracted", "first", "last", F.size("by_source").cast("long").alias("sources"))


@query("""SELECT coalesce(s.s_suppkey, c.c_custkey) AS key, coalesce(c.c_name, s.s_name) AS name, s.s_acctbal AS balance
    FROM supplier s FULL JOIN customer c ON c.c_custkey = s.s_suppkey""")
def config_sync_all(spark, d):
    stored = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    new = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    return config.synced(stored, new, "key", ["name"])


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS k FROM events)
    SELECT user_id, string_agg(event_type || '=' || event_id, ',' ORDER BY event_type) FILTER (k = 1) AS sources, max(event_id % 5) AS status_rank, count(DISTINCT event_id % 3) AS blockers FROM r GROUP BY ALL""")
def contract_merge(spark, d):
    rows = table(spark, d, "events").select(
        "user_id", F.col("event_type").alias("family"), F.col("event_id").alias("source"), F.col("value").alias("confidence"), (F.col("event_id") % 5).alias("status_rank"), (F.col("event_id") % 3).alias("blocker")
    )
    merged = config.contracts(rows, "user_id")
    listed = F.array_join(F.transform(F.array_sort(F.map_entries("sources")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return merged.select("user_id", listed.alias("sources"), "status_rank", F.size("blockers").cast("long").alias("blockers"))


@query("""SELECT p_brand, coalesce(r.threshold, 0.5) AS threshold FROM (SELECT DISTINCT p_brand FROM part) p
    LEFT JOIN (SELECT p_brand, round(avg(p_size) / 100, 4) AS threshold FROM part WHERE p_brand LIKE '%1' GROUP BY ALL) r USING (p_brand)""")
def rule_sync(spark, d):
    part = table(spark, d, "part")
    rules = part.where(F.col("p_brand").endswith("1")).groupBy("p_brand").agg(F.round(F.avg("p_size") / 100, 4).alias("threshold"))
    return config.rules_for(part, rules, "p_brand", {"threshold": F.lit(0.5)})


@query("""SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END, o_orderdate, o_orderkey) AS sequence FROM orders""")
def chronology_sequence(spark, d):
    tier = filters.case_rank(F.col("o_orderstatus"), {"F": 1, "O": 2, "P": 3}, 3)
    return documents.chronology(table(spark, d, "orders"), "o_custkey", tier, "o_orderdate", "o_orderkey").select("o_orderkey", F.col("sequence").cast("long").alias("sequence"))


@query("""WITH m AS (SELECT unnest(['A', 'N', 'R']) AS metric), p AS (SELECT o_orderkey AS doc FROM orders WHERE o_orderstatus = 'F')
    SELECT doc, metric FROM p CROSS JOIN m WHERE doc NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) AND NOT (doc % 2 = 0 AND metric = 'A')""")
def zero_extracts_all(spark, d):
    docs = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("doc"))
    metrics = spark.range(1).select(F.explode(F.array(*map(F.lit, "ANR"))).alias("metric"))
    found = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("doc"))
    cleared = docs.where("doc % 2 = 0").withColumn("metric", F.lit("A"))
    return documents.zero_extracts(docs, metrics, found, cleared)


@query("""WITH c AS (SELECT conv_id, turn, text, CAST((length(text) - length(replace(lower(text), 'the', ''))) / 3 AS BIGINT) AS hits FROM conversations),
    s AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY hits DESC, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
    SELECT conv_id, turn, hits, CAST(least(length(text), 1500 - before) AS BIGINT) AS used FROM s WHERE before < 1500""")
def chunk_packing(spark, d):
    chunks = table(spark, d, "conversations").select("conv_id", "turn", "text")
    return documents.packed_chunks(chunks, "conv_id", "turn", ["the"], 1500).select("conv_id", "turn", "hits", "used")


def _packing(budget):
    def run(spark, d):
        chunks = table(spark, d, "conversations").select("conv_id", "turn", "text")
        return documents.packed_chunks(chunks, "conv_id", "turn", ["the"], budget).select("conv_id", "turn", "hits", "used")

    return run


for _name, _budget in (("monthly", extract.MONTHLY_BUDGET), ("quarterly", extract.QUARTERLY_BUDGET)):
    QUERIES[f"chunk_packing_{_name}"] = _packing(_budget)
    SQL[f"chunk_packing_{_name}"] = f"""WITH c AS (SELECT conv_id, turn, text, CAST((length(text) - length(replace(lower(text), 'the', ''))) / 3 AS BIGINT) AS hits FROM conversations),
    s AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY hits DESC, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
    SELECT conv_id, turn, hits, CAST(least(length(text), {_budget} - before) AS BIGINT) AS used FROM s WHERE before < {_budget}"""


@query("""SELECT conv_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS prompt FROM conversations WHERE trim(text) <> '' GROUP BY ALL""")
def prompt_assembly(spark, d):
    return documents.prompts(table(spark, d, "conversations"), "conv_id", "turn", "text").select("conv_id", F.md5("prompt").alias("prompt"))


@query("""SELECT host, count(*) AS pages, min(url) AS first FROM (SELECT url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host FROM pages) GROUP BY ALL""")
def pages_by_host(spark, d):
    return table(spark, d, "pages").groupBy(text.host(F.col("url")).alias("host")).agg(F.count("*").alias("pages"), F.min("url").alias("first"))


@query("""SELECT doc_id, CASE WHEN source = 'src0' THEN 'skip' WHEN source = 'src1' AND n_chars < 500 THEN 'index_no_data' WHEN quality = 1 THEN 'ok' WHEN n_chars >= 500 THEN 'ingested_no_extraction' ELSE 'no_data' END AS state
    FROM documents LEFT JOIN labels USING (doc_id)""")
def data_states(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    mode = F.when(F.col("source") == "src0", "skip").when(F.col("source") == "src1", "index").otherwise("rss")
    docs = F.when(F.col("n_chars") >= 500, 1).otherwise(0)
    return rows.select("doc_id", registry.data_state(mode, docs, F.coalesce("quality", F.lit(0))).alias("state"))


@query("""SELECT c_custkey, max(CAST(ts AS DATE)) AS last_audit, CASE WHEN c_acctbal < 0 THEN 'inactive' WHEN max(ts) IS NULL THEN 'never_audited'
    WHEN max(ts) < TIMESTAMP '2024-01-31' - INTERVAL 7 DAY THEN 'stale' ELSE 'current' END AS status FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY c_custkey, c_acctbal""")
def governance_snapshot_all(spark, d):
    last = table(spark, d, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.max("ts").alias("ts"))
    rows = table(spark, d, "customer").join(last, "c_custkey", "left")
    now = F.lit("2024-01-31").cast("timestamp_ntz")
    status = registry.governance(F.col("ts"), now, 7, F.lit(None), F.col("c_acctbal") >= 0)
    return rows.select("c_custkey", F.to_date("ts").alias("last_audit"), status.alias("status"))


@query("""SELECT page_id, CASE WHEN regexp_matches(lower(url), '^[a-z]+://([^/?#:]*[.])?[a-z0-9-]+[.]org([/?#:]|$)') THEN 'org' ELSE 'other' END AS rule FROM pages""")
def rule_match(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    rules = spark.createDataFrame([("org", "", "org", 1)], "host string, prefix string, rule string, rank int")
    hit = registry.matched_rules(pages, rules).select("page_id", "rule")
    return pages.select("page_id").join(hit, "page_id", "left").withColumn("rule", F.coalesce("rule", F.lit("other")))


#: Names of earlier rounds; they read whole tables as well.
for _name in ("zero_extracts", "config_sync", "governance_snapshot"):
    QUERIES[_name], SQL[_name] = QUERIES[f"{_name}_all"], SQL[f"{_name}_all"]
