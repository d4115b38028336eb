"""Queries of streams, snapshots, traces and cadence, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coverage, documents, trace
from ..sources import snapshots
from ..streaming import merge as streams
from ..streaming.ordered import in_order
from .views import table

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query("""SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS sequence, o_orderkey, true AS in_order FROM orders""")
def ordered_commit(spark, d):
    """Orders of each customer come scrambled over several batches and are released by date."""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"))
    numbered = documents.chronology(orders, "o_custkey", F.lit(0), "day", "o_orderkey").select("o_custkey", F.col("sequence").cast("long").alias("sequence"), "o_orderkey")
    landed = streams.shared_folder(spark, "scrambled")
    numbered.repartition(4, F.xxhash64("o_orderkey")).write.parquet(landed)
    released = streams.written(in_order(streams.landed_stream(spark, landed, 1), "o_custkey", "sequence"), "released")
    before = released.select("o_custkey", (F.col("sequence") + 1).alias("sequence"), F.col("_batch").alias("_before"))
    rows = released.join(before, ["o_custkey", "sequence"], "left")
    return rows.select("o_custkey", "sequence", "o_orderkey", (F.coalesce("_before", F.lit(-1)) <= F.col("_batch")).alias("in_order"))


_RANKS = "CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 2 ELSE 3 END"


@query(f"""SELECT user_id, rank, event_id, value FROM (SELECT user_id, CAST({_RANKS} AS INTEGER) AS rank, event_id, value FROM events)
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rank, event_id DESC) = 1""")
def authority_stream(spark, d):
    """The last event of the greatest authority of each user, whatever comes late."""
    rank = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type").isin("click", "view"), 2).otherwise(3)
    stream = streams.landed_stream(spark, f"{d}/event[s].parquet").select("user_id", rank.alias("rank"), "event_id", "value")
    return streams.guarded(stream, ["user_id"], "rank", "event_id")


@query("""SELECT o_orderkey AS id, 'kept' AS place FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT o_orderkey, 'archived' FROM orders WHERE o_orderstatus = 'F'""")
def archived_purge(spark, d):
    """Finished orders are archived and purged in one publication."""
    root = streams.shared_folder(spark, "snapshot")
    orders = table(spark, d, "orders")
    snapshots.archive_and_purge(orders, orders.where("o_orderstatus = 'F'"), ["o_orderkey"], root)
    kept = snapshots.current(spark, root, "rows").select(F.col("o_orderkey").alias("id"), F.lit("kept").alias("place"))
    gone = snapshots.current(spark, root, "archive").select(F.get_json_object("row_data", "$.o_orderkey").cast("long").alias("id"), F.lit("archived").alias("place"))
    return kept.unionAll(gone)


_SOURCES = "CASE o_orderkey % 4 WHEN 0 THEN 'edgar_10k' WHEN 1 THEN 'ir_press_release' WHEN 2 THEN 'edgar_8k' ELSE 'archive_pdf' END"


@query(f"""WITH o AS (SELECT *, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders),
    r AS (SELECT o_custkey AS entity, month, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status, CASE WHEN o_orderkey % 10 = 0 THEN 'parse_failed' ELSE 'text_ok' END AS pq,
        CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE length(o_orderpriority) END AS chars FROM o
        QUALIFY row_number() OVER (PARTITION BY o_custkey, month ORDER BY CASE {_SOURCES} WHEN 'edgar_10k' THEN 1 WHEN 'edgar_8k' THEN 2 ELSE 3 END DESC, CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) = 1),
    g AS (SELECT DISTINCT entity, month, metric FROM (SELECT o_custkey AS entity, month FROM o UNION SELECT user_id, CAST(date_trunc('month', ts) AS DATE) FROM events), (SELECT unnest(['A', 'N', 'R']) AS metric)),
    l AS (SELECT l_orderkey AS id, o_custkey AS entity, month, l_returnflag AS metric, max(l_quantity) AS hi, min(l_discount) AS disc, min(l_quantity) AS lo FROM lineitem JOIN o ON o_orderkey = l_orderkey GROUP BY ALL),
    v AS (SELECT entity, month, metric, arg_min(hi, id) AS value FROM l WHERE hi > 40 GROUP BY ALL),
    q AS (SELECT entity, month, metric, min(id) AS review_id, arg_min(disc > 0.01, id) AS is_empty FROM l WHERE lo < 20 AND id % 3 <> 0 AND id % 5 <> 0 GROUP BY ALL),
    k AS (SELECT g.*, status, pq, chars, EXISTS (SELECT 1 FROM o WHERE o_custkey = g.entity AND o.month = g.month AND o_totalprice > 200000) AS has_manifest,
        CASE WHEN status IS NOT NULL THEN value END AS value, CASE WHEN status IS NOT NULL THEN review_id END AS review_id, CASE WHEN status IS NOT NULL THEN is_empty END AS is_empty
        FROM g LEFT JOIN r USING (entity, month) LEFT JOIN v USING (entity, month, metric) LEFT JOIN q USING (entity, month, metric)),
    m AS (SELECT *, bool_or(value IS NOT NULL) OVER w AS hv, bool_or(review_id IS NOT NULL AND NOT is_empty) OVER w AS hr, coalesce(bool_or(is_empty) OVER w, false) AS he FROM k WINDOW w AS (PARTITION BY entity, month))
    SELECT entity, month, metric, has_manifest, CAST(coalesce(chars, 0) AS INTEGER) AS char_count, pq AS parse_quality, status AS extraction_status,
        coalesce(status = 'done' AND chars > 0 AND NOT hv AND NOT hr AND NOT he, false) AS keyword_gated,
        CASE WHEN hv THEN 'data' WHEN hr THEN 'review_pending' WHEN he THEN 'llm_empty' WHEN pq = 'parse_failed' THEN 'parse_failed' WHEN status = 'done' THEN 'extract_failed' ELSE 'no_document' END AS cell_state, value, review_id FROM m""")
def period_traces(spark, d):
    orders = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    k = F.col("o_orderkey")
    source = F.when(k % 4 == 0, "edgar_10k").when(k % 4 == 1, "ir_press_release").when(k % 4 == 2, "edgar_8k").otherwise("archive_pdf")
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "pending").otherwise("failed")
    reports = orders.select(
        k.alias("id"), F.col("o_custkey").alias("entity"), "day", source.alias("source_type"), status.alias("status"),
        F.when(k % 10 == 0, "parse_failed").otherwise("text_ok").alias("parse_quality"), F.when(k % 13 != 0, F.col("o_orderpriority")).alias("text"), "o_totalprice",
    )
    months = reports.withColumn("month", F.trunc("day", "MM"))
    cells = months.select("entity", "month").union(table(spark, d, "events").select("user_id", F.trunc("ts", "MM")))
    metrics = spark.range(1).select(F.explode(F.array(*map(F.lit, "ANR"))).alias("metric"))
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("metric"))
    lines = lines.agg(F.max("l_quantity").alias("value"), F.min("l_discount").alias("disc"), F.min("l_quantity").alias("lo")).join(months.select("id", "entity", "month"), "id")
    reviews = lines.where("lo < 20").withColumns({
        "status": F.when(F.col("id") % 3 != 0, "PENDING").otherwise("APPROVED"), "precedence": F.when(F.col("id") % 5 == 0, "deferred"), "agreement": F.when(F.col("disc") > 0.01, "LLM_EMPTY"),
    })
    return trace.period_trace(cells, reports, months.where("o_totalprice > 200000"), metrics, lines.where("value > 40"), reviews)


_LINKS = """x AS (SELECT DISTINCT l_orderkey AS doc, l_orderkey * 10 + l_linenumber AS id, l_quantity, l_discount FROM lineitem),
    links(kind, id, to_kind, to_id) AS (
        SELECT DISTINCT 'document', doc, 'chunk', id FROM x UNION SELECT 'chunk', id, 'value', id FROM x WHERE l_quantity > 10
        UNION SELECT 'value', id, 'review', id FROM x WHERE l_quantity BETWEEN 11 AND 30 UNION SELECT 'review', id, 'decision', id FROM x WHERE l_discount < 0.05
        UNION SELECT 'decision', id, 'fact', id FROM x WHERE l_discount < 0.03 UNION SELECT 'value', id, 'fact', id FROM x WHERE l_quantity > 30),
    cells AS (SELECT DISTINCT o_custkey AS entity, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, l_returnflag AS metric, 'value' AS kind, l_orderkey * 10 + l_linenumber AS id
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity > 10),
    down AS (SELECT * FROM cells UNION SELECT entity, month, metric, to_kind, to_id FROM down JOIN links USING (kind, id)),
    up AS (SELECT * FROM cells UNION SELECT entity, month, metric, links.kind, links.id FROM up JOIN links ON to_kind = up.kind AND to_id = up.id),
    every AS (SELECT * FROM down UNION SELECT * FROM up)"""


def _trails(spark, d):
    lines = table(spark, d, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    link = lambda a, b, rows, start="id": rows.select(F.lit(a).alias("kind"), F.col(start).alias("id"), F.lit(b).alias("to_kind"), F.col("id").alias("to_id"))
    q, disc = F.col("l_quantity"), F.col("l_discount")
    links = (
        link("document", "chunk", lines, "l_orderkey").union(link("chunk", "value", lines.where(q > 10))).union(link("value", "review", lines.where(q.between(11, 30))))
        .union(link("review", "decision", lines.where(disc < 0.05))).union(link("decision", "fact", lines.where(disc < 0.03))).union(link("value", "fact", lines.where(q > 30)))
    )
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("entity"), F.trunc("o_orderdate", "MM").alias("month"))
    cells = lines.where(q > 10).join(orders, "l_orderkey").select("entity", "month", F.col("l_returnflag").alias("metric"), F.lit("value").alias("kind"), "id").distinct()
    return trace.trails(cells, links)


@query(f"""WITH RECURSIVE {_LINKS}, o AS (SELECT *, list_position(['document', 'chunk', 'value', 'review', 'decision', 'fact'], kind) AS place FROM every)
    SELECT entity, month, metric, string_agg(kind || ':' || id, ' > ' ORDER BY place, id) AS trail FROM o GROUP BY ALL""")
def lineage_trails(spark, d):
    return trace.trail_texts(_trails(spark, d), ["entity", "month", "metric"])


@query(f"""WITH RECURSIVE {_LINKS} SELECT entity, month, metric, count(*) FILTER (kind = 'document') AS document, count(*) FILTER (kind = 'chunk') AS chunk, count(*) FILTER (kind = 'value') AS value,
    count(*) FILTER (kind = 'review') AS review, count(*) FILTER (kind = 'decision') AS decision, count(*) FILTER (kind = 'fact') AS fact FROM every GROUP BY ALL""")
def lineage_counts(spark, d):
    return trace.stage_counts(_trails(spark, d), ["entity", "month", "metric"])


@query("""WITH c AS (SELECT c_custkey AS entity, CASE c_custkey % 3 WHEN 0 THEN 'INDEX' WHEN 1 THEN 'rss' END AS mode, c_custkey % 17 = 0 AS driven, CASE WHEN c_custkey % 2 = 0 THEN 1990 + c_custkey % 5 END AS y FROM customer),
    s AS (SELECT o_custkey AS entity, CAST(o_orderdate AS DATE) AS day FROM orders UNION ALL SELECT user_id, CAST(ts AS DATE) FROM events WHERE user_id % 2 = 0),
    g AS (SELECT entity, day, datediff('day', lag(day) OVER (PARTITION BY entity ORDER BY day), day) AS gap FROM s),
    a AS (SELECT entity, count(*) AS n, min(day) AS first, median(gap) AS gap FROM g GROUP BY ALL), f AS (SELECT DISTINCT o_custkey AS entity FROM orders WHERE o_orderstatus = 'P'),
    r AS (SELECT c.*, n, first, gap, f.entity IS NOT NULL AS filed, CASE WHEN driven OR mode = 'INDEX' AND n IS NULL THEN 1 WHEN n >= 4 AND gap <= 45 THEN 2 WHEN n >= 4 AND gap >= 70 THEN 3 WHEN f.entity IS NOT NULL THEN 4 ELSE 5 END AS rule
        FROM c LEFT JOIN a USING (entity) LEFT JOIN f USING (entity))
    SELECT entity, CASE rule WHEN 1 THEN 'announcement' WHEN 3 THEN 'quarterly' WHEN 4 THEN 'quarterly' ELSE 'monthly' END AS cadence,
        make_date(CAST(coalesce(y, CASE WHEN rule IN (2, 3) THEN year(first) ELSE 2024 END) AS BIGINT), 1, 1) AS start,
        CAST(CASE rule WHEN 1 THEN 0.9 WHEN 4 THEN 0.7 WHEN 5 THEN 0.6 ELSE 0.85 END AS DOUBLE) AS confidence,
        CASE rule WHEN 1 THEN 'index_mode_event_driven_profile' WHEN 4 THEN 'edgar_quarterly_forms_present' WHEN 5 THEN 'fallback_default_monthly' ELSE 'median_interval_days=' || format('{:.1f}', gap) END AS evidence FROM r""")
def cadence_rules(spark, d):
    k = F.col("c_custkey")
    companies = table(spark, d, "customer").select(
        k.alias("entity"), F.when(k % 3 == 0, "INDEX").when(k % 3 == 1, "rss").alias("mode"), (k % 17 == 0).alias("event_driven"), F.when(k % 2 == 0, 1990 + k % 5).cast("int").alias("start_year")
    )
    dates = table(spark, d, "orders").select(F.col("o_custkey").alias("entity"), F.to_date("o_orderdate").alias("day"))
    dates = dates.union(table(spark, d, "events").where("user_id % 2 = 0").select("user_id", F.to_date("ts")))
    filers = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("entity"))
    return coverage.cadence_windows(companies, dates, filers, F.to_date(F.lit("2024-06-01")))


@query(f"""SELECT user_id, rank, event_id, value FROM (SELECT user_id, CAST({_RANKS} AS INTEGER) AS rank, event_id, value FROM events)
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rank, event_id DESC) = 1""")
def authority_batch(spark, d):
    """What ``authority_stream`` gives, as one batch merge."""
    rank = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type").isin("click", "view"), 2).otherwise(3)
    rows = table(spark, d, "events").select("user_id", rank.alias("rank"), "event_id", "value")
    return rows.groupBy("user_id").agg(F.max_by(F.struct("rank", "event_id", "value"), streams.authority(F.col("rank"), F.col("event_id"))).alias("r")).select("user_id", "r.*")
