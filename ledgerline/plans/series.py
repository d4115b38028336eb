"""Queries over the observation series, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import periods
from ..operators import aggregates, anomalies, coverage, extract, fill, filters, joins, merge, windows
from .views import CELLS, KEPT, OBS, QOBS, SPINE, kept, observations, quarterly, table

QUERIES, SQL = {}, {}
KEYS = ["entity", "metric"]


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query(f"""WITH {OBS}, {SPINE} SELECT s.entity, s.metric, s.month, o.value, o.value IS NOT NULL AS present
    FROM spine s LEFT JOIN obs o ON s.entity = o.entity AND s.metric = o.metric AND s.month = o.period""")
def timeseries_spine(spark, d):
    return coverage.filled(observations(spark, d), KEYS)


@query(f"""WITH {OBS}, {SPINE} SELECT s.entity, s.metric, count(o.value) AS present, count(*) AS expected,
    round(count(o.value) / count(*), 4) AS ratio
    FROM spine s LEFT JOIN obs o ON s.entity = o.entity AND s.metric = o.metric AND s.month = o.period GROUP BY ALL""")
def timeseries_completeness(spark, d):
    return coverage.completeness(observations(spark, d), KEYS)


@query(f"""WITH {OBS} SELECT * FROM obs WHERE metric = 'N' AND entity IN (1, 2, 3) AND period >= DATE '1996-01-01'
    AND period < DATE '1998-04-01' AND value >= 20 ORDER BY entity, period LIMIT 50 OFFSET 10""")
def data_filter_page(spark, d):
    obs = filters.where_all(observations(spark, d), equal={"metric": "N"}, among={"entity": [1, 2, 3]}, least={"value": 20}, most={"entity": None})
    rows = filters.within_months(obs, "period", "1996-01", "1998-03").orderBy("entity", "period")
    return rows.offset(10).limit(50)


@query(f"""WITH {OBS}, l AS (SELECT *, lag(value) OVER w AS pv, lag(period) OVER w AS pp FROM obs WINDOW w AS (PARTITION BY entity, metric ORDER BY period)),
    g AS (SELECT *, date_diff('month', pp, period) AS gap FROM l)
    SELECT entity, period, metric, value, CASE WHEN gap = 1 THEN value - pv END AS delta,
        CASE WHEN gap > 1 THEN 'gap_' || gap || '_months' END AS skipped FROM g""")
def mom_delta(spark, d):
    return windows.month_delta(observations(spark, d), KEYS)


@query(f"""WITH {OBS}, t AS (SELECT *, avg(value) OVER w AS a, count(value) OVER w AS c FROM obs
        WINDOW w AS (PARTITION BY entity, metric ORDER BY period ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
    SELECT entity, period, metric, value, CASE WHEN c >= 3 THEN round(a, 6) END AS trailing_avg,
        coalesce(c >= 3 AND abs(value - a) / greatest(abs(a), 1e-9) > 0.4, false) AS is_outlier FROM t""")
def trailing_outlier(spark, d):
    return windows.outliers(observations(spark, d), KEYS, 0.4).withColumn("trailing_avg", F.round("trailing_avg", 6))


@query(f"""WITH {OBS}, r AS (SELECT *, row_number() OVER (PARTITION BY entity, metric ORDER BY period DESC) AS k FROM obs)
    SELECT entity, metric, max(CASE WHEN k = 1 THEN value END) AS last_value, round(avg(value), 6) AS mean, min(period) AS period_start,
        max(period) AS period_end, count(*) AS sample_size FROM r WHERE k <= 6 GROUP BY ALL""")
def scorecard_last_avg6(spark, d):
    obs = observations(spark, d)
    last = windows.latest(obs, KEYS).select(*KEYS, F.col("value").alias("last_value"))
    return windows.latest_mean(obs, KEYS, 6).withColumn("mean", F.round("mean", 6)).join(last, KEYS)


@query(f"""WITH {OBS}, p AS (SELECT DISTINCT period FROM obs ORDER BY period DESC LIMIT 12)
    SELECT entity, metric, sum(value) AS total, count(*) AS n, arg_max(value, period) AS last_value FROM obs WHERE period IN (SELECT period FROM p) GROUP BY ALL""")
def stacked_recent_n(spark, d):
    rows = windows.recent_periods(observations(spark, d), 12)
    return rows.groupBy(*KEYS).agg(F.sum("value").alias("total"), F.count("*").alias("n"), F.max_by("value", "period").alias("last_value"))


@query(f"""WITH {OBS}, v AS (SELECT row_number() OVER (PARTITION BY metric ORDER BY value DESC, entity, period) AS rank, * FROM obs)
    SELECT entity, period, metric, value, rank FROM v WHERE rank <= 5""")
def topk_per_group(spark, d):
    return windows.best(observations(spark, d), ["metric"], [F.desc("value"), F.col("entity"), F.col("period")], 5, "rank")


@query(f"""WITH {OBS}, {SPINE} SELECT s.* FROM spine s ANTI JOIN obs o ON s.entity = o.entity AND s.metric = o.metric AND s.month = o.period""")
def missing_periods(spark, d):
    return coverage.missing_periods(observations(spark, d), KEYS)


@query(f"""WITH {OBS}, {SPINE}, j AS (SELECT s.*, o.value FROM spine s LEFT JOIN obs o ON s.entity = o.entity AND s.metric = o.metric AND s.month = o.period),
    n AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN month END IGNORE NULLS) OVER b AS m1, last_value(value IGNORE NULLS) OVER b AS v1,
        first_value(CASE WHEN value IS NOT NULL THEN month END IGNORE NULLS) OVER a AS m2, first_value(value IGNORE NULLS) OVER a AS v2 FROM j
        WINDOW b AS (PARTITION BY entity, metric ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
            a AS (PARTITION BY entity, metric ORDER BY month ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
    SELECT entity, metric, month, value, CASE WHEN value IS NULL THEN round(v1 + (v2 - v1) * date_diff('month', m1, month) / date_diff('month', m1, m2), 6) END AS suggested FROM n""")
def interpolate_nearest(spark, d):
    return windows.interpolated(timeseries_spine(spark, d).drop("present"), KEYS)


@query(f"""WITH {OBS}, h AS (SELECT entity, period, value FROM obs WHERE metric = 'N'), p AS (SELECT entity, period, value FROM obs WHERE metric = 'R')
    SELECT h.entity, h.period, round(b.value + p.value - h.value, 6) AS sold FROM h JOIN h b ON b.entity = h.entity AND h.period = b.period + INTERVAL 1 MONTH
    JOIN p ON p.entity = h.entity AND p.period = h.period WHERE round(b.value + p.value - h.value, 6) >= 0""")
def derived_sales(spark, d):
    obs = observations(spark, d)
    pick = lambda m: obs.where(F.col("metric") == m).select("entity", "period", "value")
    return fill.derived_sales(pick("N"), pick("R"))


def _frame(spark, d):
    obs = observations(spark, d)
    return fill.cells(quarterly(obs), kept(obs))


_CADENCE = "CASE WHEN entity % 2 = 0 THEN 'quarterly' ELSE 'monthly' END"
_BASE = f"WITH {OBS}, {KEPT}, {QOBS}, {CELLS}"


def _cadence():
    return F.when(F.col("entity") % 2 == 0, "quarterly").otherwise("monthly")


@query(f"""{_BASE} SELECT entity, metric, month,
        round(CASE WHEN {_CADENCE} = 'monthly' AND n_known = n - 1 THEN total - known_sum ELSE total / n END, 6) AS value,
        CASE WHEN {_CADENCE} = 'monthly' AND n_known = n - 1 THEN 'quarterly_inferred' ELSE 'quarterly_carry' END AS method,
        CASE WHEN {_CADENCE} = 'quarterly' THEN 0.80 WHEN n_known = n - 1 THEN 0.65 ELSE 0.70 END::DOUBLE AS confidence
    FROM cells WHERE known IS NULL""")
def quarter_bridge_flow(spark, d):
    return fill.bridge_flow(_frame(spark, d), _cadence()).withColumn("value", F.round("value", 6))


@query(f"""{_BASE} SELECT entity, metric, month, total AS value, CASE WHEN {_CADENCE} = 'quarterly' THEN 'carry' ELSE 'review' END AS route,
        CASE WHEN {_CADENCE} = 'quarterly' THEN 0.80 ELSE 0.50 END::DOUBLE AS confidence
    FROM cells WHERE known IS NULL AND ({_CADENCE} = 'monthly' OR place = n - 1)""")
def quarter_bridge_snapshot(spark, d):
    return fill.bridge_snapshot(_frame(spark, d), _cadence())


@query(f"""{_BASE}, s AS (SELECT *, n - n_known AS missing, total - known_sum AS rest FROM cells)
    SELECT entity, covering, metric, month,
        CASE WHEN missing = 0 OR missing = 2 OR (missing = 1 AND rest < 0) THEN 'skipped' ELSE 'filled' END AS status,
        CASE WHEN missing = 0 THEN 'all_months_present' WHEN missing = 1 AND rest < 0 THEN 'negative_delta' WHEN missing = 1 THEN 'inferred_delta'
            WHEN missing = 3 THEN 'inferred_prorated' ELSE 'insufficient_known_months' END AS reason,
        round(CASE WHEN missing = 1 AND rest >= 0 THEN rest WHEN missing = 3 THEN total / 3 END, 6) AS value
    FROM s WHERE known IS NULL OR (missing = 0 AND place = 0)""")
def gap_fill_flow(spark, d):
    return fill.fill_flow(_frame(spark, d)).withColumn("value", F.round("value", 6))


def _snapshot(mode):
    def run(spark, d):
        frame = _frame(spark, d)
        totals = frame.where("place = 0").select("entity", "metric", "covering", "total")
        prev = windows.previous(totals, KEYS, "covering", "total", "previous").drop("total")
        return fill.fill_snapshot(frame.join(prev, [*KEYS, "covering"]), F.col("previous"), mode).withColumn("value", F.round("value", 6))

    return run


_PREV = f"""{_BASE}, t AS (SELECT entity, metric, covering, lag(value) OVER (PARTITION BY entity, metric ORDER BY covering) AS pv FROM qobs)"""
for _mode in ("endpoint", "stepwise", "linear"):
    _value = "coalesce(t.pv + (total - t.pv) * ((place + 1) / n), total)" if _mode == "linear" else "total"
    _method = {"endpoint": "'inferred_snapshot'", "stepwise": "'inferred_stepwise'", "linear": "CASE WHEN t.pv IS NULL THEN 'inferred_stepwise' ELSE 'inferred_linear' END"}[_mode]
    QUERIES[f"gap_fill_{_mode}"] = _snapshot(_mode)
    SQL[f"gap_fill_{_mode}"] = f"""{_PREV} SELECT c.entity, c.covering, c.metric, c.month, round({_value}, 6) AS value, {_method} AS method
        FROM cells c JOIN t ON t.entity = c.entity AND t.metric = c.metric AND t.covering = c.covering
        WHERE known IS NULL {'AND place = n - 1' if _mode == 'endpoint' else ''}"""


@query(f"""WITH {OBS} SELECT entity, strftime(period, '%Y-%m') AS ym, max(CASE WHEN metric = 'A' THEN value END) AS "A",
    max(CASE WHEN metric = 'N' THEN value END) AS "N", max(CASE WHEN metric = 'R' THEN value END) AS "R" FROM obs GROUP BY ALL""")
def pivot_wide_all(spark, d):
    rows = observations(spark, d).withColumn("ym", F.date_format("period", "yyyy-MM"))
    return aggregates.pivoted(rows, ["entity", "ym"], "metric", "value", ["A", "N", "R"])


QUERIES["pivot_wide"], SQL["pivot_wide"] = pivot_wide_all, SQL["pivot_wide_all"]


@query(f"""WITH {OBS}, s AS (SELECT entity, metric, period, value, CASE WHEN month(period) % 5 = 0 THEN value END AS final,
        CASE WHEN month(period) % 2 = 0 THEN value + 1 END AS accepted, value + 2 AS pending FROM obs)
    SELECT entity, period, metric, coalesce(final, accepted, pending) AS value,
        CASE WHEN final IS NOT NULL THEN 0 WHEN accepted IS NOT NULL THEN 1 ELSE 2 END AS layer FROM s""")
def layered_precedence(spark, d):
    obs = observations(spark, d)
    final = obs.where(F.month("period") % 5 == 0)
    accepted = obs.where(F.month("period") % 2 == 0).withColumn("value", F.col("value") + 1)
    pending = obs.withColumn("value", F.col("value") + 2)
    return windows.layered([final, accepted, pending], ["entity", "period", "metric"])


@query(f"""WITH {OBS}, e AS (SELECT DISTINCT entity FROM obs), m AS (SELECT DISTINCT metric FROM obs),
    p AS (SELECT CAST(unnest(generate_series(DATE '1998-01-01', DATE '1998-12-01', INTERVAL 1 MONTH)) AS DATE) AS period)
    SELECT e.entity, p.period, m.metric, CASE WHEN o.value IS NOT NULL AND o.value >= 100 THEN 'data' WHEN o.value IS NOT NULL THEN 'review_pending' ELSE 'no_document' END AS state
    FROM e CROSS JOIN p CROSS JOIN m LEFT JOIN obs o ON o.entity = e.entity AND o.period = p.period AND o.metric = m.metric""")
def explorer_grid(spark, d):
    obs = observations(spark, d)
    months = spark.range(1).select(F.explode(periods.month_spine(F.to_date(F.lit("1998-01-01")), F.to_date(F.lit("1998-12-01")))).alias("period"))
    grid = coverage.dense_grid(obs.select("entity").distinct(), months, obs.select("metric").distinct())
    rows = grid.join(obs, ["entity", "period", "metric"], "left")
    there = F.col("value").isNotNull()
    state = coverage.metric_cell_state({"data": there & (F.col("value") >= 100), "review": there})
    return rows.select("entity", "period", "metric", state.alias("state"))


@query(f"""WITH g AS ({SQL['explorer_grid']}) SELECT state, count(*) AS n FROM g GROUP BY ALL""")
def coverage_summary(spark, d):
    return explorer_grid(spark, d).groupBy("state").agg(F.count("*").alias("n"))


@query(f"""WITH {OBS}, e AS (SELECT DISTINCT entity FROM obs), p AS (SELECT CAST(unnest(generate_series(DATE '1997-01-01', DATE '1998-12-01', INTERVAL 1 MONTH)) AS DATE) AS period),
    a AS (SELECT entity, period, bool_or(metric = 'N') AS has_n, bool_or(value < 60) AS low FROM obs GROUP BY ALL)
    SELECT e.entity, p.period, CASE WHEN has_n THEN 'ok' WHEN a.entity IS NULL THEN 'no_file' WHEN low THEN 'low_confidence' ELSE 'no_extraction' END AS reason
    FROM e CROSS JOIN p LEFT JOIN a ON a.entity = e.entity AND a.period = p.period""")
def gap_reason(spark, d):
    obs = observations(spark, d)
    months = spark.range(1).select(F.explode(periods.month_spine(F.to_date(F.lit("1997-01-01")), F.to_date(F.lit("1998-12-01")))).alias("period"))
    flags = obs.groupBy("entity", "period").agg(F.bool_or(F.col("metric") == "N").alias("has_n"), F.bool_or(F.col("value") < 60).alias("low"))
    rows = coverage.dense_grid(obs.select("entity").distinct(), months).join(flags, ["entity", "period"], "left")
    reason = coverage.gap_reason(F.coalesce("has_n", F.lit(False)), F.col("has_n").isNotNull(), F.coalesce("low", F.lit(False)))
    return rows.select("entity", "period", reason.alias("reason"))


@query(f"""WITH {OBS}, {SPINE}, o AS ({SQL['trailing_outlier']}), p AS (SELECT entity, count(*) AS points, count(*) FILTER (is_outlier) AS outliers FROM o GROUP BY ALL),
    g AS (SELECT s.entity, count(*) AS gaps FROM spine s ANTI JOIN obs o ON s.entity = o.entity AND s.metric = o.metric AND s.month = o.period GROUP BY ALL)
    SELECT p.entity, points, outliers, coalesce(gaps, 0) AS gaps, round(coalesce(gaps, 0) / (coalesce(gaps, 0) + points), 4) AS gap_ratio FROM p LEFT JOIN g USING (entity)""")
def health_card(spark, d):
    obs = observations(spark, d)
    return coverage.health(windows.outliers(obs, KEYS, 0.4), obs, "entity")


@query(f"""WITH {OBS}, w AS (SELECT DISTINCT entity, CASE WHEN entity % 2 = 0 THEN 3 ELSE 1 END AS step FROM obs)
    SELECT entity, CAST(unnest(generate_series(DATE '1996-02-01', DATE '1998-06-15', to_months(CAST(step AS INTEGER)))) AS DATE) AS period FROM w""")
def expected_periods(spark, d):
    w = observations(spark, d).select("entity").distinct()
    w = w.select("entity", _cadence().alias("cadence"), F.to_date(F.lit("1996-02-10")).alias("start"), F.lit(None).cast("date").alias("end"))
    return coverage.expected_periods(w, "entity", F.to_date(F.lit("1998-06-15")))


@query(f"""WITH {OBS}, x AS ({SQL['expected_periods']}), h AS (SELECT entity, period, count(*) AS metrics FROM obs GROUP BY ALL)
    SELECT x.entity, x.period, CASE WHEN metrics = 3 THEN 'covered' WHEN metrics >= 1 THEN 'partial' ELSE 'missing' END AS state,
        CASE WHEN metrics IS NULL THEN 'high' WHEN metrics < 3 THEN 'medium' ELSE 'none' END AS priority FROM x LEFT JOIN h ON h.entity = x.entity AND h.period = x.period""")
def scout_directives(spark, d):
    have = observations(spark, d).groupBy("entity", "period").agg(F.count("*").alias("metrics"))
    rows = expected_periods(spark, d).join(have, ["entity", "period"], "left")
    n = F.coalesce("metrics", F.lit(0))
    state = filters.ladder([("covered", n == 3), ("partial", n >= 1)], "missing")
    urgency = filters.ladder([("high", n == 0), ("medium", n < 3)], "none")
    return rows.select("entity", "period", state.alias("state"), urgency.alias("priority"))


@query(f"""WITH {OBS}, i AS (SELECT entity, metric, year(period) || '-Q' || quarter(period) AS period, count(*) AS covered,
        count(*) FILTER (value < 50) AS pending FROM obs GROUP BY ALL)
    SELECT entity, metric, period, CASE WHEN pending > 0 THEN 'deferred' WHEN covered = 3 THEN 'suppressed' ELSE 'active' END AS precedence FROM i""")
def review_precedence(spark, d):
    obs = observations(spark, d)
    items = quarterly(obs).select("entity", "metric", F.col("covering").alias("period"), F.concat_ws("|", "entity", "metric", "covering").alias("id"))
    # a month's report of one metric is pending while its value is low; the metric is part of the entity here
    joined = lambda df: df.withColumn("entity", F.concat_ws("|", "entity", "metric"))
    reports = joined(obs).select("entity", F.col("period").alias("month"), (F.col("value") < 50).alias("pending"))
    months = joined(obs).select("entity", "metric", F.col("period").alias("month"))
    out = extract.review_precedence(joined(items), reports, months)
    return out.select(F.substring_index("entity", "|", 1).cast("long").alias("entity"), "metric", "period", "precedence")


@query(f"""WITH {OBS}, r AS (SELECT *, CASE WHEN value <> lag(value) OVER w OR lag(period) OVER w + INTERVAL 1 MONTH <> period OR lag(period) OVER w IS NULL THEN 1 ELSE 0 END AS new
        FROM (SELECT entity, metric, period, floor(value / 100) AS value FROM obs) WINDOW w AS (PARTITION BY entity, metric ORDER BY period)),
    n AS (SELECT *, sum(new) OVER (PARTITION BY entity, metric ORDER BY period) AS run FROM r)
    SELECT entity, metric, CAST(value AS BIGINT) AS value, count(*) AS months, min(period) AS first, max(period) AS last FROM n GROUP BY entity, metric, run, value HAVING count(*) >= 3""")
def stale_repetition(spark, d):
    obs = observations(spark, d).withColumn("value", F.floor(F.col("value") / 100))
    return windows.repeated_runs(obs, KEYS, 3)


@query(f"""WITH {OBS}, l AS (SELECT *, lag(value) OVER w AS pv, lag(period) OVER w + INTERVAL 1 MONTH = period AS next FROM obs WINDOW w AS (PARTITION BY entity, metric ORDER BY period))
    SELECT entity, metric, period, CASE WHEN value = 0 THEN 'zero_unexplained' WHEN next AND pv > 0 AND value / pv > 3 THEN 'swing_up' WHEN next AND pv > 0 AND value / pv < 0.2 THEN 'swing_down' END AS rule
    FROM l WHERE value = 0 OR (next AND pv > 0 AND (value / pv > 3 OR value / pv < 0.2))""")
def anomaly_rules(spark, d):
    rows = windows.month_delta(observations(spark, d), KEYS)
    before = F.col("value") - F.col("delta")
    rate = F.try_divide(F.col("value"), F.when(before > 0, before))
    rule = F.when(F.col("value") == 0, "zero_unexplained").when(rate > 3, "swing_up").when(rate < 0.2, "swing_down")
    return rows.select("entity", "metric", "period", rule.alias("rule")).where("rule is not null")


@query(f"""WITH {OBS}, o AS (SELECT entity, period, metric, (entity * 5 + month(period) + year(period)) % 5 AS k, CASE WHEN (entity + month(period)) % 11 = 0 THEN 0 ELSE floor(value / 60) * 60 END AS v FROM obs),
    x AS (
        SELECT entity, period, CASE metric WHEN 'A' THEN 'production_btc' WHEN 'N' THEN 'hashrate_eh_operational' ELSE 'treasury_btc_total' END AS metric, k, CASE metric WHEN 'N' THEN v / 2 ELSE v END AS v FROM o
        UNION ALL SELECT entity, period, 'sold_btc', k, CASE WHEN k = 0 THEN 5.0 ELSE 0.0 END FROM o WHERE metric = 'R' UNION ALL SELECT entity, period, 'ytd_production_btc', k, CASE WHEN k < 2 THEN v ELSE v * 2 + 1 END FROM o WHERE metric = 'A'),
    e AS (SELECT *, lower(coalesce(CASE k WHEN 0 THEN 'Output in ' || monthname(period) WHEN 1 THEN 'Q2 figures' WHEN 2 THEN 'After an OUTAGE we sold' WHEN 3 THEN 'Rated ' || CAST(v AS BIGINT) || ' PH/s' END, '')) AS said, (k + 1) / 5.0 AS trust FROM x),
    w AS (SELECT e.*, b1.v AS p1, b2.v AS p2, (SELECT CASE WHEN count(*) = 3 THEN sum(q.v) END FROM e q WHERE q.entity = e.entity AND q.metric = e.metric AND date_trunc('quarter', q.period) = date_trunc('quarter', e.period) - INTERVAL 3 MONTH) AS lq,
        h.v AS h, s.v AS sold, y.v AS ytd FROM e LEFT JOIN e b1 ON b1.entity = e.entity AND b1.metric = e.metric AND b1.period = e.period - INTERVAL 1 MONTH LEFT JOIN e b2 ON b2.entity = e.entity AND b2.metric = e.metric AND b2.period = e.period - INTERVAL 2 MONTH
        LEFT JOIN e h ON h.entity = e.entity AND h.period = e.period AND h.metric = 'hashrate_eh_operational' LEFT JOIN e s ON s.entity = e.entity AND s.period = e.period AND s.metric = 'sold_btc'
        LEFT JOIN e y ON y.entity = e.entity AND y.period = e.period AND y.metric = 'ytd_production_btc'),
    r AS (
        SELECT *, 'mom_swing_unexplained' AS code FROM w WHERE metric IN ('production_btc', 'hashrate_eh_operational', 'treasury_btc_total') AND abs(v - p1) / greatest(p1, 1) > 0.5 AND NOT contains(said, 'outage')
        UNION ALL SELECT *, 'production_hashrate_impossible' FROM w WHERE metric = 'production_btc' AND h IS NOT NULL AND v / greatest(h, 0.001) > 500
        UNION ALL SELECT *, 'hashrate_implausible_pre2025' FROM w WHERE metric = 'hashrate_eh_operational' AND period < DATE '2025-01-01' AND v > 200
        UNION ALL SELECT *, 'treasury_drop_unexplained' FROM w WHERE metric = 'treasury_btc_total' AND p1 > 0 AND (p1 - v) / p1 > 0.2 AND coalesce(sold, 0) = 0 AND NOT contains(said, 'sold')
        UNION ALL SELECT *, 'ytd_confusion_exact_match' FROM w WHERE metric = 'production_btc' AND v = ytd AND month(period) <> 1
        UNION ALL SELECT *, 'quarterly_imputation_pattern' FROM w WHERE abs(v * 3 - lq) <= 0.01 * abs(lq) AND lq <> 0 AND k = 1
        UNION ALL SELECT *, 'zero_production_unexplained' FROM w WHERE metric = 'production_btc' AND v = 0 AND NOT contains(said, 'outage')
        UNION ALL SELECT *, 'low_confidence_no_agreement' FROM w WHERE trust < 0.6 AND entity % 2 = 0
        UNION ALL SELECT *, 'stale_value_repetition' FROM w WHERE v = p1 AND v = p2 AND metric <> 'sold_btc'
        UNION ALL SELECT *, 'hashrate_unit_mismatch' FROM w WHERE metric = 'hashrate_eh_operational' AND k = 3)
    SELECT entity, period AS month, metric, CAST(v AS DOUBLE) AS value, code, CASE WHEN code IN ('mom_swing_unexplained', 'treasury_drop_unexplained', 'quarterly_imputation_pattern', 'low_confidence_no_agreement', 'stale_value_repetition') THEN 'medium' ELSE 'high' END AS severity FROM r""")
def documented_anomalies(spark, d):
    """All ten rules on quantities by month, some of them zero, with five kinds of evidence."""
    obs = observations(spark, d)
    k = ((F.col("entity") * 5 + F.month("period") + F.year("period")) % 5).alias("k")
    v = F.when((F.col("entity") + F.month("period")) % 11 == 0, 0.0).otherwise(F.floor(F.col("value") / 60) * 60.0)
    o = obs.select("entity", F.col("period").alias("month"), F.col("metric").alias("m"), k, v.alias("v"))
    name = F.when(F.col("m") == "A", "production_btc").when(F.col("m") == "N", "hashrate_eh_operational").otherwise("treasury_btc_total")
    rows = o.select("entity", "month", name.alias("metric"), "k", F.when(F.col("m") == "N", F.col("v") / 2).otherwise(F.col("v")).alias("value"))
    sold = o.where("m = 'R'").select("entity", "month", F.lit("sold_btc"), "k", F.when(F.col("k") == 0, 5.0).otherwise(0.0))
    year = o.where("m = 'A'").select("entity", "month", F.lit("ytd_production_btc"), "k", F.when(F.col("k") < 2, F.col("v")).otherwise(F.col("v") * 2 + 1))
    rows = rows.union(sold).union(year)
    said = (
        F.when(F.col("k") == 0, F.concat(F.lit("Output in "), F.date_format("month", "MMMM"))).when(F.col("k") == 1, "Q2 figures").when(F.col("k") == 2, "After an OUTAGE we sold")
        .when(F.col("k") == 3, F.concat(F.lit("Rated "), F.col("value").cast("long").cast("string"), F.lit(" PH/s")))
    )
    rows = rows.withColumns({"evidence": said, "confidence": (F.col("k") + 1) / 5.0, "agreed": F.col("entity") % 2 == 1})
    return anomalies.anomalies(rows, ("sold_btc",)).drop("action")


@query("""SELECT l_orderkey, l_linenumber, arg_min(l_suppkey, (CASE l_linestatus WHEN 'F' THEN 1 ELSE 2 END, -l_partkey, -l_suppkey)) AS l_suppkey,
    min(CASE l_linestatus WHEN 'F' THEN 1 ELSE 2 END) AS priority FROM lineitem GROUP BY ALL""")
def priority_merge(spark, d):
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", F.when(F.col("l_linestatus") == "F", 1).otherwise(2).alias("priority"),
        (F.col("l_partkey") * 100_000 + F.col("l_suppkey")).alias("seq"),
    )
    return merge.authority_wins(rows, ["l_orderkey", "l_linenumber"]).drop("seq")


@query(f"""WITH {OBS} SELECT strftime(o.period, '%Y-%m') AS ym, quarter(o.period) AS q, CASE WHEN period >= DATE '1998-01-01' THEN 'monthly' ELSE 'quarterly' END AS cadence, entity, metric FROM obs o""")
def asof_regime(spark, d):
    obs = observations(spark, d)
    first = obs.select("entity").distinct()
    day = lambda x: F.lit(x).cast("date")
    early = first.select("entity", day("1990-01-01").alias("start"), day("1997-12-31").alias("end"), F.lit("quarterly").alias("cadence"))
    late = first.select("entity", day("1998-01-01").alias("start"), day(None).alias("end"), F.lit("monthly").alias("cadence"))
    hit = joins.as_of(obs, early.union(late), "entity", "period", "cadence", "monthly")
    return hit.select(F.date_format("period", "yyyy-MM").alias("ym"), F.quarter("period").cast("long").alias("q"), "cadence", "entity", "metric")
