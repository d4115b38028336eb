"""Streams over restarts, snapshots that fail between their phases, traces."""

import random
import time
from collections import Counter
from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import coverage, trace
from ledgerline.sources import snapshots
from ledgerline.streaming import merge as streams
from ledgerline.streaming.ordered import in_order


def land(spark, path, rows, schema, n):
    """Each row chunk as a file of its own, in the order given."""
    size = -(-len(rows) // n)
    for k in range(0, len(rows), size):
        spark.createDataFrame(rows[k : k + size], schema).coalesce(1).write.mode("append").parquet(path)


def test_rows_are_released_in_order_over_a_restart(spark, tmp_path):
    r = random.Random(7)
    rows = [(k, n, f"{k}-{n}" if n % 4 else None) for k in ("a", "b", None) for n in range(1, 15)]
    r.shuffle(rows)
    late = [x for x in rows if x[:2] in (("a", 3), ("b", 1))]
    first = [x for x in rows if x not in late] + [("a", 5, "again"), ("a", None, "no number")]
    path, out, schema = f"{tmp_path}/in", f"{tmp_path}/out", "k string, n long, v string"
    land(spark, path, first, schema, 3)
    told = [tuple(x) for x in in_order(streams.landed_stream(spark, path, 1), "k", "n", out=out).select("k", "n", "v", "_batch").collect()]
    assert {(k, n) for k, n, _, _ in told} == {("a", 1), ("a", 2), *((None, n) for n in range(1, 15))}
    land(spark, path, [*late, ("a", 2, "sent twice")], schema, 1)
    told = [tuple(x) for x in in_order(streams.landed_stream(spark, path, 1), "k", "n", out=out).select("k", "n", "v", "_batch").collect()]
    assert Counter((k, n) for k, n, _, _ in told) == Counter((k, n) for k, n, _ in rows)
    for k in ("a", "b", None):
        batches = [b for _, _, _, b in sorted((x for x in told if x[0] == k), key=lambda x: x[1])]
        assert batches == sorted(batches)
    assert {(k, n): v for k, n, v, _ in told} == {(k, n): v for k, n, v in rows} | ({("a", 5): "again"} if {(k, n): v for k, n, v, _ in told}["a", 5] == "again" else {})


def test_many_keys_are_released_in_order(spark, tmp_path):
    """60,000 groups of a key in a batch, each of which cost several calls of Python's state."""
    land(spark, f"{tmp_path}/in", [(k, n) for n in (2, 1, 3) for k in range(20_000)], "k long, n long", 3)
    began = time.monotonic()
    rows = in_order(streams.landed_stream(spark, f"{tmp_path}/in", 1), "k", "n")
    got = {(r["n"], r["_batch"]): r["c"] for r in rows.groupBy("n", "_batch").agg(F.count("*").alias("c")).collect()}
    assert got == {(1, 1): 20_000, (2, 1): 20_000, (3, 2): 20_000}
    assert time.monotonic() - began < 60


@pytest.mark.parametrize("seed", [1, 2])
def test_lesser_authority_never_replaces(spark, tmp_path, seed):
    """The same in any order of arrival, and when a run stops and goes on."""
    r = random.Random(seed)
    rows = [(k, r.choice([1, 2, 3, None]), n, f"{k}.{n}") for k in range(6) for n in range(12)]
    r.shuffle(rows)
    path, out, schema = f"{tmp_path}/in", f"{tmp_path}/out", "k int, rank int, n long, v string"
    best = lambda xs: {k: max((x for x in xs if x[0] == k), key=lambda x: (x[1] is not None, -(x[1] or 0), x[2])) for k in {x[0] for x in xs}}
    for part in (rows[:30], rows[30:]):
        land(spark, path, part, schema, 4)
        got = {x["k"]: tuple(x[c] for c in ("k", "rank", "n", "v")) for x in streams.guarded(streams.landed_stream(spark, path, 2), ["k"], "rank", "n", out=out).collect()}
        seen = rows[:30] if part == rows[:30] else rows
        assert got == best(seen)


def test_changes_name_the_keys_of_a_batch(spark, tmp_path):
    land(spark, f"{tmp_path}/in", [(1, 5), (2, 1), (1, 3), (1, 9)], "k int, n int", 4)
    log = streams.changes(streams.landed_stream(spark, f"{tmp_path}/in", 1), ["k"], F.col("n")).collect()
    assert len(log) == 4 and max(r["_row"]["n"] for r in log if r["k"] == 1) == 9


def test_streams_leave_the_callers_settings_alone(spark, tmp_path):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    land(spark, f"{tmp_path}/in", [(1, 5)], "k int, n int", 1)
    assert streams.deduplicated(streams.landed_stream(spark, f"{tmp_path}/in"), ["k"]).count() == 1
    assert spark.conf.get(name) == before


def test_archive_and_purge_are_seen_together_or_not_at_all(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/snap"
    rows = spark.createDataFrame([(k, None if k == 3 else f"v{k}") for k in range(6)], "k int, v string")
    scope = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k int")
    seen = lambda: (sorted(r["k"] for r in snapshots.current(spark, root, "rows").collect()), snapshots.current(spark, root, "archive").count())
    snapshots.archive_and_purge(rows, scope(1, 3), ["k"], root)
    assert seen() == ([0, 2, 4, 5], 2)
    with monkeypatch.context() as m:  # the job stops between its phases
        m.setattr(snapshots, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            snapshots.archive_and_purge(snapshots.current(spark, root, "rows"), scope(0), ["k"], root)
    assert seen() == ([0, 2, 4, 5], 2)
    bad = snapshots.staged({"rows": rows, "archive": scope(9)}, root)
    rows.limit(1).write.mode("append").parquet(f"{root}/versions/{bad}/rows")  # not what was staged
    with pytest.raises(ValueError, match="not what was staged"):
        snapshots.publish(spark, root, bad)
    assert seen() == ([0, 2, 4, 5], 2)
    snapshots.archive_and_purge(snapshots.current(spark, root, "rows"), scope(0, 77), ["k"], root)
    assert seen() == ([2, 4, 5], 3)


def test_a_failed_task_leaves_the_old_snapshot(spark, tmp_path):
    root = f"file://{tmp_path}/snap"
    rows = spark.range(4).withColumnRenamed("id", "k")
    snapshots.publish(spark, root, snapshots.staged({"rows": rows}, root))
    with pytest.raises(Exception, match="lost"):
        snapshots.publish(spark, root, snapshots.staged({"rows": rows.withColumn("k", F.when(F.col("k") == 2, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("k")))}, root))
    assert snapshots.current(spark, root, "rows").count() == 4


def test_checksums_tell_rows_and_repeats(spark):
    of = lambda *xs: tuple(snapshots.checksum(spark.createDataFrame([(x, None) for x in xs], "a int, b array<int>")).first())
    assert of(1, 2, 2) == of(2, 1, 2) != of(1, 1, 2) and of(1) != of(None)
    assert tuple(snapshots.checksum(spark.createDataFrame([], "a int")).first()) == (0, 0)


def test_trails_are_closures_and_are_dealt_by_cell_once(spark):
    rng = random.Random(5)
    kinds = trace.KINDS
    links = {(kinds[a], rng.randrange(6), kinds[b], rng.randrange(6)) for a, b in (sorted(rng.sample(range(6), 2)) for _ in range(60))}
    cells = {(cell, kinds[rng.randrange(6)], rng.randrange(6)) for cell in range(12) for _ in range(2)}
    expected = set(cells)
    for forth in (links, {(k, i, kind, n) for kind, n, k, i in links}):
        new = set(cells)
        while new:
            expected |= new
            new = {(c, k, i) for c, kind, n in new for kind_, n_, k, i in forth if (kind, n) == (kind_, n_)}
    rows = trace.trails(spark.createDataFrame(list(cells), "cell int, kind string, id int"), spark.createDataFrame([*links, *links], "kind string, id int, to_kind string, to_id int"))
    got = [tuple(r) for r in rows.select("cell", "kind", "id").collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    plan = trace.stage_counts(rows, ["cell"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1


def test_trails_go_up_and_down(spark):
    links = [("document", 1, "chunk", 11), ("document", 1, "chunk", 12), ("chunk", 11, "value", 11), ("value", 11, "review", 5), ("review", 5, "decision", 5), ("decision", 5, "fact", 9), ("value", 11, "fact", 9), ("document", 2, "chunk", 20)]
    links = spark.createDataFrame([*links, links[0]], "kind string, id long, to_kind string, to_id long")
    cells = spark.createDataFrame([("x", "value", 11), ("y", "chunk", 20), ("z", "fact", 404)], "cell string, kind string, id long")
    rows = trace.trails(cells, links)
    got = {r["cell"]: r["trail"] for r in trace.trail_texts(rows, ["cell"]).collect()}
    assert got == {"x": "document:1 > chunk:11 > value:11 > review:5 > decision:5 > fact:9", "y": "document:2 > chunk:20", "z": "fact:404"}
    counts = {r["cell"]: (r["document"], r["chunk"], r["fact"]) for r in trace.stage_counts(rows, ["cell"]).collect()}
    assert counts == {"x": (1, 1, 1), "y": (1, 1, 0), "z": (0, 0, 1)}


def test_period_trace_of_months_with_and_without_reports(spark):
    day = date(2024, 5, 3)
    cells = spark.createDataFrame([("a", date(2024, 5, 1)), ("b", date(2024, 5, 1)), ("a", date(2024, 6, 1))], "entity string, month date")
    reports = spark.createDataFrame([(1, "a", day, "edgar_8k", "pending", "text_ok", "long"), (2, "a", day, "archive_pdf", "done", "text_ok", "text"), (3, "b", day, "x", "done", "parse_failed", None)], "id int, entity string, day date, source_type string, status string, parse_quality string, text string")
    manifest = spark.createDataFrame([("b", date(2024, 5, 1))], "entity string, month date")
    metrics = spark.createDataFrame([("m",), ("n",)], "metric string")
    values = spark.createDataFrame([(1, "a", date(2024, 6, 1), "m", 5.0)], "id int, entity string, month date, metric string, value double")
    reviews = spark.createDataFrame([(1, "b", date(2024, 5, 1), "n", "LLM_EMPTY", "PENDING", None), (2, "b", date(2024, 5, 1), "m", None, "PENDING", "deferred")], "id int, entity string, month date, metric string, agreement string, status string, precedence string")
    got = {(r["entity"], r["month"].month, r["metric"]): r for r in trace.period_trace(cells, reports, manifest, metrics, values, reviews).collect()}
    assert len(got) == 6
    assert (got["a", 5, "m"]["char_count"], got["a", 5, "m"]["keyword_gated"], got["a", 5, "m"]["cell_state"]) == (4, True, "extract_failed")
    assert (got["b", 5, "n"]["review_id"], got["b", 5, "m"]["cell_state"], got["b", 5, "m"]["has_manifest"], got["b", 5, "m"]["keyword_gated"]) == (1, "llm_empty", True, False)
    assert (got["a", 6, "m"]["value"], got["a", 6, "m"]["cell_state"]) == (None, "no_document")  # without a report nothing else counts


def test_cadence_rules_in_turn(spark):
    companies = [("driven", "rss", True, 2020), ("index", "Index", False, None), ("monthly", "index", False, None), ("quarterly", None, False, 2019), ("between", None, False, None), ("few", "rss", False, None)]
    step = {"monthly": 30, "quarterly": 91, "between": 60}
    dates = [(e, date.fromordinal(date(2022, 3, 1).toordinal() + k * n)) for e, n in step.items() for k in range(5)] + [("monthly", date(2022, 3, 1)), ("few", date(2022, 3, 1)), ("few", None)]
    rows = coverage.cadence_windows(
        spark.createDataFrame(companies, "entity string, mode string, event_driven boolean, start_year int"), spark.createDataFrame(dates, "entity string, day date"),
        spark.createDataFrame([("between",), ("between",)], "entity string"), F.to_date(F.lit("2024-06-01")),
    )
    got = {r["entity"]: (r["cadence"], r["start"].year, r["confidence"], r["evidence"]) for r in rows.collect()}
    assert got == {
        "driven": ("announcement", 2020, 0.9, "index_mode_event_driven_profile"), "index": ("announcement", 2024, 0.9, "index_mode_event_driven_profile"),
        "monthly": ("monthly", 2022, 0.85, "median_interval_days=30.0"), "quarterly": ("quarterly", 2019, 0.85, "median_interval_days=91.0"),
        "between": ("quarterly", 2024, 0.7, "edgar_quarterly_forms_present"), "few": ("monthly", 2024, 0.6, "fallback_default_monthly"),
    }
