import random
from datetime import date

import pytest
from pyspark.sql import functions as F


from ledgerline.functions import html as pages
from ledgerline.operators import aggregates, coverage, extract, fill, filters, joins, merge, nearhash, windows
from ledgerline.plans import corpus as plans
from ledgerline.sources import files


def series(spark, values, entity="a"):
    rows = [(entity, "m", date(2024 + (k - 1) // 12, (k - 1) % 12 + 1, 1), float(v)) for k, v in values]
    return spark.createDataFrame(rows, "entity string, metric string, period date, value double")


def test_month_delta_skips_holes(spark):
    got = windows.month_delta(series(spark, [(1, 10), (2, 15), (4, 9)]), ["entity", "metric"]).orderBy("period").collect()
    assert [r["delta"] for r in got] == [None, 5.0, None]
    assert [r["skipped"] for r in got] == [None, None, "gap_2_months"]


def test_outlier_bounds(spark):
    flags = lambda values, thr: [r["is_outlier"] for r in windows.outliers(series(spark, values), ["entity", "metric"], thr).orderBy("period").collect()]
    assert flags([(1, 100), (2, 100), (3, 100), (4, 140)], 0.4)[-1] is False  # strictly more
    assert flags([(1, 100), (2, 100), (3, 100), (4, 141)], 0.4)[-1] is True
    assert flags([(1, 0), (2, 0), (3, 0), (4, 1)], 0.4)[-1] is True
    assert flags([(1, 1), (2, 1), (3, 50)], 0.4)[-1] is False  # history too short


def test_priority_merge_equals_writing_in_turn(spark):
    r = random.Random(5)
    rows = [(r.choice("abc"), r.randint(0, 4), seq, r.random()) for seq in range(200)]
    state = {}
    for key, prio, seq, value in rows:
        if key not in state or prio <= state[key][0]:
            state[key] = (prio, seq, value)
    df = spark.createDataFrame(rows, "key string, priority int, seq int, value double")
    got = {x["key"]: (x["priority"], x["seq"], x["value"]) for x in merge.authority_wins(df, ["key"]).collect()}
    assert got == state


def test_gap_fill_flow(spark):
    total = spark.createDataFrame([("a", "2024-Q1", "m", 30.0)], "entity string, covering string, metric string, value double")
    run = lambda known: {r["month"].month: (r["status"], r["reason"], r["value"]) for r in fill.fill_flow(fill.cells(total, series(spark, known) if known else series(spark, [(9, 1)]))).collect()}
    assert run([(1, 10), (2, 12)]) == {3: ("filled", "inferred_delta", 8.0)}
    assert run([(1, 20), (2, 12)])[3][:2] == ("skipped", "negative_delta")
    assert run([(1, 1), (2, 1), (3, 1)]) == {1: ("skipped", "all_months_present", None)}
    assert {v[2] for v in run([]).values()} == {10.0}
    assert {v[1] for v in run([(1, 1)]).values()} == {"insufficient_known_months"}


def test_gap_fill_snapshot(spark):
    total = spark.createDataFrame([("a", "2024-Q1", "m", 30.0)], "entity string, covering string, metric string, value double")
    frame = fill.cells(total, series(spark, [(1, 5)]))
    values = lambda mode, prev: {r["month"].month: r["value"] for r in fill.fill_snapshot(frame, F.lit(prev).cast("double"), mode).collect()}
    assert values("endpoint", None) == {3: 30.0}
    assert values("stepwise", None) == {2: 30.0, 3: 30.0}
    assert values("linear", 0.0) == {2: pytest.approx(20.0), 3: pytest.approx(30.0)}
    assert values("linear", None) == {2: 30.0, 3: 30.0}
    with pytest.raises(ValueError):
        fill.fill_snapshot(frame, F.lit(1.0), "odd")


def test_bridge_annual_and_monthly(spark):
    total = spark.createDataFrame([("a", "2024-FY", "m", 120.0)], "entity string, covering string, metric string, value double")
    got = fill.bridge_flow(fill.cells(total, series(spark, [(k, 10) for k in range(1, 12)])), F.lit("monthly")).collect()
    assert [(r["month"], r["value"], r["method"], r["confidence"]) for r in got] == [(date(2024, 12, 1), 10.0, "quarterly_inferred", 0.65)]
    got = fill.bridge_flow(fill.cells(total, series(spark, [(1, 10)])), F.lit("quarterly")).collect()
    assert len(got) == 11 and {r["method"] for r in got} == {"annual_carry"}


def test_interpolation_and_one_sided_carry(spark):
    rows = [("a", "m", date(2024, k, 1), v) for k, v in ((1, None), (2, 10.0), (3, None), (4, 20.0), (5, None))]
    df = spark.createDataFrame(rows, "entity string, metric string, month date, value double")
    got = [r["suggested"] for r in windows.interpolated(df, ["entity", "metric"]).orderBy("month").collect()]
    assert got == [10.0, None, 15.0, None, 20.0]


def test_as_of_takes_the_latest_window(spark):
    days = spark.createDataFrame([("a", date(2024, 5, 1)), ("b", date(2024, 5, 1))], "k string, day date")
    w = spark.createDataFrame([("a", date(2020, 1, 1), None, "monthly"), ("a", date(2024, 1, 1), date(2024, 12, 31), "quarterly")], "k string, start date, end date, cadence string")
    got = {r["k"]: r["cadence"] for r in joins.as_of(days, w, "k", "day", "cadence", "monthly").collect()}
    assert got == {"a": "quarterly", "b": "monthly"}


def test_hamming_bands_find_all_close_pairs(spark):
    r = random.Random(3)
    base = [r.getrandbits(63) for _ in range(30)]
    hashes = base + [b ^ sum(1 << k for k in r.sample(range(63), r.randint(1, 5))) for b in base]
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if bin(hashes[i] ^ hashes[j]).count("1") <= 3}
    df = spark.createDataFrame([(i, "g", h) for i, h in enumerate(hashes)], "id int, g string, h long")
    assert {(x["key_a"], x["key_b"]) for x in nearhash.near_by_hamming(df, "id", "g", "h").collect()} == want


def test_near_dup_docs_hold_reworded_copies(spark, tmp_path):
    words = [f"word{k}" for k in range(40)]
    base = [" ".join(words), " ".join(words[::-1]), " ".join(words).upper(), ", ".join(words) + "."]
    texts = [(t, lang) for t in base for lang in ("en", "de")] + [(" ".join([*words, "more"]), "en"), (" ".join([*words, "more"]).upper(), "en"), ("else", "en"), ("", "fr"), ("?", "fr"), (None, "fr"), ("word1", None), ("WORD1", None)]
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(texts)], "doc_id long, text string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    hashes = {r["doc_id"]: r["simhash"] for r in nearhash.simhash(docs, "doc_id", "text").collect()}
    assert len({hashes[i] for i in (0, 2, 4, 6)}) == 1
    near = lambda i, j: texts[i][1] and texts[i][1] == texts[j][1] and ((hashes[i] ^ hashes[j]) & (2**64 - 1)).bit_count() <= 3
    want = {(i, j) for i in hashes for j in hashes if i < j and near(i, j)}
    members = {r["doc_id"]: r for r in plans.near_dup_members(spark, str(tmp_path)).collect()}
    assert {i: r["near"] for i, r in members.items()} == {i: sum(i in p for p in want) for i in hashes}
    pairs = {(r["key_a"], r["key_b"]): r["distance"] for r in plans.near_dup_docs(spark, str(tmp_path)).collect()}
    assert all(p in want and d == ((hashes[p[0]] ^ hashes[p[1]]) & (2**64 - 1)).bit_count() for p, d in pairs.items())
    rep = {i: members[i]["representative"] for i in hashes}
    assert want == {(i, j) for i in hashes for j in hashes if i < j and None not in (rep[i], rep[j]) and (rep[i] == rep[j] or tuple(sorted((rep[i], rep[j]))) in pairs)}
    assert all((rep[i], i) in pairs for i in hashes if rep[i] not in (None, i))


def test_within_days_equals_brute_force(spark):
    r = random.Random(4)
    a = [(i, r.choice("xy"), date.fromordinal(738000 + r.randint(0, 300))) for i in range(40)]
    b = [(i, r.choice("xy"), date.fromordinal(738000 + r.randint(0, 300))) for i in range(40)]
    want = {(i, j) for i, k, d in a for j, q, e in b if k == q and abs((d - e).days) <= 20}
    left, right = spark.createDataFrame(a, "i int, k string, d date"), spark.createDataFrame(b, "j int, k string, e date")
    got = joins.within_days(left, right, "k", "d", "e", 20).collect()
    assert {(x["i"], x["j"]) for x in got} == want and len(got) == len(want)


def test_coverage_states(spark):
    no, yes = F.lit(False), F.lit(True)
    state = lambda *a: spark.range(1).select(coverage.cell_state(*a).alias("s")).first()["s"]
    arr = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    none = F.lit(None).cast("array<string>")
    assert state(yes, yes, yes, none) == "accepted" and state(no, yes, yes, none) == "extracted_in_review"
    assert state(no, no, no, arr("failed")) == "pending_ingest" and state(no, no, no, arr("legacy_undated")) == "legacy_undated"
    assert state(no, no, no, arr("ingested")) == "ingested_pending_extraction" and state(no, no, no, none) == "no_source"


def test_expected_periods(spark):
    w = spark.createDataFrame([("a", "monthly", date(2024, 1, 15), date(2024, 3, 31)), ("a", "quarterly", date(2024, 4, 1), None)], "k string, cadence string, start date, end date")
    got = sorted(r["period"].month for r in coverage.expected_periods(w, "k", F.to_date(F.lit("2024-10-05"))).collect())
    assert got == [1, 2, 3, 4, 7, 10]


def test_review_decisions(spark):
    queue = spark.createDataFrame([(1, "a", "p", "m", 5.0, "PENDING"), (2, "a", "p", "m", 6.0, "PENDING"), (3, "b", "p", "m", 7.0, "PENDING")], "id int, entity string, period string, metric string, value double, status string")
    decisions = spark.createDataFrame([(1, "edit", 5.5), (3, "reject", None)], "id int, action string, value double")
    facts, final, after = merge.approved(queue, decisions)
    assert [(r["entity"], r["value"], r["priority"]) for r in facts.collect()] == [("a", 5.5, 0)]
    assert {r["id"]: r["status"] for r in after.collect()} == {1: "APPROVED", 2: "DISMISSED", 3: "REJECTED"}


def test_responses_and_plug_in(spark):
    raw = 'Sure: {"btc": {"value": "12", "confidence": 2}, "mw": {"value": "x"}, "eh": {"value": 999}} done'
    rows = spark.createDataFrame([(1, raw), (2, "no json"), (3, None)], "id int, raw string")
    ranges = spark.createDataFrame([("btc", 0.0, 100.0), ("eh", 0.0, 100.0), ("mw", 0.0, 1.0)], "metric string, lo double, hi double")
    assert [tuple(r) for r in extract.parse_responses(rows, "id", "raw", ranges).collect()] == [(1, "btc", 12.0, 1.0)]
    docs = spark.createDataFrame([(1, "a1"), (2, None)], "id int, t string")
    got = extract.extract(docs, lambda t: [("len", float(len(t)), 0.9)], "id", "t").orderBy("id").collect()
    assert [r["value"] for r in got] == [2.0, 0.0]


def test_sources(spark, tmp_path):
    (tmp_path / "a.html").write_text("<title>T x</title><p>Hi</p><table><tr><td>BTC</td><td>1,200</td></tr></table><a href='/u'>go</a>")
    (tmp_path / "a.pdf").write_bytes(b"%PDF")
    scan = files.scan_archive(spark, str(tmp_path)).withColumn("key", F.lit("k"))
    assert files.prefer_html(scan, ["key"]).count() == 1
    m = files.manifest(scan)
    assert {r["state"] for r in files.manifest_drift(m, m).collect()} == {"ok"}
    html = scan.where("path like '%.html'").select(F.lit(1).alias("id"), F.col("content").cast("string").alias("h"))
    parts = html.select("id", pages.plain_text(F.col("h")).alias("text"), pages.page_title(F.col("h")).alias("title"), pages.page_links(F.col("h")).alias("links"))
    row = parts.first()
    assert row["title"] == "T x" and "BTC | 1,200" in row["text"] and row["links"][0]["href"] == "/u"
    values = extract.table_values(parts.select("id", F.col("text").alias("t")), "id", "t").collect()
    assert [(r["label"], r["value"]) for r in values] == [("BTC", 1200.0)]
    rss = spark.createDataFrame([("<rss><channel><item><title>A</title><link>l</link><pubDate>d</pubDate></item><item><title>B</title></item></channel></rss>",)], "xml string")
    assert [r["title"] for r in files.feed_items(rss).collect()] == ["A", "B"]
    sub = spark.createDataFrame([('{"accessionNumber":["x","y"],"form":["8-K","10-Q"],"filingDate":["2024-01-02","2024-02-02"],"reportDate":["",""],"periodOfReport":["2024-01-01",""]}',)], "j string")
    assert [tuple(r) for r in files.filings(sub, "j", "10-Q").collect()] == [("y", "2024-02-02")]


def test_small_operators(spark):
    df = spark.createDataFrame([(1, "x", None), (2, "y", 3.0), (2, "y", 4.0)], "k int, t string, v double")
    assert filters.where_all(df, equal={"k": 2, "t": None}).count() == 2
    assert aggregates.duplicated(df, ["k"], "v").collect()[0]["kept"] == 4.0
    assert aggregates.bucketed(df, "v", [0, 2, 3.5], ["lo", "mid", "hi"]).orderBy("bucket").collect()[1]["n"] == 0
    assert merge.insert_new(df, spark.createDataFrame([(2, "n", 1.0, 1), (9, "n", 1.0, 2)], "k int, t string, v double, seq int"), ["k"]).count() == 4
    assert filters.sampled(df, 2, 7, "k").count() == 2


def test_as_of_keeps_repeated_rows(spark):
    left = spark.createDataFrame([(1, "2024-02-01"), (1, "2024-02-01"), (2, "2024-02-01"), (None, None)], "k int, day string")
    w = spark.createDataFrame([(1, "2024-01-01", "2024-01-31", "a"), (1, "2023-01-01", None, "b")], "k int, start string, end string, cadence string")
    got = sorted((tuple(r) for r in joins.as_of(left, w, "k", "day", "cadence", "none").collect()), key=str)
    assert got == [(1, "2024-02-01", "b"), (1, "2024-02-01", "b"), (2, "2024-02-01", "none"), (None, None, "none")]


def test_attempts_count_every_run(spark):
    rows = [(1, s, n) for n, s in enumerate(["failed"] * 4 + ["done", "failed", "queued"])] + [(2, "failed", 0), (2, "done", 1)] + [(3, "failed", n) for n in range(4)]
    got = {r["k"]: (r["attempts"], r["state"]) for r in merge.attempt_state(spark.createDataFrame(rows, "k int, s string, n int"), "k", "s", "n").collect()}
    assert got == {1: (6, "dead_letter"), 2: (2, "done"), 3: (4, "failed")}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_keys_of_hashes_are_not_broadcast(spark, tmp_path):
    """A small file of hashes has many keys for each: the join on them stays a sort-merge join."""
    spark.range(1000).selectExpr("id", "'en' AS lang", "xxhash64(id) AS simhash").write.parquet(f"{tmp_path}/hashes")
    pairs = nearhash.near_by_hamming(spark.read.parquet(f"{tmp_path}/hashes"), "id", "lang", "simhash")
    by_bits = [line for line in _plan(pairs).splitlines() if "Join" in line and line.count("_bits") >= 2 and "_part" in line]
    assert by_bits and all("SortMergeJoin" in line for line in by_bits)
    assert pairs.count() == 0


def test_near_members_broadcasts_nothing(spark, tmp_path):
    spark.range(1000).selectExpr("id", "'en' AS lang", "id div 2 AS simhash").write.parquet(f"{tmp_path}/hashes")
    spark.createDataFrame([(0, 2, 1), (0, 4, 1)], "key_a long, key_b long, distance int").write.parquet(f"{tmp_path}/pairs")
    read = spark.read.parquet
    members = joins.near_members(read(f"{tmp_path}/hashes"), read(f"{tmp_path}/pairs"), "id", "lang", "simhash")
    assert "Broadcast" not in _plan(members)
    near = {r["id"]: (r["representative"], r["near"]) for r in members.where("id < 8").collect()}
    assert near == {0: (0, 5), 1: (0, 5), 2: (2, 3), 3: (2, 3), 4: (4, 3), 5: (4, 3), 6: (6, 1), 7: (6, 1)}


def test_archives_of_many_folders_are_read_in_few_tasks(spark, tmp_path):
    """300 files in as many folders made 10 tasks, and a task for each folder to list them."""
    for k in range(300):
        (tmp_path / f"f{k}").mkdir()
        (tmp_path / f"f{k}/a.txt").write_text(str(k))
    names = ("spark.sql.files.openCostInBytes", "spark.sql.sources.parallelPartitionDiscovery.parallelism")
    before = [spark.conf.get(n) for n in names]
    found = files.scan_archive(spark, str(tmp_path), "*.txt")
    assert found.rdd.getNumPartitions() <= 6
    assert found.sparkSession.conf.get(names[1]) == "16" and [spark.conf.get(n) for n in names] == before
    assert sorted(int(r[0]) for r in found.select(F.decode("content", "utf-8")).collect()) == list(range(300))


def test_openings_are_computed_once(spark, tmp_path):
    """A dictionary is read once more than it has shards; the texts were split anew for each."""
    texts = ["One two three four", " \n One two  three four five", "one two", "", None, "\tA b c", "a b c ", "x y z w v u", " p q  r"]
    spark.createDataFrame([(t,) for t in texts], "text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = plans._openings(spark, str(tmp_path))
    assert sorted(r[0] for r in found.collect()) == ["a b c", "one two three", "p q r", "x y z"]
    assert "split" not in _plan(found)
