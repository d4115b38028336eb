"""Each documented rule where it holds, and beside it where it doesn't."""

from datetime import date

import pytest

from ledgerline.operators import anomalies

P, H, T = anomalies.PRODUCTION, anomalies.OPERATING, anomalies.TREASURY
NAMES = {"p": P, "h": H, "i": anomalies.INSTALLED, "t": T, "s": anomalies.SOLD, "y": anomalies.YEAR_TO_DATE, "x": "power_mw"}


@pytest.mark.parametrize(
    ("cells", "want"),
    [
        ("p1=100 p2=160", {("p2", "mom_swing_unexplained")}),
        ("p1=100 p2=150", set()),
        ("p1=100 p2=160:new_upgrade", set()),
        ("p1=100 p3=160", set()),
        ("x1=100 x2=900", set()),
        ("p1=501 h1=1", {("p1", "production_hashrate_impossible")}),
        ("p1=500 h1=1", set()),
        ("p1=9000", set()),
        ("i1=201", {("i1", "hashrate_implausible_pre2025")}),
        ("i13=201", set()),
        ("t1=100 t2=79", {("t2", "treasury_drop_unexplained")}),
        ("t1=100 t2=79 s2=21", set()),
        ("t1=100 t2=79:was_SOLD", set()),
        ("p2=7 y2=7", {("p2", "ytd_confusion_exact_match")}),
        ("p1=7 y1=7", set()),
        ("x1=10 x2=11 x3=9 x4=10:Q1_total", {("x4", "quarterly_imputation_pattern")}),
        ("x1=10 x3=20 x5=10.05:Q1_total", set()),
        ("x1=10 x2=11 x3=9 x5=10.05:Q1_total", {("x5", "quarterly_imputation_pattern")}),
        ("x1=10 x2=11 x3=9 x4=10:Q1_of_March", set()),
        ("p1=0", {("p1", "zero_production_unexplained")}),
        ("p1=0:SHUTDOWN", set()),
        ("x1=5 x2=5 x3=5 x4=5", {("x3", "stale_value_repetition"), ("x4", "stale_value_repetition")}),
        ("x1=5 x2=5 x4=5", set()),
        ("h1=7:rated_7_PH/s", {("h1", "hashrate_unit_mismatch")}),
        ("h1=0.007:rated_7_PH/s", {("h1", "hashrate_unit_mismatch")}),
        ("h1=0.07:rated_70_PH/s", set()),
        ("h1=1200:rated_1,200_PH/s", {("h1", "hashrate_unit_mismatch"), ("h1", "hashrate_implausible_pre2025")}),
    ],
)
def test_rules(spark, cells, want):
    rows = []
    for cell in cells.split():
        place, _, rest = cell.partition("=")
        value, _, said = rest.partition(":")
        n = int(place[1:]) - 1
        rows.append(("e", date(2024 + n // 12, n % 12 + 1, 1), NAMES[place[0]], float(value), 0.9, True, said.replace("_", " ") or None))
    df = spark.createDataFrame(rows, "entity string, month date, metric string, value double, confidence double, agreed boolean, evidence string")
    short = {v: k for k, v in NAMES.items()}
    got = {(f"{short[r['metric']]}{(r['month'].year - 2024) * 12 + r['month'].month}", r["code"]) for r in anomalies.anomalies(df).collect()}
    assert got == want


def test_trust_nulls_and_severity(spark):
    rows = [("a", date(2024, 1, 1), "m", 1.0, 0.5, None, None), ("b", date(2024, 1, 1), "m", 1.0, 0.5, True, None), ("c", date(2024, 1, 1), P, None, None, None, None), ("d", date(2024, 1, 1), "m", None, 0.1, False, None)]
    df = spark.createDataFrame(rows, "entity string, month date, metric string, value double, confidence double, agreed boolean, evidence string")
    got = sorted((r["entity"], r["code"], r["severity"]) for r in anomalies.anomalies(df).collect())
    assert got == [("a", "low_confidence_no_agreement", "medium"), ("d", "low_confidence_no_agreement", "medium")]
    assert anomalies.anomalies(df.limit(0)).collect() == []
