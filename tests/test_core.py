import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyframe.operators import core


def test_latest(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", None, "w")], "k string, at int, v string")
    got = {r["k"]: r["v"] for r in core.latest_per_key(rows, ["k"], "at", ["v"]).collect()}
    assert got == {"a": "z", "b": "w"}


def test_mutual_best_leaves_second_choices_alone(spark):
    pairs = spark.createDataFrame([("a", "x", 0), ("b", "x", 1), ("b", "y", 2), ("c", "y", 1)], "l string, r string, d int")
    got = {(r["l"], r["r"]) for r in core.mutual_best(pairs, "l", "r", [F.col("d")]).collect()}
    assert got == {("a", "x"), ("c", "y")}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(-40, 40)), max_size=12), st.lists(st.tuples(st.integers(0, 2), st.integers(-40, 40)), max_size=12), st.integers(0, 6))
def test_band_pairs(spark, left, right, days):
    day = lambda n: dt.date(1970, 1, 10) + dt.timedelta(n)
    a = spark.createDataFrame([(i, k, day(n)) for i, (k, n) in enumerate(left)], "i int, k int, d date")
    b = spark.createDataFrame([(i, k, day(n)) for i, (k, n) in enumerate(right)], "j int, q int, e date")
    got = sorted((r["i"], r["j"], r["day_gap"]) for r in core.band_pairs(a, b, [("k", "q")], "d", "e", days).collect())
    want = sorted((i, j, abs(n - m)) for i, (k, n) in enumerate(left) for j, (q, m) in enumerate(right) if k == q and abs(n - m) <= days)
    assert got == want


def test_tree(spark):
    nodes = spark.createDataFrame([("r", "Food", None), ("a", "Out", "r"), ("b", "Bars", "a"), ("s", "Home", None)], "id string, name string, parent_id string")
    assert {(r["id"], r["path"], r["depth"]) for r in core.tree_paths(nodes).collect()} == {("r", "Food", 0), ("a", "Food/Out", 1), ("b", "Food/Out/Bars", 2), ("s", "Home", 0)}
    assert {tuple(r) for r in core.tree_closure(nodes).collect()} == {("r", "r"), ("a", "a"), ("b", "b"), ("s", "s"), ("a", "r"), ("b", "a"), ("b", "r")}


def test_cycle(spark):
    nodes = spark.createDataFrame([("a", "A", "b"), ("b", "B", "a")], "id string, name string, parent_id string")
    with pytest.raises(ValueError, match="cycle"):
        core.tree_closure(nodes)


def test_allocation_is_exact(spark):
    rows = [("t", "1", 18564, 372), ("t", "2", 18564, 172), ("z", "1", 100, 0), ("z", "2", 100, 0), ("z", "3", 100, 0)]
    got = core.allocate_exact(spark.createDataFrame(rows, "t string, i string, charge long, item long"), "t", "i", "charge", "item").collect()
    share = {(r["t"], r["i"]): r["share_cents"] for r in got}
    assert share[("t", "1")] == 12695 and sum(v for (t, _), v in share.items() if t == "t") == 18564
    assert [share[("z", x)] for x in "123"] == [33, 33, 34]


def test_recurring(spark):
    day = dt.date(2024, 1, 5)
    tx = [(f"n{i}", "NETFLIX", "outflow", "-15.49", day + dt.timedelta(30 * i)) for i in range(6)] + [(f"x{i}", "RANDOM", "outflow", "-5.00", day + dt.timedelta(i * i * 9)) for i in range(5)]
    rows = spark.createDataFrame(tx, "transaction_id string, merchant_name string, flow string, amount string, posted_on date").withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    got = core.recurring(rows, {"monthly": (25, 35)}, 0.25).collect()
    assert [(r["merchant_name"], r["cadence"], r["occurrence_count"], str(r["amount"])) for r in got] == [("NETFLIX", "monthly", 6, "15.49")]


def test_nearest(spark):
    ref = spark.createDataFrame([("near", "c1", [0.99, 0.01, 0.0]), ("far", "c2", [0.0, 1.0, 0.0])], "ref_name string, category_id string, ref_vector array<double>")
    names = spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("b", [0.0, 0.0, 1.0])], "name string, v array<double>")
    got = core.nearest_by_cosine(names, ref, "name", "v", 0.8).collect()
    assert [(r["name"], r["ref_name"], r["category_id"]) for r in got] == [("a", "near", "c1")]


def test_anomaly(spark):
    rows = [("s", dt.date(2024, m, 1), 100.0 + m) for m in range(1, 12)] + [("s", dt.date(2024, 12, 1), 900.0)]
    got = core.mad_anomalies(spark.createDataFrame(rows, "s string, month date, v double"), ["s"], "month", "v", 3.5, 50.0, 3, 6).collect()
    assert [r["month"] for r in got] == [dt.date(2024, 12, 1)]
