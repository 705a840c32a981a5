"""Steps whose work must not grow faster than their input."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from tallyframe.operators import core, patterns, vectors
from tallyframe.plans import silver

DAY = dt.date(2024, 1, 1)


def test_equal_rows_make_no_pairs_of_all_with_all(spark, monkeypatch):
    """Matches are those of all pairs, of which as many are made as there are kinds of rows."""
    rnd = random.Random(4)
    rows = [(f"t{k:03}", rnd.choice("AB"), "USD", DAY + dt.timedelta(rnd.randrange(3)), str(rnd.choice([-5, 5])), rnd.choice(["to A", None])) for k in range(120)]
    stg = spark.createDataFrame(rows, "transaction_id string, account_name string, currency string, posted_on date, amount string, description_raw string").withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    made = []
    plain = silver.band_pairs
    monkeypatch.setattr(silver, "band_pairs", lambda *a, **k: made.append(plain(*a, **k)) or made[-1])
    got = {(r["outflow_id"], r["inflow_id"]) for r in silver.transfers(stg).collect()}
    assert made[0].count() <= 12 * 12
    monkeypatch.setattr(silver, "first_alike", lambda df, key, alike: df)
    want = {(r["outflow_id"], r["inflow_id"]) for r in silver.transfers(stg).collect()}
    assert got == want and want and made[1].count() > 12 * 12


def test_order_matches_are_those_of_all_pairs(spark, monkeypatch):
    rnd = random.Random(5)
    shipped = spark.createDataFrame([(f"o{k}", DAY + dt.timedelta(rnd.randrange(20)), rnd.choice(["1", "2"])) for k in range(60)], "website_order_id string, ship_date date, total_owed string").withColumn("total_owed", F.col("total_owed").cast("decimal(18,2)"))
    tx = spark.createDataFrame([(f"t{k}", DAY + dt.timedelta(rnd.randrange(20)), "A", rnd.choice(["-1", "-2"])) for k in range(60)], "transaction_id string, posted_on date, account_name string, amount string").withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    found = lambda: {(r["website_order_id"], r["transaction_id"]) for r in silver.order_matches(shipped, tx).collect()}
    got = found()
    monkeypatch.setattr(silver, "first_alike", lambda df, key, alike: df)
    assert got == found() and got


def test_nearest_before_is_the_best_of_all_pairs(spark, monkeypatch):
    """Each pair of blocks gives a vector one row at most, and the best are those of all pairs."""
    monkeypatch.setattr(vectors, "ROWS", 7)
    monkeypatch.setattr(vectors, "PRODUCT", 30)
    rng = np.random.default_rng(3)
    rows = [(f"n{k:02}", rng.normal(size=4).tolist(), int(rng.integers(3))) for k in range(60)]
    rows += [("same1", rows[0][1], 1), ("same2", rows[0][1], 1), ("zero", [0.0] * 4, 1), ("null", None, 9)]
    df = spark.createDataFrame(rows, "name string, v array<double>, n long").repartition(3)
    unit = {k: (np.array(v) / np.linalg.norm(v), n) for k, v, n in rows if v is not None and any(v)}
    for weight in (None, "n"):
        before = lambda a, b: (-unit[a][1], a) < (-unit[b][1], b) if weight else a < b  # noqa: E731, B023
        want = {}
        for b in unit:
            best = min(((-round(float(unit[a][0] @ unit[b][0]), 12), a) for a in unit if a != b and before(a, b)), default=(9, ""))
            if best[0] <= -0.3:
                want[b] = best[1]
        got = vectors.nearest_before(df, "name", "v", 0.3, weight).collect()
        assert {r["b"]: r["a"] for r in got} == want and len(got) == len(want)


def test_large_tables_are_dealt_to_more_tasks(spark):
    assert core.dealt(spark.range(1000), ["id"], 100).rdd.getNumPartitions() == 10
    few = spark.range(300)
    assert core.dealt(few, ["id"], 100) is few


def test_long_literals_meet_few_texts(spark):
    """Numbered names share their short runs with a part of all others; patterns meet those texts that have long runs of theirs."""
    names = [f"Customer#{k:09}" for k in range(400)]
    rules = spark.createDataFrame([(f"r{n}", n + r"\b") for n in names], "id string, pattern string")
    found = patterns.matches(spark.createDataFrame([(f"PAYPAL *{n} X",) for n in names], "text string"), rules)
    assert {(r["text"], r["pattern"]) for r in found.collect()} == {(f"PAYPAL *{n} X", n + r"\b") for n in names}
    assert all(len(x["gram"]) == 12 for x in patterns._indexed(rules.select("pattern")).collect())


def test_pattern_tables_are_not_broadcast_by_estimate(spark, monkeypatch, tmp_path):
    """What texts' keys explode to is far larger than Spark's estimate, that of the texts; no step may broadcast it."""
    names = [f"Customer#{k:09}" for k in range(200)]
    spark.createDataFrame([(n,) for n in names], "name string").write.parquet(str(tmp_path / "names"))
    name = spark.read.parquet(str(tmp_path / "names"))
    rules = name.select(F.concat("name", F.lit(r"\b")).alias("pattern"))
    plans, plain = [], patterns.held
    monkeypatch.setattr(patterns, "held", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df))
    found = patterns.matches(name.select(F.concat(F.lit("PAYPAL *"), "name", F.lit(" X")).alias("text")), rules)
    assert found.count() == len(names)
    assert len(plans) > 2 and not any("Broadcast" in p for p in [*plans, found._jdf.queryExecution().executedPlan().toString()])


def test_what_is_not_small_is_not_broadcast(spark):
    """An explosion counts as large as what it explodes; its rows are counted, and beyond the bound the join is shuffled."""
    many = spark.range(3).select(F.explode(F.sequence(F.lit(1), F.lit(50))).alias("k"))
    joined = lambda most: spark.range(10).toDF("k").join(core.small(many, most), "k")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in joined(1000) and "SortMergeJoin" in joined(100)


def test_nearest_other_is_the_best_of_all_others(spark, monkeypatch):
    """As brute force, ties to the first name; each pair of blocks gives a vector one row at most, and equal vectors don't meet one by one."""
    monkeypatch.setattr(vectors, "PRODUCT", 40)
    rng = np.random.default_rng(8)
    rows = [(f"n{k:02}", rng.normal(size=4).tolist()) for k in range(50)] + [(f"same{k:02}", rng.normal(size=4).tolist() if not k else None) for k in range(30)]
    rows = [(k, rows[50][1] if k.startswith("same") else v) for k, v in rows] + [("n03", rows[5][1]), ("zero", [0.0] * 4), ("null", None), (None, rows[0][1])]
    unit = [(k, np.array(v) / np.linalg.norm(v)) for k, v in rows if k is not None and v is not None and any(v)]
    want = {}
    for k, (b, x) in enumerate(unit):
        best = min(((-round(float(x @ y), 12), a) for a, y in unit if a != b), default=(9, ""))
        if best[0] <= -0.3:
            want[b] = min(want.get(b, best), best)
    df = spark.createDataFrame(rows, "name string, v array<double>").repartition(3)
    for rows_a_block in (7, 2048):
        monkeypatch.setattr(vectors, "ROWS", rows_a_block)
        got = vectors.nearest_other(df, "name", "v", 0.3).collect()
        assert {r["b"]: r["a"] for r in got} == {b: a for b, (_, a) in want.items()} and len(got) == len(want)
    place = np.arange(30)
    assert vectors._first_of_equal(np.ones((30, 4)), place, place).sum() == 2
    assert vectors._first_of_equal(np.eye(30), place, place).all()
