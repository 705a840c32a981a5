import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import ranks

def wanted():
    return {"first": F.lit(1), "q80": ranks.nearest_rank(0.8), "mid": F.floor((F.col("n") + 1) / 2), "last": F.col("n"), "none": F.col("n") + 1}


def check(df, rows, by):
    got = {tuple(r[b] for b in by): r for r in ranks.order_statistics(df, by, "v", wanted()).collect()}
    groups = {}
    for *key, v in rows:
        if v is not None and not math.isnan(v):
            groups.setdefault(tuple(key[: len(by)]), []).append(v)
    assert set(got) == set(groups)
    for key, values in groups.items():
        values.sort()
        n = len(values)
        assert (got[key]["n"], got[key]["first"], got[key]["q80"], got[key]["mid"], got[key]["last"], got[key]["none"]) == (n, values[0], values[math.ceil(0.8 * n) - 1], values[(n + 1) // 2 - 1], values[-1], None)


@pytest.mark.parametrize("limit", [3, 50, 100_000])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_like_sorting(spark, monkeypatch, limit, by):
    """Whatever the size up to which a group is sorted: ties, outliers, infinities, groups of one value, nulls in keys and values."""
    monkeypatch.setattr(ranks, "LIMIT", limit)
    monkeypatch.setattr(ranks, "GRID", 20)
    rnd = random.Random(limit)
    rows = [("a", rnd.gauss(0, 1)) for _ in range(400)] + [("b", float(rnd.randrange(4))) for _ in range(300)] + [("c", 7.0)] * 200 + [("d", rnd.choice([1, -1]) * 10.0 ** rnd.randrange(-300, 300)) for _ in range(300)]
    rows += [(None, 1.5), (None, 2.5), ("e", None), ("f", math.nan), ("f", math.inf), ("f", -math.inf), ("f", 0.0)]
    check(spark.createDataFrame(rows, "g string, v double").repartition(5), rows, by)


def test_sketch_that_is_off(spark, monkeypatch):
    """Counts are exact: a poor bracket costs rounds, not results."""
    monkeypatch.setattr(ranks, "LIMIT", 250)
    monkeypatch.setattr(ranks, "ACCURACY", 20)
    rows = [("a", float(k * k % 1009)) for k in range(600)]
    check(spark.createDataFrame(rows, "g string, v double").repartition(6), rows, ["g"])


def test_median_and_mad(spark):
    rows = [("a", float(v)) for v in (1, 2, 3, 4, 100)] + [("b", float(v)) for v in (5, 5, 7, 9)] + [(None, 3.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: (r["n"], r["median"], r["mad"]) for r in ranks.median_and_mad(df, ["g"], "v").collect()}
    assert got == {"a": (5, 3.0, 1.0), "b": (4, 6.0, 1.0), None: (1, 3.0, 0.0)}
    one = ranks.median_and_mad(df, [], "v").first()
    middle = statistics.median(v for _, v in rows)
    assert (one["median"], one["mad"]) == (middle, statistics.median(abs(v - middle) for _, v in rows))
    assert ranks.order_statistics(df.filter("false"), ["g"], "v", wanted()).count() == 0


def test_no_group_is_collected(spark):
    df = spark.range(1000).selectExpr("CAST(id AS DOUBLE) AS v")
    text = ranks.order_statistics(df, [], "v", {"mid": F.lit(500)})._jdf.queryExecution().toString().lower()
    assert "collect_list" not in text and "percentile(" not in text
