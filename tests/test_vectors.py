import numpy as np
import pytest

from tallyframe.operators import vectors as vc


def clusters(n=240, dims=8, seed=1):
    """Groups around centres, some vectors equal, some opposite, a zero, a null."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    rows = [(f"n{k:03}", (centres[k % 6] + rng.normal(scale=0.1 if k % 2 else 0.6, size=dims)).tolist()) for k in range(n)]
    rows += [(f"same{k}", rows[0][1]) for k in range(9)] + [("opposite", [-x for x in rows[0][1]]), ("zero", [0.0] * dims), ("null", None)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "name string, v array<double>").repartition(4)


def plain(rows):
    return {n: np.array(v) / np.linalg.norm(v) for n, v in rows if v is not None and any(v)}


@pytest.mark.parametrize("threshold", [0.95, 0.5, -0.2])
@pytest.mark.parametrize("rows_a_block", [5, 2048])
def test_pairs_are_all_pairs(spark, monkeypatch, threshold, rows_a_block):
    monkeypatch.setattr(vc, "ROWS", rows_a_block)
    rows = clusters()
    unit = plain(rows)
    want = {(a, b) for a, x in unit.items() for b, y in unit.items() if a < b and float(x @ y) >= threshold}
    got = vc.cosine_pairs(frame(spark, rows), "name", "v", threshold).collect()
    assert len(got) == len(want) and {(r["a"], r["b"]) for r in got} == want
    assert all(abs(r["similarity"] - float(unit[r["a"]] @ unit[r["b"]])) < 1e-12 for r in got)


def test_copies_are_bounded_and_pruned(spark, monkeypatch):
    """A vector goes to BLOCKS blocks at most, and to few where the threshold is high."""
    monkeypatch.setattr(vc, "ROWS", 5)
    monkeypatch.setattr(vc, "BLOCKS", 16)
    unit = vc.units(frame(spark, clusters(600)), "name", "v")
    side = vc.Side(unit, vc.pivots_of(unit), 600)
    n = side.rows.count()
    copies = {}
    for threshold in (-1.0, 0.98):
        routed = vc._routed(side, side, vc._angle(threshold), True, True).union(vc._routed(side, side, vc._angle(threshold), False, True))
        copies[threshold] = routed.count()
        assert routed.groupBy("key").count().agg({"count": "max"}).first()[0] <= 16
    assert copies[-1.0] == 16 * n and copies[0.98] < 8 * n


@pytest.mark.parametrize("rows_a_block", [7, 2048])
def test_nearest(spark, monkeypatch, rows_a_block):
    monkeypatch.setattr(vc, "ROWS", rows_a_block)
    rows = clusters()
    unit = plain(rows)
    df = frame(spark, rows)
    got = {r["name"]: (r["ref"], r["similarity"]) for r in vc.nearest(df, df.toDF("ref", "w"), "name", "v", "ref", "w", 0.9, others_only=True).collect()}
    want = {}
    for a, x in unit.items():
        best = min(((-round(float(x @ y), 12), b) for b, y in unit.items() if b != a), default=None)
        if -best[0] >= 0.9:
            want[a] = best[1]
    assert {a: b for a, (b, _) in got.items()} == want
    assert got["n000"][0] == "same0" and got["same5"][0] == "n000"  # ties go to the first name


def test_odd_vectors(spark):
    none = spark.createDataFrame([], "name string, v array<double>")
    some = frame(spark, [("a", [1.0, 0.0]), ("b", [1.0, 0.0])])
    assert vc.cosine_pairs(none, "name", "v", 0.5).count() == 0
    assert vc.nearest(none, some.toDF("ref", "w"), "name", "v", "ref", "w", 0.5).count() == 0
    assert vc.nearest(some, none.toDF("ref", "w"), "name", "v", "ref", "w", 0.5).count() == 0
    assert [tuple(r) for r in vc.cosine_pairs(some, "name", "v", 1.0).collect()] == [("a", "b", 1.0)]
    with pytest.raises(ValueError, match="unequal"):
        vc.cosine_pairs(frame(spark, [("a", [1.0]), ("b", [1.0, 2.0])]), "name", "v", 0.5)
    numbers = spark.createDataFrame([(3, [1.0, 0.1]), (1, [1.0, 0.0])], "id long, v array<float>")
    assert [(r["a"], r["b"]) for r in vc.cosine_pairs(numbers, "id", "v", 0.9).collect()] == [(1, 3)]
