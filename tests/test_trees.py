import random

import pytest

from tallyframe.operators import trees

SCHEMA = "id string, name string, parent_id string"


def plain(rows):
    parent, name = {r[0]: r[2] for r in rows}, {r[0]: r[1] for r in rows}
    paths, closure = {}, set()
    for k in parent:
        up, chain = k, []
        while up is not None and up in parent:
            chain.append(up)
            up = parent[up]
        closure |= {(k, a) for a in chain} | ({(k, up)} if up is not None else set())
        if up is None:
            paths[k] = ("/".join(name[a] for a in reversed(chain)), len(chain) - 1, name[chain[-1]])
    return paths, closure


def test_random_forest(spark):
    rnd = random.Random(4)
    rows = [(f"n{k}", f"N{k}", None if k % 13 == 0 else f"n{rnd.randrange(k)}") for k in range(120)] + [("lost", "L", "nowhere"), ("below", "B", "lost")]
    df = spark.createDataFrame(rows, SCHEMA)
    paths, closure = plain(rows)
    assert {r["id"]: (r["path"], r["depth"], r["root"]) for r in trees.tree_paths(df).collect()} == paths
    got = [tuple(r) for r in trees.tree_closure(df).collect()]
    assert len(got) == len(closure) and set(got) == closure


def test_rounds_grow_with_the_logarithm(spark, monkeypatch):
    """A chain of 101 nodes, 100 deep, takes seven rounds."""
    rows = [(f"n{k}", str(k), f"n{k - 1}" if k else None) for k in range(101)]
    df = spark.createDataFrame(rows, SCHEMA)
    real, rounds = trees.held, []
    monkeypatch.setattr(trees, "held", lambda x: rounds.append(1) or real(x))
    paths, closure = plain(rows)
    assert {r["id"]: (r["path"], r["depth"], r["root"]) for r in trees.tree_paths(df).collect()} == paths
    assert len(rounds) - 1 <= 7
    rounds.clear()
    assert {tuple(r) for r in trees.tree_closure(df).collect()} == closure
    assert len(rounds) - 1 <= 14  # two tables a round


def test_cycle(spark):
    rows = [("a", "A", "b"), ("b", "B", "c"), ("c", "C", "a"), ("r", "R", None), ("x", "X", "a")]
    df = spark.createDataFrame(rows, SCHEMA)
    with pytest.raises(ValueError, match="cycle"):
        trees.tree_closure(df)
    assert [r["id"] for r in trees.tree_paths(df).collect()] == ["r"]
    none = df.filter("false")
    assert trees.tree_closure(none).count() == 0 and trees.tree_paths(none).count() == 0
