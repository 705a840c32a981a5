import re
import string

import pytest
from pyspark.sql import functions as F

from tallyframe.llm import jaccard

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def sets(rows, words=3):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        out[i] = frozenset(zip(*(w[k:] for k in range(words)))) if len(w) >= words else frozenset([tuple(w)] if w else [])
    return out


def brute(rows, similarity=(90, 100), words=3):
    found = sets(rows, words)
    parent = {i: i for i in found}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(found)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = found[i], found[j]
            n = len(a & b)
            if a and b and similarity[1] * n >= similarity[0] * len(a | b):
                x, y = top(i), top(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(found[i]), top(i)) for i in ids}


def got(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def edited(n=70):
    """Near copies in chains and stars around texts of many sizes, small ones included."""
    import random

    rnd = random.Random(5)
    rows = []
    for size in (1, 2, 3, 11, 12, 13, 20, 21, 22, 23, 24, 40, 120, 200):
        base = [f"t{rnd.randrange(10**6)}" for _ in range(size)]
        for _ in range(n // 10):
            text = list(base)
            for _ in range(rnd.randrange(0, 1 + max(1, size // 40))):
                text[rnd.randrange(len(text))] = f"e{rnd.randrange(10**6)}"
            rows.append((len(rows), " ".join(text + [f"z{rnd.randrange(3)}"] * rnd.randrange(2))))
    return rows


def test_brute_force(docs, rows):
    assert got(jaccard.jaccard_classes(docs)) == brute(rows)


@pytest.mark.parametrize("light_below", [None, 1, 12])
def test_sizes(spark, light_below):
    """Whatever the boundary of light and heavy sets, links are the same."""
    rows = edited()
    want = brute(rows)
    assert len({c for _, c in want.values()}) < len(rows) * 0.8
    assert got(jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), light_below=light_below)) == want


def test_family_that_a_pivot_leaves_apart(spark):
    """Copies that are each too far from the original, some of them near one another."""
    import random

    rnd = random.Random(2)
    base = [f"t{k}" for k in range(300)]
    rows = [(0, " ".join(base))]
    for g in range(6):
        far = list(base)
        for at in rnd.sample(range(300), 11):
            far[at] = f"g{g}-{at}"
        for k in range(3):
            own = list(far)
            own[rnd.randrange(300)] = f"k{g}-{k}"
            rows.append((len(rows), " ".join(own)))
    want = brute(rows)
    assert len({c for _, c in want.values()}) > 3
    assert got(jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"))) == want


def test_passage_with_own_parts(spark):
    """A passage with own parts of many lengths: a pivot's own part is a difference of all others; some link, some only in pairs."""
    import random

    rnd = random.Random(7)
    passage = [f"t{k}" for k in range(200)]
    rows = []
    for k in range(60):
        own = [f"o{k // 2 if k % 5 == 0 else k}-{j}" for j in range(rnd.randrange(0, 60))]
        text = passage[rnd.randrange(8) :] + own
        rows.append((len(rows), " ".join(text)))
        if k % 4 == 0:
            text = list(text)
            text[rnd.randrange(len(text))] = "x"
            rows.append((len(rows), " ".join(text)))
    want = brute(rows)
    assert 10 < len({c for _, c in want.values()}) < len(rows) - 10
    assert got(jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"))) == want


def test_boundary_follows_cost():
    assert jaccard.Scheme().heavy == 20 and jaccard.Scheme((80, 100)).heavy < 20


def test_empty_and_repeated(spark, none):
    assert jaccard.jaccard_classes(none).count() == 0
    twice = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "A b C d"), (3, None)], "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard.jaccard_classes(twice).collect()) == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3)]


def test_ids_that_repeat(spark):
    """A doc_id with two texts, and rows without one: each row has the class of its own text."""
    base = [f"t{k}" for k in range(60)]
    rows = [(1, " ".join(base)), (1, "other words here"), (2, " ".join(base + ["x"])), (None, " ".join(base + ["y"])), (None, "alone in this class"), (4, "other words here")]
    got = [(r["doc_id"], r["component_id"]) for r in jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=repr) == sorted([(1, 1), (1, 1), (2, 1), (None, 1), (None, None), (4, 1)], key=repr)
    carried = jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").withColumn("class", F.lit("mine")), carry=("class",))
    assert carried.columns == ["doc_id", "n_shingles", "component_id", "class", "class"]


def test_large_family(spark):
    """Two thousand copies with up to thirty edits each: links are those of brute force, and pairs that are made grow with links."""
    import random

    import numpy as np

    rnd = random.Random(11)
    base = [f"t{k}" for k in range(150)]
    rows = []
    for k in range(2000):
        text = list(base)
        for at in rnd.sample(range(150), rnd.randrange(31)):
            text[at] = f"e{rnd.randrange(40)}"
        rows.append((k, " ".join(text)))
    found = list(sets(rows).values())
    place = {e: n for n, e in enumerate(sorted(set().union(*found)))}
    x = np.zeros((len(rows), len(place)), np.float32)
    for k, s in enumerate(found):
        x[k, [place[e] for e in s]] = 1
    common, size = x @ x.T, x.sum(axis=1)
    linked = 10 * common >= 9 * (size[:, None] + size - common)
    label, before = np.arange(len(rows)), None
    while before is None or (label != before).any():
        before, label = label, np.where(linked, label, len(rows)).min(axis=1)
    assert got(jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"))) == {k: (len(found[k]), label[k]) for k in range(len(rows))}


def test_sketches_rule_out_no_link():
    import numpy as np

    rnd = np.random.default_rng(3)
    for _ in range(200):
        a = rnd.integers(0, 1 << 62, rnd.integers(1, 3000)).astype(np.uint64)
        b = np.unique(np.r_[a[rnd.random(len(a)) < 0.95], rnd.integers(0, 1 << 62, rnd.integers(0, 40)).astype(np.uint64)])
        a = np.unique(a)
        bits = sum(int(x).bit_count() for x in (jaccard.sketch(a) ^ jaccard.sketch(b)).view(np.uint64))
        assert bits <= len(np.setxor1d(a, b))


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "u long, v long")
    assert {r["id"]: r["component"] for r in jaccard.components(chain).collect()} == {i: 0 for i in range(41)} | {100: 100, 101: 100}
