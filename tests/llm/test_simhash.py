import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tallyframe.llm import simhash

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(points, distance=4):
    """Least key reachable of each of {key: fingerprint}."""
    top = {k: k for k in points}

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    keys = sorted(points)
    for n, i in enumerate(keys):
        for j in keys[n + 1 :]:
            if (points[i] ^ points[j]).bit_count() <= distance:
                a, b = root(i), root(j)
                top[max(a, b)] = min(a, b)
    return {k: root(k) for k in keys}


def family(n=300, seed=3):
    """Fingerprints around three centres, within 6 bits of these, and some anywhere."""
    rnd = random.Random(seed)
    centres = [rnd.getrandbits(64) for _ in range(3)]
    out = [rnd.getrandbits(64) for _ in range(60)]
    for k in range(n):
        bits = rnd.sample(range(64), rnd.randrange(7))
        out.append(centres[k % 3] ^ sum(1 << b for b in bits))
    return sorted(set(out))


def signed(spark, points):
    return spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in points], "fp long").repartition(3)


def test_brute_force(docs, rows):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_classes(docs).collect()}
    prints = {i: plain_fingerprint(t) for i, t in rows}
    linked = classes(prints)
    assert got == {i: (f"{prints[i]:016x}", linked[i]) for i in prints}
    assert prints[900] == prints[901] == prints[902] == 0 and got[902][1] == 900


@pytest.mark.parametrize("distance", [0, 2, 4, 6])
@pytest.mark.parametrize("most", [2, 40, 1 << 14])
def test_links_connect_what_brute_force_connects(spark, distance, most):
    """Whatever the size from which cells are left to exact neighbours."""
    points = family(60 if distance == 6 and most < 1000 else 300)
    if distance == 6 and most == 2:
        return  # 43,745 neighbours a fingerprint
    found = simhash.near_links(signed(spark, points), distance, most).collect()
    number = {p: k for k, p in enumerate(points)}
    top = list(range(len(points)))

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    for r in found:
        u, v = r["u"] % (1 << 64), r["v"] % (1 << 64)
        assert (u ^ v).bit_count() <= distance
        a, b = root(number[u]), root(number[v])
        top[max(a, b)] = min(a, b)
    expected = classes(dict(enumerate(points)), distance)
    assert {k: root(k) for k in range(len(points))} == expected


def test_links_are_a_forest_in_each_cell(spark):
    """Hundreds of fingerprints that all link give no square of pairs."""
    points = family(3000, 4)
    dense = np.array(points, np.uint64)
    u, _ = simhash.forest(dense, 16)
    assert len(u) < len(points)
    assert simhash.near_links(signed(spark, points)).count() < 60 * len(points)


def test_fingerprints_are_sparks_hashes(spark):
    """A text of one shingle has the hash that Spark's own function gives."""
    text = "ünder one Four words"
    row = spark.createDataFrame([(1, text)], "doc_id long, text string").select(F.xxhash64(F.lower("text")).alias("h"))
    assert simhash.fingerprint(text.encode()) == row.first()["h"] % (1 << 64)


def test_odd_rows(spark, docs, none):
    odd = spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (None, "z y x"), (None, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in simhash.simhash_classes(odd).collect())
    assert got == [(-1, -1), (-1, -1), (-1, 7), (7, 7), (7, 7)]
    assert simhash.simhash_classes(none).count() == 0
    long = spark.createDataFrame([(1, "word " * 200_000 + "end"), (2, "WORD\n" * 200_000 + "end")], "doc_id long, text string")
    assert {r["component_id"] for r in simhash.simhash_classes(long).collect()} == {1}
