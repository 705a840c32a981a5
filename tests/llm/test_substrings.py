import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.llm import rlz, spans, suffix


def brute(rows, words):
    seen, units = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        u = re.findall(r"[^\x20\x09-\x0D]+", t or "") if words else (t or "").encode()
        units[i] = u
        for p in range(len(u) - 49):
            seen.setdefault(tuple(u[p : p + 50]) if words else u[p : p + 50], i)
    out = {}
    for i, u in units.items():
        gone, end = [False] * len(u), 0
        for p in range(len(u) - 49):
            if seen[tuple(u[p : p + 50]) if words else u[p : p + 50]] < i:
                gone[max(p, end) : p + 50] = [True] * (p + 50 - max(p, end))
                end = p + 50
        kept = [x for x, g in zip(u, gone) if not g]
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(u), sum(gone), runs, hashlib.sha256(" ".join(kept).encode() if words else bytes(kept)).hexdigest())
    return out


@pytest.mark.parametrize("words", [True, False])
def test_brute_force(docs, rows, words):
    got = {r[0]: tuple(r[1:]) for r in (rlz.substring_dedup(docs) if words else suffix.suffix_dedup(docs)).collect()}
    assert got == brute(rows, words)


def test_hot_minimizers(docs, rows, monkeypatch):
    monkeypatch.setattr(spans, "HOT", 2)
    assert {r[0]: tuple(r[1:]) for r in rlz.substring_dedup(docs).collect()} == brute(rows, True)
    assert {r[0]: tuple(r[1:]) for r in suffix.suffix_dedup(docs).collect()} == brute(rows, False)


@pytest.mark.parametrize("words", [True, False])
@pytest.mark.parametrize("parts", [1, 5])
def test_passage_of_one_chunk(spark, words, parts):
    """A passage that only documents of one chunk have, and one that those of all chunks have."""
    r = random.Random(2)
    text = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    passage, other = text(200), text(90)
    rows = [(i, " ".join([text(30 + i), passage if i in (1, 2) else text(40), text(20), other if i in (5, 6, 7) else "", text(60)])) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).repartition(parts, "doc_id")
    got = {r[0]: tuple(r[1:]) for r in (rlz.substring_dedup(docs) if words else suffix.suffix_dedup(docs)).collect()}
    assert got == brute(rows, words)


def test_shards_merge(docs, rows):
    """Shards so small that one minimizer's segments fill many."""
    assert {r[0]: tuple(r[1:]) for r in suffix.suffix_dedup(docs, shard=500).collect()} == brute(rows, False)


def test_blocks_continue(docs, rows):
    """Reference blocks so small that one minimizer's segments fill many."""
    assert {r[0]: tuple(r[1:]) for r in rlz.substring_dedup(docs, block=500).collect()} == brute(rows, True)


@pytest.mark.parametrize("words", [True, False])
def test_spans_are_at_their_sources(docs, rows, words):
    """Each span stands in a smaller document where it is said to."""
    units = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") if words else (t or "").encode() for i, t in rows}
    found = (rlz.factors(docs) if words else suffix.suffix_spans(docs)).collect()
    assert found
    for doc, a, b, source, at in found:
        assert source < doc and b - a >= 50 and units[doc][a:b] == units[source][at : at + b - a]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=40), min_size=1, max_size=8))
def test_parse(texts):
    """A window is hit where an earlier text has it, and its source is one."""
    windows = np.frombuffer("".join(texts).encode(), np.uint8).astype(np.uint64)
    n = np.array([len(x) for x in texts])
    doc, start = np.arange(len(texts)) // 2, np.arange(len(texts)) * 100
    source, place = rlz.parse(doc, start, n, windows)
    at = 0
    for k, x in enumerate(texts):
        for c in x:
            assert (source[at] >= 0) == any(c in y for y, d in zip(texts, doc) if d < doc[k])
            if source[at] >= 0:
                j = place[at] // 100
                assert doc[j] == source[at] < doc[k] and texts[j][place[at] % 100] == c
            at += 1


def test_shuffled_spans(docs, rows, monkeypatch):
    monkeypatch.setattr(spans, "BROADCAST", -1)
    assert {r[0]: tuple(r[1:]) for r in suffix.suffix_dedup(docs).collect()} == brute(rows, False)


@pytest.mark.parametrize("f", [rlz.substring_dedup, suffix.suffix_dedup])
def test_empty_and_odd_ids(spark, none, f):
    assert f(none).count() == 0
    twice = spark.createDataFrame([(1, "q " * 60), (1, "q " * 60), (1, "short"), (None, "q " * 60)], "doc_id long, text string")
    assert sorted(r["n_removed"] for r in f(twice).collect()) == [0, 0, 0, 0]


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=0, max_size=300) | st.text("ab", max_size=300).map(str.encode))
def test_suffix_array(raw):
    text = np.frombuffer(raw, np.uint8)
    order = suffix.suffix_array(text)
    assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    common = suffix.common_prefixes(text, order, 20) if len(raw) else []
    for k in range(1, len(raw)):
        a, b = raw[order[k - 1] :], raw[order[k] :]
        n = 0
        while n < min(len(a), len(b), 20) and a[n] == b[n]:
            n += 1
        assert common[k] == n
