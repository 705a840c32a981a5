import math
import os
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.llm import ppm

ORDER = 3


def brute(rows, order):
    low = lambda t: bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    contexts, words, n_docs, n = defaultdict(Counter), Counter(), 0, 0
    for i, t in rows:
        if not held(i):
            b = bytes([254]) * order + low(t) + bytes([255])
            for q in range(order, len(b)):
                for j in range(order + 1):
                    contexts[b[q - j : q]][b[q]] += 1
            w = re.findall(rb"[^\x20\x09-\x0D]+", low(t))
            words.update(w)
            n_docs, n = n_docs + 1, n + len(w) + 1

    def log_p(context, s):
        out, total = set(), 0.0
        for j in range(order, -1, -1):
            c = contexts.get(context[order - j :])
            if not c:
                continue
            live = {a: k for a, k in c.items() if a not in out}
            n_, u = sum(live.values()), len(live)
            if s in live:
                return total + math.log10((2 * live[s] - 1) / (2 * n_))
            total += math.log10(u / (2 * n_)) if u else 0
            out |= set(c)
        return total - math.log10(256 - len(out))

    v = len(words) + (n_docs > 0)
    base = lambda c: math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    result = {}
    for i, t in rows:
        b, w = bytes([254]) * order + low(t) + bytes([255]), re.findall(rb"[^\x20\x09-\x0D]+", low(t))
        score = sum(log_p(b[q - order : q], b[q]) for q in range(order, len(b)))
        result[i] = (held(i), len(w) + 1, sum(words[x] > 0 for x in w) + (n_docs > 0), n, sum(base(words[x]) for x in w) + base(n_docs), score)
    return result


@pytest.mark.parametrize(("block", "share"), [(1 << 20, 1 << 20), (10_000, 20_000)])
def test_brute_force(docs, rows, block, share):
    got = {r["doc_id"]: tuple(r)[1:] for r in ppm.lm_scores(docs, order=ORDER, block=block, share=share).collect()}
    want = brute(rows, ORDER)
    assert got.keys() == want.keys()
    for i, w in want.items():
        assert got[i][:4] == w[:4] and got[i][4:] == pytest.approx(w[4:], abs=1e-6), i


def test_probabilities_add_up():
    """Over all bytes, in a context that training has and in one that it hasn't."""
    import numpy as np

    text = b"abracadabra abracad"
    grams, _ = ppm.grams(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 3)
    seen, counts = ppm.add_up(grams, np.ones(len(grams), np.int64))
    triples = ppm.add_up(seen & np.uint64(0xFFFFFF), counts)
    for context in (b"bra", b"zbr", b"zzr", b"zzz"):
        c = int.from_bytes(context, "big") << 8
        keys = np.array([c | s for s in range(256)], np.uint64)
        all_, n = ppm.add_up(np.concatenate([seen, keys]), np.concatenate([counts, np.zeros(256, np.int64)]))
        p = 10 ** ppm.log_probabilities(all_, n, triples, 3)
        assert p[np.isin(all_, keys)].sum() == pytest.approx(1.0)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables here")
def test_held_out_beats_base(spark):
    """On held-out documents of a corpus of some size the model gives more probability than words do."""
    out = ppm.lm_scores(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).filter("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert out["sum(score)"] > out["sum(base_score)"]


def test_empty(spark, none):
    assert ppm.lm_scores(none).count() == 0
    alone = ppm.lm_scores(spark.createDataFrame([(None, None), (None, "A")], "doc_id long, text string")).collect()
    assert {r["n_tokens"] for r in alone} == {1, 2}


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), unique=True))
def test_squeezed(keys):
    import numpy as np

    keys = np.sort(np.array(keys, np.uint64))
    assert (ppm.spread(ppm.squeezed(keys)) == keys).all()
