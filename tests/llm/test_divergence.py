import random
import re
import string
from collections import Counter, defaultdict

import pytest

from tallyframe.llm import divergence as dv

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, least=10, top=10):
    """Rows of (lang, source, text), every term of every pair, with Python's integers."""
    docs = [(a or "", s or "", TERM.findall((t or "").translate(LOW))) for a, s, t in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(w for _, _, ws in own for w in set(ws))
        kept = {w for w, n in df.items() if n >= least}
        counts = defaultdict(Counter)
        for _, source, ws in own:
            counts[source].update(w for w in ws if w in kept)
        all_ = sum(counts.values(), Counter())

        def p(c, kept=kept):
            total = sum(c.values())
            return {w: 1 + 10**9 * (c[w] + 2) // (total + 2 * len(kept)) for w in kept}

        q, ps = p(all_), {s: p(c) for s, c in counts.items()}
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in counts:
            pairs = [(sum(f(ps[s][w], ps[o][w]) for w in kept), o) for o in counts if o != s]
            terms = [(f(ps[s][w], q[w]), w) for w in kept if counts[s][w] and ps[s][w] > q[w]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])}
    return out


def rows_of(df):
    found = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(found) == len(set(found))
    return set(found)


def corpus(sources=40, n=700, seed=2):
    """Common words, words that few sources have, cases, digits, letters of several bytes, nulls, a source without terms."""
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        s = min(rnd.randrange(sources), rnd.randrange(sources))
        words = [f"Wort{chr(97 + rnd.randrange(20))}" for _ in range(rnd.randrange(30))]
        words += [f"éü{chr(0x4E00 + s // 2)}x" for _ in range(rnd.randrange(3))] + [f"von{chr(97 + s % 26)}{chr(97 + rnd.randrange(2))}" for _ in range(rnd.randrange(4))]
        out.append((rnd.choice(["en", "EN", None, ""]), f"src{s}" if s else None, "1,2".join(words) if rnd.random() < 0.9 else None))
    return [*out, ("xx", "alone", "a a a"), ("yy", "a", ""), ("yy", "b", None), ("en", "nothing", "123 . 4"), ("en", "long", "worta " * 60_000)]


@pytest.mark.parametrize("heavy", [0.0, 0.1, 1.0])
def test_brute_force(spark, heavy):
    rows = corpus()
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)
    assert rows_of(dv.divergence(df, heavy=heavy)) == plain(rows)


def test_blocks_of_groups_and_terms(spark, monkeypatch):
    """Many blocks: pairs between them, and terms that one of them lacks."""
    monkeypatch.setattr(dv, "GROUPS", 4)
    monkeypatch.setattr(dv, "TERMS", 5)
    rows = [r for r in corpus(25, 400, 7) if r[1] != "long"]
    tile = dv._dense
    monkeypatch.setattr(dv, "_dense", lambda pdf: tile(pdf, 4))  # in a worker GROUPS is what it was
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)
    assert rows_of(dv.divergence(df, least_documents=3, top=4)) == plain(rows, 3, 4)


def test_odd_tables(spark, docs, none):
    assert dv.divergence(none).count() == 0
    plain_rows = [(r["lang"], r["source"], r["text"]) for r in docs.collect()]
    assert rows_of(dv.divergence(docs)) == plain(plain_rows)
    assert dv.divergence(spark.createDataFrame([("en", "s", "a")], "lang string, source string, text string")).count() == 0


def test_large_counts(spark):
    """p of counts whose product with 10^9 is over 64 bits."""
    row = spark.range(1).selectExpr("9000000000000 as n", "9000000000007 as own", "3L as v")
    assert row.select(dv._p("n", "own", "v").cast("long").alias("p")).first()["p"] == 1 + 10**9 * (9 * 10**12 + 2) // (9 * 10**12 + 13)
