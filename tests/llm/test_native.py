"""Exact dedup, quality rules, licence scans, mixing: DataFrame functions alone."""

import hashlib
import random
import re
import string
import uuid

import pytest
from pyspark.sql import functions as F

from tallyframe.llm import exact_dedup, licenses, mixing, quality


LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def test_no_python_in_plans(docs, spark):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for df in (exact_dedup.exact_dedup(docs), quality.quality_rules(docs, labels), licenses.license_scan(docs), mixing.mix(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan.replace("ArrowColumn", ""))


def test_exact(docs, rows):
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs).collect()}
    by = {}
    for i, t in rows:
        by.setdefault(t or "", []).append(i)
    for i, t in rows:
        group = by[t or ""]
        r = got[i]
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (max(group), len(group), i == max(group), hashlib.sha256((t or "").encode()).hexdigest())


def test_odd_rows(spark):
    """Repeated rows share a verdict; a null id is smaller than any other and stays if there is no other."""
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "b"), (None, "c"), (None, None), (2, "")]
    got = sorted((tuple(r)[:4] for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    want = [(1, 1, 2, True), (1, 1, 2, True), (1, 1, 2, True), (2, 2, 2, True), (None, 1, 2, False), (None, 2, 2, False), (None, None, 1, True)]
    assert got == sorted(want, key=repr)
    alone = exact_dedup.exact_dedup(spark.createDataFrame([(None, "a"), (None, "b")], "doc_id long, text string"))
    assert [r["kept"] for r in alone.collect()] == [True, True]


def test_index_persists(spark):
    index = f"index_{uuid.uuid4().hex}"
    day = lambda rows, batch=None: {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), index, batch).collect()}
    assert day([(1, "a"), (2, "a"), (3, "b")]) == {1: (2, False), 2: (2, True), 3: (3, True)}
    second = [(9, "a"), (8, "c"), (7, "c")]
    assert day(second, "second") == {9: (2, False), 8: (8, True), 7: (8, False)}
    assert spark.table(index).count() == 3
    # The same batch again, as after a failure behind the append: same verdicts, nothing new.
    assert day(second, "second") == {9: (2, False), 8: (8, True), 7: (8, False)}
    assert spark.table(index).count() == 3
    assert exact_dedup.exact_dedup(spark.createDataFrame([], "doc_id long, text string"), index).count() == 0


def test_anti_join_is_by_merge(spark):
    """New digests meet the index in a sort-merge anti-join that reads it bucket by bucket, without a shuffle or sort of its side."""
    index = exact_dedup.DigestIndex(spark, f"index_{uuid.uuid4().hex}", 5)
    index.append(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    groups = exact_dedup.heads(exact_dedup.digests(spark.createDataFrame([(2, "a"), (3, "b")], "doc_id long, text string")))
    fresh = groups.join(index.rows().select("digest").hint("merge"), "digest", "left_anti")
    assert [r["keep_id"] for r in fresh.collect()] == [3]
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert re.search("SortMergeJoin.*LeftAnti", plan) and f"{exact_dedup.LEAST} out of {exact_dedup.LEAST}" in plan


def measures(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    where = {}
    for i in range(len(w) - 7):
        where.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {j for places in where.values() if len(places) > 1 for i in places for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def test_measures(spark, rows):
    rnd = random.Random(4)
    more = [(2000 + i, "\n".join(rnd.choice(["a b c d e", "the cat # sat on the mat |", "", "ééé   x"]) for _ in range(rnd.randrange(30)))) for i in range(40)]
    all_ = rows + more
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r[0]: tuple(r[1:7]) for r in quality.quality_rules(spark.createDataFrame(all_, "doc_id long, text string"), labels).collect()}
    assert got == {i: measures(t) for i, t in all_}


def test_ratio_tells_junk(spark):
    rnd = random.Random(6)
    good = [f"word{k}" for k in range(300)]
    prose = lambda: " ".join(rnd.choice(good) for _ in range(100))
    junk = lambda: " ".join(f"{rnd.choice(good)}{rnd.choice('!#$')}{rnd.randrange(99)}" for _ in range(100))
    rows = [(i, prose() if i % 4 else junk()) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(100)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string"), labels, buckets=1 << 11).collect()}
    kept = {i for i, k in got.items() if k}
    assert kept >= {i for i, _ in rows if i % 4} and len(kept) <= 150 + 3  # of 50 pieces of junk, half of them without labels


def test_ratio_brute_force(spark, rows):
    """llr and kept of every document, in plain Python with the same hashes."""
    import math

    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    word = lambda w: signed(xxhash.xxh64_intdigest(w.encode(), 42))
    long = lambda x, seed: xxhash.xxh64_intdigest((x & (1 << 64) - 1).to_bytes(8, "little"), seed)
    buckets, trusted = 1 << 9, {i for i, _ in rows if i % 3 == 0} - {0}

    def hashes(text):
        h1 = [word(w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        return h1 + [signed(long(b, long(a, 42))) for a, b in zip(h1, h1[1:])]

    raw, target = [0] * buckets, [0] * buckets
    for i, t in rows:
        for h in hashes(t):
            raw[h % buckets] += 1
            target[h % buckets] += i in trusted
    n, m, ratio = sum(raw), sum(target), [0.0] * buckets
    for b in range(buckets):
        if raw[b]:
            share = (raw[b] + 0.5) / (n + 0.5 * buckets)
            ratio[b] = math.log((m * (target[b] + 20.0 * share) / (m + 20.0) + buckets * share) / (m + buckets) / share)
    labels = spark.createDataFrame([(i, 1, 0) for i in trusted] + [(1, 0, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string"), labels, threshold=0.0, buckets=buckets).collect()}
    for i, t in rows:
        h = hashes(t)
        llr = sum(ratio[x % buckets] for x in h) / len(h) if h else 0.0
        assert got[i]["llr"] == pytest.approx(llr, abs=1e-9) and (abs(llr) < 1e-9 or got[i]["kept"] == (not measures(t)[5] and llr >= 0.0)), i


def test_carry(docs, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality.quality_rules(docs, labels, carry=True).select("row.*")
    assert out.columns == docs.columns and out.exceptAll(docs).count() == 0 and out.count() == docs.count()


def unit_sets(text):
    """Distinct bigrams of each unit of a text."""
    for unit in {*(text or "").split("\n"), *re.split(r"[.!?]+[ \t\r]+|\n", text or ""), *re.split(r"\n[ \t\r]*\n", text or ""), text or ""}:
        w = re.findall("[a-z0-9]+", unit.lower())
        yield set(map(" ".join, zip(w, w[1:])))


def window_sets(text):
    """(template, distinct bigrams) of each window around a template's phrase."""
    w = re.findall("[a-z0-9]+", (text or "").translate(LOW))
    for phrase, name, before, n in licenses.phrases(licenses.TEMPLATES):
        for i in range(len(w) - 2):
            if " ".join(w[i : i + 3]) == phrase:
                own = w[max(0, i - before) : max(0, i - before) + n]
                yield name, set(map(" ".join, zip(own, own[1:])))


def best_license(texts):
    grams, found = licenses.template_bigrams(licenses.TEMPLATES), {}
    pairs = [(name, g) for t in texts for g in unit_sets(t) if g for name in grams] + [x for t in texts for x in window_sets(t)]
    for name, g in pairs:
        common = len(g & set(grams[name]))
        found[name] = max(found.get(name, (0.0, 0)), (2 * common / (len(g) + len(grams[name])), common))
    found = {k: v for k, v in found.items() if v[0] >= licenses.DICE}
    name = min(found, key=lambda k: (-found[k][1], -found[k][0], k)) if found else None
    return name and name.split("/")[0], round(found[name][0], 6) if name else None, len({k.split("/")[0] for k in found})


def test_licenses(spark, none):
    t = licenses.TEMPLATES
    texts = {
        1: "Some prose.\nReleased under the MIT License.\nMore prose.", 2: "licensed under the apache license version 2.0", 3: "Released under a licence of some kind", 4: None, 5: "",
        6: t["MIT/grant"].replace("free of charge", "without charge"), 7: "x " * 3000 + "\n" + t["ISC/grant"], 8: "Licensed under CC BY-NC 4.0.",
        9: "Copyright 2020 Foo Authors. Licensed under the Apache License, Version 2.0. See the LICENSE file.",
        10: "Copyright (c) 1999, Somebody\n\n" + t["BSD-3-Clause"].replace("copyright holder", "University"), 11: t["BSD-2-Clause"], 12: t["GPL-2.0/notice"], 13: t["LGPL-3.0/notice"],
        14: "This work is licensed under the GNU General Public License, version 2.", 15: "MIT License\n\nCopyright (c) 2020 A B\n\n" + t["MIT/text"], 16: t["Zlib"].upper(), 17: "cc\rmit . Released  under the\tMIT   License. x",
    }
    got = {r["doc_id"]: tuple(r)[1:] for r in licenses.license_scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    want = {1: "MIT", 2: "Apache-2.0", 3: None, 4: None, 5: None, 6: "MIT", 7: "ISC", 8: "CC-BY-NC-4.0", 9: "Apache-2.0", 10: "BSD-3-Clause", 11: "BSD-2-Clause", 12: "GPL-2.0", 13: "LGPL-3.0", 14: "GPL-2.0", 15: "MIT", 16: "Zlib", 17: "MIT"}
    assert {i: x[0] for i, x in got.items()} == want
    assert got == {i: best_license([x]) for i, x in texts.items()} and licenses.license_scan(none).count() == 0


CODE = "\nimport os\nfor x in range(10):\n    print(x, os.getcwd())\n" * 4


def wrapped(text, before="", width=9):
    """A text as comments have it: some words a line, each with a mark."""
    w = text.split()
    return "\n".join(before + " ".join(w[i : i + width]) for i in range(0, len(w), width))


def test_licenses_in_ordinary_places(spark):
    t = licenses.TEMPLATES
    cases = [
        ("#!/bin/sh\n" + wrapped("Copyright 2020 A B " + t["MIT/text"], "# ") + CODE, "MIT"), ("/*\n" + wrapped(t["MIT/text"], " * ") + "\n */" + CODE, "MIT"),
        ("// SPDX-License-Identifier: Apache-2.0" + CODE, "Apache-2.0"), ('[package]\nname = "x"\nlicense = "MIT"\nversion = "1"', "MIT"), ('{"name": "x",\n "license": "GPL-3.0-or-later",\n "a": 1}', "GPL-3.0-or-later"),
        (wrapped(t["BSD-3-Clause"], "; ") + CODE, "BSD-3-Clause"), ("word " * 900 + t["MIT/text"].replace("\n", "\n\n") + " word" * 900, "MIT"),
        (wrapped("                  " + t["Apache-2.0/heading"] + " License shall mean the terms and conditions for use" + CODE, "", 6), "Apache-2.0"),
        (wrapped(t["GPL-3.0/heading"] + " Preamble The GNU General Public License is a free, copyleft license", "", 7), "GPL-3.0"),
        (wrapped(t["LGPL-2.1/notice"], "-- ") + CODE, "LGPL-2.1"), (wrapped("Copyright (c) me. " + t["ISC"], "  ") + CODE, "ISC"), (wrapped(t["Zlib"], "// ") + CODE, "Zlib"),
        ("This text is about permits and the permission of the software to run. " * 20, None), (CODE, None),
    ]
    df = spark.createDataFrame([(k, x) for k, (x, _) in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in licenses.license_scan(df).collect()}
    assert [got[k][0] for k in range(len(cases))] == [want for _, want in cases]
    assert got == {k: best_license([x]) for k, (x, _) in enumerate(cases)}


def test_recall_of_planted_licenses(spark):
    """Whole licences in comments between prose and code, every tenth word or so changed in some: 0.95 of them are named."""
    rnd = random.Random(8)
    whole = {k: v for k, v in licenses.TEMPLATES.items() if len(v.split()) > 25 and k.split("/")[-1] not in ("endorsement", "opening", "warranty", "grant")}
    rows, want = [], {}
    for k in range(300):
        name = rnd.choice(sorted(whole))
        words = whole[name].split()
        for _ in range(rnd.randrange(1 + len(words) // 25)):
            words[rnd.randrange(len(words))] = f"x{rnd.randrange(99)}"
        prose = [" ".join(f"p{rnd.randrange(500)}" for _ in range(rnd.randrange(80))) for _ in range(2)]
        rows.append((k, prose[0] + "\n" + wrapped(" ".join(words), rnd.choice(["", "# ", " * ", "// "]), rnd.randrange(5, 14)) + "\n" + prose[1]))
        want[k] = name.split("/")[0]
    got = {r["doc_id"]: r["license"] for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[k] == want[k] for k in want) >= 0.95 * len(want)


def test_licenses_of_repeated_rows(spark):
    t = licenses.TEMPLATES
    rows = [(1, t["ISC"], "x"), (1, t["ISC"], "x"), (1, "Released under the MIT license", "y"), (None, "Released under the MIT license", None), (None, None, None), (2, "a", "z")]
    got = {r["doc_id"]: tuple(r)[1:] for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string, license string")).collect()}
    assert got == {i: best_license([x for j, x, _ in rows if j == i]) for i in (1, None, 2)}


def test_anchors_lose_nothing():
    """A unit that reaches a template has an anchor: whatever bigrams are taken away, enough of the template's stay only with one."""
    rnd, grams = random.Random(2), licenses.template_bigrams(licenses.TEMPLATES)
    found = set(licenses.anchors(grams, licenses.DICE))
    assert not found & {"the", "under", "of"}
    for name, own in grams.items():
        free = [g for g in own if not set(g.split()) & found]
        assert 2 * len(free) < licenses.DICE * (len(free) + len(own)), name
        some = rnd.sample(own, rnd.randrange(1, len(own) + 1))
        if 2 * len(some) >= licenses.DICE * (len(some) + len(own)):
            assert any(set(g.split()) & found for g in some)


def test_mixing_meets_marginals(spark):
    rnd = random.Random(8)
    rows = [(i, " ".join(["w"] * rnd.randrange(1, 60)), rnd.choice(["en", "en", "fr"]), rnd.choice(["a", "a", "a", "b", "c"])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = mixing.mix(docs, rounds=5, topic=F.col("doc_id") % 3).toPandas()
    out["mass"] = out["tokens"] * out["weight"]
    for dim, power in (("source", mixing.SOURCE), ("lang", mixing.LANG), ("topic", mixing.TOPIC)):
        have, tokens = out.groupby(dim)["mass"].sum(), out.groupby(dim)["tokens"].sum()
        want = tokens**power / (tokens**power).sum() * tokens.sum()
        assert (have / want - 1).abs().max() < 0.01
    assert abs((out["tokens"] * out["kept"]).sum() / (out["tokens"] * out["probability"]).sum() - 1) < 0.05


def test_mixing_odd_rows(spark, docs, none):
    out = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    assert len(out) == docs.count() and out[900]["tokens"] == 0 and mixing.mix(none).count() == 0
    blank = spark.createDataFrame([(1, None, None, None), (1, None, None, None), (None, "", "en", "a")], "doc_id long, text string, lang string, source string")
    assert [(r["tokens"], r["weight"], r["probability"]) for r in mixing.mix(blank).collect()] == [(0, 1.0, mixing.KEEP)] * 3
    tied = spark.createDataFrame([(7, "a b", "en", "a")] * 3 + [(8, "a b", "en", "b")] * 3, "doc_id long, text string, lang string, source string")
    got = mixing.mix(tied).collect()
    assert len(got) == 6 and all(len({r["kept"] for r in got if r["doc_id"] == i}) == 1 for i in (7, 8))


def misses(out, weight):
    """By how much the marginals of `weight` miss their targets: of each dimension the largest ratio to the target, less 1."""
    worst, total = 0.0, (out["tokens"] * out[weight]).sum()
    for dim, power in (("source", mixing.SOURCE), ("lang", mixing.LANG), ("topic", mixing.TOPIC)):
        tokens = out.groupby(dim)["tokens"].sum()
        want = tokens**power / (tokens**power).sum()
        worst = max(worst, ((out["tokens"] * out[weight]).groupby(out[dim]).sum() / total / want - 1).abs().max())
    return worst


def test_probabilities_meet_marginals(spark):
    """A corpus so skewed that keep times the weight is over 1 in many cells."""
    rnd = random.Random(9)
    rows = [(i, " ".join(["w"] * rnd.randrange(1, 60)), rnd.choice(["en"] * 8 + ["fr"]), rnd.choice(["hot"] * 9 + ["b", "c", "d"])) for i in range(6000)] + [(9000, None, "xx", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = mixing.mix(docs, topic=F.col("doc_id") % 3).toPandas()
    assert len(out) == len(rows) and out["probability"].between(0, 1).all()
    seen = out[out["tokens"] > 0]
    clipped = seen.assign(probability=(mixing.KEEP * seen["weight"]).clip(upper=1.0))
    assert misses(clipped, "probability") > 0.1
    assert misses(seen, "probability") <= mixing.NEAR
    # Nothing is given up without need: weights alone would have to be scaled down further.
    assert (seen["tokens"] * seen["probability"]).sum() / seen["tokens"].sum() > 1.1 / seen["weight"].max()
    assert abs((seen["tokens"] * seen["kept"]).sum() / (seen["tokens"] * seen["probability"]).sum() - 1) < 0.05


def test_calibrated_keeps_what_fits(spark, none):
    """Where no weight is cut, the probabilities are the same ones."""
    rows = [(i, "w " * 10, ("en", "fr")[i % 2], ("a", "b")[i // 2 % 2]) for i in range(400)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), topic=F.lit(0)).toPandas()
    assert (out["probability"] - mixing.KEEP).abs().max() < 1e-9
    assert mixing.mix(none).count() == 0
