import random
import re
import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyframe.functions.exprs import re2_to_java
from tallyframe.operators import core, patterns


@pytest.mark.parametrize("pattern, found", [
    ("NETFLIX", ["netflix"]), ("^CAFE ROYAL$", ["cafe royal"]), ("(STEEL|COPPER)$", ["steel", "copper"]), ("a+bcd", ["bcd"]), ("x?abc.*defg", ["defg"]), ("(abc)*", None),
    ("AB", None), (".", None), ("[abc]def", ["def"]), ("(?i)STARBUCKS", ["tarbuc"]), ("(?i)KISS", None), ("(?i)Café X", ["caf"]), (r"\bUBER\b", ["uber"]), (r"A\.B-C", ["a.b-c"]),
    ("(abc|d)", None), ("(abcd|efg)(hijkl|mnopq)", ["hijkl", "mnopq"]), ("(abc){0,2}xyz", ["xyz"]), ("(abc){2}", ["abc"]), (r"\Qabc\E", None), ("[[:alpha:]]bcd", None), ("(?=abc)d", None),
    (r"\p{L}abc", None), ("(?:abc)def", ["abcdef"]), ("(?iu)WXYZ", ["wxyz"]), ("abc|", None), (r"ab\d*cde", ["cde"]), ("(", None),
])
def test_required_literals(pattern, found):
    assert patterns.required_literals(pattern) == found


@settings(max_examples=300, deadline=None)
@given(st.text("abcAB.*+?()|[]^$-{}01, é", max_size=14), st.text("abcABé-.0 ", max_size=12))
def test_no_match_without_its_literals(pattern, text):
    """Whatever the pattern: a text that it matches contains one of the literals."""
    try:
        rx = re.compile(pattern)
    except (re.error, OverflowError):
        return
    literals = patterns.required_literals(pattern)
    if literals and rx.search(text):
        assert any(x in text.translate(patterns._LOWER) for x in literals)


def rules_of(n=400, seed=3):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("ABCDE") for _ in range(rnd.randrange(2, 6)))
    out = [rnd.choice([word, lambda: f"^{word()}", lambda: f"({word()}|{word()})", lambda: f"(?i){word().lower()}", lambda: f"{word()}.*{word()}$", lambda: f"[AB]{word()}", lambda: r"\d+"])() for _ in range(n)]
    return [(f"r{k}", re2_to_java(p), rnd.randrange(5), f"c{k}") for k, p in enumerate(out)]


def test_matches_are_those_of_the_nested_loop(spark):
    rnd = random.Random(9)
    texts = ["".join(rnd.choice("ABCDEabcde 1é") for _ in range(rnd.randrange(14))) for _ in range(250)] + ["", "AB"]
    df = spark.createDataFrame([(t,) for t in texts + texts[:40]] + [(None,)], "text string")
    rules = spark.createDataFrame(rules_of(), "id string, pattern string, priority int, category_id string")
    loop = df.distinct().join(F.broadcast(rules.select("pattern").distinct()), F.rlike("text", F.col("pattern")))
    want = {tuple(r) for r in loop.select("text", "pattern").collect()}
    found = patterns.matches(df, rules)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_plan_joins_on_a_key(spark):
    """Beyond a few patterns without literals nothing is compared with everything."""
    letters = string.ascii_uppercase
    rules = spark.createDataFrame([(f"r{k}", f"{letters[k % 26]}{letters[k // 26 % 26]}{letters[k // 676 % 26]}XYZ{k}") for k in range(3000)], "id string, pattern string")
    df = spark.createDataFrame([(f"shop AAAXYZ{k * 26} x",) for k in range(100)], "text string")
    plan = patterns.matches(df, rules)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text
    assert plan.filter("pattern = 'AAAXYZ0'").count() == 1


def test_first_match_with_many_rules(spark):
    rules = spark.createDataFrame(rules_of(300, 5), "id string, pattern string, priority int, category_id string")
    rnd = random.Random(2)
    df = spark.createDataFrame([(k, "".join(rnd.choice("ABCDE") for _ in range(8)) if k % 9 else None) for k in range(200)], "k int, t string")
    found = {r["k"]: r["category_id"] for r in core.first_match(df, rules, "k", F.col("t"), ["category_id"]).collect()}
    want = {}
    for r in df.join(F.broadcast(rules), F.rlike("t", F.col("pattern"))).collect():
        best = (r["priority"], r["id"], r["category_id"])
        want[r["k"]] = min(want.get(r["k"], best), best)
    assert found == {k: v[2] for k, v in want.items()}
