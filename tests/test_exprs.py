import pytest
from pyspark.sql import functions as F

from tallyframe.functions.exprs import cosine, name_tokens, names, normalize_merchant, period_start, re2_to_java, regexp_escape, strptime_to_java

MERCHANTS = [
    ("sq *corner bakery", "CORNER BAKERY"),
    ("ACME PAYROLL PPD ID: 12345", "ACME PAYROLL"),
    ("CITY WATER WEB", "CITY WATER"),
    ("NETFLIX.COM 866-5551234", "NETFLIX-"),
    ("GROCER STORE #0042", "GROCER"),
    ("TST* NOODLES AUSTIN TX", "NOODLES"),
    ("HARDWARE DEPOT USA", "HARDWARE DEPOT"),
    ("  plain   name  ", "PLAIN NAME"),
    ("", None),
    ("1234", None),
    (None, None),
]


def test_merchants(spark):
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(MERCHANTS)], "i int, x string")
    got = [r[0] for r in rows.orderBy("i").select(normalize_merchant(F.col("x"))).collect()]
    for (raw, want), have in zip(MERCHANTS, got):
        assert have == want, raw


def test_known_city(spark):
    row = spark.createDataFrame([("CAFE LONDRES SAN JUAN",)], "x string").select(normalize_merchant(F.col("x"), ("San Juan",)), normalize_merchant(F.col("x"))).first()
    assert tuple(row) == ("CAFE LONDRES", "CAFE LONDRES SAN JUAN")


@pytest.mark.parametrize("pattern", [r"(?=x)", r"(?<!x)y", r"(a)\1", r"a++"])
def test_re2_rejects(pattern):
    with pytest.raises(ValueError):
        re2_to_java(pattern)


@pytest.mark.parametrize("pattern, text, want", [("a$", "a\n", False), (r"x\sy", "x\x0by", False), (r"\bBP", "ÉBP", True), ("(?i)é", "É", True), (r"[^\s]b", "ab", True), (r"\*+x", "**x", True), ("[$]", "$", True)])
def test_re2(spark, pattern, text, want):
    row = spark.createDataFrame([(text, re2_to_java(pattern))], "t string, p string").select(F.rlike("t", "p")).first()
    assert row[0] is want


def test_escape(spark):
    text = "a.b*c[d]-(e)"
    row = spark.createDataFrame([(text,)], "t string").select(F.rlike("t", F.concat(F.lit("^"), regexp_escape(F.col("t")), F.lit("$")))).first()
    assert row[0]


def test_cosine(spark):
    rows = [(1, [1.0, 0.0], [1.0, 0.0]), (2, [1.0, 0.0], [0.0, 2.0]), (3, [0.0, 0.0], [1.0, 1.0])]
    got = spark.createDataFrame(rows, "i int, a array<double>, b array<double>").orderBy("i").select(cosine(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [1.0, 0.0, None]
    with pytest.raises(Exception, match="unequal"):
        spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>").select(cosine(F.col("a"), F.col("b"))).collect()


def test_tokens(spark):
    rows = spark.createDataFrame([("Acme Savings", "FROM ACME X"), ("My CARD", "ACME"), ("Acme", None), ("Acme", "ACMECORP")], "a string, d string")
    assert [r[0] for r in rows.select(names(F.col("d"), name_tokens(F.col("a")))).collect()] == [True, False, False, False]


def test_periods(spark):
    rows = spark.createDataFrame([("weekly", "2024-05-15"), ("monthly", "2024-05-15"), ("quarterly", "2024-05-15"), ("yearly", "2024-05-15"), ("daily", "2024-05-15")], "p string, d string")
    got = [str(r[0])[:10] for r in rows.select(period_start(F.col("p"), F.col("d").cast("date"))).collect()]
    assert got == ["2024-05-13", "2024-05-01", "2024-04-01", "2024-01-01", "None"]


def test_formats():
    assert strptime_to_java("%m/%d/%Y") == "MM/dd/yyyy"
    assert strptime_to_java("%Y-%m-%dT%H:%M:%S") == "yyyy-MM-dd'T'HH:mm:ss"
    with pytest.raises(ValueError):
        strptime_to_java("%Q")
