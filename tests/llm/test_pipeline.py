import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tallyframe.llm import mixing, packing
from tests.llm.test_jaccard import brute
from tests.llm.test_native import misses

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def stages(spark, docs, folder):
    """Each stage's input and output, as the pipeline runs them."""
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(folder / str(k)))
        out = spark.read.parquet(str(folder / str(k)))
        if k < 4:
            assert out.columns == columns
            assert out.exceptAll(docs).count() == 0
        yield name, docs, out
        docs = out


def test_stages(spark, tmp_path):
    """Each stage on what the one before it kept, against plain Python."""
    kept = {}
    for name, _, out in stages(spark, spark.read.parquet(f"{SF}/documents.parquet"), tmp_path):
        kept[name] = {r["doc_id"]: r["text"] for r in out.select("doc_id", "text").collect()} if name != "best-fit packing" else out.toPandas()
    quality, exact, near, mixed, packed = kept.values()
    latest = {}
    for i, t in quality.items():
        latest[t] = max(i, latest.get(t, i))
    assert set(exact) == set(latest.values())
    assert set(near) == {i for i, (_, c) in brute(list(exact.items()), (80, 100), 5).items() if c == i} < set(exact)
    judged = mixing.mix(spark.createDataFrame([(i, t) for i, t in near.items()], "doc_id long, text string").join(spark.read.parquet(f"{SF}/documents.parquet").drop("text"), "doc_id")).toPandas()
    assert misses(judged, "probability") <= mixing.NEAR and set(mixed) == set(judged[judged["kept"]]["doc_id"])
    encode = packing.encoder("byte_bpe_50k.json")
    assert packed.groupby("doc_id")["length"].sum().to_dict() == {i: len(encode(t)) + 1 for i, t in mixed.items()}
    assert packed.groupby("sequence_id")["length"].sum().max() <= packing.CAPACITY


def test_odd_rows(spark, tmp_path):
    """Null, repeated and clashing ids and texts: every stage ends, and of equal rows one stays, a null id's too."""
    prose = lambda n: " ".join(f"w{n}x{k}" for k in range(40))
    rows = [(1, prose(1)), (1, prose(1)), (1, prose(2)), (2, prose(2)), (None, prose(3)), (None, prose(3)), (None, prose(4)), (5, None), (6, ""), (7, prose(5)), (8, prose(5) + " more"), (None, prose(5) + " more more"), (9, "long " * 50_000)]
    rows = [(i and i + 10**6, t) for i, t in rows]  # ids that no label has
    docs = spark.createDataFrame([(i, t, "en", "src", 1, "a", 2, 3) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int, kept string, class int, id int")
    left = {name: out for name, _, out in stages(spark, docs, tmp_path)}
    got = lambda name: sorted(((r["doc_id"], r["text"]) for r in left[name].collect()), key=repr)
    judged = [r for r in rows if r[1] and r[0] != 10**6 + 9]
    assert got("quality rules") == sorted(judged, key=repr)
    exact = [(i and i + 10**6, t) for i, t in ((1, prose(1)), (2, prose(2)), (None, prose(3)), (None, prose(4)), (7, prose(5)), (8, prose(5) + " more"), (None, prose(5) + " more more"))]
    assert got("exact dedup") == sorted(exact, key=repr)
    assert got("n-gram Jaccard join") == sorted(exact[:5], key=repr)


def test_clashing_names(spark, tmp_path):
    """Columns with the names that stages use themselves, a map and a struct among them, come out as they went in."""
    prose = lambda n: " ".join(f"w{n}x{k}" for k in range(40))
    rows = [(1, prose(1), "en", "s", "f", "i", "d", "r", {"k": 2}, (1,)), (1, prose(1), "en", "s", "f", "i", "d", "r", {"k": 1}, (1,)), (2, prose(2), "en", "s", None, None, None, None, None, None)]
    names = "doc_id long, text string, lang string, source string, _first string, _id string, _digest string, _row string, row map<string, int>, component_id struct<a: int>"
    docs = spark.createDataFrame([(r[0] + 10**6, *r[1:]) for r in rows], names)
    left = {name: out for name, _, out in clashing(spark, docs, tmp_path)}
    near = left["n-gram Jaccard join"].collect()
    assert sorted((r["doc_id"] - 10**6, r["_first"], r["row"]) for r in near) == [(1, "f", {"k": 1}), (2, None, None)]


def clashing(spark, docs, folder):
    """stages() without the comparison of rows, which Spark doesn't do with maps."""
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(folder / str(k)))
        out = spark.read.parquet(str(folder / str(k)))
        assert k == 4 or out.columns == docs.columns
        yield name, docs, out
        docs = out


def test_run_keeps_only_its_result(spark):
    from pathlib import Path

    out = corpus_pipeline.run(spark, SF)
    place = Path(out.inputFiles()[0].removeprefix("file://").removeprefix("file:")).parent
    assert out.count() > 0 and [p.name for p in place.parent.iterdir()] == [place.name]


def test_empty(spark, tmp_path):
    assert [out.count() for _, _, out in stages(spark, spark.read.parquet(f"{SF}/documents.parquet").filter("false"), tmp_path)] == [0] * 5


def test_oracle_tables(spark):
    import duckdb

    from tests.test_queries import TABLES, compare

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    from tallyframe import llm

    for name, sql in llm.oracle_sql().items():
        compare(llm.queries()[name](spark, SF), con.sql(sql))


def test_registered():
    names = list(entry.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
