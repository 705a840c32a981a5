"""Files are parsed as their lines come, never whole."""

import csv
import io
import random

import pytest

from tallyframe.sources import exports, landing
from tallyframe.sources.config import IngestionError, Source


def test_no_task_takes_a_file_whole(spark, tmp_path, monkeypatch):
    """Several splits of a file come in order, and what a parser takes and gives at a time is bounded."""
    lines = ["Id,What,\"A\nB\""] + [f'{k},"x, ""{k}""\n y ",{"é" * (k % 5)}' for k in range(3000)]
    (tmp_path / "a+b c%20.csv").write_text("﻿" + "\n".join(lines) + "\n", encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        assert exports.lines_of(spark, str(tmp_path / "*.csv")).groupBy("path").count().count() == 1
        df = exports.records(spark, str(tmp_path / "*.csv"))
        rows = sorted(tuple(r) for r in df.collect())
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = [[x.strip() for x in r] for r in csv.reader(io.StringIO("\n".join(lines), newline=""))]
    assert [r[2] for r in rows] == [dict(zip(want[0], r)) for r in want[1:]] and [r[1] for r in rows] == list(range(3000))
    assert {r[0].rsplit("/", 1)[-1] for r in rows} == {"a+b c%20.csv"} and "content" not in plan


@pytest.mark.parametrize("text", ["a,b\r\n1,2\r\n", "a,b\r1,2\r", "a,b\n\n1,2", 'a,b\n1,"2\n"\n', "a,b,a\n0,2,1\n"])
def test_line_ends(spark, tmp_path, text):
    (tmp_path / "x.csv").write_bytes(text.encode())
    assert [r["fields"] for r in exports.records(spark, str(tmp_path / "x.csv")).collect()] == [{"a": "1", "b": "2"}]
    assert [r["fields"] for r in exports.records(spark, str(tmp_path / "x.csv"), wanted=("b", "none", "a")).collect()] == [["2", None, "1"]]


@pytest.mark.parametrize("gap", ["", "\n"])
def test_ofx_pieces(gap):
    rnd = random.Random(1)
    row = lambda k: gap.join(["<STMTTRN>", "<DTPOSTED>20240102", f"<TRNAMT>{k}.00", f"<FITID>f{k}", f"<NAME>A &amp; B {k}", "</STMTTRN>"])
    text = gap.join(["<OFX>", "<ACCTID>7", *map(row, range(50)), "<LEDGERBAL>", "</OFX>"])
    whole = list(exports.ofx_statements(text))
    cuts = [0, *sorted(rnd.sample(range(len(text)), 200)), len(text)]
    assert len(whole) == 50 and list(exports.ofx_statements(text[a:b] for a, b in zip(cuts, cuts[1:]))) == whole


def test_bytes_that_are_no_text_still_fail(spark, tmp_path):
    bank = Source("bank", column_map={"posted_on": "Date", "amount": "Amount", "description_raw": "Description"})
    (tmp_path / "x.csv").write_bytes(b"Date,Description,Amount\n2024-01-02,\xff,1\n")
    with pytest.raises(IngestionError):
        landing.ingest(spark, bank, str(tmp_path / "x.csv"), str(tmp_path / "land"))


def orders_csv(rows, gz, path):
    import gzip

    names = ("website_order_id", "asin", "ship_date", "order_date", "quantity", "unit_price")
    text = ",".join(exports.ORDER_COLUMNS[n] for n in names) + "\n" + "".join(",".join(r) + "\n" for r in rows)
    path.write_bytes(gzip.compress(text.encode()) if gz else text.encode())


@pytest.mark.parametrize("gz", [False, True])
def test_an_order_history_is_shuffled_once(spark, tmp_path, gz):
    """Compressed files come in order as they are; places and equal rows are found by one shuffle, and nothing is shuffled to join a table that isn't there."""
    rnd = random.Random(6)
    rows = [(rnd.choice("mno") + rnd.choice(["", "|x"]), rnd.choice(["x|z", "z", "x"]), rnd.choice(["2024-01-05", " "]), "2024-01-01", str(k % 9), "$1.50") for k in range(400)]
    files = [rows[:250], rows[250:], rows[:40]]
    for k, some in enumerate(files):
        orders_csv(some, gz, tmp_path / (f"{k}.csv" + ".gz" * gz))
    shop = Source("shop", "Shop", "orders", kind="orders")
    want = {}
    for some in files:
        seen = {}
        for order, asin, ship, *_ in some:
            k = seen[order, asin, ship] = seen.get((order, asin, ship), -1) + 1
            want.setdefault("|".join(["shop", "order", order, asin, ship.strip(), str(k)]), None)
    import hashlib

    path, root = str(tmp_path / "*.csv*"), str(tmp_path / "landed")
    read = exports.read(spark, shop, path)
    hashes = [r["row_hash"] for r in read.select("row_hash").collect()]
    assert sorted(hashes) == sorted(hashlib.sha256(x.encode()).hexdigest() for x in want)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == (1 if gz else 2)
    assert landing.ingest(spark, shop, path, root) == len(want) and landing.ingest(spark, shop, path, root) == 0
    assert landing.bronze_orders(spark, root).count() == len(want)


def test_joining_no_table_shuffles_nothing(spark):
    from tallyframe.schemas import columns
    from tallyframe.sources import snapshots

    rows = spark.range(9).selectExpr("cast(id AS string) AS row_hash")
    left = rows.join(snapshots.load(spark, [], columns("row_hash string")), "row_hash", "left_anti")
    assert "Exchange" not in left._jdf.queryExecution().executedPlan().toString() and left.count() == 9


def test_orders_of_an_export_are_whole_in_a_file_each(spark, tmp_path):
    """The exported order history: compressed, and each order's items in one file, in order."""
    import os

    from tallyframe import source_queries

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables here")
    path = source_queries._order_history(spark, "/root/testdata/sf0.001", str(tmp_path / "files"))
    lines = exports.records(spark, path, wanted=("Order ID",)).selectExpr("path", "fields[0] AS o").distinct()
    assert lines.count() == lines.select("o").distinct().count() > 0
    assert all(f.endswith(".gz") for f in spark.read.text(path).inputFiles())
