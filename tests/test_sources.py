import datetime as dt
import threading

import pytest

from tallyframe.schemas import columns
from tallyframe.sources import landing
from tallyframe.sources.config import Config, ConfigError, IngestionError, Rule, Source, check_pattern, flatten, load, seed, strict
from tallyframe.sources.exports import ofx_statements
from tallyframe.streaming.folder import take, watch

MAP = {"posted_on": "Date", "amount": "Amount", "description_raw": "Description"}
BANK = Source("bank", "Checking", column_map=MAP, date_format="%m/%d/%Y")
LAYOUTS = [
    (BANK, "Date,Description,Amount\n01/02/2024,COFFEE,\"-1,234.50\"\n", "-1234.50"),
    (Source("plus", column_map=MAP), "Date,Description,Amount\n2024-01-02,COFFEE,+ $32.00\n", "32.00"),
    (Source("amex", column_map=MAP, sign="inverted"), "Date,Description,Amount\n2024-01-02,COFFEE,12.00\n", "-12.00"),
    (Source("one", column_map={"posted_on": "Date", "debit": "Debit", "credit": "Credit", "description_raw": "Description"}, sign="debit_credit"), "Date,Description,Debit,Credit\n2024-01-02,COFFEE,7.25,\n", "-7.25"),
    (Source("none", columns=("Date", "Amount", "x", "y", "Description"), column_map=MAP, date_format="%Y%m%d"), '"20240102","-3.00","*","","COFFEE"\n', "-3.00"),
    (Source("pre", column_map=MAP, skip_rows=3), "a\nb,c\n\nDate,Description,Amount,Bal.\n2024-01-02,COFFEE,-5,1\n", "-5.00"),
]


@pytest.mark.parametrize("source, text, amount", LAYOUTS)
def test_layouts(spark, tmp_path, source, text, amount):
    (tmp_path / "x.csv").write_text(text)
    assert landing.ingest(spark, source, str(tmp_path / "x.csv"), str(tmp_path / "land")) == 1
    row = landing.bronze(spark, str(tmp_path / "land")).first()
    assert (row["posted_on"], str(row["amount"]), row["description_raw"], row["external_id"], row["source_file"]) == (dt.date(2024, 1, 2), amount, "COFFEE", None, "x.csv")


def test_idempotent(spark, tmp_path):
    a, b, land = tmp_path / "a.csv", tmp_path / "b.csv", str(tmp_path / "land")
    a.write_text("Date,Description,Amount\n01/02/2024,COFFEE,-3\n01/02/2024,COFFEE,-3\n01/03/2024,TEA,-2\n")
    b.write_text("Date,Description,Amount\n01/03/2024,TEA,-2\n01/04/2024,CAKE,-4\n")
    assert [landing.ingest(spark, BANK, str(f), land) for f in (a, a, b, b)] == [3, 0, 1, 0]
    assert landing.row_count(spark, f"{land}/bronze/bank") == 4


def test_concurrent(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,Description,Amount\n01/02/2024,COFFEE,-3\n01/03/2024,TEA,-2\n")
    got = []
    threads = [threading.Thread(target=lambda: got.append(landing.ingest(spark, BANK, str(tmp_path / "a.csv"), str(tmp_path / "land")))) for _ in range(3)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert sorted(got) == [0, 0, 2]


@pytest.mark.parametrize("text", ["Date,Description,Amount\n13/45/2024,X,1\n", "Date,Description,Amount\n01/02/2024,X,abc\n", "Date,Description,Amount\n01/02/2024\n"])
def test_bad_rows_land_nothing(spark, tmp_path, text):
    (tmp_path / "a.csv").write_text(text)
    with pytest.raises(IngestionError):
        landing.ingest(spark, BANK, str(tmp_path / "a.csv"), str(tmp_path / "land"))
    assert landing.bronze(spark, str(tmp_path / "land")).count() == 0


OFX = """OFXHEADER:100
<OFX><BANKMSGSRSV1><STMTTRNRS><STMTRS><BANKACCTFROM><ACCTID>77</BANKACCTFROM><BANKTRANLIST>
<STMTTRN><TRNTYPE>DEBIT<DTPOSTED>20240102120000<TRNAMT>-9.50<FITID>f1<NAME>CAFE &amp; CO<MEMO>LUNCH</STMTTRN>
<STMTTRN><TRNTYPE>CREDIT<DTPOSTED>20240103<TRNAMT>20<FITID>f2<NAME>PAY</STMTTRN>
</BANKTRANLIST><LEDGERBAL><BALAMT>1<DTASOF>20240103</LEDGERBAL></STMTRS></STMTTRNRS></BANKMSGSRSV1></OFX>"""


def test_ofx(spark, tmp_path):
    (tmp_path / "x.ofx").write_text(OFX)
    source = Source("cu", "CU", kind="ofx")
    assert landing.ingest(spark, source, str(tmp_path / "x.ofx"), str(tmp_path / "land")) == 2
    rows = landing.bronze(spark, str(tmp_path / "land")).orderBy("posted_on").collect()
    assert [(r["external_id"], str(r["amount"]), r["description_raw"]) for r in rows] == [("f1", "-9.50", "CAFE & CO LUNCH"), ("f2", "20.00", "PAY")]
    assert landing.ingest(spark, source, str(tmp_path / "x.ofx"), str(tmp_path / "land")) == 0
    for bad in ("hello", OFX.replace("LEDGERBAL", "OTHER")):
        with pytest.raises(ValueError):
            list(ofx_statements(bad))


def test_orders(spark, tmp_path):
    from tallyframe.sources.exports import ORDER_COLUMNS

    values = {"website_order_id": "1-2", "order_date": "2024-01-01T10:00:00Z", "ship_date": "2024-01-02T10:00:00Z", "product_name": '"Cup, blue"', "quantity": "2", "total_owed": "10.00", "unit_price": "5"}
    (tmp_path / "Retail.OrderHistory.1.csv").write_text(",".join(ORDER_COLUMNS.values()) + "\n" + ",".join(values.get(c, "") for c in ORDER_COLUMNS) + "\n")
    out = take(spark, str(tmp_path / "Retail.OrderHistory.1.csv"), [Source("shop", kind="orders")], str(tmp_path / "land"))
    row = landing.bronze_orders(spark, str(tmp_path / "land")).first()
    assert out.status == "ingested" and (row["ship_date"], row["product_name"], row["quantity"], row["currency"]) == (dt.date(2024, 1, 2), "Cup, blue", 2, "USD")


def test_watch(spark, tmp_path):
    drop = tmp_path / "drop"
    drop.mkdir()
    (drop / "bank.csv").write_text("Date,Description,Amount\n01/02/2024,COFFEE,-3\n")
    (drop / "other.csv").write_text("x\n")
    (drop / "bank.csv.part").write_text("x\n")
    seen = []
    run = lambda: watch(spark, str(drop), [BANK], str(tmp_path / "land"), str(tmp_path / "cp"), seen.append).awaitTermination()
    run()
    assert [(o.path.rsplit("/", 1)[-1], o.status, o.new_rows) for o in seen] == [("bank.csv", "ingested", 1), ("other.csv", "unmatched", 0)]
    (drop / "bank2.csv").write_text("x\n")
    seen.clear(), run()
    assert [o.status for o in seen] == ["unmatched"]


def test_upsert_keeps_notes(spark):
    schema = "id string, name string, note string"
    old = spark.createDataFrame([("1", "a", "mine"), ("2", "b", None)], schema)
    new = spark.createDataFrame([("1", "A", None), ("3", "c", None)], schema)
    assert {tuple(r) for r in landing.upsert(old, new, ["id"]).collect()} == {("1", "A", "mine"), ("2", "b", None), ("3", "c", None)}
    assert {tuple(r) for r in landing.insert_missing(old, new, ["id"]).collect()} == {("1", "a", "mine"), ("2", "b", None), ("3", "c", None)}


def test_replace(spark, tmp_path):
    path = str(tmp_path / "t")
    read = lambda: landing.read_or_empty(spark, path, columns("id bigint"))
    assert landing.replace(spark.range(3).toDF("id"), path)
    assert landing.replace(read().filter("id > 0"), path) and read().count() == 2
    assert not landing.replace(spark.range(0).toDF("id"), path, skip_empty=True) and read().count() == 2


def test_config(spark, tmp_path):
    (tmp_path / "taxonomy.yaml").write_text("- name: Food\n  children:\n  - name: Other\n- name: Home\n  children:\n  - name: Other\n")
    (tmp_path / "rules.yaml").write_text("- {pattern: CAFE, applies_to: merchant_name, category: Food/Other}\n")
    (tmp_path / "budgets.yaml").write_text("- {name: food, category: Food, period: monthly, amount: 100, starts_on: 2024-01-01}\n")
    config = load(str(tmp_path))
    tables = seed(spark, config, dt.datetime(2024, 1, 1))
    assert tables["categories"].count() == 4 and tables["rules"].first()["category_id"] == [c.id for c in flatten([{"name": "Food", "children": [{"name": "Other"}]}])][1]
    with pytest.raises(ConfigError):
        strict(Rule, {"pattern": "x", "applies_to": "merchant_name", "category": "c", "extra": 1})
    with pytest.raises(ConfigError):
        Config(rules=(Rule("x", "merchant_name", "nowhere"),))
    with pytest.raises(ConfigError):
        check_pattern("(")
    with pytest.raises(ConfigError):
        Source("x", column_map={"posted_on": "a"})
