import datetime as dt
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import vectors as search
from tallyframe.params import Params
from tallyframe.plans import callouts, curated, forecast, gold, merges, silver, validate
from tallyframe.plans.build import build
from tallyframe.plans.serve import Query, Refused, bind, check, describe, envelope, run_named, run_sql
from tallyframe.schemas import APP, BRONZE, BRONZE_ORDERS, empty
from tallyframe.sources.config import Alias, Budget, Category, Config, Rule, seed

NOW = dt.datetime(2026, 7, 15)
CONFIG = Config(
    categories=tuple(map(Category, ("Food", "Food/Out", "Home", "Home/Rent", "Fun", "Income"))),
    rules=(Rule("NETFLIX", "merchant_name", "Fun", 1), Rule("RENT", "description_raw", "Home/Rent", 2), Rule("CAFE", "merchant_name", "Food/Out", 3), Rule("PAYROLL", "merchant_name", "Income", 4), Rule("MUG", "product_name", "Home", 5)),
    aliases=(Alias("^CAFE", "CAFE"), Alias("^CAFE ROYAL", "ROYAL", 1)),
    budgets=(Budget("fun", "Fun", "monthly", Decimal("10.00"), "2025-01-01"),),
)


@pytest.fixture(scope="module")
def marts(spark, tmp_path_factory):
    """18 months of a household: pay, rent, a subscription, cafés, transfers to savings, an order of two items."""
    rows = []

    def add(account, day, amount, text, ext=None):
        key = f"{account}-{len(rows)}"
        rows.append(("bank", account, "checking", "USD", "f.csv", NOW, day, Decimal(amount), text, ext, key))

    for m in range(18):
        first = forecast.add_months(dt.date(2025, 1, 1), m)
        add("Main Checking", first, "-1800.00", "RENT OFFICE")
        add("Main Checking", first + dt.timedelta(4), "-15.49", "NETFLIX.COM")
        add("Main Checking", first + dt.timedelta(14), "5000.00", "PAYROLL PPD ID: 9")
        for k in range(3):
            add("Main Checking", first + dt.timedelta(6 + k), f"-{20 + (m * 7 + k * 3) % 11}.{10 + k}", "SQ *CAFE BLUE 123")
        add("Main Checking", first + dt.timedelta(20), "-250.00", "TO HARBOR")
        add("Harbor Savings", first + dt.timedelta(21), "250.00", "FROM MAIN")
    add("Main Checking", dt.date(2025, 3, 9), "-30.00", "SHOP ORDER")
    rows.append(rows[0][:5] + (NOW - dt.timedelta(1),) + rows[0][6:])  # an older landing of one row
    orders = [("shop", "o.csv", NOW, f"i{i}", "1-1", dt.date(2025, 3, 7), dt.date(2025, 3, 8), f"a{i}", n, 1, "USD", "Closed", "Shipped", *map(Decimal, (p, "0", "0", "0", p, "0", "30.00"))) for i, (n, p) in enumerate([("MUG", "10.00"), ("PLATE", "17.00")])]
    root, out = (str(tmp_path_factory.mktemp(x)) for x in ("root", "out"))
    spark.createDataFrame(rows, BRONZE).write.parquet(f"{root}/bronze/bank")
    spark.createDataFrame(orders, BRONZE_ORDERS).write.parquet(f"{root}/bronze_orders/shop")
    return build(spark, root, out, seed(spark, CONFIG, NOW))


def test_dedup(marts):
    assert marts["stg_transactions"].count() == 18 * 8 + 1
    assert not validate.unique(marts["silver_transactions"], "transaction_id").count()


def test_rebuild_keeps_what_is_read(spark, tmp_path):
    """Who has read a mart keeps its rows while the next build replaces it; a build that dies leaves every mart whole."""
    spark = spark.newSession()  # views of the other tests stay
    root, out = str(tmp_path / "root"), str(tmp_path / "out")
    row = lambda n: ("bank", "A", "checking", "USD", "f.csv", NOW, dt.date(2025, 1, n), Decimal("-5.00"), f"SHOP {n}", None, f"k{n}")
    spark.createDataFrame([row(1)], BRONZE).write.parquet(f"{root}/bronze/bank")
    before = build(spark, root, out, seed(spark, Config(), NOW))["stg_transactions"]
    spark.createDataFrame([row(2)], BRONZE).write.mode("append").parquet(f"{root}/bronze/bank")
    app = seed(spark, Config(), NOW)
    with pytest.raises(Exception):
        build(spark, root, out, app | {"merchant_aliases": spark.range(1)})
    assert before.count() == 1 and build(spark, root, out, app)["silver_transactions"].count() == 2 and before.count() == 1


def test_transfers(marts):
    t = marts["silver_transfers"]
    assert t.count() == 18 and {r["confidence"] for r in t.collect()} == {"high"}
    assert marts["silver_transactions"].filter("is_transfer").count() == 36


def test_categories(marts):
    tx = marts["silver_transactions"].join(marts["silver_transaction_categories_all"], "transaction_id").join(marts["gold_category_paths"], F.col("id") == F.col("category_id"))
    assert {(r["merchant_name"], r["path"]) for r in tx.select("merchant_name", "path").distinct().collect()} == {("NETFLIX", "Fun"), ("RENT OFFICE", "Home/Rent"), ("CAFE", "Food/Out"), ("PAYROLL", "Income")}


def test_splits(marts):
    parts = {r["product_name"]: str(r["amount"]) for r in marts["silver_splits"].collect()}
    assert parts == {"MUG": "-11.11", "PLATE": "-18.89"}
    assert not validate.splits_exact(marts["silver_splits"], marts["silver_transactions"]).count()
    assert not validate.shipment_totals(marts["stg_order_items"]).count()


def test_rollups(marts):
    got = {r["path"]: r for r in marts["gold_category_rollups"].collect()}
    assert str(got["Home"]["total_outflow"]) == "32411.11" and got["Home/Rent"]["transaction_count"] == 18 and got["Food"]["transaction_count"] == 54
    assert not validate.roots_cover(marts["gold_category_rollups"], marts["gold_line_items"]).count()


def test_gold(marts):
    assert marts["gold_monthly_flow"].count() == 18
    assert {(r["merchant_name"], r["cadence"]) for r in marts["gold_recurring_flows"].collect()} >= {("NETFLIX", "monthly"), ("RENT OFFICE", "monthly"), ("PAYROLL", "monthly")}
    b = marts["gold_budget_actuals"].collect()
    assert len(b) == 18 and {str(r["variance"]) for r in b} == {"5.49"}
    edges = {(r["source_node"], r["target_node"]): r["value"] for r in marts["gold_sankey_flow"].collect()}
    assert edges[("Income", "Main Checking")] == Decimal("90000.00")
    assert not validate.own_parents(marts["silver_categories"]).count() and not validate.related(marts["gold_line_items"], "category_id", marts["silver_categories"], "id").count()


def test_human_outranks(spark, marts):
    tx = marts["silver_transactions"].filter("merchant_name = 'NETFLIX'").first()["transaction_id"]
    labels = spark.createDataFrame([("l1", NOW, None, "transaction", tx, "x"), ("l2", NOW + dt.timedelta(1), None, "transaction", tx, "y")], APP["labels"])
    human = silver.by_human(labels, silver.TRANSACTIONS)
    all_ = silver.categories_of(human, [marts["silver_transaction_categories"]], silver.TRANSACTIONS)
    assert [r["category_id"] for r in all_.filter(F.col("transaction_id") == tx).collect()] == ["y"] and all_.count() == marts["silver_transaction_categories"].count()


def test_embedding_and_classifier_stages(spark):
    rows = spark.createDataFrame([("1", "KNOWN"), ("2", "NEAR"), ("3", "FAR"), ("4", "KNOWN")], "transaction_id string, merchant_name string")
    ruled = spark.createDataFrame([("1", "c")], "transaction_id string, category_id string")
    vectors = spark.createDataFrame([(n, "m", v) for n, v in (("KNOWN", [1.0, 0.0, 0.0]), ("NEAR", [0.99, 0.01, 0.0]), ("FAR", [0.0, 1.0, 0.0]))], "merchant_name string, model string, embedding array<double>")
    emb = silver.by_embedding(rows, ruled, vectors, silver.TRANSACTIONS, "m", 0.8)
    assert {(r["transaction_id"], r["matched_name"]) for r in emb.collect()} == {("2", "KNOWN"), ("4", "KNOWN")}
    cache = spark.createDataFrame([("FAR", "m", "d", 0.9), ("NEAR", "m", "e", 0.9)], "merchant_name string, model string, category_id string, confidence double")
    assert [(r["transaction_id"], r["category_id"]) for r in silver.by_classifier(rows, [ruled, emb], cache, silver.TRANSACTIONS, "m", 0.5).collect()] == [("3", "d")]
    assert silver.by_classifier(rows, [ruled, emb], cache, silver.TRANSACTIONS, "m", 0.95).count() == 0


@pytest.fixture(scope="module")
def predicted(spark, marts):
    app = seed(spark, CONFIG, NOW)
    history = forecast.history(marts["silver_transactions"], marts["gold_recurring_flows"], marts["gold_line_items"], app["budgets"], marts["gold_category_ancestors"], NOW.date()).cache()
    return history, forecast.forecast(history).cache(), app["budgets"]


def test_forecast(predicted):
    history, rows, _ = predicted
    assert history.count() == 3 * 18
    got = {(r["series_label"], str(r["period_start"])): r for r in rows.collect()}
    assert {m for _, m in got} == {"2026-07-01", "2026-08-01", "2026-09-01"}
    assert str(got[("outflow", "2026-07-01")]["committed"]) == "1815.49" and str(got[("inflow", "2026-08-01")]["committed"]) == "5000.00"
    fun = got[("fun", "2026-09-01")]
    assert (fun["committed"], fun["lower"], fun["upper"]) == (Decimal("15.49"),) * 3
    assert not validate.forecast_parts(rows).count()


def test_callouts(predicted):
    history, rows, budgets = predicted
    got = callouts.callouts(history, rows, budgets, NOW.date()).collect()
    assert (got[0]["kind"], got[0]["level"], got[0]["label"]) == ("BUDGET_RISK", "CRITICAL", "fun")
    assert len(callouts.callouts(history, rows, budgets, NOW.date(), limit=1).collect()) == 1


@pytest.mark.parametrize("name, least, model", forecast.MODELS)
def test_models_run(name, least, model):
    y = np.array([10.0, 12.0, 11.0, 13.0, 12.5, 14.0, 13.5, 15.0, 14.2, 16.0])
    for n in range(least, len(y) + 1):
        assert np.isfinite(model(y[:n], 3)).all() and len(model(y[:n], 3)) == 3


def test_model_choice():
    assert forecast.choose(np.array([5.0]), 2)[0] == "mean"
    assert forecast.choose(np.full(10, 7.0), 2)[:3:2] == ("naive", 0.0)
    assert forecast.half_width([1, 2, 3, 4, 5], 1.0, 4, 80, 0.5) == 8.0 and forecast.half_width([], 1.0, 1, 80, 0.5) == 0.0
    assert [forecast.trend_of(np.array(y, float), 0.1) for y in ([1, 1], [10, 11, 12, 13], [13, 12, 11, 10], [10, 10, 10])] == ["flat", "rising", "falling", "flat"]


def test_projection():
    flow = {"cadence": "monthly", "amount": 10.0, "avg_gap_days": 30.0, "last_seen_on": dt.date(2024, 1, 31)}
    assert forecast.add_months(dt.date(2024, 1, 31), 1) == dt.date(2024, 2, 29)
    assert forecast.project([flow], dt.date(2024, 2, 1), 3) == [10.0, 10.0, 10.0]
    assert forecast.project([flow | {"last_seen_on": dt.date(2023, 10, 1)}], dt.date(2024, 2, 1), 3) == [0.0, 0.0, 0.0]
    weekly = flow | {"cadence": "weekly", "avg_gap_days": 7.5, "last_seen_on": dt.date(2024, 1, 30)}
    assert sum(forecast.project([weekly], dt.date(2024, 2, 1), 1)) == 40.0


def test_projection_by_rows(spark):
    """Rows give what the walk over each flow gives, ends of months and gaps of fractions included."""
    flows = [{"cadence": c, "amount": a, "avg_gap_days": g, "last_seen_on": d} for k, (c, g) in enumerate([("monthly", 30.4), ("quarterly", 91.0), ("yearly", 365.2), ("weekly", 7.5), ("biweekly", 14.9), ("odd", None), ("weekly", 0.2)])
             for a, d in [(10.0 + k, dt.date(2024, 1, 31)), (20.25, dt.date(2024, 1, 30)), (5.0, dt.date(2023, 11, 30)), (7.0, dt.date(2024, 2, 14)), (3.0, dt.date(2022, 2, 28))]]
    df = spark.createDataFrame([tuple(f.values()) + (f"s{k % 3}",) for k, f in enumerate(flows)], "cadence string, amount double, avg_gap_days double, last_seen_on date, series_key string")
    first = dt.date(2024, 2, 1)
    got = forecast.projected(df, ["series_key"], first, 14)
    for s in range(3):
        want = forecast.project([f for k, f in enumerate(flows) if k % 3 == s], first, 14)
        mine = {(r["month"].year - 2024) * 12 + r["month"].month - 2: r["amount"] for r in got.filter(F.col("series_key") == f"s{s}").collect()}
        assert [round(mine.get(h, 0.0), 6) for h in range(14)] == [round(x, 6) for x in want]
    assert "collect_list" not in got._jdf.queryExecution().toString()


def test_named_parameters(spark, marts):
    every = run_named(spark, "spend_between", Params())
    some = run_named(spark, "spend_between", Params(), start="2025-02-01", end=dt.date(2025, 3, 31), least="100")
    assert {r["merchant_name"] for r in some["rows"]} == {"RENT OFFICE", "TO HARBOR"} and some["row_count"] < every["row_count"]
    assert run_named(spark, "months_between", Params(), start="2025-02-01", end="2025-03-01")["row_count"] == 2
    assert run_named(spark, "merchant_history", Params(), merchant="NETFLIX", flow="outflow")["row_count"] == 18
    assert run_named(spark, "merchant_history", Params(), merchant="x' OR '1' = '1")["row_count"] == 0
    for name, given in (("spend_between", {"start": "soon"}), ("spend_between", {"least": "much"}), ("spend_between", {"other": 1}), ("merchant_history", {}), ("nothing", {})):
        assert "error" in run_named(spark, name, Params(), **given)
    assert [tuple(r) for r in bind(spark, Query("SELECT :a + 1 AS x, :b AS y", {"a": "int", "b": "boolean"}), a="2", b="false").collect()] == [(3, False)]
    with pytest.raises(Refused):
        bind(spark, Query("DROP TABLE x"))


def test_curated(marts):
    assert [r["merchant_name"] for r in curated.top_merchants(marts["silver_merchants"], 1).collect()] == ["RENT OFFICE"]
    assert curated.months(marts["gold_monthly_flow"], "2025-02-01", "2025-03-01").count() == 2
    over = curated.overview(marts["gold_monthly_flow"]).first()
    assert len(over["months"]) == 18 and over["total_inflow"] == Decimal("90000.00")
    g = lambda **k: curated.spend_by_category(marts["gold_category_rollups"], marts["gold_line_items"], marts["gold_category_ancestors"], marts["gold_category_paths"], **k)
    assert {r["path"] for r in g(path="Home").collect()} == {"Home", "Home/Rent"}
    one = {r["path"]: r["total_outflow"] for r in g(start="2025-02-01", end="2025-03-01").collect()}
    assert one["Home/Rent"] == Decimal("3600.00") and one["Fun"] == Decimal("15.49")
    assert {r["path"]: r["total_outflow"] for r in g(start="2025-02-01", end="2025-03-01", whole_end_month=True).collect()}["Fun"] == Decimal("30.98")
    found = curated.transactions(marts["silver_transactions"], marts["gold_line_items"], marts["gold_category_paths"], category_path="Home", min_amount=20, start="2025-03-01", end="2025-03-31").collect()
    assert {tuple(r["category_paths"]) for r in found} == {("Home/Rent",)} or len(found) == 2
    assert curated.recurring(marts["gold_recurring_flows"], "inflow").count() >= 1 and curated.budget_status(marts["gold_budget_actuals"]).count() == 18


def test_review_queue(marts):
    left = silver.review_queue(marts["silver_transactions"].filter("NOT is_transfer"), marts["silver_transaction_categories_all"], "transaction_id", [F.col("posted_on").desc(), F.col("transaction_id")], 10)
    assert [r["description_raw"] for r in left.collect()] == ["SHOP ORDER"]


def test_merges(spark):
    vectors = spark.createDataFrame([("e%d" % i, NOW, None, n, "m", v) for i, (n, v) in enumerate([("CAFE", [1.0, 0.0]), ("CAFE B", [0.99, 0.05]), ("BANK", [0.0, 1.0])])], APP["merchant_embeddings"])
    names = spark.createDataFrame([("CAFE", 5), ("CAFE B", 2), ("BANK", 9)], "merchant_name string, transaction_count long")
    none = empty(spark, APP["merchant_merges"])
    got = merges.candidates(vectors, names, none, "m").collect()
    assert [(r["merchant_name"], r["canonical_name"]) for r in got] == [("CAFE B", "CAFE")]
    done = merges.decide(none, names, "CAFE B", "CAFE", "accepted", 0.99, NOW, "1")
    assert merges.candidates(vectors, names, done, "m").count() == 0
    for bad in (("CAFE", "CAFE"), ("CAFE", "NOWHERE"), ("CAFE", "CAFE B")):
        with pytest.raises(ValueError):
            merges.decide(done, names, *bad, "accepted", None, NOW, "2")
    assert merges.similarity(vectors, "m", "CAFE", "BANK") == 0.0 and merges.similarity(vectors, "m", "CAFE", "X") is None
    assert [r["merchant_name"] for r in merges.carry_forward(vectors.filter("merchant_name = 'CAFE B'"), "merchant_name", "CAFE B", "CAFE").collect()] == ["CAFE"]


def test_name_pairs_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "ROWS", 3)
    rng = np.random.default_rng(1)
    v = [(f"n{i}", [float(x) for x in rng.normal(size=3)]) for i in range(20)]
    got = {(r["a"], r["b"]) for r in merges.name_pairs(spark.createDataFrame(v, "name string, embedding array<double>"), 0.5).collect()}
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    assert got == {(a, b) for a, x in v for b, y in v if a < b and cos(x, y) >= 0.5}


@pytest.mark.parametrize("statement", ["DROP TABLE x", "INSERT INTO x VALUES (1)", "CREATE TABLE y AS SELECT 1", "SET a=b", "ADD JAR 'x'", "", "-- nothing", "SHOW TABLES", "SELECT java_method('java.lang.System', 'getenv', 'HOME')", "SELECT * FROM (SELECT reflect('java.lang.System', 'exit', 0))"])
def test_refused(spark, statement):
    with pytest.raises(Refused):
        check(spark, statement)


def test_run_sql(spark, marts):
    got = run_sql(spark, "WITH a AS (SELECT * FROM gold_monthly_flow) SELECT month, net_amount, net_amount FROM a ORDER BY month", Params(row_limit=5))
    assert (got["row_count"], got["truncated"], sorted(got["rows"][0])) == (5, True, ["month", "net_amount", "net_amount_2"])
    assert run_sql(spark, "SELECT * FROM gold_monthly_flow", Params(row_limit=18))["truncated"] is False
    assert "gold_monthly_flow" in run_sql(spark, "SELECT nothing FROM gold_monthly_flow")["schema"]
    assert "error" in run_sql(spark, "SELECT * FROM parquet.`/tmp`")
    slow = run_sql(spark, "SELECT count(*) FROM range(10000000000) a JOIN range(1000000) b ON a.id % 7 <= b.id", Params(timeout_s=2.0))
    assert "stopped" in slow["error"]
    assert describe(spark, "gold_monthly_flow")[0]["name"] == "month"
    with pytest.raises(LookupError):
        describe(spark, "nowhere")
    assert envelope(spark.range(0).toDF("x"), 3) == {"row_count": 0, "truncated": False, "row_limit": 3, "rows": []}
