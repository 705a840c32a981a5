"""The marts' builders on the star-schema tables, with the DuckDB SQL that gives the same rows; registered with those of queries.py."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators import core
from tallyframe.operators.ranks import median_and_mad, nearest_rank, order_statistics
from tallyframe.params import Params
from tallyframe.plans import callouts, curated, enrich, forecast, gold, merges, silver
from tallyframe.queries import _SERIES_SQL, LEDGER_SQL, TRANSFERS_SQL, ledger, query, series, t, tree
from tallyframe.schemas import APP, conform
from tallyframe.sources.landing import current

NOW = dt.datetime(2026, 7, 15)

# --- cleaning -----------------------------------------------------------------------------------------------------------------

_DEDUP_SQL = """i AS (SELECT l_orderkey::VARCHAR AS website_order_id, CAST(l_shipdate AS DATE) AS ship_date, l_orderkey || '-' || lpad(l_linenumber::VARCHAR, 3, '0') AS order_item_id,
        l_partkey, round(l_extendedprice * 100)::BIGINT AS cents
    FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) = 1)"""


@query(f"""WITH {_DEDUP_SQL}, m AS (SELECT website_order_id, min(ship_date) AS ship_date FROM i GROUP BY ALL),
    r AS (SELECT i.*, o_orderkey::VARCHAR AS transaction_id, round(o_totalprice * 100)::BIGINT AS charge FROM m JOIN i USING (website_order_id, ship_date) JOIN orders ON o_orderkey::VARCHAR = website_order_id),
    p AS (SELECT *, sum(cents) OVER w AS s, count(*) OVER w AS n, row_number() OVER (PARTITION BY transaction_id ORDER BY order_item_id DESC) AS k FROM r WINDOW w AS (PARTITION BY transaction_id)),
    q AS (SELECT *, (CASE WHEN s = 0 THEN charge // n ELSE (charge * cents + s // 2) // s END)::BIGINT AS part FROM p)
    SELECT order_item_id AS split_id, transaction_id, l_partkey::VARCHAR AS product_name,
        (-(part + CASE WHEN k = 1 THEN charge - sum(part) OVER (PARTITION BY transaction_id) ELSE 0 END)::DECIMAL(18,2) / 100)::DECIMAL(18,2) AS amount FROM q""")
def charge_splits(spark, sf_dir):
    """JN-12, WIN-6, WIN-7: each charge over the items of the shipment that it paid for, found by order and ship date."""
    rows = core.latest_per_key(t(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], "l_shipdate", ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])
    nothing = F.lit(None).cast("string")
    items = rows.select(
        F.col("l_orderkey").cast("string").alias("website_order_id"), F.col("l_shipdate").cast("date").alias("ship_date"),
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.lpad(F.col("l_linenumber").cast("string"), 3, "0")).alias("order_item_id"),
        F.col("l_partkey").cast("string").alias("product_name"), F.col("l_extendedprice").cast("decimal(18,2)").alias("shipment_item_subtotal"),
        nothing.alias("asin"), nothing.alias("quantity"), nothing.alias("unit_price"), F.lit("USD").alias("currency"),
    )
    matches = items.groupBy("website_order_id").agg(F.min("ship_date").alias("ship_date")).withColumn("transaction_id", F.col("website_order_id"))
    tx = t(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("transaction_id"), (-F.col("o_totalprice")).cast("decimal(18,2)").alias("amount"))
    return silver.splits(matches, items, tx).select("split_id", "transaction_id", "product_name", "amount")


ALIASES = [("a", "^1", 2, "ONES"), ("b", "^12", 1, "TWELVES"), ("c", "7$", 3, "SEVENS")]
MERGES = [("1", "2024-01-01", "30", "31", "accepted"), ("2", "2024-01-02", "30", "32", "accepted"), ("3", "2024-01-03", "40", "41", "rejected"), ("4", "2024-01-01", "SEVENS", "LUCKY", "accepted")]
_NAMED_SQL = f"""aliases(id, pattern, priority, canonical_name) AS (VALUES {", ".join(map(str, ALIASES))}), merges(id, dated, merchant_name, canonical_name, status) AS (VALUES {", ".join(map(str, MERGES))}),
    alias AS (SELECT transaction_id, canonical_name FROM tx JOIN aliases ON regexp_matches(merchant_name, pattern) QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY priority, id) = 1),
    decided AS (SELECT merchant_name, canonical_name FROM (SELECT * FROM merges QUALIFY row_number() OVER (PARTITION BY merchant_name ORDER BY dated DESC, id DESC) = 1) WHERE status = 'accepted'),
    named AS (SELECT tx.* REPLACE (coalesce(alias.canonical_name, merchant_name) AS merchant_name) FROM tx LEFT JOIN alias USING (transaction_id)),
    silver AS (SELECT named.* REPLACE (coalesce(d.canonical_name, named.merchant_name) AS merchant_name), l.leg IS NOT NULL AS is_transfer FROM named LEFT JOIN decided d ON d.merchant_name = named.merchant_name
        LEFT JOIN (SELECT outflow_id AS transaction_id, 1 AS leg FROM pairs UNION SELECT inflow_id, 1 FROM pairs) l ON l.transaction_id = named.transaction_id)"""


def _silver(spark, sf_dir) -> DataFrame:
    """The ledger with names resolved by alias and merge, and the legs of transfers marked."""
    aliases = spark.createDataFrame(ALIASES, "id string, pattern string, priority int, canonical_name string")
    decisions = spark.createDataFrame(MERGES, "id string, created_at string, merchant_name string, canonical_name string, status string")
    stg = ledger(spark, sf_dir).drop("is_transfer")
    return silver.transactions(stg, aliases, decisions, silver.transfers(stg))


@query(f"WITH {TRANSFERS_SQL}, {_NAMED_SQL} SELECT transaction_id, account_name, merchant_name, posted_on, amount, is_transfer FROM silver")
def resolved_transactions(spark, sf_dir):
    """SET-2, JN-8, PRJ-3, PRJ-4, WIN-3: aliases, the latest merge decisions, both legs of transfers in one set."""
    return _silver(spark, sf_dir).select("transaction_id", "account_name", "merchant_name", "posted_on", "amount", "is_transfer")


@query("SELECT o_custkey, o_orderkey AS id, o_orderstatus AS status FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_decisions(spark, sf_dir):
    """WIN-3, SNK-8: what holds of decisions that are only ever appended."""
    rows = t(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("status"))
    return current(rows, ["o_custkey"]).select("o_custkey", "id", "status")


@query("""SELECT c_custkey, category_id FROM (SELECT c_custkey, 'PAYPAL *' || c_name || ' ' || c_mktsegment || ' 123' AS raw FROM customer)
    JOIN (SELECT c_name || '\\b' AS pattern, 1 AS priority, 'r' || c_custkey AS id, c_custkey::VARCHAR AS category_id FROM customer WHERE c_custkey % 3 > 0
        UNION ALL SELECT DISTINCT '(' || c_mktsegment || '|nothing) +[0-9]', 2, c_mktsegment, lower(c_mktsegment) FROM customer) ON regexp_matches(raw, pattern)
    QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY priority, id) = 1""")
def rule_a_customer(spark, sf_dir):
    """JN-3, JN-4: as many patterns as customers, joined on what a match must contain."""
    c = t(spark, sf_dir, "customer")
    raw = c.select("c_custkey", F.concat(F.lit("PAYPAL *"), "c_name", F.lit(" "), "c_mktsegment", F.lit(" 123")).alias("raw"))
    own = c.filter("c_custkey % 3 > 0").select(F.concat("c_name", F.lit("\\b")).alias("pattern"), F.lit(1).alias("priority"), F.concat(F.lit("r"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_custkey").cast("string").alias("category_id"))
    of_all = c.select("c_mktsegment").distinct().select(F.concat(F.lit("("), "c_mktsegment", F.lit("|nothing) +[0-9]")), F.lit(2), "c_mktsegment", F.lower("c_mktsegment"))
    return core.first_match(raw, own.union(of_all), "c_custkey", F.col("raw"), ["category_id"])


# --- categories ---------------------------------------------------------------------------------------------------------------

RULES = [("a", "ring$", "p_name", 1, "rings"), ("b", "^red", "p_name", 2, "reds"), ("c", "ECONOMY", "p_type", 3, "cheap")]
PARTS = silver.Subjects("k", "m", ("p_name", "p_type"), "part")
_STAGES_SQL = f"""rules(id, pattern, applies_to, priority, category_id) AS (VALUES {", ".join(map(str, RULES))}),
    p AS (SELECT p_partkey::VARCHAR AS k, (p_partkey % 700)::VARCHAR AS m, p_name, p_type FROM part),
    e AS (SELECT vec_id::VARCHAR AS m, embedding::DOUBLE[] AS e, label, vec_id FROM embeddings),
    rule AS (SELECT k, m, category_id FROM (SELECT k, m, 'p_name' AS f, p_name AS v FROM p UNION ALL SELECT k, m, 'p_type', p_type FROM p) JOIN rules ON f = applies_to AND regexp_matches(v, pattern)
        QUALIFY row_number() OVER (PARTITION BY k ORDER BY priority, id, f) = 1),
    ref AS (SELECT m, category_id, e FROM (SELECT m, category_id FROM (SELECT m, category_id, count(*) AS n FROM rule GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY m ORDER BY n DESC, category_id) = 1) JOIN e USING (m)),
    open_ AS (SELECT k, m FROM p WHERE k NOT IN (SELECT k FROM rule)),
    near AS (SELECT c.m, ref.m AS matched, category_id, list_cosine_similarity(e.e, ref.e) AS s FROM (SELECT DISTINCT m FROM open_) c JOIN e USING (m), ref
        WHERE list_cosine_similarity(e.e, ref.e) >= 0.3 QUALIFY row_number() OVER (PARTITION BY c.m ORDER BY s DESC, ref.m) = 1),
    embedding AS (SELECT k, category_id, s FROM open_ JOIN near USING (m)),
    llm AS (SELECT k, 'c' || label AS category_id, (vec_id * 37 % 100 / 100.0)::DOUBLE AS s FROM open_ JOIN e USING (m) WHERE vec_id % 2 = 0 AND vec_id * 37 % 100 / 100.0 >= 0.5 AND k NOT IN (SELECT k FROM embedding)),
    human AS (SELECT doc_id::VARCHAR AS k, 'q' || max_by(quality, toxic) AS category_id FROM labels GROUP BY doc_id),
    machine AS (SELECT k, category_id, 'rule' AS source, 1.0::DOUBLE AS s FROM rule UNION ALL SELECT k, category_id, 'embedding', s FROM embedding UNION ALL SELECT k, category_id, 'llm', s FROM llm),
    every AS (SELECT k, category_id, 'human' AS source, 1.0::DOUBLE AS s FROM human UNION ALL SELECT * FROM machine WHERE k NOT IN (SELECT k FROM human))"""


def _stages(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(subjects, one category a subject) by rules, embeddings, a classifier's cache and people."""
    p = t(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("k"), (F.col("p_partkey") % 700).cast("string").alias("m"), "p_name", "p_type")
    e, model = t(spark, sf_dir, "embeddings"), F.lit("x").alias("model")
    vectors = e.select(F.col("vec_id").cast("string").alias("m"), model, "embedding")
    cache = e.filter("vec_id % 2 = 0").select(F.col("vec_id").cast("string").alias("m"), model, F.concat(F.lit("c"), F.col("label").cast("string")).alias("category_id"), (F.col("vec_id") * 37 % 100 / F.lit(100.0)).alias("confidence"))
    labels = t(spark, sf_dir, "labels").select(F.lit("part").alias("subject_kind"), F.col("doc_id").cast("string").alias("subject_id"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("category_id"), F.col("toxic").alias("created_at"), F.col("toxic").alias("id"))
    ruled = silver.by_rule(p, spark.createDataFrame(RULES, "id string, pattern string, applies_to string, priority int, category_id string"), PARTS)
    near = silver.by_embedding(p, ruled, vectors, PARTS, "x", 0.3)
    said = silver.by_classifier(p, [ruled, near], cache, PARTS, "x", 0.5)
    return p, silver.categories_of(silver.by_human(labels, PARTS), [ruled, near, said], PARTS)


@query(f"WITH {_STAGES_SQL} SELECT k, category_id, source AS categorization_source, round(s, 6) AS categorization_confidence FROM every")
def category_cascade(spark, sf_dir):
    """The cascade's four stages: rules, nearest decided name, classifier, people before all."""
    return _stages(spark, sf_dir)[1].withColumn("categorization_confidence", F.round("categorization_confidence", 6))


@query(f"WITH {_STAGES_SQL} SELECT k, m, p_name FROM p WHERE k NOT IN (SELECT k FROM every) ORDER BY p_name DESC, k LIMIT 25")
def review_queue(spark, sf_dir):
    """SRT-2: what no stage has categorised, the first 25 to look at."""
    p, decided = _stages(spark, sf_dir)
    return silver.review_queue(p, decided, "k", [F.col("p_name").desc(), F.col("k")], 25).select("k", "m", "p_name")


def _answer(names):
    """Stands for a model: an embedding from the name's digits."""
    return [[float(len(n)), float(int(n) % 7 + 1)] for n in names]


@query("""SELECT DISTINCT user_id::VARCHAR AS merchant_name, 'm' AS model, [length(user_id::VARCHAR), user_id % 7 + 1]::DOUBLE[] AS embedding FROM events
    WHERE user_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 3 = 0)""")
def embedding_worklist(spark, sf_dir):
    """UDF-2: vectors of the names that the cache lacks."""
    have = t(spark, sf_dir, "embeddings").filter("vec_id % 3 = 0").select(F.col("vec_id").cast("string").alias("merchant_name"), F.lit("m").alias("model"), F.slice("embedding", 1, 2).cast("array<double>").alias("embedding"))
    new, _ = enrich.embed_missing(ledger(spark, sf_dir), conform(have, APP["merchant_embeddings"]), _answer, enrich.MERCHANT_EMBEDDINGS, "m", NOW)
    return new.select("merchant_name", "model", "embedding")


def _reply(names, paths):
    """Stands for a classifier, one that isn't to be trusted."""
    said = ('{"category": "ASIA", "confidence": 0.75}', '{"category": "ASIA/NATION_12", "confidence": 3}', '{"category": "NATION_12", "confidence": 1}', '{"category": "ASIA', None)
    return [said[int(n) % 5] for n in names]


@query("""SELECT DISTINCT user_id::VARCHAR AS merchant_name, CASE user_id % 5 WHEN 0 THEN 'r' || r_regionkey ELSE 'n' || n_nationkey END AS category_id, CASE user_id % 5 WHEN 0 THEN 0.75 ELSE 1.0 END::DOUBLE AS confidence
    FROM events, region, nation WHERE event_type <> 'view' AND user_id % 5 < 2 AND r_name = 'ASIA' AND n_name = 'NATION_12' AND user_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 3 = 0)""")
def classifier_worklist(spark, sf_dir):
    """UDF-3: categories of names that neither earlier stages nor the cache have; what can't be read or isn't in the taxonomy stays open."""
    rows = ledger(spark, sf_dir)
    said = t(spark, sf_dir, "embeddings").filter("vec_id % 3 = 0").select(F.col("vec_id").cast("string").alias("merchant_name"), F.lit("m").alias("model"))
    categories = tree(spark, sf_dir).filter("NOT startswith(id, 'c')")
    decided = [rows.filter("account_name = 'view'").select("transaction_id")]
    new, _ = enrich.classify_missing(rows, decided, "transaction_id", conform(said, APP["merchant_llm_categories"]), categories, _reply, enrich.MERCHANT_CATEGORIES, "m", NOW)
    return new.select("merchant_name", "category_id", "confidence")


@query(f"""WITH tx AS ({LEDGER_SQL}), m AS (SELECT merchant_name AS name, count(*) AS n FROM tx GROUP BY ALL), e AS (SELECT vec_id::VARCHAR AS name, embedding::DOUBLE[] AS e, n FROM embeddings JOIN m ON name = vec_id::VARCHAR),
    p AS (SELECT CASE WHEN a.n >= b.n THEN b.name ELSE a.name END AS merchant_name, CASE WHEN a.n >= b.n THEN a.name ELSE b.name END AS canonical_name, list_cosine_similarity(a.e, b.e) AS s FROM e a JOIN e b ON a.name < b.name)
    SELECT merchant_name, canonical_name, round(s, 6) AS similarity FROM (SELECT * FROM p WHERE s >= 0.25 AND merchant_name NOT IN ('30', '40', 'SEVENS') QUALIFY row_number() OVER (PARTITION BY merchant_name ORDER BY s DESC, canonical_name) = 1)
    ORDER BY s DESC, merchant_name LIMIT 20""")
def merge_queue(spark, sf_dir):
    """SRT-3, JN-7: the twenty surest merges, towards the name with more transactions."""
    vectors = t(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("merchant_name"), F.lit("x").alias("model"), "embedding")
    done = spark.createDataFrame([(m[2],) for m in MERGES], "merchant_name string")
    found = merges.candidates(vectors, silver.merchants(ledger(spark, sf_dir)), done, "x", 0.25)
    return found.withColumn("similarity", F.round("similarity", 6))


# --- reports ------------------------------------------------------------------------------------------------------------------

@query(f"""WITH tx AS ({LEDGER_SQL}) SELECT transaction_id, merchant_name, posted_on, amount FROM tx
    WHERE lower(merchant_name) LIKE '%1_%' AND posted_on BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND abs(amount) >= 20""")
def merchant_search(spark, sf_dir):
    """FLT-8: part of a name, as LIKE has it, with bounds."""
    return curated.search(ledger(spark, sf_dir), merchant="1_", start="2024-01-05", end="2024-01-20", min_amount=20).select("transaction_id", "merchant_name", "posted_on", "amount")


_MONTHLY_SQL = """m AS (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, sum(CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice::DECIMAL(18,2) ELSE 0 END)::DECIMAL(38,2) AS total_outflow,
    sum(CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice::DECIMAL(18,2) ELSE 0 END)::DECIMAL(38,2) AS total_inflow, sum(CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice ELSE -o_totalprice END::DECIMAL(18,2))::DECIMAL(38,2) AS net_amount,
    count(*) AS transaction_count FROM orders GROUP BY 1)"""


def _monthly(spark, sf_dir) -> DataFrame:
    from tallyframe.queries import order_items

    return gold.monthly_flow(order_items(spark, sf_dir).withColumn("is_transfer", F.lit(False)))


@query(f"WITH {_MONTHLY_SQL} SELECT sum(total_outflow)::DECIMAL(38,2) AS total_outflow, sum(total_inflow)::DECIMAL(38,2) AS total_inflow, sum(net_amount)::DECIMAL(38,2) AS net_amount, count(*) AS n_months, min(month) AS first_month FROM m")
def overview(spark, sf_dir):
    """AGG-14: totals over months, these in order."""
    rows = curated.overview(_monthly(spark, sf_dir))
    return rows.select("total_outflow", "total_inflow", "net_amount", F.size("months").cast("long").alias("n_months"), F.get("months", F.lit(0))["month"].alias("first_month"))


@query(f"""WITH {_MONTHLY_SQL} SELECT * FROM (SELECT 'largest net' AS kind, month, net_amount, total_outflow FROM m ORDER BY abs(net_amount) DESC, month LIMIT 1)
    UNION ALL SELECT * FROM (SELECT 'most spent', month, net_amount, total_outflow FROM m ORDER BY total_outflow DESC, month LIMIT 1)
    UNION ALL SELECT * FROM (SELECT 'least spent', month, net_amount, total_outflow FROM m ORDER BY total_outflow, month LIMIT 1)""")
def extreme_months(spark, sf_dir):
    """SRT-5: extremes, the net one by its absolute value."""
    orders = {"largest net": F.abs("net_amount").desc(), "most spent": F.col("total_outflow").desc(), "least spent": F.col("total_outflow").asc()}
    return curated.extremes(_monthly(spark, sf_dir), orders, ["month", "net_amount", "total_outflow"])


@query("""WITH v AS (SELECT value AS v, count(*) OVER () AS n, row_number() OVER (ORDER BY value) AS k FROM events WHERE value IS NOT NULL), c AS (SELECT median(value) AS median FROM events)
    SELECT any_value(n) AS n, any_value(median) AS median, (SELECT median(abs(value - median)) FROM events, c) AS mad, max(v) FILTER (k = ceil(0.8 * n)) AS q80, max(v) FILTER (k = ceil(0.999 * n)) AS q999 FROM v, c""")
def ranks_of_all(spark, sf_dir):
    """AGG-16, AGG-18: median, MAD and nearest ranks of a whole table as one group."""
    e = t(spark, sf_dir, "events").select("value")
    q = order_statistics(e, [], "value", {"q80": nearest_rank(0.8), "q999": nearest_rank(0.999)})
    return median_and_mad(e, [], "value").join(q, "n").select("n", "median", "mad", "q80", "q999")


@query("""WITH c AS (SELECT event_type, median(value) AS median FROM events GROUP BY ALL) SELECT event_type, count(*) AS n, any_value(median) AS median, median(abs(value - median)) AS mad FROM events JOIN c USING (event_type) GROUP BY event_type""")
def spread_by_type(spark, sf_dir):
    """AGG-16: median and MAD of large groups."""
    return median_and_mad(t(spark, sf_dir, "events"), ["event_type"], "value")


# --- forecasts ----------------------------------------------------------------------------------------------------------------

FIRST, AHEAD = dt.date(1998, 8, 1), 6
_FLOWS_SQL = """f AS (SELECT o_custkey, list_extract(['monthly', 'quarterly', 'yearly', 'weekly', 'other'], (o_custkey % 5 + 1)::INTEGER) AS cadence, (o_custkey % 7) * 1.25::DOUBLE AS amount,
    greatest(1.0, (o_custkey % 60) * 0.75)::DOUBLE AS gap, max(CAST(o_orderdate AS DATE)) AS day, o_custkey % 3 AS series FROM orders GROUP BY ALL)"""


@query(f"""WITH RECURSIVE {_FLOWS_SQL}, w AS (SELECT *, day AS due FROM f WHERE DATE '1998-08-01' - day <= 2 * gap
        UNION ALL SELECT * REPLACE (CAST(CASE cadence WHEN 'monthly' THEN due + INTERVAL 1 MONTH WHEN 'quarterly' THEN due + INTERVAL 3 MONTH WHEN 'yearly' THEN due + INTERVAL 12 MONTH ELSE due + floor(gap)::INTEGER END AS DATE) AS due)
        FROM w WHERE due < DATE '1999-02-01')
    SELECT series, date_trunc('month', due)::DATE AS month, sum(amount) AS amount FROM w WHERE due > day AND due >= DATE '1998-08-01' AND due < DATE '1999-02-01' GROUP BY ALL""")
def committed_projection(spark, sf_dir):
    """UDTF-1: what recurring flows will charge, each date from the one before, as rows by month."""
    o = t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").cast("date").alias("last_seen_on"))
    cadence = F.get(F.array(*map(F.lit, ("monthly", "quarterly", "yearly", "weekly", "other"))), (F.col("o_custkey") % 5).cast("int"))
    flows = o.select(cadence.alias("cadence"), (F.col("o_custkey") % 7 * F.lit(1.25)).alias("amount"), F.greatest(F.lit(1.0), F.col("o_custkey") % 60 * F.lit(0.75)).alias("avg_gap_days"), "last_seen_on", (F.col("o_custkey") % 3).alias("series"))
    return forecast.projected(flows, ["series"], FIRST, AHEAD)


def _history(spark, sf_dir) -> DataFrame:
    key = F.col("region").cast("string")
    return series(spark, sf_dir).select(
        F.lit("budget").alias("series_kind"), key.alias("series_key"), F.concat(F.lit("R"), key).alias("series_label"), F.lit(None).cast("string").alias("category_id"), "month",
        F.lit(0.0).alias("committed"), F.col("spent").cast("double").alias("variable"), F.lit(None).cast("array<double>").alias("due"),
    )


_FORECAST_SQL = f"""{_SERIES_SQL}, y AS (SELECT region, month, spent::DOUBLE AS v, row_number() OVER w AS k, count(*) OVER (PARTITION BY region) AS n, lag(spent::DOUBLE) OVER w AS p1,
        avg(spent::DOUBLE) OVER (PARTITION BY region ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS p3 FROM s WINDOW w AS (PARTITION BY region ORDER BY month)),
    g AS (SELECT region, avg(abs(v - p1)) AS scale, avg(v) AS mean, max(month) AS through, max_by(v, k) AS last FROM y GROUP BY region),
    m3 AS (SELECT region, avg(v) AS mean3 FROM y WHERE k > n - 3 GROUP BY region),
    err AS (SELECT region, 'naive' AS model, 1 AS place, avg(abs(v - p1)) AS e, list_sort(list(abs(v - p1)))[5] AS q FROM y WHERE k > n - 6 GROUP BY region
        UNION ALL SELECT region, 'mean3', 2, avg(abs(v - p3)), list_sort(list(abs(v - p3)))[5] FROM y WHERE k > n - 6 GROUP BY region),
    slope AS (SELECT a.region, 12 * median((b.v - a.v) / (b.k - a.k)) AS year FROM y a JOIN y b ON a.region = b.region AND a.k < b.k GROUP BY a.region),
    best AS (SELECT region, model, e / scale AS mase, greatest(q, 0.5 * scale) AS w, CASE model WHEN 'naive' THEN last ELSE mean3 END AS point, scale, mean, through, year
        FROM err JOIN g USING (region) JOIN m3 USING (region) JOIN slope USING (region) QUALIFY row_number() OVER (PARTITION BY region ORDER BY e, place) = 1),
    fc AS (SELECT region, model, mase, h, (through + to_months(h::INTEGER))::DATE AS period_start, round(greatest(0, point), 2)::DECIMAL(18,2) AS predicted, round(w * sqrt(h), 2)::DECIMAL(18,2) AS w,
        CASE WHEN year > 0.1 * abs(mean) THEN 'rising' WHEN year < -0.1 * abs(mean) THEN 'falling' ELSE 'flat' END AS trend, mean FROM best, range(1, 4) AS r(h))"""


@query(f"""WITH {_FORECAST_SQL} SELECT region::VARCHAR AS series_key, period_start, h::INTEGER AS horizon, predicted, greatest(0, predicted - w)::DECIMAL(18,2) AS lower, (predicted + w)::DECIMAL(18,2) AS upper,
    model AS model_name, round(mase, 6) AS mase, trend FROM fc""")
def forecast_rows(spark, sf_dir):
    """UDAF-1, UDAF-3, UDAF-5, UDAF-6, UDTF-2: models chosen by rolling-origin error, here of the two that SQL can say."""
    rows = forecast.forecast(_history(spark, sf_dir), models=forecast.MODELS[:2])
    return rows.select("series_key", "period_start", "horizon", "predicted", "lower", "upper", "model_name", F.round("mase", 6).alias("mase"), "trend")


@query()
def forecasts_by_all_models(spark, sf_dir):
    """UDAF-2: smoothing models as well, which SQL can't fit."""
    return forecast.forecast(_history(spark, sf_dir)).drop("category_id")


NEXT = dt.date(1999, 2, 10)


@query("""WITH f AS (SELECT o_custkey::VARCHAR AS series_key, date_trunc('month', o_orderdate)::DATE AS period_start, sum(o_totalprice::DECIMAL(18,2))::DECIMAL(38,2) AS predicted FROM orders GROUP BY ALL)
    SELECT series_key, period_start, predicted FROM f WHERE period_start >= DATE '1996-05-01' QUALIFY row_number() OVER (PARTITION BY series_key ORDER BY period_start) = 1""")
def next_forecasts(spark, sf_dir):
    """WIN-9: of each series the forecast of this month or the first one after it."""
    f = t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("series_key"), F.trunc("o_orderdate", "month").alias("period_start"))
    f = f.agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("decimal(38,2)").alias("predicted")).withColumn("series_kind", F.lit("budget"))
    return callouts.next_forecasts(f, dt.date(1996, 5, 17)).select("series_key", "period_start", "predicted")


_CAPS = [("0", "90000.00", "monthly"), ("1", "4000.00", "weekly"), ("2", "30000.00", "quarterly"), ("3", "999999999.00", "yearly"), ("4", "1.00", "yearly")]
FEED = Params(anomaly_z=1.0, anomaly_months=60)


@query(f"""WITH {_FORECAST_SQL}, b(id, amount, period) AS (VALUES {", ".join(map(str, _CAPS))}),
    cap AS (SELECT id, amount::DOUBLE / CASE period WHEN 'weekly' THEN 7 / (365.25 / 12) WHEN 'monthly' THEN 1 WHEN 'quarterly' THEN 3 ELSE 12 END AS cap FROM b),
    nx AS (SELECT *, greatest(0, predicted - w) AS lower FROM fc WHERE h = 2),
    c AS (SELECT region, median(v) AS center, max(month) AS last FROM y GROUP BY region), d AS (SELECT y.region, month, v, center, last, v - center AS dev FROM y JOIN c USING (region)),
    k AS (SELECT region, median(abs(dev)) AS mad, avg(abs(dev)) AS ad FROM d GROUP BY region),
    z AS (SELECT d.*, dev / (CASE WHEN mad > 0 THEN mad / 0.6745 ELSE ad * 1.253314 END) AS z FROM d JOIN k USING (region)),
    rows_ AS (SELECT CASE WHEN z > 0 THEN 'SPIKE' ELSE 'DIP' END AS kind, CASE WHEN z > 0 THEN 'WARNING' ELSE 'INFO' END AS level, region::VARCHAR AS series_key, abs(z) AS rank, v AS amount, center AS expected, month AS "on"
        FROM z WHERE month > last - INTERVAL 60 MONTH AND abs(dev) >= 50 AND abs(z) >= 1.0
        UNION ALL SELECT 'TREND_' || upper(trend), 'INFO', region::VARCHAR, abs((predicted::DOUBLE - mean) / mean), predicted::DOUBLE, mean, period_start FROM nx WHERE trend <> 'flat' AND mean > 0
        UNION ALL SELECT 'BUDGET_RISK', CASE WHEN lower::DOUBLE > cap THEN 'CRITICAL' ELSE 'WARNING' END, id, (predicted::DOUBLE - cap) / cap, predicted::DOUBLE, cap, period_start FROM nx JOIN cap ON id = region::VARCHAR WHERE predicted::DOUBLE > cap)
    SELECT kind, level, series_key, round(rank, 6) AS rank, round(amount, 4) AS amount, round(expected, 4) AS expected, "on" FROM rows_""")
def callout_feed(spark, sf_dir):
    """UDF-4, UDF-5: anomalies, trends and budgets at risk in one feed."""
    history = _history(spark, sf_dir)
    budgets = spark.createDataFrame(_CAPS, "id string, amount string, period string").withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    rows = callouts.callouts(history, forecast.forecast(history, models=forecast.MODELS[:2]), budgets, NEXT, p=FEED)
    return rows.select("kind", "level", "series_key", F.round("rank", 6).alias("rank"), F.round("amount", 4).alias("amount"), F.round("expected", 4).alias("expected"), F.col("on").cast("date").alias("on"))


# --- tables that change, parameters, checks -----------------------------------------------------------------------------------

@query("""WITH old AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'mine' END AS note FROM customer WHERE c_custkey % 3 > 0),
    new AS (SELECT c_custkey AS id, upper(c_name) || '!' AS name, CASE WHEN c_custkey % 5 = 0 THEN 'theirs' END AS note FROM customer WHERE c_custkey % 3 < 2)
    SELECT coalesce(new.id, old.id) AS id, coalesce(new.name, old.name) AS name, coalesce(new.note, old.note) AS note FROM old FULL JOIN new USING (id)
    UNION ALL SELECT s_suppkey + 1000000, s_name, NULL FROM supplier""")
def upserted(spark, sf_dir):
    """SNK-4 to SNK-7: an upsert that keeps notes, rows that are added once however often they come, each replacing the table in one step."""
    from tallyframe.operators.store import checkpoint_folder
    from tallyframe.sources import landing

    c, s = t(spark, sf_dir, "customer"), t(spark, sf_dir, "supplier")
    row = lambda df, id_, name, note: df.select(id_.cast("long").alias("id"), name.alias("name"), note.alias("note"))
    key = F.col("c_custkey")
    old = row(c.filter("c_custkey % 3 > 0"), key, F.col("c_name"), F.when(key % 2 == 0, "mine"))
    new = row(c.filter("c_custkey % 3 < 2"), key, F.concat(F.upper("c_name"), F.lit("!")), F.when(key % 5 == 0, "theirs"))
    more = row(s, F.col("s_suppkey") + 1_000_000, F.col("s_name"), F.lit(None).cast("string"))
    path = f"{checkpoint_folder(spark)}/table-{uuid.uuid4().hex}"
    now = lambda: landing.read_or_empty(spark, path, old.schema)
    landing.replace(old, path)
    landing.replace(landing.upsert(now(), new, ["id"]), path)
    for _ in range(2):
        landing.replace(landing.insert_missing(now(), more, ["id"]), path)
    landing.replace(more.filter("false"), path, skip_empty=True)
    return now()


@query("""SELECT l_orderkey AS website_order_id, CAST(l_shipdate AS DATE) AS ship_date, count(*) AS item_count, arg_min(l_returnflag, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) FILTER (l_linenumber > 1) AS order_status,
    sum(l_extendedprice::DECIMAL(18,2))::DECIMAL(38,2) AS items_subtotal FROM lineitem GROUP BY ALL""")
def shipments(spark, sf_dir):
    """AGG-1, AGG-3: items to shipments; what repeats on each item is the first item's that has it."""
    nothing = F.lit(None).cast("string")
    given = {"order_status": F.when(F.col("l_linenumber") > 1, F.col("l_returnflag")), "shipment_item_subtotal": F.col("l_extendedprice").cast("decimal(18,2)"), "shipment_item_subtotal_tax": F.lit(0).cast("decimal(18,2)")}
    others = ("order_date", "total_owed", "shipping_charge", "total_discounts", "currency", "shipment_status")
    items = t(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("website_order_id"), F.col("l_shipdate").cast("date").alias("ship_date"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("order_item_id"),
        *(c.alias(n) for n, c in given.items()), *(nothing.alias(n) for n in others),
    )
    return silver.shipments(items).select("website_order_id", "ship_date", "item_count", "order_status", "items_subtotal")


@query("""SELECT o_orderpriority, count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DECIMAL(38,2) AS total FROM orders WHERE o_orderdate >= DATE '1995-03-01' AND o_totalprice >= 1000.50 GROUP BY 1""")
def named_parameters(spark, sf_dir):
    """PARM-1: a statement with typed parameters, one of them left out."""
    from tallyframe.plans.serve import Query, bind

    t(spark, sf_dir, "orders").createOrReplaceTempView("orders_of_parameters")
    text = """SELECT o_orderpriority, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total FROM orders_of_parameters
        WHERE (:start IS NULL OR o_orderdate >= :start) AND (:end IS NULL OR o_orderdate <= :end) AND (:least IS NULL OR o_totalprice >= :least) GROUP BY o_orderpriority"""
    return bind(spark, Query(text, {"start": "date", "end": "date", "least": "decimal"}), start="1995-03-01", least="1000.50")


@query("""WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 100 = 7 THEN c_custkey ELSE c_nationkey END AS parent FROM customer), o AS (SELECT * FROM orders)
    SELECT 'own parents' AS check_name, count(*) AS offending FROM c WHERE c_custkey = parent UNION ALL SELECT 'unique', count(*) FROM (SELECT o_custkey FROM o GROUP BY o_custkey HAVING count(*) > 1)
    UNION ALL SELECT 'related', count(*) FROM c WHERE parent NOT IN (SELECT n_nationkey FROM nation) UNION ALL SELECT 'accepted', count(*) FROM o WHERE o_orderstatus NOT IN ('F', 'O')
    UNION ALL SELECT 'between', count(*) FROM o WHERE o_totalprice NOT BETWEEN 1000 AND 100000 UNION ALL SELECT 'totals', count(*) FROM (SELECT sum(o_totalprice) AS a FROM o) x, (SELECT sum(l_extendedprice) AS b FROM lineitem) y WHERE round(a, 2) <> round(b, 2)""")
def data_checks(spark, sf_dir):
    """REC-3, JN-19 and the checks of marts: how many rows offend."""
    from tallyframe.plans import validate

    key = F.col("c_custkey")
    c = t(spark, sf_dir, "customer").select(key.cast("string").alias("id"), F.when(key % 100 == 7, key).otherwise(F.col("c_nationkey")).cast("string").alias("parent_id"))
    o = t(spark, sf_dir, "orders")
    roots = o.select(F.lit(None).cast("string").alias("parent_id"), F.col("o_totalprice").cast("decimal(18,2)").alias("net_amount"))
    items = t(spark, sf_dir, "lineitem").select(F.lit("x").alias("category_id"), F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"))
    checks = {
        "own parents": validate.own_parents(c), "unique": validate.unique(o, "o_custkey"), "related": validate.related(c, "parent_id", t(spark, sf_dir, "nation").withColumn("k", F.col("n_nationkey").cast("string")), "k"),
        "accepted": validate.accepted(o, "o_orderstatus", "F", "O"), "between": validate.between(o, "o_totalprice", 1000, 100000), "totals": validate.roots_cover(roots, items),
    }
    out = None
    for name, rows in checks.items():
        one = rows.agg(F.count(F.lit(1)).alias("offending")).select(F.lit(name).alias("check_name"), "offending")
        out = one if out is None else out.union(one)
    return out
