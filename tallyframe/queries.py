"""The ledger's operators on the star-schema tables: one Spark query each, with the DuckDB SQL that gives the same rows.

Adapters: `events` is a ledger (purchase: outflow; all else: inflow; account: event type; merchant: user), `orders` another one,
region/nation/customer a category tree, `lineitem` the items of orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions.exprs import merchant_steps, month_of, normalize_merchant, total
from tallyframe.operators import core
from tallyframe.operators.ranks import nearest_rank, order_statistics
from tallyframe.params import Params
from tallyframe.plans import gold, silver

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- adapters -----------------------------------------------------------------------------------------------------------------

_TEXT_SQL = "CASE event_id % 4 WHEN 0 THEN 'Transfer from PURCHASE' WHEN 1 THEN 'to click, thanks' WHEN 2 THEN event_type END"
LEDGER_SQL = f"""SELECT event_id::VARCHAR AS transaction_id, event_type AS account_name, 'USD' AS currency, user_id::VARCHAR AS merchant_name,
    CAST(ts AS DATE) AS posted_on, (CASE WHEN event_type = 'purchase' THEN -value ELSE value END)::DECIMAL(18,2) AS amount, {_TEXT_SQL} AS description_raw
    FROM events"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "events")
    amount = F.when(F.col("event_type") == "purchase", -F.col("value")).otherwise(F.col("value")).cast("decimal(18,2)")
    return rows.select(
        F.col("event_id").cast("string").alias("transaction_id"), F.col("event_type").alias("account_name"), F.lit("USD").alias("currency"),
        F.col("user_id").cast("string").alias("merchant_name"), F.col("ts").cast("date").alias("posted_on"), amount.alias("amount"),
        F.when(amount < 0, "outflow").otherwise("inflow").alias("flow"), F.lit(False).alias("is_transfer"), F.expr(_TEXT_SQL).alias("description_raw"),
    )


TREE_SQL = """SELECT 'r' || r_regionkey AS id, r_name AS name, CAST(NULL AS VARCHAR) AS parent_id FROM region
    UNION ALL SELECT 'n' || n_nationkey, n_name, 'r' || n_regionkey FROM nation
    UNION ALL SELECT 'c' || c_custkey, c_name, 'n' || c_nationkey FROM customer"""

CLOSURE_SQL = f"""nodes AS ({TREE_SQL}),
    up AS (SELECT id AS category_id, id AS ancestor_id FROM nodes UNION ALL SELECT up.category_id, nodes.parent_id FROM up JOIN nodes ON nodes.id = up.ancestor_id WHERE nodes.parent_id IS NOT NULL),
    paths AS (SELECT id, name, parent_id, name AS path, 0 AS depth FROM nodes WHERE parent_id IS NULL
        UNION ALL SELECT n.id, n.name, n.parent_id, p.path || '/' || n.name, p.depth + 1 FROM nodes n JOIN paths p ON n.parent_id = p.id)"""

ITEMS_SQL = """items AS (SELECT o_orderkey::VARCHAR AS line_item_id, 'c' || o_custkey AS category_id, CAST(o_orderdate AS DATE) AS posted_on,
    (CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice ELSE -o_totalprice END)::DECIMAL(18,2) AS amount, o_orderpriority AS account_name FROM orders)"""


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n, c = (t(spark, sf_dir, x) for x in ("region", "nation", "customer"))
    key = lambda p, x: F.concat(F.lit(p), F.col(x).cast("string"))
    rows = r.select(key("r", "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent_id"))
    rows = rows.union(n.select(key("n", "n_nationkey"), "n_name", key("r", "n_regionkey")))
    return rows.union(c.select(key("c", "c_custkey"), "c_name", key("n", "c_nationkey")))


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice")).otherwise(-F.col("o_totalprice")).cast("decimal(18,2)")
    return t(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("line_item_id"), F.col("o_orderkey").cast("string").alias("transaction_id"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("category_id"), F.col("o_orderdate").cast("date").alias("posted_on"), price.alias("amount"),
        F.col("o_orderpriority").alias("account_name"),
    )


# --- silver -------------------------------------------------------------------------------------------------------------------

@query("""SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_shipdate AS DATE) AS shipped, l_quantity FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC NULLS LAST, l_partkey DESC NULLS LAST, l_suppkey DESC NULLS LAST,
        l_quantity DESC NULLS LAST, l_extendedprice DESC NULLS LAST) = 1""")
def dedup_latest(spark, sf_dir):
    """WIN-1: the latest row of each key."""
    rows = core.latest_per_key(t(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], "l_shipdate", ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_shipdate").cast("date").alias("shipped"), "l_quantity")


def _merchant_sql(x: str) -> str:
    x = f"upper({x})"
    for pattern, replacement, everywhere in merchant_steps():
        pattern = pattern.replace("'", "''")
        x = f"regexp_replace({x}, '{pattern}', '{replacement}'{", 'g'" if everywhere else ''})"
    return f"nullif(trim({x}), '')"


_RAW_SQL = """CASE c_custkey % 5 WHEN 0 THEN 'SQ *' || c_mktsegment || ' 1234 AUSTIN TX' WHEN 1 THEN 'PAYPAL * ' || c_mktsegment || ' WEB ID: 99'
    WHEN 2 THEN c_name || '.COM STORE #42' WHEN 3 THEN c_mktsegment || ' POS' ELSE 'TST* ' || c_name || ' USA' END"""


@query(f"SELECT c_custkey, raw, {_merchant_sql('raw')} AS merchant_name FROM (SELECT c_custkey, {_RAW_SQL} AS raw FROM customer)")
def merchant_names(spark, sf_dir):
    """The merchant normalisation chain over decorated descriptors."""
    raw = F.expr(_RAW_SQL)
    return t(spark, sf_dir, "customer").select("c_custkey", raw.alias("raw")).withColumn("merchant_name", normalize_merchant(F.col("raw")))


RULES = [("a", "^forest", "p_name", 3, "green"), ("b", "BRASS", "p_type", 1, "metal"), ("c", "Brand#1", "p_brand", 2, "first"), ("d", "(STEEL|COPPER)$", "p_type", 1, "metal2"), ("e", ".", "p_name", 9, "rest")]


def _rules(spark):
    return spark.createDataFrame(RULES, "id string, pattern string, applies_to string, priority int, category_id string")


_RULES_SQL = "rules(id, pattern, applies_to, priority, category_id) AS (VALUES " + ", ".join(map(str, RULES)) + ")"
PARTS = silver.Subjects("p_partkey", "p_name", ("p_name", "p_type", "p_brand"), "part")


@query(f"""WITH {_RULES_SQL}, f AS (SELECT p_partkey, 'p_name' AS field, p_name AS value FROM part UNION ALL SELECT p_partkey, 'p_type', p_type FROM part
        UNION ALL SELECT p_partkey, 'p_brand', p_brand FROM part)
    SELECT p_partkey, category_id, id AS rule_id, pattern AS matched_pattern, 'rule' AS categorization_source, 1.0::DOUBLE AS categorization_confidence
    FROM f JOIN rules ON applies_to = field AND regexp_matches(value, pattern)
    QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY priority, id, field) = 1""")
def rule_cascade(spark, sf_dir):
    """JN-4, stage 1 of the cascade: regex rules on several fields, first match wins."""
    return silver.by_rule(t(spark, sf_dir, "part"), _rules(spark), PARTS)


@query(f"""WITH {_RULES_SQL} SELECT p_partkey, category_id FROM part JOIN rules ON regexp_matches(p_type, pattern)
    QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY priority, id) = 1""")
def regex_first_match(spark, sf_dir):
    """JN-3: a theta join on patterns from a column."""
    return core.first_match(t(spark, sf_dir, "part"), _rules(spark), "p_partkey", F.col("p_type"), ["category_id"])


#: CTEs up to `pairs`, the transfers of the ledger `tx`.
TRANSFERS_SQL = f"""tx AS ({LEDGER_SQL}), o AS (SELECT * FROM tx WHERE amount < 0), i AS (SELECT * FROM tx WHERE amount > 0),
    c AS (SELECT o.transaction_id AS outflow_id, i.transaction_id AS inflow_id, o.account_name AS from_account, i.account_name AS to_account, i.amount,
        o.posted_on AS sent_on, i.posted_on AS received_on, abs(i.posted_on - o.posted_on)::BIGINT AS day_gap,
        coalesce(regexp_matches(upper(i.description_raw), '\\b' || upper(o.account_name) || '\\b'), false) OR coalesce(regexp_matches(upper(o.description_raw), '\\b' || upper(i.account_name) || '\\b'), false) AS name_match
        FROM o JOIN i ON i.amount = -o.amount AND i.currency = o.currency AND i.account_name <> o.account_name AND abs(i.posted_on - o.posted_on) <= 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY outflow_id ORDER BY name_match DESC, day_gap, inflow_id) AS a, row_number() OVER (PARTITION BY inflow_id ORDER BY name_match DESC, day_gap, outflow_id) AS b FROM c),
    pairs AS (SELECT md5(outflow_id || '|' || inflow_id) AS transfer_id, outflow_id, inflow_id, from_account, to_account, 'USD' AS currency, amount, sent_on, received_on, day_gap,
        name_match, CASE WHEN name_match THEN 'high' ELSE 'medium' END AS confidence FROM r WHERE a = 1 AND b = 1)"""


@query(f"WITH {TRANSFERS_SQL} SELECT * FROM pairs")
def transfer_pairs(spark, sf_dir):
    """JN-1, JN-M: transfers between accounts by amount, days and what the descriptions say, mutual best."""
    return silver.transfers(ledger(spark, sf_dir))


@query("""SELECT l_orderkey AS website_order_id, CAST(l_shipdate AS DATE) AS ship_date, count(*) AS item_count, max(l_returnflag) AS status,
    sum(l_extendedprice::DECIMAL(18,2))::DECIMAL(38,2) AS subtotal FROM lineitem GROUP BY ALL""")
def shipment_totals(spark, sf_dir):
    """AGG-1, AGG-3: items to shipments."""
    rows = t(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_shipdate").cast("date").alias("ship_date"), "l_returnflag", F.col("l_extendedprice").cast("decimal(18,2)").alias("price"))
    return rows.groupBy(F.col("l_orderkey").alias("website_order_id"), "ship_date").agg(F.count(F.lit(1)).alias("item_count"), F.max("l_returnflag").alias("status"), total(F.col("price")).alias("subtotal"))


@query("""WITH s AS (SELECT l_orderkey::VARCHAR AS k, CAST(min(l_shipdate) AS DATE) AS ship_date FROM lineitem GROUP BY ALL),
    c AS (SELECT s.k AS shipment, o.o_orderkey AS order_id, s.ship_date, CAST(o.o_orderdate AS DATE) AS ordered, abs(CAST(o.o_orderdate AS DATE) - s.ship_date)::BIGINT AS day_gap
        FROM s JOIN orders o ON o.o_custkey % 97 = s.k::BIGINT % 97 AND abs(CAST(o.o_orderdate AS DATE) - s.ship_date) <= 5),
    r AS (SELECT *, row_number() OVER (PARTITION BY shipment ORDER BY day_gap, order_id) AS a, row_number() OVER (PARTITION BY order_id ORDER BY day_gap, shipment) AS b FROM c)
    SELECT shipment, order_id, ship_date, ordered, day_gap FROM r WHERE a = 1 AND b = 1""")
def order_match(spark, sf_dir):
    """JN-2: shipments to charges in a window of days, mutual best."""
    s = t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("shipment")).agg(F.min("l_shipdate").cast("date").alias("ship_date"))
    s = s.withColumn("ka", F.col("shipment").cast("long") % 97)
    o = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").cast("date").alias("ordered"), (F.col("o_custkey") % 97).alias("kb"))
    s, o = core.first_alike(s, "shipment", ["ka", "ship_date"]), core.first_alike(o, "order_id", ["kb", "ordered"])
    pairs = core.band_pairs(s, o, [("ka", "kb")], "ship_date", "ordered", 5)
    return core.mutual_best(pairs, "shipment", "order_id", [F.col("day_gap")]).select("shipment", "order_id", "ship_date", "ordered", "day_gap")


@query("""WITH r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS item,
        round(o_totalprice * 100)::BIGINT AS charge, round(l_extendedprice * 100)::BIGINT AS cents FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    p AS (SELECT *, sum(cents) OVER w AS s, count(*) OVER w AS n FROM r WINDOW w AS (PARTITION BY l_orderkey)),
    q AS (SELECT *, (CASE WHEN s = 0 THEN charge // n ELSE (charge * cents + s // 2) // s END)::BIGINT AS part FROM p)
    SELECT l_orderkey, item::BIGINT AS item, (part + CASE WHEN item = n THEN charge - sum(part) OVER (PARTITION BY l_orderkey) ELSE 0 END)::BIGINT AS share_cents FROM q""")
def exact_allocation(spark, sf_dir):
    """WIN-6, WIN-7: a charge over its items, exact to the cent."""
    from pyspark.sql import Window

    rows = core.dealt(t(spark, sf_dir, "lineitem"), ["l_orderkey"]).join(t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    item = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")).cast("long")
    rows = rows.select("l_orderkey", item.alias("item"), F.round(F.col("o_totalprice") * 100).cast("long").alias("charge"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    return core.allocate_exact(rows, "l_orderkey", "item", "charge", "cents").select("l_orderkey", "item", "share_cents")


NEAR_SQL = """WITH r AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
    s AS (SELECT c.vec_id, r.vec_id AS ref_name, r.label, list_cosine_similarity(c.e, r.e) AS sim FROM r c JOIN r ON c.vec_id <> r.vec_id)
    SELECT vec_id, ref_name, label, round(sim, 6) AS similarity FROM s WHERE sim >= 0.3 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, ref_name) = 1"""


@query(NEAR_SQL)
def nearest_category(spark, sf_dir):
    """JN-6, WIN-5, stage 2 of the cascade: of each vector the nearest of all others, from a threshold on."""
    from tallyframe.operators.vectors import nearest_other

    e = t(spark, sf_dir, "embeddings")
    near = nearest_other(e, "vec_id", "embedding", 0.3).join(e.select(F.col("vec_id").alias("a"), "label"), "a")
    return near.select(F.col("b").alias("vec_id"), F.col("a").alias("ref_name"), "label", F.round("similarity", 6).alias("similarity"))


@query("""WITH v AS (SELECT user_id, event_type, count(*) AS votes FROM events GROUP BY ALL)
    SELECT user_id, event_type, votes FROM v QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, event_type) = 1""")
def majority_vote(spark, sf_dir):
    """AGG-6: the most frequent category of each name, ties by name."""
    votes = t(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("votes"))
    return core.first_per(votes, ["user_id"], [F.col("votes").desc(), F.col("event_type")])


@query("""WITH h AS (SELECT doc_id, 'q' || quality AS category_id, 'human' AS source FROM labels),
    rule AS (SELECT doc_id, 'en' AS category_id, 'rule' AS source FROM documents WHERE lang = 'en'),
    emb AS (SELECT doc_id, 'long' AS category_id, 'embedding' AS source FROM documents WHERE n_chars > 3000 AND doc_id NOT IN (SELECT doc_id FROM rule))
    SELECT * FROM h UNION ALL SELECT * FROM (SELECT * FROM rule UNION ALL SELECT * FROM emb) WHERE doc_id NOT IN (SELECT doc_id FROM h)""")
def human_override(spark, sf_dir):
    """JN-14, SET-1: stages in order, people outrank them."""
    d, h = t(spark, sf_dir, "documents"), t(spark, sf_dir, "labels")
    human = h.select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("category_id"), F.lit("human").alias("source"))
    rule = d.filter("lang = 'en'").select("doc_id", F.lit("en").alias("category_id"), F.lit("rule").alias("source"))
    emb = silver.without(d.filter("n_chars > 3000").select("doc_id", F.lit("long").alias("category_id"), F.lit("embedding").alias("source")), [rule], "doc_id")
    return human.unionByName(silver.without(rule.unionByName(emb), [human], "doc_id"))


@query("""WITH c AS (SELECT vec_id, label, ((vec_id * 37) % 100 / 100.0)::DOUBLE AS confidence FROM embeddings)
    SELECT vec_id, label, confidence FROM c WHERE confidence >= 0.5 AND vec_id NOT IN (SELECT doc_id FROM labels)""")
def cached_classes(spark, sf_dir):
    """FLT-10, stage 3 of the cascade: cached classes from a confidence on, minus what is decided."""
    c = t(spark, sf_dir, "embeddings").select("vec_id", "label", ((F.col("vec_id") * 37) % 100 / F.lit(100.0)).alias("confidence"))
    return c.filter("confidence >= 0.5").join(t(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_anti")


@query(f"""WITH tx AS ({LEDGER_SQL}) SELECT merchant_name, count(*) AS transaction_count, sum(CASE WHEN amount < 0 THEN -amount ELSE 0 END)::DECIMAL(38,2) AS total_outflow,
    min(posted_on) AS first_seen_on, max(posted_on) AS last_seen_on, md5(merchant_name) AS merchant_id FROM tx GROUP BY merchant_name""")
def merchant_totals(spark, sf_dir):
    return silver.merchants(ledger(spark, sf_dir))


# --- gold ---------------------------------------------------------------------------------------------------------------------

@query(f"WITH RECURSIVE {CLOSURE_SQL} SELECT id, name, parent_id, path, depth FROM paths")
def category_paths(spark, sf_dir):
    """REC-2: names from the root, and depth."""
    return core.tree_paths(tree(spark, sf_dir)).drop("root")


@query(f"WITH RECURSIVE {CLOSURE_SQL} SELECT category_id, ancestor_id FROM up")
def category_ancestors(spark, sf_dir):
    """REC-1: the closure of a tree."""
    return core.tree_closure(tree(spark, sf_dir))


@query(f"""WITH RECURSIVE {CLOSURE_SQL}, {ITEMS_SQL},
    s AS (SELECT ancestor_id, count(*) AS n, sum(CASE WHEN amount < 0 THEN -amount ELSE 0 END) AS o, sum(CASE WHEN amount > 0 THEN amount ELSE 0 END) AS i, sum(amount) AS a
        FROM items JOIN up USING (category_id) GROUP BY ancestor_id)
    SELECT id AS category_id, parent_id, name, path, depth, coalesce(n, 0)::BIGINT AS transaction_count, coalesce(o, 0)::DECIMAL(38,2) AS total_outflow,
        coalesce(i, 0)::DECIMAL(38,2) AS total_inflow, coalesce(a, 0)::DECIMAL(38,2) AS net_amount FROM paths LEFT JOIN s ON id = ancestor_id""")
def category_rollups(spark, sf_dir):
    """JN-13, AGG-7, AGG-9: subtree totals of every category."""
    nodes = tree(spark, sf_dir)
    return gold.category_rollups(core.tree_paths(nodes), core.tree_closure(nodes), order_items(spark, sf_dir))


@query(f"""WITH tx AS ({LEDGER_SQL}) SELECT date_trunc('month', posted_on)::TIMESTAMP AS month, sum(CASE WHEN amount < 0 THEN -amount ELSE 0 END)::DECIMAL(38,2) AS total_outflow,
    sum(CASE WHEN amount > 0 THEN amount ELSE 0 END)::DECIMAL(38,2) AS total_inflow, sum(amount)::DECIMAL(38,2) AS net_amount, count(*) AS transaction_count FROM tx GROUP BY 1""")
def monthly_flow(spark, sf_dir):
    """AGG-2, AGG-4: flows by month."""
    return gold.monthly_flow(ledger(spark, sf_dir))


BUDGETS = [("b1", "asia", "r2", "monthly", "50000.00", "1995-01-01"), ("b2", "europe", "r3", "weekly", "9000.00", "1996-06-15"), ("b3", "africa", "r0", "quarterly", "200000.00", "1993-01-01"), ("b4", "nation", "n5", "yearly", "300000.00", "1994-01-01")]
_BUDGETS_SQL = "b(id, name, category_id, period, amount, starts_on) AS (SELECT a, b, c, d, e::DECIMAL(18,2), f::DATE FROM (VALUES " + ", ".join(map(str, BUDGETS)) + ") v(a, b, c, d, e, f))"


@query(f"""WITH RECURSIVE {CLOSURE_SQL}, {ITEMS_SQL}, {_BUDGETS_SQL}
    SELECT *, (actual_outflow - budgeted_amount)::DECIMAL(38,2) AS variance FROM (SELECT b.id AS budget_id, b.name, b.category_id, period, b.amount AS budgeted_amount,
        (CASE period WHEN 'weekly' THEN date_trunc('week', posted_on) WHEN 'monthly' THEN date_trunc('month', posted_on) WHEN 'quarterly' THEN date_trunc('quarter', posted_on)
            ELSE date_trunc('year', posted_on) END)::TIMESTAMP AS period_start, sum(-items.amount)::DECIMAL(38,2) AS actual_outflow
    FROM b JOIN up ON b.category_id = up.ancestor_id JOIN items ON items.category_id = up.category_id WHERE items.amount < 0 AND posted_on >= starts_on GROUP BY ALL)""")
def budget_actuals(spark, sf_dir):
    """PRJ-6: budgets against the spending of their subtree, by period."""
    b = spark.createDataFrame(BUDGETS, "id string, name string, category_id string, period string, amount string, starts_on string")
    b = b.withColumns({"amount": F.col("amount").cast("decimal(18,2)"), "starts_on": F.col("starts_on").cast("date")})
    return gold.budget_actuals(b, core.tree_closure(tree(spark, sf_dir)), order_items(spark, sf_dir))


@query(f"""WITH RECURSIVE {CLOSURE_SQL}, {ITEMS_SQL}, r AS (SELECT id AS category_id, split_part(path, '/', 1) AS root FROM paths)
    SELECT 'income' AS stage, root AS source_node, account_name AS target_node, sum(amount)::DECIMAL(38,2) AS value FROM items JOIN r USING (category_id) WHERE amount > 0 GROUP BY ALL
    UNION ALL SELECT 'spending', account_name, root, sum(-amount)::DECIMAL(38,2) FROM items JOIN r USING (category_id) WHERE amount < 0 GROUP BY ALL""")
def sankey_flow(spark, sf_dir):
    """JN-21: edges of the flow of money."""
    items = order_items(spark, sf_dir)
    return gold.sankey_flow(items.drop("account_name"), items.select("transaction_id", "account_name"), core.tree_paths(tree(spark, sf_dir)))


WIDE = Params(cadences={"short": (1, 60), "quarterly": (61, 120), "long": (121, 400)}, regularity=0.9)


@query("""WITH tx AS (SELECT o_custkey::VARCHAR AS merchant_name, 'outflow' AS flow, CAST(o_orderdate AS DATE) AS d, o_orderkey::VARCHAR AS id FROM orders),
    g AS (SELECT *, d - lag(d) OVER (PARTITION BY merchant_name ORDER BY d, id) AS gap FROM tx),
    s AS (SELECT merchant_name, flow, count(*) AS occurrence_count, min(d) AS first_seen_on, max(d) AS last_seen_on, avg(gap) AS a, stddev_pop(gap) AS v FROM g GROUP BY ALL),
    c AS (SELECT *, CASE WHEN a BETWEEN 1 AND 60 THEN 'short' WHEN a BETWEEN 61 AND 120 THEN 'quarterly' WHEN a BETWEEN 121 AND 400 THEN 'long' END AS cadence FROM s WHERE occurrence_count >= 3)
    SELECT md5(merchant_name || '|outflow|-1.00') AS recurring_flow_id, merchant_name, flow, 1.00::DECIMAL(18,2) AS amount, cadence, occurrence_count, first_seen_on, last_seen_on,
        round(a, 6) AS avg_gap_days, round(v, 6) AS gap_days_stddev FROM c WHERE cadence IS NOT NULL AND v <= a * 0.9""")
def recurring_flows(spark, sf_dir):
    """WIN-8, AGG-5, FLT-11: flows at regular gaps."""
    tx = t(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("merchant_name"), F.lit("outflow").alias("flow"), F.lit("-1.00").cast("decimal(18,2)").alias("amount"),
        F.col("o_orderdate").cast("date").alias("posted_on"), F.col("o_orderkey").cast("string").alias("transaction_id"), F.lit(False).alias("is_transfer"),
    )
    return gold.recurring_flows(tx, WIDE).withColumns({c: F.round(c, 6) for c in ("avg_gap_days", "gap_days_stddev")})


@query("""WITH o AS (SELECT o_orderkey, o_totalprice::DECIMAL(18,2) AS p, CAST(o_orderdate AS DATE) AS d FROM orders), l AS (SELECT * FROM lineitem)
    SELECT 's' || l_orderkey || '-' || l_linenumber AS line_item_id, l_orderkey AS transaction_id, l_extendedprice::DECIMAL(18,2) AS amount, d AS posted_on FROM l JOIN o ON l_orderkey = o_orderkey
    UNION ALL SELECT 't' || o_orderkey, o_orderkey, p, d FROM o WHERE o_orderkey NOT IN (SELECT l_orderkey FROM l)""")
def line_items(spark, sf_dir):
    """A split transaction counts by its splits; another by itself."""
    o = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("transaction_id"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"), F.col("o_orderdate").cast("date").alias("posted_on"))
    l_ = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("transaction_id"), F.concat(F.lit("s"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("line_item_id"), F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"))
    split = l_.join(o.select("transaction_id", "posted_on"), "transaction_id").select("line_item_id", "transaction_id", "amount", "posted_on")
    whole = o.join(l_.select("transaction_id").distinct(), "transaction_id", "left_anti").select(F.concat(F.lit("t"), F.col("transaction_id").cast("string")).alias("line_item_id"), "transaction_id", "amount", "posted_on")
    return split.unionByName(whole)


# --- series -------------------------------------------------------------------------------------------------------------------

SPINE = ("1992-01-01", "1998-12-01")
_SERIES_SQL = f"""m AS (SELECT unnest(generate_series(DATE '{SPINE[0]}', DATE '{SPINE[1]}', INTERVAL 1 MONTH))::DATE AS month),
    f AS (SELECT n_regionkey AS region, date_trunc('month', o_orderdate)::DATE AS month, sum(o_totalprice::DECIMAL(18,2))::DECIMAL(38,2) AS spent
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
    s AS (SELECT r_regionkey AS region, m.month, coalesce(spent, 0)::DECIMAL(38,2) AS spent FROM region CROSS JOIN m LEFT JOIN f ON f.region = r_regionkey AND f.month = m.month)"""


def series(spark, sf_dir) -> DataFrame:
    o, c, n = (t(spark, sf_dir, x) for x in ("orders", "customer", "nation"))
    facts = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(core.small(n), F.col("c_nationkey") == F.col("n_nationkey"))
    facts = facts.groupBy(F.col("n_regionkey").alias("region"), F.trunc("o_orderdate", "month").alias("month")).agg(total(F.col("o_totalprice").cast("decimal(18,2)")).alias("spent"))
    keys = t(spark, sf_dir, "region").select(F.col("r_regionkey").alias("region"))
    return core.densify(facts, core.month_spine(spark, *SPINE), keys, ["region"], ["spent"])


@query(f"WITH {_SERIES_SQL} SELECT region, month, spent FROM s")
def dense_series(spark, sf_dir):
    """GEN-1, JN-16, JN-17: a spine of months, facts joined to it."""
    return series(spark, sf_dir).select("region", "month", "spent")


@query(f"""WITH {_SERIES_SQL}, v AS (SELECT region, (year(month) * 12 + month(month))::BIGINT AS x, spent::DOUBLE AS y FROM s)
    SELECT a.region, round(median((b.y - a.y) / (b.x - a.x)), 4) AS slope FROM v a JOIN v b ON a.region = b.region AND a.x < b.x GROUP BY a.region""")
def theil_sen_slope(spark, sf_dir):
    """AGG-17: the median of all pairwise slopes."""
    v = series(spark, sf_dir).select("region", (F.year("month") * 12 + F.month("month")).cast("long").alias("x"), F.col("spent").cast("double").alias("y"))
    return core.theil_sen(v, ["region"], "x", "y").withColumn("slope", F.round("slope", 4))


@query(f"""WITH {_SERIES_SQL}, v AS (SELECT region, month, spent::DOUBLE AS y FROM s), c AS (SELECT region, median(y) AS center, count(*) AS n, max(month) AS last FROM v GROUP BY region),
    d AS (SELECT v.*, center, n, last, y - center AS dev FROM v JOIN c USING (region)), k AS (SELECT region, median(abs(dev)) AS mad, avg(abs(dev)) AS ad FROM d GROUP BY region)
    SELECT region, month, y, center, round(dev, 4) AS dev, round(dev / (CASE WHEN mad > 0 THEN mad / 0.6745 ELSE ad * 1.253314 END), 6) AS z FROM d JOIN k USING (region)
    WHERE n >= 6 AND month > last - INTERVAL 60 MONTH AND abs(dev) >= 50 AND abs(dev / (CASE WHEN mad > 0 THEN mad / 0.6745 ELSE ad * 1.253314 END)) >= 1.0""")
def anomalies(spark, sf_dir):
    """AGG-16: months that stand out from the median by MAD."""
    v = series(spark, sf_dir).select("region", "month", F.col("spent").cast("double").alias("y"))
    return core.mad_anomalies(v, ["region"], "month", "y", 1.0, 50.0, 60, 6).withColumns({"dev": F.round("dev", 4), "z": F.round("z", 6)})


@query(f"""WITH {_SERIES_SQL}, g AS (SELECT region, abs(spent - lag(spent) OVER (PARTITION BY region ORDER BY month))::DOUBLE AS d FROM s)
    SELECT region, round(avg(d), 4) AS scale FROM g GROUP BY region""")
def mase_scale(spark, sf_dir):
    """UDAF-4: mean absolute change from month to month."""
    from pyspark.sql import Window

    d = F.abs(F.col("spent") - F.lag("spent").over(Window.partitionBy("region").orderBy("month"))).cast("double")
    return series(spark, sf_dir).withColumn("d", d).groupBy("region").agg(F.round(F.avg("d"), 4).alias("scale"))


@query(f"""WITH {_SERIES_SQL}, l AS (SELECT region, list_sort(list(spent::DOUBLE)) AS v FROM s GROUP BY region) SELECT region, v[ceil(0.8 * len(v))::BIGINT] AS q80 FROM l""")
def nearest_rank_quantile(spark, sf_dir):
    """AGG-18: the element at ceil(p n)."""
    return order_statistics(series(spark, sf_dir), ["region"], "spent", {"q80": nearest_rank(0.8)}).select("region", "q80")


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings), p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.e, b.e) AS s FROM e a JOIN e b ON a.vec_id < b.vec_id)
    SELECT b AS variant, a AS canonical, round(s, 6) AS similarity FROM p WHERE s >= 0.3 QUALIFY row_number() OVER (PARTITION BY b ORDER BY s DESC, a) = 1""")
def merge_candidates(spark, sf_dir):
    """JN-7: pairs of names by similarity, the best for each variant."""
    from tallyframe.operators.vectors import nearest_before

    best = nearest_before(t(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.3)
    return best.select(F.col("b").alias("variant"), F.col("a").alias("canonical"), F.round("similarity", 6).alias("similarity"))


# --- serving ------------------------------------------------------------------------------------------------------------------

@query("""SELECT user_id::VARCHAR AS merchant_name, sum(value::DECIMAL(18,2))::DECIMAL(38,2) AS total_outflow FROM events WHERE event_type = 'purchase' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def top_merchants(spark, sf_dir):
    """SRT-1: a top-k report."""
    from tallyframe.plans.curated import top_merchants as top

    return top(silver.merchants(ledger(spark, sf_dir).filter("amount < 0")), 10).select("merchant_name", "total_outflow")


@query("""SELECT c_mktsegment, list_sort(list_distinct(list(n_name))) AS nations, count(DISTINCT date_trunc('month', o_orderdate)) AS months, min(CAST(o_orderdate AS DATE)) AS first_on
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def distinct_lists(spark, sf_dir):
    """AGG-11, AGG-12, AGG-13."""
    rows = t(spark, sf_dir, "orders").join(t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(core.small(t(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("c_mktsegment").agg(F.array_sort(F.collect_set("n_name")).alias("nations"), F.count_distinct(F.trunc("o_orderdate", "month")).alias("months"), F.min("o_orderdate").cast("date").alias("first_on"))


@query(f"""WITH RECURSIVE {CLOSURE_SQL}, {ITEMS_SQL} SELECT line_item_id, posted_on, amount, path FROM items JOIN paths ON id = category_id
    WHERE (path = 'ASIA' OR path LIKE 'ASIA/%') AND posted_on >= DATE '1996-01-01' AND posted_on <= DATE '1996-06-30' AND abs(amount) >= 1000""")
def search_items(spark, sf_dir):
    """FLT-7, FLT-9: optional bounds, a subtree by its path."""
    from tallyframe.plans.curated import search

    paths = core.tree_paths(tree(spark, sf_dir)).select(F.col("id").alias("category_id"), "path")
    rows = order_items(spark, sf_dir).join(paths, "category_id")
    return search(rows, category_path="ASIA", start="1996-01-01", end="1996-06-30", min_amount=1000).select("line_item_id", "posted_on", "amount", "path")


@query("""SELECT o_custkey, max_by(o_totalprice, (o_orderdate, o_orderkey)) AS latest_total, max(CAST(o_orderdate AS DATE)) AS latest_on FROM orders GROUP BY 1""")
def latest_of_group(spark, sf_dir):
    """AGG-15: each group's latest value."""
    return t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("latest_total"), F.max("o_orderdate").cast("date").alias("latest_on"))


@query("""SELECT c.c_custkey FROM customer c WHERE c.c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 5 = 0) AND c.c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)""")
def anti_semi(spark, sf_dir):
    """JN-14, JN-15: anti and semi joins."""
    n = t(spark, sf_dir, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    o = t(spark, sf_dir, "orders").filter("o_orderkey % 5 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, sf_dir, "customer").join(o, "c_custkey", "left_anti").join(core.small(n), "c_nationkey", "left_semi").select("c_custkey")


@query("""WITH v AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) SELECT o_custkey, (SELECT o_orderpriority FROM v w WHERE w.o_custkey = v.o_custkey ORDER BY n DESC, o_orderpriority LIMIT 1) AS modal,
    sum(n)::BIGINT AS orders FROM v GROUP BY o_custkey""")
def modal_category(spark, sf_dir):
    """JN-20: a group's modal category, as an aggregate and a ranking."""
    votes = t(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("o_custkey").agg(F.min_by("o_orderpriority", F.struct(-F.col("n"), "o_orderpriority")).alias("modal"), F.sum("n").alias("orders"))
