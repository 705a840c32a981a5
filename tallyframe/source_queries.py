"""Exports that Spark writes from the star-schema tables, landed and read again: the sources' queries, with DuckDB SQL of the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.operators.store import checkpoint_folder, let_go
from tallyframe.queries import query, t
from tallyframe.sources import landing
from tallyframe.sources.config import Source
from tallyframe.sources.exports import ORDER_COLUMNS

#: Files to an export.
FILES = 8


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_folder(spark)}/exports-{uuid.uuid4().hex}"


def _written(rows: DataFrame, order: list[str], path: str, kind: str = "csv", **options) -> str:
    """rows (column f: the file) as files, each in `order`; a glob of these."""
    writer = rows.repartition(FILES, "f").sortWithinPartitions("f", *order).drop(*[c for c in order if c.startswith("_")])
    writer.write.partitionBy("f").options(**options).format(kind).save(path)
    return f"{path}/f=*/part-*"


#: Debits and credits apart; all signs turned; signed, with dollar signs and thousands commas, without a header.
BANKS = (
    Source("card", "Card", "credit", date_format="%m/%d/%Y", sign="debit_credit", column_map={"posted_on": "Date", "description_raw": "What", "debit": "Out", "credit": "In", "external_id": "Id"}),
    Source("loan", "Loan", "loan", date_format="%Y-%m-%d", sign="inverted", column_map={"posted_on": "Date", "description_raw": "What", "amount": "Amount", "external_id": "Id"}),
    Source("bank", "Bank", date_format="%d.%m.%y", sign="signed", columns=("day", "text", "sum"), column_map={"posted_on": "day", "description_raw": "text", "amount": "sum"}),
)


@query("""WITH e AS (SELECT *, CASE event_type WHEN 'purchase' THEN 'card' WHEN 'signup' THEN 'loan' ELSE 'bank' END AS source, CAST(ts AS DATE) AS posted_on,
        (CASE event_type WHEN 'purchase' THEN -value WHEN 'signup' THEN -value ELSE value * 10 END)::DECIMAL(18,2) AS amount, 'user ' || user_id % 50 || ', ' || event_type AS description_raw FROM events),
    x AS (SELECT *, CASE WHEN source <> 'bank' AND event_id % 3 > 0 THEN event_id::VARCHAR END AS external_id, row_number() OVER (PARTITION BY source, user_id % 8, posted_on, amount, description_raw ORDER BY event_id) - 1 AS k FROM e)
    SELECT DISTINCT source, posted_on, amount, description_raw, external_id,
        sha256(CASE WHEN external_id IS NOT NULL THEN source || '|id|' || external_id ELSE source || '|content|' || posted_on || '|' || amount || '|' || description_raw || '|' || k END) AS row_hash, 0 AS second_run FROM x""")
def csv_landing(spark, sf_dir):
    """SRC-1 to SRC-9, SRC-13 to SRC-16, SNK-1, SNK-2, UDF-1: three banks' CSV files, each landed twice."""
    e = t(spark, sf_dir, "events").withColumns({"f": F.col("user_id") % FILES, "_k": F.col("event_id"), "What": F.concat(F.lit("user "), (F.col("user_id") % 50).cast("string"), F.lit(", "), "event_type")})
    cents = lambda v: F.format_number(v.cast("decimal(18,2)"), 2)
    id_ = F.when(F.col("event_id") % 3 > 0, F.col("event_id").cast("string")).otherwise(F.lit("  ")).alias("Id")
    exports = (
        e.filter("event_type = 'purchase'").select("f", "_k", F.date_format("ts", "MM/dd/yyyy").alias("Date"), F.col("What"), cents(F.col("value")).alias("Out"), F.lit(" ").alias("In"), id_),
        e.filter("event_type = 'signup'").select("f", "_k", F.date_format("ts", "yyyy-MM-dd").alias("Date"), F.col("What"), F.col("value").cast("decimal(18,2)").cast("string").alias("Amount"), id_),
        e.filter("event_type NOT IN ('purchase', 'signup')").select("f", "_k", F.date_format("ts", "dd.MM.yy").alias("a"), F.col("What").alias("b"), F.concat(F.lit("+ $"), cents(F.col("value") * 10)).alias("c")),
    )
    root = _folder(spark)
    again = 0
    for source, rows in zip(BANKS, exports):
        path = _written(rows, ["_k"], f"{root}/files/{source.name}", header=str(not source.columns).lower(), quoteAll="true", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false")
        landing.ingest(spark, source, path, root)
        again += landing.ingest(spark, source, path, root)
    return landing.bronze(spark, root).select("source", "posted_on", "amount", "description_raw", "external_id", "row_hash", F.lit(again).alias("second_run"))


OFX = Source("union", "Union", kind="ofx")


@query("""WITH x AS (SELECT o_custkey % 8 AS account, CAST(o_orderdate AS DATE) AS posted_on, (-o_totalprice)::DECIMAL(18,2) AS amount, 'Order & Co ' || o_orderpriority AS description_raw,
        CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey::VARCHAR END AS external_id, o_orderkey FROM orders),
    k AS (SELECT *, row_number() OVER (PARTITION BY account, posted_on, amount, description_raw ORDER BY o_orderkey) - 1 AS k FROM x)
    SELECT DISTINCT posted_on, amount, description_raw, external_id, sha256(CASE WHEN external_id IS NOT NULL THEN 'union|id|' || account || ':' || external_id
        ELSE 'union|content|' || account || ':' || posted_on || '|' || amount || '|' || description_raw || '|' || k END) AS row_hash FROM k""")
def ofx_landing(spark, sf_dir):
    """SRC-11: OFX statements of eight accounts, ids being the bank's within each."""
    o = t(spark, sf_dir, "orders").withColumn("f", F.col("o_custkey") % FILES)
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c)
    fitid = F.when(F.col("o_orderkey") % 4 > 0, F.concat(F.lit("<FITID>"), F.col("o_orderkey").cast("string"))).otherwise(F.lit(""))
    what = F.concat(tag("NAME", F.lit("Order &amp; Co")), tag("MEMO", F.col("o_orderpriority")))
    row = F.concat(F.lit("<STMTTRN>"), tag("DTPOSTED", F.date_format("o_orderdate", "yyyyMMdd120000")), tag("TRNAMT", (-F.col("o_totalprice")).cast("decimal(18,2)").cast("string")), fitid, what, F.lit("</STMTTRN>"))
    body = o.select("f", F.col("o_orderkey").alias("_k"), row.alias("value"))
    accounts = o.select("f").distinct()
    head = accounts.select("f", F.lit(-1).cast("long").alias("_k"), F.concat(F.lit("OFXHEADER:100<OFX><ACCTID>"), F.col("f").cast("string")).alias("value"))
    tail = accounts.select("f", F.lit((1 << 62)).alias("_k"), F.lit("<LEDGERBAL><BALAMT>0</LEDGERBAL></OFX>").alias("value"))
    root = _folder(spark)
    path = _written(head.union(body).union(tail), ["_k"], f"{root}/files", "text")
    landing.ingest(spark, OFX, path, root)
    return landing.bronze(spark, root).select("posted_on", "amount", "description_raw", "external_id", "row_hash")


SHOP = Source("shop", "Shop", "orders", kind="orders")


def _order_history(spark: SparkSession, sf_dir: str, path: str) -> str:
    """The order history as files compressed by gzip, each order's items in one of them; a glob of these."""
    rows = t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    money = lambda c: F.concat(F.lit("$"), F.format_number(F.col(c).cast("decimal(18,2)"), 2))
    day = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    given = {
        "website_order_id": F.col("l_orderkey").cast("string"), "order_date": day("o_orderdate"), "ship_date": F.when(F.col("l_linenumber") < 7, day("l_shipdate")).otherwise(F.lit(" ")),
        "asin": F.concat(F.lit("A"), F.col("l_partkey").cast("string")), "quantity": F.col("l_quantity").cast("bigint").cast("string"), "shipment_item_subtotal": money("l_extendedprice"), "total_owed": money("o_totalprice"),
    }
    columns = [given.get(name, F.lit("")).alias(column) for name, column in ORDER_COLUMNS.items()]
    # Numbers are shuffled, once, by the order; texts are made as they are written. The window keeps an order's items in one task, and so in one file.
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity"))
    export = rows.select("*", (F.col("l_orderkey") % FILES).alias("f"), place.alias("_k")).sortWithinPartitions("f", "l_orderkey", "_k").select("f", *columns)
    export.write.partitionBy("f").csv(path, header="true", quoteAll="true", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false", compression="gzip")
    return f"{path}/f=*/part-*"


@query("""WITH x AS (SELECT l_orderkey::VARCHAR AS website_order_id, CAST(o_orderdate AS DATE) AS order_date, CASE WHEN l_linenumber < 7 THEN CAST(l_shipdate AS DATE) END AS ship_date, 'A' || l_partkey AS asin,
        l_quantity::BIGINT AS quantity, l_extendedprice::DECIMAL(18,2) AS shipment_item_subtotal, o_totalprice::DECIMAL(18,2) AS total_owed, l_linenumber, l_suppkey, l_extendedprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    k AS (SELECT *, row_number() OVER (PARTITION BY website_order_id, asin, ship_date ORDER BY l_linenumber, l_suppkey, l_extendedprice, quantity) - 1 AS k FROM x)
    SELECT website_order_id, order_date, ship_date, asin, quantity, shipment_item_subtotal, total_owed, sha256('shop|order|' || website_order_id || '|' || asin || '|' || coalesce(ship_date::VARCHAR, '') || '|' || k) AS row_hash FROM k""")
def order_history_landing(spark, sf_dir):
    """SRC-12, SRC-8: an order history's items, unshipped ones with a blank date, equal ones told apart by their place."""
    root = _folder(spark)
    path = _order_history(spark, sf_dir, f"{root}/files")
    let_go(spark)
    landing.ingest(spark, SHOP, path, root)
    return landing.bronze_orders(spark, root).select("website_order_id", "order_date", "ship_date", "asin", "quantity", "shipment_item_subtotal", "total_owed", "row_hash")


@query("""WITH x AS (SELECT 'b' || user_id % 8 AS source, CAST(ts AS DATE) AS posted_on, (CASE WHEN event_type = 'purchase' THEN -value ELSE value END)::DECIMAL(18,2) AS amount, 'user ' || user_id AS description_raw, event_id FROM events),
    k AS (SELECT *, row_number() OVER (PARTITION BY source, posted_on, amount, description_raw ORDER BY event_id) - 1 AS k FROM x)
    SELECT source, source || '.csv' AS source_file, posted_on, amount, description_raw, sha256(source || '|content|' || posted_on || '|' || amount || '|' || description_raw || '|' || k) AS row_hash, '1 failed, 8 ingested, 1 unmatched' AS outcomes FROM k""")
def dropped_exports(spark, sf_dir):
    """SRC-10, SRC-18, SRC-19, SNK-9 and the file stream: exports deposited in a folder, a bad and an unknown one among them."""
    from tallyframe.sources import snapshots
    from tallyframe.streaming.folder import watch

    e = t(spark, sf_dir, "events")
    amount = F.when(F.col("event_type") == "purchase", -F.col("value")).otherwise(F.col("value")).cast("decimal(18,2)").cast("string")
    rows = e.select((F.col("user_id") % FILES).alias("f"), F.col("event_id").alias("_k"), F.date_format("ts", "yyyy-MM-dd").alias("Date"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("What"), amount.alias("Amount"))
    root = _folder(spark)
    _written(rows, ["_k"], f"{root}/files", header="true")
    columns = {"posted_on": "Date", "description_raw": "What", "amount": "Amount"}
    sources = [Source(f"b{f}", f"Account {f}", column_map=columns if f < FILES else columns | {"posted_on": "What"}) for f in range(FILES + 1)]
    fs = snapshots.file_system(spark, root)
    for f in range(FILES + 2):  # the ninth source takes a file whose dates it can't read, the tenth name is nobody's
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/files/f={min(f, FILES - 1)}/part-*")
        for status in fs.globStatus(place) or []:
            snapshots.deposit(spark, status.getPath().toString(), f"{root}/drop", f"b{f}.csv")
    seen: list[str] = []
    watch(spark, f"{root}/drop", sources, root, f"{root}/stream", lambda outcome: seen.append(outcome.status)).awaitTermination()
    said = ", ".join(f"{seen.count(s)} {s}" for s in ("failed", "ingested", "unmatched"))
    return landing.bronze(spark, root).select("source", "source_file", "posted_on", "amount", "description_raw", "row_hash", F.lit(said).alias("outcomes"))
