"""Silver marts: cleaning, transfers, orders, categories. Each builder takes DataFrames and parameters and returns one."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.exprs import cents, money, name_tokens, names, normalize_merchant, total
from tallyframe.operators.core import allocate_exact, band_pairs, first_alike, first_match, first_per, latest_per_key, mutual_best, nearest_by_cosine, small
from tallyframe.operators.patterns import matches
from tallyframe.params import Params


def stg_transactions(bronze: DataFrame, p: Params = Params()) -> DataFrame:
    """One row per row_hash, the latest landing; amounts signed, zero counts as inflow."""
    rows = latest_per_key(bronze, ["row_hash"], "ingested_at", ["source_file"])
    return rows.select(
        F.col("row_hash").alias("transaction_id"), "source", "account_name", "account_type", "currency", "posted_on", money(F.col("amount")).alias("amount"),
        F.when(F.col("amount") < 0, "outflow").otherwise("inflow").alias("flow"), F.nullif(F.trim("description_raw"), F.lit("")).alias("description_raw"),
        normalize_merchant(F.col("description_raw"), p.known_cities).alias("merchant_name"), "external_id", "source_file", "ingested_at",
    )


def stg_order_items(bronze: DataFrame) -> DataFrame:
    rows = latest_per_key(bronze, ["row_hash"], "ingested_at", ["source_file"])
    return rows.withColumnRenamed("row_hash", "order_item_id").drop("source", "source_file", "ingested_at")


def transfers(stg: DataFrame, p: Params = Params()) -> DataFrame:
    """Pairs of an outflow and an inflow of one amount and currency, of two accounts, at most some days apart, each other's best."""
    tokens = stg.select("account_name").distinct().withColumn("tokens", name_tokens(F.col("account_name")))
    rows = stg.filter("amount <> 0").join(small(tokens), "account_name", "left")
    side = lambda name: [F.col(c).alias(f"{name}_{c}") for c in ("transaction_id", "account_name", "currency", "posted_on", "description_raw", "tokens")]
    out = rows.filter("amount < 0").select(*side("out"), (-F.col("amount")).cast("decimal(18,2)").alias("out_amount"))
    into = rows.filter("amount > 0").select(*side("in"), F.col("amount").alias("in_amount"))
    out, into = (first_alike(df, f"{x}_transaction_id", [f"{x}_{c}" for c in ("amount", "currency", "posted_on", "account_name", "description_raw")]) for df, x in ((out, "out"), (into, "in")))
    pairs = band_pairs(out, into, [("out_amount", "in_amount"), ("out_currency", "in_currency")], "out_posted_on", "in_posted_on", p.transfer_window_days, F.col("out_account_name") != F.col("in_account_name"))
    pairs = pairs.withColumn("name_match", names(F.col("in_description_raw"), F.col("out_tokens")) | names(F.col("out_description_raw"), F.col("in_tokens")))
    best = mutual_best(pairs, "out_transaction_id", "in_transaction_id", [F.col("name_match").desc(), F.col("day_gap")])
    return best.select(
        F.md5(F.concat_ws("|", "out_transaction_id", "in_transaction_id")).alias("transfer_id"), F.col("out_transaction_id").alias("outflow_id"),
        F.col("in_transaction_id").alias("inflow_id"), F.col("out_account_name").alias("from_account"), F.col("in_account_name").alias("to_account"),
        F.col("out_currency").alias("currency"), F.col("in_amount").alias("amount"), F.col("out_posted_on").alias("sent_on"), F.col("in_posted_on").alias("received_on"),
        "day_gap", "name_match", F.when(F.col("name_match"), "high").otherwise("medium").alias("confidence"),
    )


def transactions(stg: DataFrame, aliases: DataFrame, merges: DataFrame, moved: DataFrame) -> DataFrame:
    """Staged rows with the merchant's name resolved by alias and accepted merge, and is_transfer."""
    alias = first_match(stg.filter("merchant_name IS NOT NULL"), aliases.select("id", "pattern", "priority", "canonical_name"), "transaction_id", F.col("merchant_name"), ["canonical_name"])
    named = stg.join(alias, "transaction_id", "left").withColumn("merchant_name", F.coalesce("canonical_name", "merchant_name")).drop("canonical_name")
    decided = latest_per_key(merges, ["merchant_name"], "created_at", ["id"]).filter("status = 'accepted'").select("merchant_name", "canonical_name")
    merged = named.join(small(decided), "merchant_name", "left").withColumn("merchant_name", F.coalesce("canonical_name", "merchant_name")).drop("canonical_name")
    legs = moved.select(F.col("outflow_id").alias("transaction_id")).union(moved.select("inflow_id")).distinct().withColumn("_leg", F.lit(True))
    flagged = merged.join(legs, "transaction_id", "left").withColumn("is_transfer", F.col("_leg").isNotNull())
    return flagged.select(*stg.columns, "is_transfer")


def merchants(tx: DataFrame, with_transfers: bool = True) -> DataFrame:
    """Totals by merchant; transfers count, as in all earlier reports, unless told otherwise."""
    rows = tx.filter("merchant_name IS NOT NULL") if with_transfers else tx.filter("merchant_name IS NOT NULL AND NOT is_transfer")
    return rows.groupBy("merchant_name").agg(
        F.count(F.lit(1)).alias("transaction_count"), total(F.when(F.col("amount") < 0, -F.col("amount")).otherwise(0)).alias("total_outflow"),
        F.min("posted_on").alias("first_seen_on"), F.max("posted_on").alias("last_seen_on"),
    ).withColumn("merchant_id", F.md5("merchant_name"))


def shipments(items: DataFrame) -> DataFrame:
    """One row per order and ship date: totals that repeat on each item once (the first item's that has one), items' own amounts summed."""
    once = ["order_date", "total_owed", "shipping_charge", "total_discounts", "currency", "order_status", "shipment_status"]
    return items.groupBy("website_order_id", "ship_date").agg(
        *(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("order_item_id"))).alias(c) for c in once), total(F.col("shipment_item_subtotal")).alias("items_subtotal"), total(F.col("shipment_item_subtotal_tax")).alias("items_subtotal_tax"),
        F.count(F.lit(1)).alias("item_count"),
    )


def order_matches(shipped: DataFrame, tx: DataFrame, p: Params = Params()) -> DataFrame:
    """Shipments and the charges that paid for them: equal to the cent, some days apart at most, each other's best."""
    left = shipped.select("website_order_id", "ship_date", "total_owed", F.concat_ws("|", "website_order_id", F.col("ship_date").cast("string")).alias("shipment"))
    right = tx.filter("amount < 0").select("transaction_id", "posted_on", "account_name", (-F.col("amount")).cast("decimal(18,2)").alias("charge"))
    left, right = first_alike(left, "shipment", ["total_owed", "ship_date"]), first_alike(right, "transaction_id", ["charge", "posted_on"])
    pairs = band_pairs(left, right, [("total_owed", "charge")], "ship_date", "posted_on", p.order_match_window_days)
    best = mutual_best(pairs, "shipment", "transaction_id", [F.col("day_gap")])
    key = F.md5(F.concat_ws("|", "shipment", "transaction_id"))
    return best.select(key.alias("order_match_id"), "website_order_id", "ship_date", "transaction_id", "posted_on", "account_name", "total_owed", "day_gap")


def splits(matches: DataFrame, items: DataFrame, tx: DataFrame) -> DataFrame:
    """The charge over the items it paid for, in proportion, exact to the cent."""
    rows = matches.select("website_order_id", "ship_date", "transaction_id").join(items, ["website_order_id", "ship_date"]).join(tx.select("transaction_id", "amount"), "transaction_id")
    rows = rows.withColumns({"charge_cents": cents(F.col("amount")), "item_cents": cents(F.coalesce("shipment_item_subtotal", F.lit(0)))})
    shared = allocate_exact(rows, "transaction_id", "order_item_id", "charge_cents", "item_cents")
    amount = money((F.when(F.col("amount") < 0, -F.col("share_cents")).otherwise(F.col("share_cents")) * F.lit(1).cast("decimal(18,0)")) / 100)
    return shared.select(F.col("order_item_id").alias("split_id"), "transaction_id", "asin", "product_name", "quantity", "unit_price", "currency", amount.alias("amount"))


@dataclass(frozen=True)
class Subjects:
    """What a cascade categorises: the key, the name that caches know it by, the rules' fields."""

    key: str
    name: str
    fields: tuple[str, ...]
    kind: str


TRANSACTIONS = Subjects("transaction_id", "merchant_name", ("merchant_name", "description_raw", "account_name", "account_type"), "transaction")
SPLITS = Subjects("split_id", "product_name", ("product_name",), "split")


def by_rule(rows: DataFrame, rules: DataFrame, s: Subjects) -> DataFrame:
    """Stage 1: the first rule, by priority and id, whose pattern is in the field that it applies to."""
    fields = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in s.fields))
    long = rows.select(s.key, F.explode(fields).alias("f")).select(s.key, "f.field", "f.value").filter("value IS NOT NULL")
    known = small(rules.select("id", "pattern", "applies_to", "priority", "category_id"))
    pairs = matches(long.select(F.col("value").alias("text")), rules).join(known, "pattern")
    by_text = first_per(pairs, ["applies_to", "text"], [F.col("priority"), F.col("id")])
    found = long.join(small(by_text), (F.col("field") == F.col("applies_to")) & (F.col("value") == F.col("text")))
    best = first_per(found, [s.key], [F.col("priority"), F.col("id"), F.col("field")])
    return best.select(s.key, "category_id", F.col("id").alias("rule_id"), F.col("pattern").alias("matched_pattern"), F.lit("rule").alias("categorization_source"), F.lit(1.0).alias("categorization_confidence"))


def without(rows: DataFrame, decided: Sequence[DataFrame], key: str) -> DataFrame:
    for d in decided:
        rows = rows.join(d.select(key), key, "left_anti")
    return rows


def by_embedding(rows: DataFrame, ruled: DataFrame, vectors: DataFrame, s: Subjects, model: str, threshold: float) -> DataFrame:
    """Stage 2: names of uncovered rows take the category of the nearest name that rules have covered, by majority."""
    own = vectors.filter(F.col("model") == model).select(F.col(s.name), "embedding")
    named = rows.filter(F.col(s.name).isNotNull()).select(s.key, s.name)
    votes = named.join(ruled.select(s.key, "category_id"), s.key).groupBy(s.name, "category_id").agg(F.count(F.lit(1)).alias("votes"))
    majority = first_per(votes, [s.name], [F.col("votes").desc(), F.col("category_id")]).select(s.name, "category_id")
    reference = majority.join(own, s.name).select(F.col(s.name).alias("ref_name"), "category_id", F.col("embedding").alias("ref_vector"))
    left = without(named, [ruled], s.key)
    near = nearest_by_cosine(left.select(s.name).distinct().join(own, s.name), reference, s.name, "embedding", threshold)
    return left.join(near, s.name).select(s.key, "category_id", F.col("ref_name").alias("matched_name"), F.lit("embedding").alias("categorization_source"), F.col("similarity").alias("categorization_confidence"))


def by_classifier(rows: DataFrame, decided: Sequence[DataFrame], cache: DataFrame, s: Subjects, model: str, threshold: float) -> DataFrame:
    """Stage 3: what a classifier has said about the name, if it was sure enough."""
    said = cache.filter((F.col("model") == model) & (F.col("confidence") >= threshold)).select(s.name, "category_id", "confidence")
    found = without(rows.select(s.key, s.name), decided, s.key).join(said, s.name)
    return found.select(s.key, "category_id", F.col(s.name).alias("matched_name"), F.lit("llm").alias("categorization_source"), F.col("confidence").alias("categorization_confidence"))


def by_human(labels: DataFrame, s: Subjects) -> DataFrame:
    """The latest label of each subject."""
    own = latest_per_key(labels.filter(F.col("subject_kind") == s.kind), ["subject_id"], "created_at", ["id"])
    return own.select(F.col("subject_id").alias(s.key), "category_id", F.lit("human").alias("categorization_source"), F.lit(1.0).alias("categorization_confidence"))


def categories_of(human: DataFrame, machine: Sequence[DataFrame], s: Subjects) -> DataFrame:
    """One category a subject: people outrank every stage. Subjects without one have no row."""
    columns = [s.key, "category_id", "categorization_source", "categorization_confidence"]
    out = human.select(*columns)
    for stage in machine:
        out = out.unionByName(without(stage.select(*columns), [human], s.key))
    return out


def review_queue(rows: DataFrame, decided: DataFrame, key: str, order: Sequence[Column], limit: int) -> DataFrame:
    return without(rows, [decided], key).orderBy(*order).limit(limit)
