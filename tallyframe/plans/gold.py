"""Gold marts over line items and the category tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.exprs import month_of, period_start, total
from tallyframe.operators.core import recurring, small
from tallyframe.params import Params


def line_items(tx: DataFrame, splits: DataFrame, tx_categories: DataFrame, split_categories: DataFrame) -> DataFrame:
    """Splits, and transactions that have none; transfers are neither. Uncategorised ones have a null category."""
    flows = tx.filter("NOT is_transfer")
    cat = ["category_id", "categorization_source", "categorization_confidence"]
    parts = splits.join(flows.select("transaction_id", "posted_on"), "transaction_id").join(split_categories.select("split_id", *cat), "split_id", "left")
    parts = parts.select(F.col("split_id").alias("line_item_id"), "transaction_id", "amount", "posted_on", F.col("product_name").alias("description"), *cat)
    whole = flows.join(splits.select("transaction_id").distinct(), "transaction_id", "left_anti").join(tx_categories.select("transaction_id", *cat), "transaction_id", "left")
    whole = whole.select(F.col("transaction_id").alias("line_item_id"), "transaction_id", "amount", "posted_on", F.col("merchant_name").alias("description"), *cat)
    return parts.unionByName(whole)


def category_rollups(paths: DataFrame, ancestors: DataFrame, items: DataFrame) -> DataFrame:
    """Every category with the totals of its subtree. Items are summed by category before they meet the tree."""
    amount = F.col("amount")
    own = items.filter("category_id IS NOT NULL").groupBy("category_id").agg(
        F.count(F.lit(1)).alias("n"), total(F.when(amount < 0, -amount).otherwise(0)).alias("o"), total(F.when(amount > 0, amount).otherwise(0)).alias("i"), total(amount).alias("a")
    )
    up = own.join(small(ancestors), "category_id").groupBy("ancestor_id").agg(F.sum("n").alias("n"), total(F.col("o")).alias("o"), total(F.col("i")).alias("i"), total(F.col("a")).alias("a"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("decimal(38,2)"))
    return paths.join(up, F.col("id") == F.col("ancestor_id"), "left").select(
        F.col("id").alias("category_id"), "parent_id", "name", "path", "depth", F.coalesce("n", F.lit(0)).cast("long").alias("transaction_count"),
        zero("o").alias("total_outflow"), zero("i").alias("total_inflow"), zero("a").alias("net_amount"),
    )


def monthly_flow(tx: DataFrame) -> DataFrame:
    amount = F.col("amount")
    return tx.filter("NOT is_transfer").groupBy(month_of(F.col("posted_on")).alias("month")).agg(
        total(F.when(amount < 0, -amount).otherwise(0)).alias("total_outflow"), total(F.when(amount > 0, amount).otherwise(0)).alias("total_inflow"),
        total(amount).alias("net_amount"), F.count(F.lit(1)).alias("transaction_count"),
    )


def budget_actuals(budgets: DataFrame, ancestors: DataFrame, items: DataFrame) -> DataFrame:
    """Spending of each budget's subtree by its period, from its start on. Periods without spending have no row."""
    scope = small(budgets.join(ancestors, budgets["category_id"] == ancestors["ancestor_id"]).select(
        budgets["id"].alias("budget_id"), budgets["name"], budgets["category_id"].alias("top"), "period", budgets["amount"].alias("budgeted_amount"), "starts_on", ancestors["category_id"].alias("category_id")
    ))
    spent = items.filter("amount < 0").select("category_id", "posted_on", "amount").join(scope, "category_id").filter("posted_on >= starts_on")
    by = ["budget_id", "name", F.col("top").alias("category_id"), "period", "budgeted_amount", period_start(F.col("period"), F.col("posted_on")).alias("period_start")]
    out = spent.groupBy(*by).agg(total(-F.col("amount")).alias("actual_outflow"))
    return out.withColumn("variance", (F.col("actual_outflow") - F.col("budgeted_amount")).cast("decimal(38,2)"))


def recurring_flows(tx: DataFrame, p: Params = Params()) -> DataFrame:
    return recurring(tx.filter("NOT is_transfer AND merchant_name IS NOT NULL"), p.cadences, p.regularity, p.min_occurrences)


def sankey_flow(items: DataFrame, tx: DataFrame, paths: DataFrame) -> DataFrame:
    """Edges income category -> account, and account -> root category of spending, with positive sums."""
    root = small(paths.select(F.col("id").alias("category_id"), F.split_part("path", F.lit("/"), F.lit(1)).alias("root")))
    rows = items.join(root, "category_id").join(tx.select("transaction_id", "account_name"), "transaction_id")
    edge = lambda sign, stage, a, b: rows.filter(f"amount {sign} 0").groupBy(F.lit(stage).alias("stage"), F.col(a).alias("source_node"), F.col(b).alias("target_node")).agg(total(F.abs("amount")).alias("value"))
    return edge(">", "income", "root", "account_name").unionByName(edge("<", "spending", "account_name", "root"))


def forecasts(rows: DataFrame, paths: DataFrame) -> DataFrame:
    return rows.join(small(paths.select(F.col("id").alias("category_id"), F.col("path").alias("category_path"))), "category_id", "left")
