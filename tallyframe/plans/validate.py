"""Checks of the marts: each is a DataFrame of offending rows, empty where all is well."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def not_null(df: DataFrame, *columns: str) -> DataFrame:
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull()
    return df.filter(bad)


def unique(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def accepted(df: DataFrame, column: str, *values) -> DataFrame:
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(*values))


def related(df: DataFrame, column: str, to: DataFrame, key: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).join(to.select(F.col(key).alias(column)), column, "left_anti")


def between(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return df.filter(~F.col(column).between(low, high))


def own_parents(categories: DataFrame) -> DataFrame:
    return categories.filter("parent_id = id")


def splits_exact(splits: DataFrame, tx: DataFrame) -> DataFrame:
    """Charges whose splits don't add up."""
    sums = splits.groupBy("transaction_id").agg(F.sum("amount").alias("splits"))
    return sums.join(tx.select("transaction_id", "amount"), "transaction_id").filter("splits <> amount")


def shipment_totals(items: DataFrame) -> DataFrame:
    """Shipments whose items disagree on what is theirs in common."""
    return items.groupBy("website_order_id", "ship_date").agg(F.count_distinct("total_owed").alias("n")).filter("n > 1")


def forecast_parts(forecasts: DataFrame) -> DataFrame:
    return forecasts.filter("predicted <> committed + variable OR lower > predicted OR upper < predicted")


def roots_cover(rollups: DataFrame, items: DataFrame) -> DataFrame:
    """Root totals against all categorised items."""
    roots = rollups.filter("parent_id IS NULL").agg(F.coalesce(F.sum("net_amount"), F.lit(0)).alias("roots"))
    total = items.filter("category_id IS NOT NULL").agg(F.coalesce(F.sum("amount"), F.lit(0)).alias("total"))
    return roots.join(total, F.lit(True)).filter("roots <> total")
