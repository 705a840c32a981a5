"""The queries that users ask by name, over the marts; all filters are optional."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.exprs import total


def bounded(df: DataFrame, column: str, start=None, end=None) -> DataFrame:
    """Rows with `column` from `start` to `end`, both included."""
    if start is not None:
        df = df.filter(F.col(column) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.filter(F.col(column) <= F.lit(end).cast("date"))
    return df


def in_subtree(df: DataFrame, path: str | None, column: str = "path") -> DataFrame:
    return df if path is None else df.filter((F.col(column) == path) | F.col(column).startswith(f"{path}/"))


def overview(monthly: DataFrame) -> DataFrame:
    """Totals over all months, with the months in order."""
    months = F.array_sort(F.collect_list(F.struct("month", "total_outflow", "total_inflow", "net_amount", "transaction_count")))
    return monthly.agg(total(F.col("total_outflow")).alias("total_outflow"), total(F.col("total_inflow")).alias("total_inflow"), total(F.col("net_amount")).alias("net_amount"), months.alias("months"))


def months(monthly: DataFrame, start=None, end=None) -> DataFrame:
    return bounded(monthly, "month", start, end).orderBy("month")


def extremes(rows: DataFrame, orders: dict[str, Column], keep: Sequence[str]) -> DataFrame:
    """kind and `keep` of the row that comes first in each of `orders`; the columns in `keep` break ties. One row a kind, none of none."""
    out = None
    for kind, order in orders.items():
        first = rows.orderBy(order, *keep).limit(1).select(F.lit(kind).alias("kind"), *keep)
        out = first if out is None else out.unionByName(first)
    return out


def top_merchants(merchants: DataFrame, limit: int = 10) -> DataFrame:
    return merchants.orderBy(F.col("total_outflow").desc(), "merchant_name").limit(limit)


def spend_by_category(rollups: DataFrame, items: DataFrame, ancestors: DataFrame, paths: DataFrame, path=None, start=None, end=None, whole_end_month: bool = False) -> DataFrame:
    """Spending by category: the mart as it is, or rolled up anew from line items if there are bounds.

    The end bound is compared to the day as given, so a month's first day takes in that day only, unlike months(); with
    whole_end_month its whole month counts.
    """
    if start is None and end is None:
        return in_subtree(rollups, path).select("category_id", "path", "depth", "total_outflow", "total_inflow", "net_amount", "transaction_count").orderBy("path")
    if whole_end_month and end is not None:
        end = F.last_day(F.lit(end).cast("date"))
    amount = F.col("amount")
    up = bounded(items, "posted_on", start, end).groupBy("category_id").agg(
        total(F.when(amount < 0, -amount).otherwise(0)).alias("o"), total(F.when(amount > 0, amount).otherwise(0)).alias("i"), total(amount).alias("a"), F.count(F.lit(1)).alias("n")
    )
    rolled = up.join(ancestors, "category_id").groupBy(F.col("ancestor_id").alias("id")).agg(total(F.col("o")).alias("total_outflow"), total(F.col("i")).alias("total_inflow"), total(F.col("a")).alias("net_amount"), F.sum("n").alias("transaction_count"))
    return in_subtree(rolled.join(paths, "id"), path).select(F.col("id").alias("category_id"), "path", "depth", "total_outflow", "total_inflow", "net_amount", "transaction_count").orderBy("path")


def recurring(flows: DataFrame, flow: str | None = None) -> DataFrame:
    return (flows if flow is None else flows.filter(F.col("flow") == flow)).orderBy(F.col("amount").desc(), "merchant_name")


def budget_status(actuals: DataFrame) -> DataFrame:
    return actuals.orderBy("name", "period_start")


def search(rows: DataFrame, merchant: str | None = None, category_path: str | None = None, start=None, end=None, min_amount=None, limit: int | None = None) -> DataFrame:
    """Rows by part of the merchant's name (% and _ as LIKE has them), subtree, days and least absolute amount."""
    rows = bounded(in_subtree(rows, category_path), "posted_on", start, end)
    if merchant is not None:
        rows = rows.filter(F.lower("merchant_name").like(f"%{merchant.lower()}%"))
    if min_amount is not None:
        rows = rows.filter(F.abs("amount") >= min_amount)
    return rows if limit is None else rows.orderBy(F.col("posted_on").desc(), "transaction_id").limit(limit)


def transactions(tx: DataFrame, items: DataFrame, paths: DataFrame, limit: int = 50, **bounds) -> DataFrame:
    """One row a transaction with the sorted paths of its line items; search()'s bounds apply."""
    tagged = items.join(paths.select(F.col("id").alias("category_id"), "path"), "category_id").groupBy("transaction_id").agg(F.array_sort(F.collect_set("path")).alias("category_paths"))
    path = bounds.pop("category_path", None)
    rows = search(tx, **bounds).join(tagged, "transaction_id", "left").withColumn("category_paths", F.coalesce("category_paths", F.array().cast("array<string>")))
    if path is not None:
        rows = rows.filter(F.exists("category_paths", lambda p: (p == path) | p.startswith(f"{path}/")))
    return rows.orderBy(F.col("posted_on").desc(), "transaction_id").limit(limit)
