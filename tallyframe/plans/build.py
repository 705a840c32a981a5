"""All marts from the landing layer and the app's tables, each written once in order of what it reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyframe.operators.core import tree_closure, tree_paths
from tallyframe.params import Params
from tallyframe.schemas import APP
from tallyframe.sources import snapshots
from tallyframe.sources.landing import bronze, bronze_orders, read_or_empty

from . import gold, silver


def recipes(spark: SparkSession, root: str, app: Callable[[str], DataFrame], p: Params) -> dict[str, Callable[[Callable[[str], DataFrame]], DataFrame]]:
    """Mart name -> builder from get(name); in an order in which what is read is already there."""

    def cascade(s: silver.Subjects, prefix: str, rows: str, vectors: str, cache: str):
        return {
            f"{prefix}_categories": lambda g: silver.by_rule(g(rows), app("rules"), s),
            f"{prefix}_categories_embedding": lambda g: silver.by_embedding(g(rows), g(f"{prefix}_categories"), app(vectors), s, p.embedding_model, p.embedding_threshold),
            f"{prefix}_categories_llm": lambda g: silver.by_classifier(g(rows), [g(f"{prefix}_categories"), g(f"{prefix}_categories_embedding")], app(cache), s, p.classifier_model, p.classifier_threshold),
            f"{prefix}_categories_human": lambda g: silver.by_human(app("labels"), s),
            f"{prefix}_categories_all": lambda g: silver.categories_of(g(f"{prefix}_categories_human"), [g(f"{prefix}_categories{x}") for x in ("", "_embedding", "_llm")], s),
        }

    return {
        "stg_transactions": lambda g: silver.stg_transactions(bronze(spark, root), p),
        "stg_order_items": lambda g: silver.stg_order_items(bronze_orders(spark, root)),
        "silver_transfers": lambda g: silver.transfers(g("stg_transactions"), p),
        "silver_transactions": lambda g: silver.transactions(g("stg_transactions"), app("merchant_aliases"), app("merchant_merges"), g("silver_transfers")),
        "silver_merchants": lambda g: silver.merchants(g("silver_transactions")),
        "silver_categories": lambda g: app("categories"),
        "silver_shipments": lambda g: silver.shipments(g("stg_order_items")),
        "silver_order_matches": lambda g: silver.order_matches(g("silver_shipments"), g("silver_transactions"), p),
        "silver_splits": lambda g: silver.splits(g("silver_order_matches"), g("stg_order_items"), g("silver_transactions")),
        **cascade(silver.TRANSACTIONS, "silver_transaction", "silver_transactions", "merchant_embeddings", "merchant_llm_categories"),
        **cascade(silver.SPLITS, "silver_split", "silver_splits", "product_embeddings", "product_llm_categories"),
        "gold_category_paths": lambda g: tree_paths(g("silver_categories").select("id", "name", "parent_id")),
        "gold_category_ancestors": lambda g: tree_closure(g("silver_categories").select("id", "parent_id")),
        "gold_line_items": lambda g: gold.line_items(g("silver_transactions"), g("silver_splits"), g("silver_transaction_categories_all"), g("silver_split_categories_all")),
        "gold_category_rollups": lambda g: gold.category_rollups(g("gold_category_paths"), g("gold_category_ancestors"), g("gold_line_items")),
        "gold_monthly_flow": lambda g: gold.monthly_flow(g("silver_transactions")),
        "gold_budget_actuals": lambda g: gold.budget_actuals(app("budgets"), g("gold_category_ancestors"), g("gold_line_items")),
        "gold_recurring_flows": lambda g: gold.recurring_flows(g("silver_transactions"), p),
        "gold_sankey_flow": lambda g: gold.sankey_flow(g("gold_line_items"), g("silver_transactions"), g("gold_category_paths")),
        "gold_forecasts": lambda g: gold.forecasts(app("forecasts"), g("gold_category_paths")),
    }


def build(spark: SparkSession, root: str, out: str, app: dict[str, DataFrame] | None = None, p: Params = Params()) -> dict[str, DataFrame]:
    """Build every mart under `out`, and a view by its name; what each reads is read from there.

    Each is replaced in one step (see snapshots.py): who reads an older build goes on doing so, and a build that dies leaves whole
    marts. Data that no build of the last week needs goes.

    app: the app's tables; those not given are read from `root`/app, or empty.
    """
    given = app or {}
    table = lambda name: given.get(name, None) if name in given else read_or_empty(spark, f"{root}/app/{name}", APP[name])
    made: dict[str, DataFrame] = {}
    for name, recipe in recipes(spark, root, table, p).items():
        rows = recipe(made.__getitem__)
        snapshots.replace(rows, f"{out}/{name}")
        snapshots.vacuum(spark, f"{out}/{name}")
        made[name] = snapshots.read(spark, f"{out}/{name}", rows.schema)
        made[name].createOrReplaceTempView(name)
    return made
