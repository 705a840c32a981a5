"""Schemas of landing rows and of the app's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DateType, DecimalType, DoubleType, IntegerType, LongType, StringType, StructType, TimestampType

_TYPES = {"string": StringType(), "timestamp": TimestampType(), "date": DateType(), "int": IntegerType(), "bigint": LongType(), "double": DoubleType()}


def columns(text: str) -> StructType:
    """name type, ... as a schema; unlike Spark's own parser this needs no session."""

    def kind(t: str) -> DataType:
        if t.startswith("array<"):
            return ArrayType(kind(t[6:-1]))
        if t.startswith("decimal("):
            return DecimalType(*map(int, t[8:-1].split(",")))
        return _TYPES[t]

    out = StructType()
    for part in text.split(", "):
        name, _, t = part.partition(" ")
        out.add(name, kind(t))
    return out


BRONZE = columns(
    "source string, account_name string, account_type string, currency string, source_file string, ingested_at timestamp, "
    "posted_on date, amount decimal(18,2), description_raw string, external_id string, row_hash string"
)
BRONZE_ORDERS = columns(
    "source string, source_file string, ingested_at timestamp, row_hash string, website_order_id string, order_date date, ship_date date, "
    "asin string, product_name string, quantity bigint, currency string, order_status string, shipment_status string, "
    "unit_price decimal(18,2), unit_price_tax decimal(18,2), shipping_charge decimal(18,2), total_discounts decimal(18,2), "
    "shipment_item_subtotal decimal(18,2), shipment_item_subtotal_tax decimal(18,2), total_owed decimal(18,2)"
)

_OWN = "id string, created_at timestamp, note string"
#: Tables that users and models write; each also has id, created_at and note.
APP = {
    name: columns(f"{_OWN}, {own}")
    for name, own in {
        "categories": "name string, parent_id string, description string",
        "accounts": "name string, account_type string, currency string",
        "merchants": "name string, aliases array<string>",
        "rules": "pattern string, applies_to string, category_id string, priority int",
        "merchant_aliases": "pattern string, canonical_name string, priority int",
        "merchant_merges": "merchant_name string, canonical_name string, similarity double, status string",
        "merchant_embeddings": "merchant_name string, model string, embedding array<double>",
        "product_embeddings": "product_name string, model string, embedding array<double>",
        "merchant_llm_categories": "merchant_name string, model string, category_id string, confidence double",
        "product_llm_categories": "product_name string, model string, category_id string, confidence double",
        "labels": "subject_kind string, subject_id string, category_id string",
        "budgets": "name string, category_id string, period string, amount decimal(18,2), starts_on date",
        "transactions": "account_id string, posted_on date, amount decimal(18,2), description string",
        "transaction_splits": "transaction_id string, product_name string, quantity decimal(18,4), unit_price decimal(18,4), amount decimal(18,2)",
        "documents": "kind string, path string, parsed_payload string",
        "recurring_flows": "merchant_name string, flow string, amount decimal(18,2), cadence string",
        "forecasts": "series_kind string, series_key string, series_label string, category_id string, period_start date, horizon int, committed decimal(18,2), "
        "variable decimal(18,2), predicted decimal(18,2), lower decimal(18,2), upper decimal(18,2), interval_level int, model_name string, mase double, trend string, trained_through date",
    }.items()
}
#: What makes rows of a table the same, besides id.
UNIQUE = {
    "merchant_embeddings": ("merchant_name", "model"),
    "product_embeddings": ("product_name", "model"),
    "merchant_llm_categories": ("merchant_name", "model"),
    "product_llm_categories": ("product_name", "model"),
    "forecasts": ("series_key", "period_start"),
}


def empty(spark: SparkSession, schema: StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """`df` with the columns, order and types of `schema`; columns that it lacks are null, others go."""
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
