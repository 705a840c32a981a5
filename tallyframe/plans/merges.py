"""Merging merchants that are one: candidates by embedding, and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.exprs import cosine
from tallyframe.operators.core import latest_per_key
from tallyframe.operators.vectors import cosine_pairs, nearest_before


def name_pairs(vectors: DataFrame, threshold: float) -> DataFrame:
    """a < b, similarity of names (name, embedding) that reach `threshold`."""
    return cosine_pairs(vectors, "name", "embedding", threshold)


def candidates(vectors: DataFrame, merchants: DataFrame, merges: DataFrame, model: str, threshold: float = 0.90, limit: int = 20) -> DataFrame:
    """The best canonical name for each variant: towards more transactions, of equal ones the smaller name; undecided variants only."""
    own = vectors.filter(F.col("model") == model).select("merchant_name", "embedding").join(merchants.select("merchant_name", "transaction_count"), "merchant_name")
    best = nearest_before(own, "merchant_name", "embedding", threshold, "transaction_count")
    best = best.select(F.col("b").alias("merchant_name"), F.col("a").alias("canonical_name"), "similarity")
    open_ = best.join(merges.select("merchant_name").distinct(), "merchant_name", "left_anti")
    return open_.orderBy(F.col("similarity").desc(), "merchant_name").limit(limit)


def similarity(vectors: DataFrame, model: str, a: str, b: str) -> float | None:
    rows = {r["merchant_name"]: r["embedding"] for r in vectors.filter((F.col("model") == model) & F.col("merchant_name").isin(a, b)).select("merchant_name", "embedding").collect()}
    if a not in rows or b not in rows:
        return None
    spark = vectors.sparkSession
    return spark.createDataFrame([(rows[a], rows[b])], "x array<double>, y array<double>").select(cosine(F.col("x"), F.col("y"))).first()[0]


def decide(merges: DataFrame, merchants: DataFrame, name: str, canonical: str, status: str, similarity: float | None, at, id_: str) -> DataFrame:
    """`merges` with one more decision. No merge into itself, of unknown names, or back into what was merged into it."""
    if status not in ("accepted", "rejected"):
        raise ValueError(f"status {status}")
    if name == canonical:
        raise ValueError("a merchant can't be merged into itself")
    known = merchants.select("merchant_name").union(merges.select("merchant_name")).union(merges.select("canonical_name"))
    if known.filter(F.col("merchant_name").isin(name, canonical)).distinct().count() < 2:
        raise ValueError("unknown merchant")
    if status == "accepted":
        back = latest_per_key(merges.filter(F.col("merchant_name") == canonical), ["merchant_name"], "created_at", ["id"])
        if back.filter((F.col("canonical_name") == name) & (F.col("status") == "accepted")).count():
            raise ValueError("the canonical merchant is merged into this one")
    row = merges.sparkSession.createDataFrame([(id_, at, None, name, canonical, similarity, status)], merges.schema)
    return merges.unionByName(row)


def carry_forward(cache: DataFrame, column: str, name: str, canonical: str) -> DataFrame:
    """Rows of a cache to add when `name` becomes `canonical`: copies for models that the canonical name lacks."""
    have = cache.filter(F.col(column) == canonical).select("model")
    return cache.filter(F.col(column) == name).join(have, "model", "left_anti").select(*cache.columns).withColumn(column, F.lit(canonical)).withColumn("id", F.md5(F.concat_ws("|", column, "model")))
