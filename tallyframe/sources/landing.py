"""The landing layer: append-only Parquet by source, idempotent by row_hash; and small tables that are rewritten.

Each is a table of commits (see snapshots.py), so writers of several processes and machines are safe, and readers never see half of
anything.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyframe.operators.core import latest_per_key
from tallyframe.schemas import BRONZE, BRONZE_ORDERS, columns

from . import snapshots
from .config import IngestionError, Source
from .exports import read
from .snapshots import exists, replace

__all__ = ["append_new", "bronze", "bronze_orders", "current", "exists", "ingest", "insert_missing", "read_or_empty", "replace", "row_count", "row_hashes", "upsert"]


def read_or_empty(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table at `path`, or all tables that a glob names; columns matched by name; empty with `schema` if there is none."""
    fs = snapshots.file_system(spark, path)
    found = fs.globStatus(snapshots._jvm(spark).Path(path)) or []
    paths = [p for status in found for p in snapshots.snapshot(spark, status.getPath().toString()).paths]
    return snapshots.load(spark, paths, schema)


def folder_of(root: str, s: Source) -> str:
    return f"{root}/{'bronze_orders' if s.kind == 'orders' else 'bronze'}/{s.name}"


def bronze(spark: SparkSession, root: str) -> DataFrame:
    return read_or_empty(spark, f"{root}/bronze/*", BRONZE)


def bronze_orders(spark: SparkSession, root: str) -> DataFrame:
    return read_or_empty(spark, f"{root}/bronze_orders/*", BRONZE_ORDERS)


def row_hashes(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, path, columns("row_hash string")).select("row_hash").distinct()


def row_count(spark: SparkSession, path: str) -> int:
    return read_or_empty(spark, path, columns("row_hash string")).count()


def append_new(rows: DataFrame, path: str, batch: str | None = None, distinct: bool = False) -> int:
    """Append the rows whose row_hash isn't there yet, exactly once, whoever else appends; how many these were.

    batch: a name (of a file's content, say) that lands once. distinct: rows have each row_hash once as they are.
    """
    once = rows if distinct else rows.dropDuplicates(["row_hash"])
    fresh = lambda old: once.join(old.select("row_hash"), "row_hash", "left_anti").select(*rows.columns)
    return snapshots.append(rows.sparkSession, path, fresh, rows.schema, batch)


def ingest(spark: SparkSession, s: Source, path: str, root: str) -> int:
    """Land an export; the number of new rows. Anything wrong with the file is an IngestionError, and nothing lands."""
    try:
        return append_new(read(spark, s, path), folder_of(root, s), distinct=s.kind == "orders")
    except IngestionError:
        raise
    except Exception as e:
        raise IngestionError(f"{s.name}: {path}: {str(e)[:500]}") from e


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], keep: Sequence[str] = ("note",)) -> DataFrame:
    """`old` with the rows of `new` in place of those with the same key; columns in `keep` stay as they were where new has null."""
    kept = old.select(*key, *(F.col(c).alias(f"_{c}") for c in keep if c in old.columns))
    fresh = new.join(kept, list(key), "left")
    for c in keep:
        if c in old.columns:
            fresh = fresh.withColumn(c, F.coalesce(c, f"_{c}")).drop(f"_{c}")
    return old.join(new.select(*key), list(key), "left_anti").select(*old.columns).unionByName(fresh.select(*old.columns))


def insert_missing(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*key), list(key), "left_anti").select(*old.columns))


def current(decisions: DataFrame, by: Sequence[str]) -> DataFrame:
    """The latest of append-only decisions."""
    return latest_per_key(decisions, by, "created_at", ["id"])
