"""Exact deduplication over a persistent digest index.

The index is a table bucketed and sorted by SHA-256 digest. A batch is reduced to one row per digest (combined map-side, so a
text with a billion copies is one row a task), a sort-merge anti-join leaves the digests that the index lacks, and these are
appended. Only digests and ids travel, never texts.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Digests to a bucket (some 100 MB), and the least and the most buckets of a new index.
PER_BUCKET, LEAST, MOST = 1_000_000, 16, 1 << 16


class DigestIndex:
    """Digests that were ever kept, with the id that was kept and the batch that brought it.

    Of equal texts in a batch the row with the largest doc_id stays; a text that the index has from another batch stays out. Null
    text counts as empty, and a null doc_id is smaller than any other. Rows that repeat doc_id and text are the same document: all
    of them carry the same verdict. An empty batch appends nothing. A batch that is added again, after a failure or by mistake,
    appends only what it lacks and gives the same verdicts. Input columns other than doc_id and text are not read, so their names
    can't clash.
    """

    def __init__(self, spark: SparkSession, name: str, expected: int = 0):
        """expected: digests that a new index is made for; its number of buckets follows from it."""
        self.spark, self.name = spark, name
        if not spark.catalog.tableExists(name):
            buckets = min(MOST, max(LEAST, 1 << math.ceil(math.log2(max(1, expected / PER_BUCKET)))))
            spark.sql(f"CREATE TABLE {name} (digest STRING, keep_id BIGINT, batch STRING) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def buckets(self) -> int:
        return int(self.told("Num Buckets"))

    def told(self, what: str) -> str:
        return self.spark.sql(f"DESCRIBE FORMATTED {self.name}").filter(F.col("col_name") == what).first()["data_type"]

    def append(self, docs: DataFrame, batch: str | None = None) -> None:
        """Add what the index lacks of a batch, in the order of its buckets."""
        fresh = heads(digests(docs)).join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        n = self.buckets()
        rows = fresh.select("digest", "keep_id", F.lit(batch or uuid.uuid4().hex).alias("batch")).repartition(n, "digest")
        rows.write.bucketBy(n, "digest").sortBy("digest").mode("append").format("parquet").saveAsTable(self.name)

    def verdicts(self, docs: DataFrame, batches: list[str]) -> DataFrame:
        """Per row of documents that came in `batches`: doc_id, keep_id, group_size (rows of `docs` with this text), kept, text_sha256."""
        rows = digests(docs)
        # The anti-join reads the index by bucket, this reads its plain files: both sides are then ordinary exchanges, and a digest
        # with a large share of all rows can be split at run time.
        index = self.spark.read.schema(self.rows().schema).parquet(self.told("Location"))
        verdict = index.join(heads(rows).select("digest", "group_size"), "digest")
        kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.col("batch").isin(batches)
        return rows.join(verdict, "digest").select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"))


def digests(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))


def heads(rows: DataFrame) -> DataFrame:
    """digest, keep_id, group_size: combined map-side, so a text with many copies is one row a task."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def exact_dedup(docs: DataFrame, index: str | None = None, batch: str | None = None) -> DataFrame:
    """Deduplicate `docs` against the index of that name and append what is new. See DigestIndex.

    Without an index, a new one: the half of the documents with the larger ids is its first batch, and the other half is
    deduplicated against it, so that of equal texts the largest doc_id stays all the same. Neither half's size matters for the
    result; a null doc_id is in the second.
    """
    spark = docs.sparkSession
    if index:
        name = batch or uuid.uuid4().hex
        found = DigestIndex(spark, index, 0 if spark.catalog.tableExists(index) else docs.count())
        found.append(docs, name)
        return found.verdicts(docs, [name])
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("doc_id", 0.5, 1000).alias("middle")).first()
    found = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", size["n"])
    first = F.coalesce(F.col("doc_id") > F.lit(size["middle"]), F.lit(False))
    found.append(docs.filter(first), "first")
    found.append(docs.filter(~first), "second")
    return found.verdicts(docs, ["first", "second"])
