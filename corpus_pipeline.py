"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again as the next one's input.

A row is known by its doc_id and a digest of its text (null counts as empty), so null and repeated ids are judged row by row. Rows
that repeat both are one document, of which the exact stage leaves one. All columns of the input are handed on, whatever their names: a
row travels as one column, and comes apart again at a stage's end.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import shared_folder, table
from tallyframe.llm.exact_dedup import exact_dedup
from tallyframe.llm.jaccard import BROADCAST_ROWS, jaccard_classes
from tallyframe.llm.mixing import mix
from tallyframe.llm.packing import best_fit_packing
from tallyframe.llm.quality import quality_rules

#: Near duplicates: shingles of so many words, and a Jaccard similarity of so many hundredths.
WORDS, SIMILARITY = 5, (80, 100)
KEY = ("_id", "_digest")


def _keyed(docs: DataFrame, *own: str) -> DataFrame:
    """doc_id, text, the columns in `own`, KEY, and the whole row as one column, in which names can't clash with these."""
    digest = _short(F.sha2(F.coalesce("text", F.lit("")), 256))
    return docs.select("doc_id", "text", *own, F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), digest.alias("_digest"), F.struct("*").alias("_row"))


def _short(digest):
    return F.substring(digest, 1, 16)


def _stay(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of `keyed`, as they came, whose KEY is in `keys`: broadcast if these are few, else a shuffled semi-join."""
    few = keys.limit(BROADCAST_ROWS // 2 + 1).count() <= BROADCAST_ROWS // 2
    return keyed.join(F.broadcast(keys) if few else keys, list(KEY), "left_semi").select("_row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. Repeated rows stay repeated; a null text has no words and goes."""
    judged = quality_rules(docs, table(spark, sf_dir, "labels"), carry=True)
    # A filter would be pushed down with the verdict's whole expression in it, over and over; this stays where it is.
    return judged.select(F.explode(F.when(F.col("kept"), F.array("row"))).alias("row")).select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays, as one row: of several, the first by its other columns."""
    verdict = exact_dedup(docs).filter("kept").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), _short(F.col("text_sha256")).alias("_digest"))
    counted = verdict.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_rows"))
    path = f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}"
    counted.write.parquet(path)
    counted, keyed = spark.read.parquet(path), _keyed(docs)
    once = _stay(keyed, counted.filter("_rows = 1").select(*KEY))
    repeated = counted.filter("_rows > 1").select(*KEY)
    if repeated.isEmpty():
        return once
    # A map has no order of its own; its text has.
    others = [F.to_json(F.struct(F.col("_row")[c])) if "map<" in kind else F.col("_row")[c] for c, kind in docs.dtypes if c not in ("doc_id", "text")]
    first = F.row_number().over(Window.partitionBy(*KEY).orderBy(*others, F.col("text").desc_nulls_last()))
    one = keyed.join(repeated, list(KEY), "left_semi").withColumn("_first", first).filter("_first = 1").select("_row.*")
    return once.unionByName(one)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id stays, one without id last; texts without words all stay."""
    classes = jaccard_classes(_keyed(docs), SIMILARITY, WORDS, carry=KEY)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_digest")
    first = classes.filter("n_shingles > 0").groupBy("class").agg(F.min_by(F.struct(*KEY), order).alias("k")).select("k.*")
    return _stay(_keyed(docs), first.union(classes.filter("n_shingles = 0").select(*KEY)))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay with the probability that brings sources, languages and topics to their target shares."""
    return _stay(_keyed(docs), mix(_keyed(docs, "source", "lang"), carry=KEY).filter("kept").select(*KEY))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, each with its place in a sequence."""
    return best_fit_packing(docs)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing", mixture), ("best-fit packing", packing)]

#: Hashed n-gram ratios and components of links aren't for SQL; tests/llm has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the tables in `sf_dir`. A stage's output goes once the next one has written its own."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            before = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
            before.getFileSystem(spark._jsc.hadoopConfiguration()).delete(before, True)
    return docs
