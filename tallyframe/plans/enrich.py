"""What models have yet to say: embeddings and categories of names that a cache lacks, by functions that the caller brings.

The work-list is an anti-join with the cache. Its names go out in batches from Arrow's tasks; what comes back is data, not control
flow: a batch that fails says so in its rows and costs the others nothing, and an answer that can't be read is an answer like any
other until a join with the taxonomy sorts it out. Only what is whole gets into the cache, by key, so that a second run asks nothing
again and a repeated one changes nothing.

A function is pickled to the tasks, so it should open its connections itself, at its first call.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.core import tree_paths
from tallyframe.operators.store import held
from tallyframe.schemas import APP, conform
from tallyframe.sources.config import stable_ids

#: Names to a call.
BATCH = 128
#: Calls of one batch before it is given up, and seconds before the second one; each further wait is twice as long.
TRIES, WAIT = 3, 0.5


@dataclass(frozen=True)
class Cache:
    """An app table that keeps what models said about names. table: its name; name: the column that it knows them by."""

    table: str
    name: str


MERCHANT_EMBEDDINGS, PRODUCT_EMBEDDINGS = Cache("merchant_embeddings", "merchant_name"), Cache("product_embeddings", "product_name")
MERCHANT_CATEGORIES, PRODUCT_CATEGORIES = Cache("merchant_llm_categories", "merchant_name"), Cache("product_llm_categories", "product_name")


def missing(rows: DataFrame, cache: DataFrame, name: str, model: str, decided: Sequence[DataFrame] = (), key: str | None = None) -> DataFrame:
    """The distinct names of `rows` that the cache lacks for `model`. decided: rows (by `key`) that earlier stages have settled."""
    for d in decided:
        rows = rows.join(d.select(key), key, "left_anti")
    names = rows.filter(F.col(name).isNotNull()).select(name).distinct()
    return names.join(cache.filter(F.col("model") == model).select(name), name, "left_anti")


def _called(names: DataFrame, call: Callable[[list[str]], Sequence], kind: str, batch: int, tries: int, wait: float) -> DataFrame:
    """name, answer (of type `kind`), error: what `call` gives for each name of a batch, or why the batch came to nothing."""
    import pyarrow as pa

    arrow = {"array<double>": pa.list_(pa.float64()), "string": pa.string()}[kind]

    def asked(some: list[str]):
        for k in range(tries):
            try:
                answers = list(call(some))
                if len(answers) != len(some):
                    raise ValueError(f"{len(answers)} answers to {len(some)} names")
                return pa.array(answers, arrow), None
            except Exception as e:  # whatever a client raises is this batch's own affair
                error = f"{type(e).__name__}: {e}"[:500]
                if k + 1 < tries:
                    time.sleep(wait * 2**k)
        return pa.nulls(len(some), arrow), error

    def run(batches):
        left: list[str] = []

        def answered(some):
            answers, error = asked(some)
            return pa.RecordBatch.from_arrays([pa.array(some, pa.string()), answers, pa.array([error] * len(some), pa.string())], ["name", "answer", "error"])

        for rows in batches:
            left += rows.column(0).to_pylist()
            while len(left) >= batch:
                yield answered(left[:batch])
                left = left[batch:]
        if left:
            yield answered(left)

    # Each name is asked for once: what a later action or a retried stage reads is the checkpoint.
    return held(names.toDF("name").mapInArrow(run, f"name string, answer {kind}, error string"))


def _identified(rows: DataFrame, cache: Cache, model: str, at) -> DataFrame:
    """`rows` as the cache's, with ids that are the same for the same name and model."""
    known = stable_ids(F.lit(cache.table), F.concat(F.lit(f"{model}:"), cache.name))
    return conform(rows.withColumns({"id": known, "created_at": F.lit(at), "model": F.lit(model)}), APP[cache.table])


def embed_missing(
    rows: DataFrame, vectors: DataFrame, embed: Callable[[list[str]], Sequence[Sequence[float]]], cache: Cache, model: str, at, batch: int = BATCH, tries: int = TRIES, wait: float = WAIT
) -> tuple[DataFrame, DataFrame]:
    """(rows to upsert into the cache, failures: name, error) for every name that has no vector yet, categorised or not.

    A vector must have the length that the model's others have, or that most of this run's have, and finite numbers alone.
    """
    asked = _called(missing(rows, vectors, cache.name, model), embed, "array<double>", batch, tries, wait)
    said = asked.filter("error IS NULL")
    known = vectors.filter(F.col("model") == model).select(F.size("embedding").alias("n"))
    lengths = (known if not known.isEmpty() else said.filter("answer IS NOT NULL").select(F.size("answer").alias("n"))).groupBy("n").count()
    length = lengths.orderBy(F.desc("count"), "n").first()
    finite = F.forall("answer", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce((F.size("answer") == (length["n"] if length else 0)) & finite, F.lit(False))
    judged = asked.withColumn("error", F.coalesce("error", F.when(~good, "not a vector of this model")))
    new = judged.filter("error IS NULL").select(F.col("name").alias(cache.name), F.col("answer").alias("embedding"))
    return _identified(new, cache, model, at), judged.filter("error IS NOT NULL").select("name", "error")


def parsed(answers: DataFrame, paths: DataFrame) -> DataFrame:
    """name, category_id, confidence, error of answers (name, answer: JSON text with category, a path of the taxonomy, and confidence).

    A confidence is clamped to 0 to 1. What can't be read, names no path of `paths` (id, path) or isn't sure by a number is an error.
    """
    read = F.from_json("answer", "category string, confidence string")
    rows = answers.select("name", read.alias("r")).select("name", F.col("r.category").alias("path"), F.expr("try_cast(r.confidence AS double)").alias("sure"))
    rows = rows.join(paths.select("path", F.col("id").alias("category_id")), "path", "left")
    error = F.when(F.col("path").isNull() | F.col("sure").isNull() | F.isnan("sure"), "not a classification").when(F.col("category_id").isNull(), "not in the taxonomy")
    return rows.select("name", "category_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "sure")).alias("confidence"), error.alias("error"))


def classify_missing(
    rows: DataFrame, decided: Sequence[DataFrame], key: str, said: DataFrame, categories: DataFrame, classify: Callable[[list[str], list[str]], Sequence[str | None]],
    cache: Cache, model: str, at, batch: int = BATCH, tries: int = TRIES, wait: float = WAIT,
) -> tuple[DataFrame, DataFrame]:
    """(rows to upsert into the cache, failures: name, error) for the names that earlier stages and the cache leave open.

    classify(names, paths): a JSON text for each name, or None. It is untrusted: see parsed(). Names that failed stay on the work-list.
    categories: id, name, parent_id, a table of configuration whose paths every call is given.
    """
    paths = held(tree_paths(categories.select("id", "name", "parent_id")).select("id", "path"))
    offered = [r["path"] for r in paths.orderBy("path").collect()]
    asked = _called(missing(rows, said, cache.name, model, decided, key), lambda names: classify(names, offered), "string", batch, tries, wait)
    judged = parsed(asked.filter("error IS NULL"), paths)
    new = judged.filter("error IS NULL").select(F.col("name").alias(cache.name), "category_id", "confidence")
    failed = asked.filter("error IS NOT NULL").select("name", "error").union(judged.filter("error IS NOT NULL").select("name", "error"))
    return _identified(new, cache, model, at), failed
