import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tallyframe.plans import enrich
from tallyframe.schemas import APP, empty
from tallyframe.sources.config import stable_id, stable_ids
from tallyframe.sources.landing import upsert

NOW = dt.datetime(2026, 7, 15)
M, C = enrich.MERCHANT_EMBEDDINGS, enrich.MERCHANT_CATEGORIES


def rows(spark, n=300):
    """Names that repeat, among them nulls."""
    return spark.createDataFrame([(f"t{k}", f"N{k % n}" if k % 50 else None) for k in range(2 * n)], "transaction_id string, merchant_name string").repartition(2)


def logged(tmp_path, answer):
    """A client that writes down what it is asked, since it runs in another process."""
    import uuid

    folder = str(tmp_path)

    def call(names):
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(json.dumps(names))
        return [answer(n) for n in names]

    return call


def asked(tmp_path):
    return [json.loads(p.read_text()) for p in tmp_path.iterdir()]


def test_embedding_of_what_is_missing(spark, tmp_path):
    cache = empty(spark, APP["merchant_embeddings"])
    names = {f"N{k}" for k in range(300) if k % 50}
    call = logged(tmp_path, lambda n: [float(len(n)), 1.0])
    new, failed = enrich.embed_missing(rows(spark), cache, call, M, "m", NOW)
    calls = asked(tmp_path)
    assert sorted(n for c in calls for n in c) == sorted(names) and max(map(len, calls)) <= 128
    got = {r["merchant_name"]: r for r in new.collect()}
    assert set(got) == names and failed.count() == 0 and len(asked(tmp_path)) == len(calls)
    assert got["N7"]["embedding"] == [2.0, 1.0] and got["N7"]["id"] == stable_id("merchant_embeddings", "m:N7")
    # A second run asks nothing, another model everything.
    cache = upsert(cache, new, ["merchant_name", "model"])
    again, _ = enrich.embed_missing(rows(spark), cache, call, M, "m", NOW)
    assert again.count() == 0 and len(asked(tmp_path)) == len(calls)
    other, _ = enrich.embed_missing(rows(spark), cache, call, M, "other", NOW)
    assert other.count() == len(names)


def test_a_failing_batch_loses_only_itself(spark):
    def call(names):
        if "N7" in names:
            raise RuntimeError("no answer")
        return [[1.0, 2.0]] * len(names)

    new, failed = enrich.embed_missing(rows(spark), empty(spark, APP["merchant_embeddings"]), call, M, "m", NOW, batch=16, wait=0.0)
    lost = {r["name"] for r in failed.collect()}
    assert "N7" in lost and len(lost) <= 16 and {r["error"] for r in failed.collect()} == {"RuntimeError: no answer"}
    assert new.count() + len(lost) == 294 and not lost & {r["merchant_name"] for r in new.collect()}


def test_tries_and_odd_answers(spark, tmp_path):
    folder = str(tmp_path)

    def sometimes(names):
        import os

        os.makedirs(folder, exist_ok=True)
        n = len(os.listdir(folder))
        open(f"{folder}/{n}", "w").close()
        if n < 2:
            raise OSError("busy")
        return [[1.0, 0.0]] * len(names)

    one = spark.createDataFrame([("A",)], "merchant_name string")
    cache = empty(spark, APP["merchant_embeddings"])
    new, failed = enrich.embed_missing(one, cache, sometimes, M, "m", NOW, wait=0.0)
    assert new.count() == 1 and failed.count() == 0
    some = spark.createDataFrame([(x,) for x in "ABCDEFG"], "merchant_name string").coalesce(1)
    answers = {"A": [1.0, 2.0], "B": [1.0], "C": None, "D": [float("nan"), 1.0], "E": [1.0, 3.0], "F": [None, 1.0], "G": [float("inf"), 0.0]}
    new, failed = enrich.embed_missing(some, cache, lambda names: [answers[n] for n in names], M, "m", NOW)
    assert {r["merchant_name"] for r in new.collect()} == {"A", "E"} and {r["name"] for r in failed.collect()} == {"B", "C", "D", "F", "G"}
    short, failed = enrich.embed_missing(some, cache, lambda names: [[1.0]], M, "m", NOW, tries=1)
    assert short.count() == 0 and failed.count() == 7


CATEGORIES = [("f", "Food", None), ("o", "Out", "f"), ("h", "Home", None)]
REPLIES = {
    "GOOD": '{"category": "Food/Out", "confidence": 0.9}', "SURE": '{"category": "Home", "confidence": 7}', "UNSURE": '{"category": "Home", "confidence": -1}',
    "TEXT": '{"category": "Home", "confidence": "0.5"}', "OFF": '{"category": "Out", "confidence": 0.9}', "BROKEN": '{"category": "Food', "NONE": None, "EMPTY": "",
    "LIST": '["Food", 1]', "NO_NUMBER": '{"category": "Food", "confidence": "very"}', "NAN": '{"category": "Food", "confidence": "NaN"}', "MISSING": '{"category": "Food"}',
    "NESTED": '{"category": {"a": 1}, "confidence": 1}', "SQL": "'; DROP TABLE categories; --",
}


def test_classification_of_what_is_missing(spark):
    names = [*REPLIES, "RULED", "NEAR", "CACHED"]
    tx = spark.createDataFrame([(f"t{k}", n) for k, n in enumerate(names + names)], "transaction_id string, merchant_name string")
    decided = [tx.filter(F.col("merchant_name") == n).select("transaction_id") for n in ("RULED", "NEAR")]
    cache = spark.createDataFrame([("x", NOW, None, "CACHED", "m", "h", 0.8)], APP["merchant_llm_categories"])
    categories = spark.createDataFrame(CATEGORIES, "id string, name string, parent_id string")

    def classify(some, paths):
        assert paths == ["Food", "Food/Out", "Home"] and not {"RULED", "NEAR", "CACHED"} & set(some)
        return [REPLIES[n] for n in some]

    new, failed = enrich.classify_missing(tx, decided, "transaction_id", cache, categories, classify, C, "m", NOW, tries=1)
    got = {r["merchant_name"]: (r["category_id"], r["confidence"]) for r in new.collect()}
    assert got == {"GOOD": ("o", 0.9), "SURE": ("h", 1.0), "UNSURE": ("h", 0.0), "TEXT": ("h", 0.5)}
    errors = {r["name"]: r["error"] for r in failed.collect()}
    assert set(errors) == set(REPLIES) - set(got) and errors["OFF"] == "not in the taxonomy" and errors["BROKEN"] == errors["NAN"] == "not a classification"
    # What failed stays on the work-list; the rest is off it.
    cache = upsert(cache, new, ["merchant_name", "model"])
    left = enrich.missing(tx, cache, "merchant_name", "m", decided, "transaction_id")
    assert {r[0] for r in left.collect()} == set(errors)


@pytest.mark.parametrize("parts", [("a", "b"), ("merchant_embeddings", "m:Café €"), ("", "")])
def test_ids_are_those_of_python(spark, parts):
    row = spark.createDataFrame([parts], "a string, b string").select(stable_ids(F.col("a"), F.col("b"))).first()
    assert row[0] == stable_id(*parts)
