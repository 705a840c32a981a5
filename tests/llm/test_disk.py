"""What operators leave in the shared folder."""

import pyarrow.parquet as pq

from tallyframe.llm import common
from tallyframe.llm.jaccard import jaccard_classes


def test_keys_go_once_lists_are_made(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_folder", lambda _: f"file://{tmp_path}/shared")
    text = " ".join(f"w{k}" for k in range(80))
    docs = spark.createDataFrame([(k, f"{text} {k % 3}" if k < 6 else f"other {k} words {k * 7} here {k}") for k in range(20)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_classes(docs).collect()}
    left = [pq.read_schema(f).names for f in tmp_path.glob("shared/stored-*/*.parquet")]
    assert left and not any("blocks" in names for names in left)
    assert {got[k] for k in range(6)} == {0} and all(got[k] == k for k in range(6, 20))
