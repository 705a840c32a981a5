"""What the substring operators shuffle and leave in the shared folder."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from tallyframe.llm import common, rlz, spans, suffix


@pytest.mark.parametrize("f", [rlz.substring_dedup, suffix.suffix_dedup])
def test_candidates_and_pieces_go(docs, tmp_path, monkeypatch, f):
    """What is left are spans: segments' places, minimizers and bytes are deleted once they have been compared."""
    monkeypatch.setattr(common, "shared_folder", lambda _: f"file://{tmp_path}/shared")
    removed = f(docs).filter("n_removed > 0").count()
    left = [pq.read_schema(p).names for p in tmp_path.glob("shared/stored-*/*.parquet")]
    assert removed and left and not any({"route", "payload"} & set(names) for names in left)


def test_texts_are_shuffled_at_any_size(docs, spark):
    """So that what a small table takes tells what a large one will."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = suffix.suffix_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("words", [True, False])
def test_parts_are_all_segments(rows, words):
    """Each segment is of one part, which has its minimizer where it says."""
    units = spans.Units(words, 50, 8 if words else 16)
    raw = [(t or "").encode() for _, t in rows]
    values, first = units.values(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    whole = set(zip(*(x.tolist() for x in spans.segments_of(values, first, units))))
    parts = [set(zip(*(x.tolist() for x in spans.segments_of(values, first, units, k, 3)))) for k in range(3)]
    assert whole == set().union(*parts) and len(whole) == sum(map(len, parts)) and all(parts)
    rolling = common.Rolling(values, 1)
    for text, start, n, off, minimizer, _, _ in whole:
        at = first[text] + start + off
        assert rolling.of(np.array([at]), np.array([at + units.gram]))[0] == minimizer and 0 <= off <= units.width - units.gram
    assert sum(n for _, _, n, *_ in whole) == sum(max(0, m - 49) for m in np.diff(first))
