import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.llm import packing

public = pytest.importorskip("public_tokenizers")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60), st.sampled_from(["norm", "dot"]), st.integers(1, 5))
def test_capacities_hold(lengths, score, docs):
    lengths = np.sort(np.array(lengths, float))[::-1]
    sizes = np.column_stack([lengths, np.ones_like(lengths), lengths**2])
    limits = np.array([100.0, docs, 10_000.0])
    bins = packing.vector_best_fit(sizes, limits, score=score)
    for b in set(bins.tolist()):
        assert (sizes[bins == b].sum(axis=0) <= limits).all()
    assert sorted(set(bins.tolist())) == list(range(len(set(bins.tolist()))))


def test_best_fit_fills():
    sizes = np.array([[6.0], [5.0], [5.0], [4.0]])
    assert packing.vector_best_fit(sizes, np.array([10.0])).tolist() == [0, 1, 1, 0]


def test_round_trip(docs, rows):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    got = packing.best_fit_packing(docs, capacity=256).toPandas().sort_values(["doc_id", "piece"])
    for i, text in rows:
        ids = np.array([*own.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        pieces = got[got.doc_id == i]
        assert pieces.piece.tolist() == list(range(len(pieces))) and pieces.length.sum() == len(ids)
        assert (pieces.length.tolist()[1:] == [256] * (len(pieces) - 1)) and (len(pieces) == 1 or len(ids) > 256)
        for p in pieces.itertuples():
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    for _, seq in got.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert seq.offset.tolist() == [0, *seq.length.cumsum().tolist()[:-1]] and seq.length.sum() <= 256
    assert got.sequence_id.nunique() <= 1.05 * got.length.sum() / 256 + 2


def test_limits_and_shards(docs):
    got = packing.best_fit_packing(docs, capacity=256, max_docs=3, max_attention=256.0 * 200, shard=10).toPandas()
    for _, seq in got.groupby("sequence_id"):
        assert len(seq) <= 3 and ((seq.length**2).sum() <= 256 * 200 or len(seq) == 1)


def test_special_tokens_and_speedup_agree():
    from tokenizers import Tokenizer

    own, fast = Tokenizer.from_file(public.path("byte_bpe_50k.json")), packing.encoder("byte_bpe_50k.json")
    for text in ("a <|endoftext|> b", "", "  \n\n x\t ", "it's 1234 naïve 你好 🙂", "é" * 300, "a" * 3000, "   x", "don't\r\nstop"):
        assert list(fast(text)) == own.encode(text, add_special_tokens=False).ids


def test_empty(none):
    assert packing.best_fit_packing(none).count() == 0


def test_repeated_ids(spark):
    """Rows that repeat a doc_id are documents of their own: each has its pieces from 0 on, and all are packed."""
    rows = [(1, "one two three"), (1, "one two three"), (1, "four"), (None, "five"), (None, None)]
    got = packing.best_fit_packing(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    encode = packing.encoder("byte_bpe_50k.json")
    assert sorted(got["length"]) == sorted(len(encode(t or "")) + 1 for _, t in rows) and set(got["piece"]) == {0}
    ends = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    for _, g in ends:
        assert g["offset"].tolist() == (g["length"].cumsum() - g["length"]).tolist()
