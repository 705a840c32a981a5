"""Best-fit packing of token sequences under vector capacities."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

CAPACITY = 2048
#: Pieces to a shard: what one task packs at a time. A shard leaves at most a few sequences part-filled.
SHARD = 4096


def vector_best_fit(sizes: np.ndarray, capacity: np.ndarray, weights: np.ndarray | None = None, score: str = "norm") -> np.ndarray:
    """A bin for each item: largest first, into the feasible open bin that scores best, else a new one.

    sizes: (n, d) demands, none over `capacity`. score "norm": the least weighted norm of what the bin has left after the item;
    "dot": the largest weighted dot product of demand and what the bin has left before it. Ties: the oldest bin. Demands and
    capacities are scaled to 1 for the score.
    """
    n, d = sizes.shape
    scale = (np.ones(d) if weights is None else np.asarray(weights, float)) / np.asarray(capacity, float) ** 2
    left = np.empty((n, d))
    ids = np.empty(n, np.int64)
    out = np.empty(n, np.int64)
    least = np.minimum.accumulate(sizes[::-1], axis=0)[::-1]  # of the items from here on
    used = made = 0
    for i in range(n):
        need = sizes[i]
        open_ = left[:used]
        fits = np.flatnonzero((open_ >= need).all(axis=1))
        if len(fits):
            room = open_[fits]
            value = -(((room - need) ** 2) @ scale) if score == "norm" else (room * need) @ scale
            at = fits[int(value.argmax())]
        else:
            at, used = used, used + 1
            left[at], ids[at], made = capacity, made, made + 1
        left[at] -= need
        out[i] = ids[at]
        if i + 1 < n and (left[at] < least[i + 1]).any():  # nothing to come fits: close it, keeping the order of age
            left[at : used - 1] = left[at + 1 : used]
            ids[at : used - 1] = ids[at + 1 : used]
            used -= 1
    return out


def tokenised(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's pieces: its ids, then id 0.

    Longer documents are cut into pieces of `capacity`; the first piece takes what is over. Null text is an empty one. The
    vocabulary is read once a task, from `tokenizer`, a folder-less name of the public tokenizers or a path.
    """

    def pieces(batches):
        encode = encoder(tokenizer)
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                ids = encode(text if isinstance(text, str) else "")
                ids = np.append(np.asarray(ids, "<u4"), np.uint32(0))
                end = len(ids) % capacity or min(capacity, len(ids))
                start = piece = 0
                while start < len(ids):
                    rows.append((doc_id, piece, start, end - start, zlib.crc32(ids[start:end].tobytes())))
                    start, end, piece = end, end + capacity, piece + 1
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInPandas(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long")


def encoder(name: str):
    """text -> ids, without special tokens added.

    Ids are those of the `tokenizers` file. Where the same vocabulary is there as ranks (name.tiktoken), these give the same ids
    several times faster; a text that spells a special token goes through the file itself, which knows those.
    """
    import os

    import public_tokenizers

    path = name if os.path.sep in name else public_tokenizers.path(name)
    ranks = path.removesuffix(".json") + ".tiktoken"

    def exact():
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        return Tokenizer.from_file(path)

    if not os.path.exists(ranks):
        own = exact()
        return lambda text: own.encode(text, add_special_tokens=False).ids
    import base64

    import tiktoken

    with open(ranks, "rb") as file:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
    slow = []

    def encode(text: str):
        if "<|endoftext|>" in text:
            slow or slow.append(exact())
            return slow[0].encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def pack(pieces: DataFrame, capacity: int = CAPACITY, max_docs: int | None = None, max_attention: float | None = None, score: str = "norm", shard: int = SHARD) -> DataFrame:
    """`pieces` (doc_id, piece, length and more) with sequence_id, offset: vector best-fit within shards of about `shard` pieces.

    Each sequence holds at most `capacity` tokens, `max_docs` pieces and `max_attention` (the sum of squared lengths); by
    default these two don't bind. Shards are by hash of the piece, so that neither a source nor a long document fills one.
    A piece longer than the capacity is an error. An empty table gives an empty one.
    """
    limits = np.array([capacity, max_docs or capacity, max_attention or float(capacity) ** 2], float)
    pieces = cut(pieces)
    shards = max(1, math.ceil(pieces.count() / shard))
    schema = pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if (pdf["length"] > capacity).any():
            raise ValueError(f"a piece is longer than {capacity} tokens")
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], ignore_index=True)
        length = pdf["length"].to_numpy(float)
        bins = vector_best_fit(np.column_stack([length, np.ones_like(length), length**2]), limits, score=score)
        pdf["sequence_id"] = key[0] * (1 << 32) + bins
        pdf["offset"] = (pdf.groupby(bins)["length"].cumsum() - pdf["length"]).astype("int64")
        return pdf

    shard_of = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards))
    packed = pieces.withColumn("_shard", shard_of).groupBy("_shard")
    return packed.applyInPandas(lambda key, pdf: fit(key, pdf.drop(columns="_shard")), schema)


def best_fit_packing(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", capacity: int = CAPACITY, **limits) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. See tokenised and pack.

    Rows that repeat a doc_id, or have none, are documents of their own, each with pieces from 0 on. Null text is empty: its one piece
    is the id that ends a document.
    """
    return pack(tokenised(docs, tokenizer, capacity), capacity, **limits)
