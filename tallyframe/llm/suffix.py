"""Substring deduplication by suffix arrays, over bytes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .spans import Units, compared, factor_rows, route_blocks, strip

BYTES, GRAM = 50, 16
#: Bytes of text to a shard, for which one suffix array is made.
SHARD = 2 << 20
LANES = 4096


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order.

    Larsson and Sadakane: ranks by a short prefix, then each round orders suffixes of one rank by the rank of what follows that
    prefix, which doubles it. Suffixes alone in their rank are done and take no further part.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    letter = np.cumsum(np.bincount(text, minlength=256) > 0)  # from 1: the end sorts first
    base = int(letter[-1]) + 1
    h = int(62 / np.log2(base))  # so many letters fit a key
    padded = np.zeros(n + h, np.int64)
    padded[:n] = letter[text]
    key = np.zeros(n, np.int64)
    for j in range(h):
        key *= base
        key += padded[j : j + n]
    order = np.argsort(key)
    key = key[order]
    head = np.ones(n, bool)
    head[1:] = key[1:] != key[:-1]
    at = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[order], rank[n] = at + 1, 0
    alone = head & np.r_[head[1:], True]
    open_ = np.flatnonzero(~alone)  # places in the order whose suffix isn't alone
    while len(open_) and h < n:
        suffix = order[open_]
        key = at[open_] * (n + 1) + rank[np.minimum(suffix + h, n)]
        o = np.argsort(key)
        suffix, key = suffix[o], key[o]
        order[open_] = suffix
        head = np.ones(len(o), bool)
        head[1:] = key[1:] != key[:-1]
        new = open_[np.maximum.accumulate(np.where(head, np.arange(len(o)), 0))]
        at[open_] = new
        rank[suffix] = new + 1
        alone = head & np.r_[head[1:], True]
        open_ = open_[~alone]
        h *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Of each suffix in order and the one before it, the common prefix, up to `most`: Kasai's scan in text order.

    The scan keeps what it knows from the suffix one place to the left, less one. Many stretches of the text are scanned side by
    side, each from nothing and at its own pace, eight bytes at a time.
    """
    n = len(text)
    before = np.full(n, n, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.zeros(n + most + 16, np.uint8)
    padded[:n] = text
    eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)).view("<u8").ravel()
    length = -(-n // max(1, min(LANES, n // 64)))
    i = np.arange(0, n, length)
    end = np.minimum(i + length, n)
    known = np.zeros(len(i), np.int64)
    out = np.zeros(n, np.int64)
    while len(i):
        j = before[i]
        room = np.minimum(n - np.maximum(i, j), most)
        unlike = eight[i + known] ^ eight[j + known]
        known = np.minimum(known + (np.bitwise_count(~unlike & (unlike - np.uint64(1))) >> 3), room)  # bytes below the first unlike one
        done = (unlike != 0) | (known == room)
        out[i[done]] = known[done]
        known = np.where(done, np.maximum(known - 1, 0), known)
        i = i + done
        live = i < end
        if not live.all():
            i, end, known = i[live], end[live], known[live]
    return out[order]


def _keys(text: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    """The windows at `places` as fixed-length byte strings (of one length, so that dropped zero ends don't confuse them)."""
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, width)[places]).view(f"S{width}").ravel()


def least_owners(doc: np.ndarray, start: np.ndarray, n: np.ndarray, raw: bytes, width: int):
    """Of each window of a shard, the smallest document of the shard that has it, where, and the windows' places in `raw`.

    The shard's suffix array and its common prefixes: suffixes whose common prefixes reach `width` are one class. Segments that may
    share windows come in order of doc_id, so that a class's first place is its smallest document's.
    """
    text = np.frombuffer(raw, np.uint8)
    length = n + width - 1
    begin = np.cumsum(length) - length
    segment = np.repeat(np.arange(len(n)), n)
    inner = np.arange(len(segment)) - np.repeat(np.cumsum(n) - n, n)
    places = begin[segment] + inner
    order = suffix_array(text)
    head = common_prefixes(text, order, width) < width
    group = np.empty(len(text), np.int64)
    group[order] = np.cumsum(head) - 1
    group = group[places]
    least = np.full(int(head.sum()), len(segment))
    np.minimum.at(least, group, np.arange(len(segment)))
    least = least[group]
    return doc[segment[least]], start[segment[least]] + inner[least], places


def repeated(width: int, shard: int = SHARD):
    """For compared(): runs of windows that a smaller document has.

    All segments with one minimizer meet, in order of doc_id, in shards of about `shard` bytes. Segments of a shard with the same
    bytes are one, the earliest document's, in its suffix array, and share what it finds. A minimizer whose segments are more than
    one shard has its shards merged: the windows of each are looked up by binary search in the sorted windows of those before it.
    """

    def run(batches):
        seen, first, where = np.zeros(0, f"S{width}"), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for more, route, doc, start, n, payload in route_blocks(batches, shard):
            coded = payload.combine_chunks().dictionary_encode()
            code = coded.indices.to_numpy(zero_copy_only=False)
            one = np.unique(code, return_index=True)[1]  # rows come by doc_id, so it is the earliest that has these bytes
            raw = b"".join(coded.dictionary.to_pylist())
            text = np.frombuffer(raw, np.uint8)
            least, at, places = least_owners(doc[one], start[one], n[one], raw, width)
            if not more:
                seen, first, where = seen[:0], first[:0], where[:0]
            if len(seen):
                ours = np.flatnonzero(np.repeat(route[one], n[one]) == route[0])
                keys = _keys(text, places[ours], width)
                found = np.minimum(np.searchsorted(seen, keys), len(seen) - 1)
                old = (seen[found] == keys) & (first[found] < least[ours])
                least[ours[old]], at[ours[old]] = first[found[old]], where[found[old]]
            if len(route) and route[0] == route[-1]:  # only such a shard can be continued
                keys = np.concatenate([seen, _keys(text, places, width)])
                first, where = np.concatenate([first, least]), np.concatenate([where, at])
                seen, index = np.unique(keys, return_index=True)
                first, where = first[index], where[index]
            begin = np.cumsum(n[one]) - n[one]
            window = np.repeat(begin[code] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            least, at = least[window], at[window]
            yield factor_rows(doc, start, n, np.where(least < np.repeat(doc, n), least, -1), at, width)

    return run


def suffix_spans(docs: DataFrame, width: int = BYTES, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """doc_id, a, b (from, to), source, source_from: bytes that a smaller document has, and where. Spans may overlap."""

    def judge(doc, start, n, raw):
        least, at, _ = least_owners(doc, start, n, raw, width)
        return np.where(least < np.repeat(doc, n), least, -1), at

    return compared(docs, Units(False, width, gram), judge, repeated(width, shard))


def suffix_dedup(docs: DataFrame, width: int = BYTES, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: every byte goes that a window shares with a smaller doc_id.

    Texts are UTF-8 bytes; null counts as empty. Windows are judged on the input, overlaps count, and none crosses documents. Rows
    that repeat a doc_id never remove one another; a null doc_id removes nothing and loses nothing. Columns besides doc_id and text
    are not read.
    """
    spans = suffix_spans(docs, width, gram, shard).select("doc_id", "a", "b")
    return strip(docs, spans, Units(False, width, gram)).withColumnRenamed("n_units", "n_bytes")
