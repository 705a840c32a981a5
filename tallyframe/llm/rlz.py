"""Substring deduplication by relative Lempel-Ziv parsing, over words."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .spans import Units, compared, factor_rows, route_blocks, strip

WORDS, GRAM = 50, 8
BLOCK = 8 << 20
#: Windows that are parsed in a row; a factor that is longer goes on as another.
STRETCH = 512


def longest_sources(windows: np.ndarray, owner: np.ndarray, room: np.ndarray) -> np.ndarray:
    """For each window the place of one in an earlier document whose windows go on alike for longest; -1: none.

    The index has runs of 1, 2, 4, ... windows: a run of twice the length is two runs that follow one another. Of the longest that an
    earlier document has too, the earliest document's is taken. room: windows from here to the end of the reference run.
    """
    source = np.full(len(windows), -1, np.int64)
    rank = np.unique(windows, return_inverse=True)[1].astype(np.int64)
    at, span = np.arange(len(windows)), 1
    while len(at):
        order = at[np.lexsort((at, owner[at], rank[at]))]
        head = np.ones(len(order), bool)
        head[1:] = rank[order[1:]] != rank[order[:-1]]
        begin, group = np.flatnonzero(head), np.cumsum(head) - 1
        earliest = order[begin][group]
        hit = owner[earliest] < owner[order]
        source[order[hit]] = earliest[hit]
        common = np.zeros(len(windows), bool)
        common[order[np.logical_or.reduceat(hit, begin)[group]]] = True
        at = np.flatnonzero(common & (room >= 2 * span))
        at = at[common[at + span]]
        new = np.unique(rank[at] * len(windows) + rank[at + span], return_inverse=True)[1]
        rank = rank.copy()
        rank[at] = new
        span *= 2
    return source


def parse(doc: np.ndarray, start: np.ndarray, n: np.ndarray, windows: np.ndarray):
    """For each window of the runs (one after another) an earlier document that has it, and where; -1: none.

    Greedy: a factor starts at the first window that the index has and runs on along its source for as long as this goes on alike;
    where it ends, the next window, which crosses the boundary, is looked up again.
    """
    run = np.repeat(np.arange(len(n)), n)
    ends = np.cumsum(n)
    place = np.arange(len(windows)) - (ends - n)[run]
    owner = doc[run]
    source = longest_sources(windows, owner, ends[run] - np.arange(len(windows)))
    taken = np.full(len(windows), -1, np.int64)
    begin = np.flatnonzero(place % STRETCH == 0)
    stop = np.append(begin[1:], len(windows))
    now = np.full(len(begin), -1, np.int64)
    for step in range(int((stop - begin).max()) if len(begin) else 0):
        lane = np.flatnonzero(begin + step < stop)
        i, s = begin[lane] + step, now[lane]
        follow = np.minimum(s + 1, len(windows) - 1)
        on = (s >= 0) & (s + 1 < ends[run[np.maximum(s, 0)]]) & (windows[follow] == windows[i])
        now[lane] = taken[i] = np.where(on, follow, source[i])
    at = np.maximum(taken, 0)
    return np.where(taken >= 0, owner[at], -1), place[at] + start[run[at]]


def factored(width: int, block: int = BLOCK):
    """For compared(): factors (from, to) of segments against the reference blocks of smaller documents, with their sources.

    All segments with one minimizer meet, in order of doc_id. Each is a reference for those after it. Of a minimizer that doesn't fit
    a block the index stays, by binary search, for the blocks that continue it.
    """

    def run(batches):
        seen, first, where = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for more, route, doc, start, n, payload in route_blocks(batches, block):
            windows = np.frombuffer(b"".join(payload.to_pylist()), np.uint64)
            owner, group = np.repeat(doc, n), np.repeat(route, n)
            source, place = parse(doc, start, n, windows)
            if not more:
                seen, first, where = seen[:0], first[:0], where[:0]
            if len(seen):
                ours = np.flatnonzero(group == route[0])
                at = np.minimum(np.searchsorted(seen, windows[ours]), len(seen) - 1)
                old = (seen[at] == windows[ours]) & (first[at] < owner[ours])
                source[ours[old]], place[ours[old]] = first[at[old]], where[at[old]]
            if len(route) and route[0] == route[-1]:  # only such a block can be continued
                own = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(len(windows))
                keys, owners, places = (np.concatenate(x) for x in ((seen, windows), (first, owner), (where, own)))
                order = np.lexsort((owners, keys))
                keys, owners, places = keys[order], owners[order], places[order]
                head = np.ones(len(keys), bool)
                head[1:] = keys[1:] != keys[:-1]
                seen, first, where = keys[head], owners[head], places[head]
            yield factor_rows(doc, start, n, source, place, width)

    return run


def factors(docs: DataFrame, width: int = WORDS, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """doc_id, a, b (from, to), source, source_from: factors of at least `width` words that a smaller document has, and where.

    A factor of more than STRETCH windows goes on as another one, and one ends with its segment between chunks; what factors cover is
    the same.
    """

    def judge(doc, start, n, raw):
        return parse(doc, start, n, np.frombuffer(raw, np.uint64))

    return compared(docs, Units(True, width, gram), judge, factored(width, block))


def substring_dedup(docs: DataFrame, width: int = WORDS, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans, kept_sha256: every word goes that a window shares with a smaller doc_id.

    Words are runs of anything but ASCII white space, unchanged; null text has none. Windows are judged on the input. Rows that
    repeat a doc_id never remove one another. A null doc_id removes nothing and loses nothing. Windows are compared by a 64-bit
    hash within a chunk or a 64-bit minimizer. Columns besides doc_id and text are not read.
    """
    spans = factors(docs, width, gram, block).select("doc_id", "a", "b")
    return strip(docs, spans, Units(True, width, gram)).withColumnRenamed("n_units", "n_words")
