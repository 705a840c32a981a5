"""Finding the parts of documents that earlier documents have too: what the two substring operators share.

A unit is a word or a byte. A window is `width` consecutive units of one document. Windows with the same minimizer, the least hash
of their `gram`-unit runs, that follow one another form a segment; equal windows have equal minimizers, so segments with different
minimizers have no window in common. Minimizers only say who may meet: those of one document only, nine tenths and more of the
corpus, end here, and every window of the others is judged by the operator's own method, twice:

* in each chunk of texts, where windows of an earlier document of the chunk are removed;
* what a chunk has left, with all other chunks' segments of its minimizer. A passage in a third of all documents is thus one row a
  chunk in its group.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _TABLE, Rolling, discard, release, splitmix, stored, text_chunks, word_hashes, word_spans

#: Bytes of text within which equal segments meet before they are shuffled; and that are hashed at a time.
CHUNK, SLICE = 2 << 20, 1 << 18
#: A minimizer with more segments than this has them dealt out window by window, by the window's own hash.
HOT = 200_000
#: Minimizers are met in so many parts, for each of which texts are hashed anew, and what chunks have left in so many: shuffles of one
#: part are on disk at a time.
PASSES, PARTS = 2, 4
#: Longest segment; and the most bytes of packed spans of words that are broadcast to the texts instead of shuffling these. Of bytes
#: there are so many more spans that texts are always shuffled.
LONGEST = 1 << 14
BROADCAST = 64 << 20
PIECE = ["route", "doc_id", "start", "n", "payload", "source", "source_from"]
SPAN = ["doc_id", "a", "b", "source", "source_from"]
SPANS = "doc_id long, a long, b long, source long, source_from long"


@dataclass(frozen=True)
class Units:
    """words: units are words (else bytes); width: units to a window; gram: units to a run that may be a minimizer."""

    words: bool
    width: int
    gram: int

    def values(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A 64-bit value for each unit of concatenated texts, and the units before each text."""
        if not self.words:
            return _TABLE[1][data], offsets
        starts, ends, first = word_spans(data, offsets)
        return word_hashes(data, starts, ends, 1), first


def least_of(x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Minimum of each `width` consecutive values, and where it is first. Values are compared by all bits but those a place takes."""
    bits = np.uint64(len(x).bit_length())
    m, span = (x >> bits << bits) | np.arange(len(x), dtype=np.uint64), 1
    while span * 2 <= width:
        m = np.minimum(m[: len(m) - span], m[span:])
        span *= 2
    if width > span:
        m = np.minimum(m[: len(m) - (width - span)], m[width - span :])
    at = (m & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    return x[at], at


def segments_of(values: np.ndarray, first: np.ndarray, units: Units, part: int = 0, parts: int = 1):
    """Text number, first window, windows, minimizer's place in the first window, minimizer, content hash and context of each segment
    of concatenated texts whose minimizer is of this part.

    Windows are longer than minimizers, by so much that a window has at least half of that to the left of its minimizer or to the
    right. context: a hash of the minimizer with the units to its left, and one of it with those to its right, 32 bits each: equal
    windows agree in one of the two. 0: the segment has its minimizer more than once, and may meet any.
    """
    none = np.zeros(0, np.int64)
    if len(values) < units.width:
        return none, none, none, none, *[none.astype(np.uint64)] * 3
    rolling = Rolling(values, 1)
    at = np.arange(len(values) - units.gram + 1)
    least, place = least_of(rolling.of(at, at + units.gram), units.width - units.gram + 1)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    whole = text[: len(least)] == text[units.width - 1 :]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (text[1 : len(least)] != text[: len(least) - 1]) | (whole[1:] != whole[:-1])
    starts = np.flatnonzero(new)
    counts = np.diff(starts, append=len(least))
    own = whole[starts] & (least[starts] % np.uint64(parts) == part)
    starts, counts = starts[own], counts[own]
    each = -(-counts // LONGEST)
    before = (np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)) * LONGEST
    starts, counts = np.repeat(starts, each) + before, np.minimum(np.repeat(counts, each) - before, LONGEST)
    content = Rolling(splitmix(values), 2).of(starts, starts + counts + units.width - 1)
    at, half = place[starts], (units.width - units.gram + 1) // 2
    lo, hi = at - half, at + units.gram + half
    left = rolling.of(np.maximum(lo, first[text[starts]]), at + units.gram)
    right = rolling.of(at, np.minimum(hi, first[text[starts] + 1])) ^ np.uint64(0x5555555555555555)
    context = (left >> np.uint64(32) << np.uint64(32)) | (right >> np.uint64(32))
    context = np.where(at == place[starts + counts - 1], context, np.uint64(0))
    return text[starts], starts - first[text[starts]], counts, at - starts, least[starts], content, context


def segments(docs: DataFrame, units: Units, part: int = 0, parts: int = 1) -> DataFrame:
    """route, content, doc_id, at: segments of a part's minimizers, one to a row.

    at: first window << 23 | windows << 8 | minimizer's place in it << 2 | sure << 1 | known.

    sure: another document of the chunk has this content too, so it need not be asked whether any has. Of such rows the earliest
    document's tells others of its minimizer; the rest are known: dealt out evenly by `route`, and `content` is their minimizer,
    where it is the context (see segments_of()) of others.
    """
    import pyarrow as pa

    def out(held):
        doc, start, n, off, route, content, context = map(np.concatenate, zip(*held))
        order = np.lexsort((doc, content, route))
        r, c, d = route[order], content[order], doc[order]
        head = np.ones(len(r), bool)
        head[1:] = (r[1:] != r[:-1]) | (c[1:] != c[:-1])
        first, last = np.flatnonzero(head), np.flatnonzero(np.r_[head[1:], True]) if len(r) else []
        group = np.cumsum(head) - 1
        known, sure = np.zeros(len(r), bool), np.zeros(len(r), bool)
        known[order] = d > d[first][group]
        sure[order] = (d[first] < d[last])[group]
        even = splitmix((doc.astype(np.uint64) << np.uint64(20)) + start.astype(np.uint64))
        route, content = np.where(known, even, route), np.where(known, route, context)
        columns = [route.view(np.int64), content.view(np.int64), doc, start << 23 | n << 8 | off << 2 | sure << 1 | known]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["route", "content", "doc_id", "at"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in text_chunks(batch, 1, SLICE):
                text, *found = segments_of(*units.values(data, offsets), units, part, parts)
                held.append((ids[lo:hi][text], *found))
                size += len(data)
                if size >= CHUNK:
                    yield out(held)
                    held, size = [], 0
        if held:
            yield out(held)

    given = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    return given.mapInArrow(run, "route long, content long, doc_id long, at long")


def candidates(docs: DataFrame, units: Units) -> DataFrame:
    """Segments whose minimizer two documents or more have, with units to the left or to the right of it: route, doc_id, at.

    at: first window << 22 | windows << 7 | minimizer's place in it << 1 | hot.
    """
    parts = []
    for k in range(PASSES):
        parts.append(stored(shared_contexts(segments(docs, units, k, PASSES))))
        release(docs.sparkSession)
    return reduce(DataFrame.union, parts)


def shared_contexts(rows: DataFrame) -> DataFrame:
    """Of segments() those that candidates() gives."""
    rows = rows.repartition(F.col("route"))
    minimizer = Window.partitionBy("route")
    known, sure = F.col("at") % 2 == 1, F.col("at") % 4 > 1
    lo, hi = F.min("doc_id"), F.max("doc_id")
    rows = rows.withColumns({"lo": lo.over(minimizer), "hi": hi.over(minimizer), "m": F.count(F.lit(1)).over(minimizer), "any": F.max(~known & (F.col("content") == 0)).over(minimizer)})
    rows = rows.filter(sure | (F.col("lo") < F.col("hi")))
    sides = {k: Window.partitionBy("route", side) for k, side in (("left", F.shiftright("content", 32)), ("right", F.col("content").bitwiseAND(0xFFFFFFFF)))}
    met = sure | F.col("any")
    for side in sides.values():
        rows = rows.withColumn("met", met | (lo.over(side) < hi.over(side)))
        met = F.col("met")
    hot = F.when(F.col("m") > HOT, 1).otherwise(0)
    return rows.filter("met").select(
        F.when(known, F.col("content")).otherwise(F.col("route")).alias("route"), "doc_id", (F.shiftright("at", 2) * 2 + hot).alias("at")
    )


def packed(rows: DataFrame, merge: bool = False) -> DataFrame:
    """doc_id, spans: per document its rows' other columns, 64-bit numbers, packed; merge: two, as from and to, overlaps joined.

    A document has no more of them than units.
    """
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            spans = batch.column(1)
            ends = np.frombuffer(spans.buffers()[1], np.int32)[spans.offset : spans.offset + len(spans) + 1]
            flat = np.column_stack([spans.values.field(i).to_numpy(zero_copy_only=False) for i in range(len(own))])
            out = []
            for lo, hi in zip(ends[:-1], ends[1:]):
                one = flat[lo:hi]
                one = one[np.lexsort(one.T[::-1])]
                if merge and len(one):
                    reach = np.maximum.accumulate(one[:, 1])
                    head = np.r_[True, one[1:, 0] > reach[:-1]]
                    at = np.flatnonzero(head)
                    one = np.column_stack([one[at, 0], reach[np.r_[at[1:], len(one)] - 1]])
                out.append(np.ascontiguousarray(one).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "spans"])

    own = [c for c in rows.columns if c != "doc_id"]
    grouped = rows.groupBy("doc_id").agg(F.collect_list(F.struct(*own)).alias("s"))
    return stored(grouped.mapInArrow(run, "doc_id long, spans binary"))


def with_spans(docs: DataFrame, spans: DataFrame, how: str, units: Units) -> DataFrame:
    """docs with packed spans, which are broadcast if they are small and of words."""
    small = units.words and (spans.agg(F.sum(F.length("spans") + 64)).first()[0] or 0) <= BROADCAST
    return docs.join(F.broadcast(spans) if small else spans, "doc_id", how).select("doc_id", "text", "spans")


def unpacked(column, numbers: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a column of packed spans: all of them, (n, numbers), and where each row's begin."""
    blobs = [b or b"" for b in column.to_pylist()]
    ends = np.cumsum([0, *(len(b) // (8 * numbers) for b in blobs)])
    return np.frombuffer(b"".join(blobs), np.int64).reshape(-1, numbers), ends


def hot_routes(rows: DataFrame) -> list[int]:
    """Hot minimizers, of which there is at most one to HOT segments. Known segments don't tell by themselves that theirs is hot."""
    return [r[0] for r in rows.filter("at % 2 = 1").select("route").distinct().collect()]


def judged_in_chunks(docs: DataFrame, rows: DataFrame, units: Units, judge) -> DataFrame:
    """route, doc_id, start, n, payload, source, source_from: what judge() removes within chunks, and what it leaves.

    judge(doc, start, n, payload) has runs of windows, which it gets one after another, by doc_id (of words, the windows' 64-bit
    hashes; else the runs' bytes), and gives for each window an earlier document that has it and where (-1: none). Removed: payload is null, and
    start and n are from and to. Segments with a window left have the payload that the operator compares between chunks.
    """
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            flat, ends = unpacked(batch.column(2), 1)
            for lo, hi, data, offsets in text_chunks(batch, 1, CHUNK):
                own = flat[ends[lo] : ends[hi], 0]
                text = np.repeat(np.arange(hi - lo), np.diff(ends[lo : hi + 1]))
                start, n, off = own >> 22, own >> 7 & 0x7FFF, own >> 1 & 0x3F
                values, first = units.values(data, offsets)
                inside = start + n + units.width - 1 <= np.diff(first)[text]  # not so if another row has the doc_id
                order = np.lexsort((start, text, ids[lo:hi][text]))
                order = order[inside[order]]
                if not len(order):
                    continue
                s, c, off, text = (x[order] for x in (start, n, off, text))
                at = s + off + first[text]
                r = Rolling(values, 1).of(at, at + units.gram).view(np.int64)
                h = np.isin(r, hots)
                rolling = Rolling(values, 2)

                def payload_of(at, c):
                    if not units.words:
                        return [data[a : a + k + units.width - 1].tobytes() for a, k in zip(at, c)]
                    w = np.repeat(at - (np.cumsum(c) - c), c) + np.arange(c.sum())
                    found, to = rolling.of(w, w + units.width).tobytes(), np.cumsum(8 * c)
                    return [found[a:b] for a, b in zip(to - 8 * c, to)]

                # Segments that follow one another are one run.
                head = np.ones(len(s), bool)
                head[1:] = (text[1:] != text[:-1]) | (s[1:] != s[:-1] + c[:-1])
                at = np.flatnonzero(head)
                doc, begin, many = ids[lo:hi][text[at]], s[at], np.add.reduceat(c, at)
                source, place = judge(doc, begin, many, b"".join(payload_of(begin + first[text[at]], many)))
                d, a, b, sd, sa = factor_rows(doc, begin, many, source, place, units.width)
                even = splitmix((d.astype(np.uint64) << np.uint64(20)) + a.astype(np.uint64)).view(np.int64)
                columns = [pa.array(even), pa.array(d), pa.array(a), pa.array(b), pa.nulls(len(d), pa.binary()), pa.array(sd), pa.array(sa)]
                yield pa.RecordBatch.from_arrays(columns, PIECE)
                left = ~np.logical_and.reduceat(source >= 0, np.cumsum(c) - c) if len(c) else np.zeros(0, bool)
                r, s, c, h, text = (x[left] for x in (r, s, c, h, text))
                # Of a hot minimizer each window is a segment of its own.
                each = np.where(h, c, 1)
                r, text, split = np.repeat(r, each), np.repeat(text, each), np.repeat(h, each)
                s = np.repeat(s, each) + np.where(split, np.arange(len(split)) - np.repeat(np.cumsum(each) - each, each), 0)
                c = np.where(split, 1, np.repeat(c, each))
                at = s + first[text]
                r[split] = rolling.of(at[split], at[split] + units.width).view(np.int64)
                none = np.full(len(r), -1, np.int64)
                columns = [pa.array(r), pa.array(ids[lo:hi][text]), pa.array(s), pa.array(c), pa.array(payload_of(at, c), pa.binary()), pa.array(none), pa.array(none)]
                yield pa.RecordBatch.from_arrays(columns, PIECE)

    hots = np.array(hot_routes(rows), np.int64)
    spans = packed(rows.select("doc_id", "at"))
    release(docs.sparkSession)
    discard(rows)
    given = with_spans(docs.select(F.col("doc_id").cast("long"), "text"), spans, "inner", units)
    return given.mapInArrow(run, "route long, doc_id long, start long, n long, payload binary, source long, source_from long")


def compared(docs: DataFrame, units: Units, judge, between) -> DataFrame:
    """SPANS that judge() removes within chunks, and those that between() does.

    between() has an iterator of record batches of the segments that chunks have left, sorted by minimizer and doc_id, and yields
    SPANS. These overlap where they follow one another in a text, so that they take far less space as stored than as shuffled.
    """
    import pyarrow as pa

    def run(batches):
        for found in between(batches):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], SPAN)

    pieces = stored(judged_in_chunks(docs, candidates(docs, units), units, judge), "zstd")
    release(docs.sparkSession)
    parts = [stored(pieces.filter("payload IS NULL").select("doc_id", F.col("start").alias("a"), F.col("n").alias("b"), "source", "source_from"))]
    left = pieces.filter("payload IS NOT NULL")
    for k in range(PARTS):
        parts.append(stored(by_route(left.filter(F.pmod("route", F.lit(PARTS)) == k)).mapInArrow(run, SPANS)))
        release(docs.sparkSession)
    discard(pieces)
    return reduce(DataFrame.union, parts)


def by_route(rows: DataFrame) -> DataFrame:
    return rows.repartition(F.col("route")).sortWithinPartitions("route", "doc_id", "start")


def route_blocks(batches, limit: int):
    """Of record batches sorted by route: (route continues, columns, payloads), of about `limit` payload bytes.

    A block ends where a route does, unless one route is over the limit by itself: it then has blocks of its own, each but the
    first of which continues it.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    held, size, last = [], 0, None

    def out(parts):
        nonlocal last
        t = pa.Table.from_batches(parts).combine_chunks()
        route = t.column("route").to_numpy()
        more = last is not None and len(route) and route[0] == last
        last = route[-1] if len(route) else last
        return more, route, t.column("doc_id").to_numpy(), t.column("start").to_numpy(), t.column("n").to_numpy(), t.column("payload")

    for batch in batches:
        while batch.num_rows:
            length = pc.cumulative_sum(pc.cast(pc.binary_length(batch.column("payload")), pa.int64())).to_numpy(zero_copy_only=False)
            if size + length[-1] <= limit:
                held.append(batch)
                size += length[-1]
                break
            take = max(1, int(np.searchsorted(length, limit - size, "right")))
            held.append(batch.slice(0, take))
            batch = batch.slice(take)
            t = pa.Table.from_batches(held)
            route = t.column("route").to_numpy()
            others = np.flatnonzero(route != route[-1])
            end = int(others[-1]) + 1 if len(others) else len(route)
            whole, rest = t.slice(0, end), t.slice(end)
            yield out(whole.combine_chunks().to_batches())
            held = rest.combine_chunks().to_batches()
            size = sum(pc.sum(pc.binary_length(b.column("payload"))).as_py() for b in held)
    if held:
        yield out(held)


def factor_rows(doc: np.ndarray, start: np.ndarray, n: np.ndarray, source: np.ndarray, place: np.ndarray, width: int):
    """doc_id, from, to, source, from: stretches of windows (one run's after another's) that one earlier document has in a row."""
    run = np.repeat(np.arange(len(n)), n)
    own = np.arange(len(source)) - np.repeat(np.cumsum(n) - n, n) + start[run]
    hit = source >= 0
    on = np.zeros(len(hit), bool)  # goes on with the factor of the window before
    on[1:] = hit[1:] & hit[:-1] & (run[1:] == run[:-1]) & (source[1:] == source[:-1]) & (place[1:] == place[:-1] + 1)
    head = hit & ~on
    tail = hit.copy()
    tail[:-1] &= ~on[1:]
    return doc[run[head]], own[head], own[tail] + width, source[head], place[head]


def strip(docs: DataFrame, spans: DataFrame, units: Units) -> DataFrame:
    """doc_id, n_units, n_removed, n_spans, kept_sha256 of every row; spans: doc_id, a, b (from, to in units), that may overlap."""
    import hashlib

    import pyarrow as pa

    def run(batches):
        for batch in batches:
            flat, ends = unpacked(batch.column(2), 2)
            lo_, hi_ = flat[:, 0], flat[:, 1]
            rows = []
            for lo, hi, data, offsets in text_chunks(batch, 1, CHUNK):
                if units.words:
                    starts, stops, first = word_spans(data, offsets)
                else:
                    first = offsets
                for i in range(lo, hi):
                    a, b = int(first[i - lo]), int(first[i - lo + 1])
                    cover = np.zeros(b - a + 1, np.int32)
                    np.add.at(cover, np.minimum(lo_[ends[i] : ends[i + 1]], b - a), 1)
                    np.add.at(cover, np.minimum(hi_[ends[i] : ends[i + 1]], b - a), -1)
                    gone = np.cumsum(cover[:-1]) > 0
                    n_spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                    if not units.words:
                        left = data[a:b][~gone].tobytes()
                    else:
                        left = _joined(data, starts[a:b], stops[a:b], ~gone)
                    rows.append((b - a, int(gone.sum()), n_spans, hashlib.sha256(left).hexdigest()))
            if rows:
                n, removed, runs, sha = zip(*rows)
                columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_units", "n_removed", "n_spans", "kept_sha256"])

    merged = packed(spans, merge=True)
    release(docs.sparkSession)
    given = with_spans(docs.select(F.col("doc_id").cast("long"), "text"), merged, "left", units)
    return given.mapInArrow(run, "doc_id long, n_units long, n_removed long, n_spans long, kept_sha256 string")


def _joined(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, keep: np.ndarray) -> bytes:
    """The kept words, joined by one space."""
    starts, stops = starts[keep], stops[keep]
    if not len(starts):
        return b""
    length = stops - starts + 1
    out = np.full(int(length.sum()), 32, np.uint8)
    begin = np.cumsum(length) - length
    place = np.arange(len(out)) - np.repeat(begin, length)
    inside = place < np.repeat(length - 1, length)
    out[inside] = data[(np.repeat(starts, length) + place)[inside]]
    return out[:-1].tobytes()
