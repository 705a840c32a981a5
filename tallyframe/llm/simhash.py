"""SimHash near duplicates: a grid range-join over counts of bits by segment, then the exact distance.

A fingerprint maps to the number of ones in each of its segments of two bits. The Manhattan distance of two such vectors is at most
the fingerprints' Hamming distance d, so it bounds what can link. Segments fall into d // 3 + 1 blocks; two fingerprints within d are
within 2 of each other in one block at least. In each block's grid, whose cells are single vectors, a fingerprint is placed in its own
cell and in those one step away: two vectors within 2 have a cell in common, half way. What meets in a cell is compared exactly.

A cell's links leave its task as a spanning forest, not as pairs. A cell of over MOST fingerprints (a family with thousands of
different fingerprints around one) isn't compared: its fingerprints are placed on every fingerprint within d / 2 of them. Those
that share one of these are within d of each other, so a chain through them is all that is needed, and work stays linear.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import cut, splitmix, stored, text_chunks
from .jaccard import components

WORDS = 4
DISTANCE = 4
SEED = 42
#: Bits of a segment.
SEGMENT = 2
#: A cell of more fingerprints is left to exact neighbours: comparing one with so many costs less than placing it on its neighbours.
MOST = 1 << 14
#: Members of a cell up to which pairs are compared by shifting the sorted rows, all cells at once.
FEW = 16
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes; 0 for a text without words."""
    from xxhash import xxh64_intdigest

    found = text.translate(_LOWER).split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(found) - words + 1)
    starts, ends = starts[:n].tolist(), ends[len(found) - n :].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[at : at + (1 << 15)], ends[at : at + (1 << 15)])], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed number) of rows doc_id, text; a null text has no words."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            found = [fingerprint(data[a:b].tobytes(), words) for _, _, data, ends in text_chunks(batch, 1) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.mapInArrow(run, StructType([docs.schema["doc_id"], StructField("fp", LongType())]))


def cells(fps: np.ndarray, distance: int = DISTANCE) -> list[tuple[np.ndarray, np.ndarray]]:
    """(fingerprints, a cell of each): for each block the vector of counts itself and all that are one step away."""
    low = np.uint64(0x5555555555555555)
    counts = (fps & low) + ((fps >> np.uint64(1)) & low)  # 32 fields of two bits, each 0 to 2
    blocks = distance // 3 + 1
    edges = [64 // SEGMENT * b // blocks * SEGMENT for b in range(blocks + 1)]
    out = []
    for block, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        own = counts if b - a == 64 else (counts >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)
        name = splitmix(np.array([block + 1], np.uint64))
        out.append((fps, splitmix(own + name)))
        for at in range(0, b - a, SEGMENT):
            field, step = (own >> np.uint64(at)) & np.uint64(3), np.uint64(1 << at)
            out.append((fps[field < 2], splitmix(own[field < 2] + step + name)))
            out.append((fps[field > 0], splitmix(own[field > 0] - step + name)))
    return out


def forest(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (u, v) that connect what links connect among different fingerprints: at most one each."""
    left, us, vs = fps.copy(), [], []
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            u = frontier.pop()
            near = np.bitwise_count(left ^ u) <= distance
            if near.any():
                found = left[near]
                us.append(np.full(len(found), u))
                vs.append(found)
                frontier.extend(found)
                left = left[~near]
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *us]), np.concatenate([none, *vs])


def links_in(cell: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among the members of each cell; equal cells stand together."""
    starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    sizes = np.diff(np.append(starts, len(cell)))
    us, vs = [], []
    few = np.repeat(sizes <= FEW, sizes) & np.repeat(sizes > 1, sizes)
    small_cell, small_fp = cell[few], fps[few]
    for k in range(1, min(FEW, len(small_cell))):
        same = small_cell[k:] == small_cell[:-k]
        if not same.any():
            break
        near = same & (np.bitwise_count(small_fp[k:] ^ small_fp[:-k]) <= distance)
        us.append(small_fp[:-k][near])
        vs.append(small_fp[k:][near])
    for at in np.flatnonzero(sizes > FEW):
        u, v = forest(fps[starts[at] : starts[at] + sizes[at]], distance)
        us.append(u)
        vs.append(v)
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *us]), np.concatenate([none, *vs])


def _columns(batch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch.column(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in (0, 1))


def _rows(names: list[str], *columns: np.ndarray):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], names)


def near_links(fps: DataFrame, distance: int = DISTANCE, most: int = MOST) -> DataFrame:
    """Links (u, v) that connect what links connect among different fingerprints (fp)."""
    import pyarrow as pa

    def place(batches):
        for batch in batches:
            found = cells(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), distance)
            yield _rows(["cell", "fp"], np.concatenate([c for _, c in found]), np.concatenate([f for f, _ in found]))

    def compare(batches):
        """Links, and members of cells that are too large as u alone. A cell may go on in the next batch."""
        none = np.zeros(0, np.uint64)
        cell, fp, large = none, none, None

        def alone(u):
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.nulls(len(u), pa.int64())], ["u", "v"])

        for batch in batches:
            more, members = _columns(batch)
            cell, fp = np.concatenate([cell, more]), np.concatenate([fp, members])
            if large is not None:
                n = int(np.argmin(cell == large)) if (cell != large).any() else len(cell)
                yield alone(fp[:n])
                cell, fp = cell[n:], fp[n:]
                if not len(cell):
                    continue
                large = None
            last = len(cell) - int(np.argmin((cell == cell[-1])[::-1])) if (cell != cell[-1]).any() else 0
            if last:
                yield from compared(cell[:last], fp[:last], alone)
                cell, fp = cell[last:], fp[last:]
            if len(cell) > most:
                large = cell[0]
                yield alone(fp)
                cell, fp = none, none
        if len(cell):
            yield from compared(cell, fp, alone)

    def compared(cell, fp, alone):
        starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        over = np.repeat(np.diff(np.append(starts, len(cell))) > most, np.diff(np.append(starts, len(cell))))
        if over.any():
            yield alone(fp[over])
            cell, fp = cell[~over], fp[~over]
        if len(cell):
            u, v = links_in(cell, fp, distance)
            yield _rows(["u", "v"], u, v)

    placed = fps.select("fp").mapInArrow(place, "cell long, fp long")
    found = stored(placed.repartition("cell").sortWithinPartitions("cell").mapInArrow(compare, "u long, v long").distinct())
    links, dense = found.filter("v IS NOT NULL"), found.filter("v IS NULL").select("u")
    return links if dense.isEmpty() else links.union(exact_neighbours(dense, distance))


def exact_neighbours(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (u, v) of fingerprints (u), by the fingerprints that both are within half the distance of."""
    masks = np.array([sum(1 << b for b in bits) for r in range(distance // 2 + 1) for bits in combinations(range(64), r)], np.uint64)

    def spread(batches):
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(own), 64):
                some = own[at : at + 64]
                yield _rows(["z", "u"], (some[:, None] ^ masks).ravel(), np.repeat(some, len(masks)))

    def chain(batches):
        """Each row that follows another on the same z, with it."""
        none = np.zeros(0, np.uint64)
        z, u = none, none
        for batch in batches:
            more, members = _columns(batch)
            z, u = np.concatenate([z, more]), np.concatenate([u, members])
            same = z[1:] == z[:-1]
            yield _rows(["u", "v"], u[:-1][same], u[1:][same])
            z, u = z[-1:], u[-1:]

    return fps.mapInArrow(spread, "z long, u long").repartition("z").sortWithinPartitions("z", "u").mapInArrow(chain, "u long, v long").distinct()


def simhash_classes(docs: DataFrame, distance: int = DISTANCE, words: int = WORDS, most: int = MOST) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 lowercase hex digits), component_id (least doc_id reachable, itself included).

    Shingles are of `words` words in lower case (A-Z), repeats included; a text with fewer is one shingle. Texts without words, or
    null, have fingerprint zero and link as any other. `distance` must be even. Rows that repeat a doc_id have the class of their own
    text; a row without doc_id has its class's least one, null if that has none. Other columns aren't read.
    """
    if distance % 2 or not 0 <= distance <= 16:
        raise ValueError("distance must be even, from 0 to 16")
    rows = stored(fingerprints(docs.select(F.col("doc_id").cast("long"), "text"), words))
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    label = components(near_links(nodes, distance, most))
    least = label.join(nodes, F.col("id") == F.col("fp")).groupBy("component").agg(F.min("least").alias("component_id"))
    label = label.join(least, "component").select("id", "component_id")
    nodes = nodes.join(label, F.col("fp") == F.col("id"), "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return rows.join(nodes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
