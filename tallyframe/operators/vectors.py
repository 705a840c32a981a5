"""Exact search by cosine among any number of vectors: blocks, bounds by the triangle inequality, and matrix products.

Vectors become unit vectors once; their angle is a metric, so what lies at an angle of alpha from a pivot is at least
|alpha - beta| from what lies at beta. Some vectors of a sample, far from one another, are pivots. Each side is dealt by range of
(nearest pivot, angle to it) into blocks of about the same size, at most BLOCKS of them, and each block knows the least and greatest
angle of its members to every pivot. A vector goes to those blocks that these bounds allow for the threshold, so to BLOCKS at most;
each pair of blocks is one task, which multiplies matrices of Arrow batches and computes anew, one by one, what comes near.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, StructField, StructType

from .store import held

#: Most blocks of a side, hence most copies of a vector.
BLOCKS = 64
#: Vectors to a block, as long as there are fewer than BLOCKS.
ROWS = 2048
#: Pivots, and how many vectors they are chosen from.
PIVOTS, SAMPLE = 16, 1024
#: Rows of a matrix product, and its elements at most.
STRIP, PRODUCT = 512, 1 << 22
#: More than what rounding can take from a bound or a product.
SLACK = 1e-9


def units(df: DataFrame, key: str, vector: str, *more: str) -> DataFrame:
    """key, unit and more: vectors of length 1, as doubles. Null and zero vectors have no direction and are left out; ValueError for unequal lengths."""
    out = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"), *more).filter("v IS NOT NULL")
    out = out.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).filter("norm > 0")
    return out.select("key", F.transform("v", lambda x: x / F.col("norm")).alias("unit"), *more)


def matrix(column) -> np.ndarray:
    """A column of equally long arrays as rows of a matrix."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def pivots_of(vectors: DataFrame) -> np.ndarray:
    """Of a sample of the unit vectors (the first SAMPLE by hash) those farthest from one another."""
    sample = np.array([r[0] for r in vectors.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("unit").collect()])
    chosen, best = [], np.full(len(sample), -2.0)
    while len(chosen) < min(PIVOTS, len(sample)):
        chosen.append(int(np.argmin(best)))
        best = np.maximum(best, sample @ sample[chosen[-1]])
    return sample[chosen]


def angles_to(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(vectors @ pivots.T, -1, 1))


class Side:
    """A side's blocks: rows key, unit, block and what else the vectors have; for each block and pivot the least and greatest angle."""

    def __init__(self, vectors: DataFrame, pivots: np.ndarray, rows: int):
        import pyarrow as pa

        def near(batches):
            for batch in batches:
                angle = angles_to(matrix(batch.column(1)), pivots) if len(batch) else np.zeros((0, len(pivots)))
                cell = angle.argmin(axis=1)
                columns = [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angle[np.arange(len(cell)), cell]), pa.array(list(angle), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "cell", "near", "angles"])

        schema = StructType([*vectors.schema.fields, *StructType.fromDDL("cell int, near double, angles array<double>").fields])
        n = max(1, min(BLOCKS, -(-rows // ROWS)))
        placed = vectors.mapInArrow(near, schema)
        # The key's hash splits what many equal vectors share.
        placed = placed.repartitionByRange(n, "cell", "near", F.xxhash64("key")).withColumn("block", F.spark_partition_id())
        self.rows = held(placed.select("key", "unit", "angles", "block", *vectors.columns[2:]))
        bounds = [f(F.get("angles", F.lit(p))) for p in range(len(pivots)) for f in (F.min, F.max)]
        found = {r[0]: np.array(r[1:], float).reshape(-1, 2) for r in self.rows.groupBy("block").agg(*bounds).collect()}
        self.low = np.array([found[b][:, 0] if b in found else np.full(len(pivots), np.inf) for b in range(n)])
        self.high = np.array([found[b][:, 1] if b in found else np.full(len(pivots), -np.inf) for b in range(n)])

    def reach(self, angles: np.ndarray, most: float) -> np.ndarray:
        """Which blocks may have a vector within the angle `most`, for each row of angles to the pivots."""
        out = np.ones((len(angles), len(self.low)), bool)
        for p in range(self.low.shape[1]):
            a = angles[:, p, None]
            out &= (a >= self.low[None, :, p] - most - SLACK) & (a <= self.high[None, :, p] + most + SLACK)
        return out


def _routed(side: Side, other: Side, most: float, left: bool, same: bool) -> DataFrame:
    """i, j (blocks of the left and of the right side), side, key, unit: each vector for each block of the other side in its reach.

    same: both sides are one, and a pair of blocks is met once, as i <= j.
    """
    import pyarrow as pa

    low, high = other.low, other.high
    sent = [c for c in side.rows.columns if c not in ("angles", "block")]

    def run(batches):
        reach = Side.__new__(Side)
        reach.low, reach.high = low, high
        for batch in batches:
            if not len(batch):
                continue
            own = batch.column("block").to_numpy()
            row, there = np.nonzero(reach.reach(matrix(batch.column("angles")), most))
            here = own[row]
            if same:
                keep = (here < there) if left else (here > there)
                keep |= (here == there) & left
                row, here, there = row[keep], here[keep], there[keep]
            i, j = (here, there) if left else (there, here)
            taken = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(np.full(len(row), left)), *(taken.column(c) for c in sent)],
                ["i", "j", "is_left", *sent],
            )

    fields = side.rows.schema
    schema = StructType([*StructType.fromDDL("i int, j int, is_left boolean").fields, *(fields[c] for c in sent)])
    return side.rows.mapInArrow(run, schema)


def _strips(table, same: bool) -> Iterator[tuple]:
    """(first row, product, left, right, keys of both) of each strip of a pair of blocks."""
    is_left = table.column("is_left").to_numpy()
    unit, keys = matrix(table.column("unit")), np.array(table.column("key").to_pylist(), object)
    left = np.flatnonzero(is_left)
    right = left if same else np.flatnonzero(~is_left)
    step = max(1, min(STRIP, PRODUCT // max(1, len(right))))
    others, names = unit[right], keys[right]
    for at in range(0, len(left), step):
        some = left[at : at + step]
        yield at, unit[some] @ others.T, unit[some], others, keys[some], names


def _exact(left: np.ndarray, right: np.ndarray, l_: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Cosines of pairs of rows, each computed alike wherever it stands: a product's sums depend on the place."""
    return (left[l_] * right[r]).sum(axis=1)


def _met(side: Side, other: Side, most: float, same: bool, f: Callable, schema: StructType) -> DataFrame:
    routed = _routed(side, other, most, True, same).union(_routed(other, side, most, False, same))
    return routed.groupBy("i", "j").applyInArrow(f, schema)


def _angle(threshold: float) -> float:
    return math.acos(max(-1.0, min(1.0, threshold)))


def _counted(vectors: DataFrame) -> int:
    n, low, high = vectors.agg(F.count(F.lit(1)), F.min(F.size("unit")), F.max(F.size("unit"))).first()
    if n and low != high:
        raise ValueError("vectors of unequal lengths")
    return n


def cosine_pairs(vectors: DataFrame, key: str, vector: str, threshold: float) -> DataFrame:
    """a < b, similarity: all pairs of keys whose vectors' cosine reaches `threshold`.

    Rows with null or zero vectors, or a null key, have no pairs; a key that repeats has none with itself.
    """
    import pyarrow as pa

    kind = vectors.schema[key].dataType
    schema = StructType([StructField("a", kind), StructField("b", kind), StructField("similarity", DoubleType())])
    unit = held(units(vectors.filter(F.col(key).isNotNull()), key, vector))
    n = _counted(unit)
    if not n:
        return vectors.sparkSession.createDataFrame([], schema)
    side = Side(unit, pivots_of(unit), n)

    def run(table):
        a, b, found = [], [], []
        same = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        for at, product, left, right, own, others in _strips(table, same):
            l_, r = np.nonzero(product >= threshold - SLACK)
            if same:
                l_, r = l_[at + l_ < r], r[at + l_ < r]
            for lo in range(0, len(l_), 1 << 16):
                some, them = l_[lo : lo + (1 << 16)], r[lo : lo + (1 << 16)]
                cosine = _exact(left, right, some, them)
                ka, kb = own[some], others[them]
                keep = (cosine >= threshold) & (ka != kb)
                ka, kb = ka[keep], kb[keep]
                forward = ka < kb
                a.append(np.where(forward, ka, kb))
                b.append(np.where(forward, kb, ka))
                found.append(cosine[keep])
        none = np.zeros(0, object)
        return pa.table([pa.array(np.concatenate([none, *a]), _arrow(kind)), pa.array(np.concatenate([none, *b]), _arrow(kind)), pa.array(np.concatenate([np.zeros(0), *found]))], ["a", "b", "similarity"])

    return _met(side, side, _angle(threshold), True, run, schema)


def nearest_before(vectors: DataFrame, key: str, vector: str, threshold: float, weight: str | None = None) -> DataFrame:
    """a, b, similarity: of each key b the a before it whose cosine is highest, if that reaches `threshold`; ties to the first a.

    a is before b if it has more weight, or as much and the smaller key. What cosine_pairs() has many rows of, each pair of blocks
    here gives one a vector at most. Vectors without use are as in cosine_pairs().
    """
    import pyarrow as pa

    kind = vectors.schema[key].dataType
    schema = StructType([StructField("a", kind), StructField("b", kind), StructField("similarity", DoubleType())])
    known = vectors.filter(F.col(key).isNotNull()).withColumn("_weight", F.lit(0).cast("long") if weight is None else F.col(weight).cast("long"))
    unit = held(units(known, key, vector, "_weight"))
    n = _counted(unit)
    if not n:
        return vectors.sparkSession.createDataFrame([], schema)
    side = Side(unit, pivots_of(unit), n)

    def run(table):
        same = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        is_left = table.column("is_left").to_numpy()
        ranked = [(-w, k) for w, k in zip(table.column("_weight").to_pylist(), table.column("key").to_pylist())]
        place = {k: at for at, k in enumerate(sorted(set(ranked)))}
        place = np.array([place[k] for k in ranked])
        own_place = place[is_left]
        their_place = own_place if same else place[~is_left]
        best: dict = {}
        sure = np.full(len(their_place), threshold)

        def take(cosine, before, after):
            for c, a, b in zip(cosine.tolist(), before, after):
                if c >= threshold and (b not in best or (-c, a) < best[b]):
                    best[b] = (-c, a)

        for at, product, left, right, own, others in _strips(table, same):
            if not len(others):
                continue
            p = own_place[at : at + len(own), None]
            earlier = np.where(their_place[None, :] < p, product, -np.inf)
            l_, r = np.nonzero(earlier >= (np.maximum(earlier.max(axis=1), threshold) - SLACK)[:, None])
            take(_exact(left, right, l_, r), others[r], own[l_])
            if not same:
                earlier = np.where(p < their_place[None, :], product, -np.inf)
                sure = np.maximum(sure, earlier.max(axis=0))
                l_, r = np.nonzero(earlier >= sure - SLACK)
                take(_exact(left, right, l_, r), own[l_], others[r])
        found = [(a, b, -c) for b, (c, a) in best.items()]
        columns = list(zip(*found)) or [[], [], []]
        return pa.table([pa.array(columns[0], _arrow(kind)), pa.array(columns[1], _arrow(kind)), pa.array(columns[2], pa.float64())], ["a", "b", "similarity"])

    met = _met(side, side, _angle(threshold), True, run, schema)
    best = met.groupBy("b").agg(F.min_by(F.struct("a", "similarity"), F.struct(-F.col("similarity"), F.col("a"))).alias("v"))
    return best.select("v.a", "b", "v.similarity")


def _first_of_equal(unit: np.ndarray, place: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which of a side's rows can be somebody's nearest: of equal vectors those of the first two keys, as one may be the asker's own."""
    kind = np.unique(np.ascontiguousarray(unit[rows]).view(f"V{unit.shape[1] * unit.itemsize}").ravel(), return_inverse=True)[1].ravel()
    pairs, at = np.unique(np.stack([kind, place[rows]], axis=1), axis=0, return_index=True)
    third = np.concatenate([np.zeros(2, bool), pairs[2:, 0] == pairs[:-2, 0]])[: len(pairs)]
    out = np.zeros(len(rows), bool)
    out[at[~third]] = True
    return out


def nearest_other(vectors: DataFrame, key: str, vector: str, threshold: float) -> DataFrame:
    """a, b, similarity: of each key b the other key a whose cosine is highest, if that reaches `threshold`; ties to the first a.

    Each pair of blocks is met once, serves both ways and gives one row a vector at most. Equal vectors, however many, don't meet one by
    one. Vectors without use are as in cosine_pairs().
    """
    import pyarrow as pa

    kind = vectors.schema[key].dataType
    schema = StructType([StructField("a", kind), StructField("b", kind), StructField("similarity", DoubleType())])
    unit = held(units(vectors.filter(F.col(key).isNotNull()), key, vector))
    n = _counted(unit)
    if not n:
        return vectors.sparkSession.createDataFrame([], schema)
    side = Side(unit, pivots_of(unit), n)

    def run(table):
        same = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        unit, keys = matrix(table.column("unit")), table.column("key").to_pylist()
        names = sorted(set(keys))
        place = {k: at for at, k in enumerate(names)}
        place = np.array([place[k] for k in keys])
        is_left = table.column("is_left").to_numpy()
        left = np.flatnonzero(is_left)
        right = left if same else np.flatnonzero(~is_left)
        of_left = _first_of_equal(unit, place, left)
        of_right = of_left if same else _first_of_equal(unit, place, right)
        best, who = np.full(len(keys), -np.inf), np.full(len(keys), len(names))

        def take(b, a):
            for lo in range(0, len(b), 1 << 16):
                some, them = b[lo : lo + (1 << 16)], a[lo : lo + (1 << 16)]
                cosine = _exact(unit, unit, some, them)
                order = np.lexsort((place[them], -cosine, some))
                first = order[np.unique(some[order], return_index=True)[1]]
                some, cosine, them = some[first], cosine[first], place[them[first]]
                better = (cosine >= threshold) & ((cosine > best[some]) | ((cosine == best[some]) & (them < who[some])))
                best[some[better]], who[some[better]] = cosine[better], them[better]

        step = max(1, min(STRIP, PRODUCT // max(1, len(right))))
        sure = np.full(len(right), threshold)
        for at in range(0, len(left) if len(right) else 0, step):
            some = left[at : at + step]
            product = unit[some] @ unit[right].T
            product[place[some][:, None] == place[right][None, :]] = -np.inf
            l_, r = np.nonzero((product >= (np.maximum(product.max(axis=1), threshold) - SLACK)[:, None]) & of_right)
            take(some[l_], right[r])
            if not same:
                sure = np.maximum(sure, product.max(axis=0))
                l_, r = np.nonzero((product >= sure - SLACK) & of_left[at : at + step, None])
                take(right[r], some[l_])
        found = np.flatnonzero(best >= threshold)
        columns = [names[k] for k in who[found]], [keys[k] for k in found], best[found]
        return pa.table([pa.array(columns[0], _arrow(kind)), pa.array(columns[1], _arrow(kind)), pa.array(columns[2], pa.float64())], ["a", "b", "similarity"])

    met = _met(side, side, _angle(threshold), True, run, schema)
    best = met.groupBy("b").agg(F.min_by(F.struct("a", "similarity"), F.struct(-F.col("similarity"), F.col("a"))).alias("v"))
    return best.select("v.a", "b", "v.similarity")


def _arrow(kind: DataType):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def nearest(candidates: DataFrame, reference: DataFrame, key: str, vector: str, ref_key: str, ref_vector: str, threshold: float, others_only: bool = False) -> DataFrame:
    """key, ref_key, similarity: of each candidate the reference of the highest cosine, if that reaches `threshold`; ties to the first ref_key.

    Each pair of blocks gives one row a candidate at most, so these are what is shuffled. Neither side is broadcast. others_only: a
    reference with the candidate's own key doesn't count. Null and zero vectors are nobody's nearest and have none.
    """
    import pyarrow as pa

    kind, ref_kind = candidates.schema[key].dataType, reference.schema[ref_key].dataType
    schema = StructType([StructField("key", kind), StructField("ref_key", ref_kind), StructField("similarity", DoubleType())])
    own, them = held(units(candidates, key, vector)), held(units(reference, ref_key, ref_vector))
    n, m = _counted(own), _counted(them)
    named = [F.col("key").alias(key), F.col("ref_key").alias(ref_key), "similarity"]
    if not n or not m:
        return candidates.sparkSession.createDataFrame([], schema).select(*named)
    if len(own.first()["unit"]) != len(them.first()["unit"]):
        raise ValueError("vectors of unequal lengths")
    pivots = pivots_of(them)

    def run(table):
        out = []
        for _, product, left, right, names, others in _strips(table, False):
            if not len(others):
                continue
            if others_only:
                places: dict = {}
                for k, name in enumerate(others):
                    places.setdefault(name, []).append(k)
                for k, name in enumerate(names):
                    product[k, places.get(name, [])] = -np.inf
            near = np.maximum(product.max(axis=1), threshold) - SLACK
            l_, r = np.nonzero(product >= near[:, None])
            cosine = _exact(left, right, l_, r)
            best: dict[int, tuple] = {}
            for k, c, name in zip(l_.tolist(), cosine.tolist(), others[r]):
                if c >= threshold and (k not in best or (-c, name) < best[k]):
                    best[k] = (-c, name)
            out += [(names[k], name, -c) for k, (c, name) in best.items()]
        columns = list(zip(*out)) or [[], [], []]
        return pa.table([pa.array(columns[0], _arrow(kind)), pa.array(columns[1], _arrow(ref_kind)), pa.array(columns[2], pa.float64())], ["key", "ref_key", "similarity"])

    met = _met(Side(own, pivots, n), Side(them, pivots, m), _angle(threshold), False, run, schema)
    best = met.groupBy("key").agg(F.min_by(F.struct("ref_key", "similarity"), F.struct(-F.col("similarity"), F.col("ref_key"))).alias("b"))
    return best.select("key", "b.*").select(*named)
