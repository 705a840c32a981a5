"""N-gram Jaccard join, size-aware: subsets of small sets, inverted lists of large ones, and the classes that links form.

Two sets of sizes a <= b link if 100 * |A and B| >= 90 * |A or B|; they then differ in at most (a + b) / 19 elements, and b is at
most a / 0.9 (both for the default of 0.9).

* Light sets enumerate their subsets of every size that a link can share. Two sets that share a subset of c elements link if
  100 c >= 90 (a + b - c), so a subset's list needs no verification, and its smallest set links with whatever any set of it
  links with: one edge a member.
* Heavy sets fall into blocks by hash range of their elements, a third more blocks than a link has differences, so two linked sets
  have many in common, and a set that shares fewer with all others is left out. The inverted lists are of whole blocks and not of single elements: a line that a third of all documents
  share makes no long list unless the rest of the block is shared too. Members of a list are verified against its pivot, the
  most central member, which joins most families of near copies at once. What the pivot leaves apart is compared by how it differs
  from what most sets near that pivot have (see kin()): a link needs common differences, and these are few and rare where the sets
  themselves have hundreds in common. Sketches of 512 bits rule out nearly all that differ by too much before a pair is made.
* A set is light if its subsets cost less than its blocks and their verification.

Equal sets are one node throughout, so thousands of copies cost as much as one.
"""

from __future__ import annotations

import math
from fractions import Fraction
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import cut, discard, lower_ascii, release, splitmix, stored, text_chunks, word_hashes, word_spans

SIMILARITY = (90, 100)
WORDS = 3
#: A side of at most so many rows of one id (some 150 bytes each in memory) is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 400_000
#: 64-bit words of a set's sketch.
SKETCH = [f"k{i}" for i in range(8)]
#: Of so many blocks one more is made than a link needs: the more a set must share, the fewer sets have to be compared.
SPARE = 3
#: Blocks' keys are met in so many parts at most, one after the other, so that shuffles of one part are on disk at a time.
PARTS = 4
#: A part has so many keys at least: of a small table each part costs more, by its tasks and files, than it saves.
PART_KEYS = 4_000_000
#: Sets for comparing of so many bytes at most in all are broadcast: then nothing of them is shuffled, and all are compared at once.
BROADCAST_BYTES = 16_000_000
#: Links (16 bytes each, both ways) of at most so many rows are followed in one task, without an exchange in each round.
TOGETHER = 100_000
#: Bits, as a power of two, of the largest bitmap of shared keys (8 MB) by which other keys are dropped before they are shuffled.
BITS = 26
#: Ratio of size classes within which sets have the same number of blocks.
CLASS = Fraction(3, 2)


class Scheme:
    """What sets of each size emit. similarity: the threshold as a fraction."""

    def __init__(self, similarity: tuple[int, int] = SIMILARITY, light_below: int | None = None):
        self.t = Fraction(*similarity)
        n = 1
        while self.subsets(n) <= self.blocks_of(n) + 2 * n and n < 64:  # a key costs about as much as an element to verify
            n += 1
        #: Sets of at least so many elements are heavy.
        self.heavy = n if light_below is None else light_below
        #: Light sets of at least so many elements can link with heavy ones, so they have blocks as well.
        self.both = max(1, math.ceil(self.t * self.heavy))
        self.starts = [self.both]
        while self.starts[-1] < 1 << 40:
            self.starts.append(max(self.starts[-1] + 1, int(self.starts[-1] * CLASS)))

    def differences(self, a: int) -> int:
        """The most elements by which a set of a elements differs from a larger one that it links with."""
        return int((1 - self.t) / (1 + self.t) * (a + int(a / self.t)))

    def least(self, a: int) -> int:
        return math.ceil(self.t * a)

    def subsets(self, n: int) -> int:
        return sum(math.comb(n, n - c) for c in range(self.least(n), n + 1))

    def blocks_of(self, n: int) -> int:
        return self.differences(n) + 1

    def near(self, left: str, right: str, a: str, b: str) -> Column:
        """Whether two sets' sketches (columns with these prefixes) allow a link of sets with a and b elements.

        A sketch has at each bit the parity of the elements that hash to it, so two sketches differ in no more bits than the sets
        in elements: this never rules out a link.
        """
        bits = sum((F.bit_count(F.col(left + k).bitwiseXOR(F.col(right + k))) for k in SKETCH[1:]), F.bit_count(F.col(left + SKETCH[0]).bitwiseXOR(F.col(right + SKETCH[0]))))
        p, q = self.t.numerator, self.t.denominator
        return bits * (p + q) <= (q - p) * (F.col(a) + F.col(b))

    def linked(self, common, a, b):
        return common * self.t.denominator >= self.t.numerator * (a + b - common)

    def keys(self, elements: np.ndarray) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
        """Keys of a set's blocks and how many of them it shares at least with any set that it links with; keys of its subsets and
        their sizes."""
        n = len(elements)
        keys, subsets, common = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        mixed, least = splitmix(elements), n
        if n < self.heavy:
            from itertools import combinations

            whole = mixed.sum(dtype=np.uint64)
            for c in range(self.least(n), n + 1):
                gone = np.array([mixed[list(x)].sum(dtype=np.uint64) for x in combinations(range(n), n - c)], np.uint64)
                subsets.append(splitmix(whole - gone + np.uint64(c)))
                common.append(np.full(len(gone), c))
        if n >= self.both:
            at = int(np.searchsorted(self.starts, n, "right")) - 1
            for k in {at, at + 1 if int(n / self.t) >= self.starts[at + 1] else at}:
                most = self.differences(self.starts[k + 1] - 1)
                spare = 2 + most // SPARE
                blocks = most + 1 + spare
                block = ((elements >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
                size = np.bincount(block.astype(np.int64), minlength=blocks)
                sums = np.zeros(blocks, np.uint64)
                np.add.at(sums, block.astype(np.int64), mixed)
                # Linked sets have 1 + spare of these first blocks in common. A set with at most `spare` empty ones leaves these out:
                # others are shared as well. If both sets leave theirs out, these are the same among what they share; if one keeps
                # its own, no more than one key is sure.
                here = np.arange(min(blocks, self.differences(n) + 1 + spare))
                empty = size[here] == 0
                if empty.sum() <= spare:
                    here = here[~empty]
                    least = min(least, 1 + spare - int(empty.sum()))
                else:
                    least = 1
                keys.append(splitmix(sums[here] + splitmix((here + (k << 32)).astype(np.uint64)) * np.uint64(2 * k + 3) + size[here].astype(np.uint64)))
        return np.concatenate(keys), least, np.concatenate(subsets), np.concatenate(common)


def shingle_sets(batch, text: int, words: int = WORDS):
    """For each text of an Arrow batch the sorted 64-bit hashes of its distinct shingles, of lower-cased words."""
    for lo, hi, data, offsets in text_chunks(batch, text):
        data = lower_ascii(data)
        starts, ends, first = word_spans(data, offsets)
        hashes = word_hashes(data, starts, ends, 1)
        rolled = np.zeros(len(hashes), np.uint64)
        for j in range(words):
            rolled = splitmix(rolled + hashes[np.minimum(np.arange(len(hashes)) + j, max(len(hashes) - 1, 0))] * np.uint64(2 * j + 1)) if len(hashes) else rolled
        for i in range(hi - lo):
            a, b = int(first[i]), int(first[i + 1])
            if b - a >= words:
                yield np.unique(rolled[a : b - words + 1])
            elif b > a:
                short = np.uint64(b - a)
                for h in hashes[a:b]:
                    short = splitmix(np.array([short], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + h)[0]
                yield np.array([short], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def set_ids(sets: list[np.ndarray]) -> list[int]:
    """A 64-bit digest of each set; 0 for an empty one."""
    return [int(splitmix(splitmix(x ^ np.uint64(0xA5A5A5A5)).sum(dtype=np.uint64) + np.uint64([len(x)]))[0].astype(np.int64)) if len(x) else 0 for x in sets]


def sketch(elements: np.ndarray) -> np.ndarray:
    """Parities of the elements by 9 bits of their hash, as 64-bit words."""
    odd = np.bincount((splitmix(elements) & np.uint64(64 * len(SKETCH) - 1)).astype(np.int64), minlength=64 * len(SKETCH)) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def signatures(docs: DataFrame, scheme: Scheme, words: int = WORDS) -> DataFrame:
    """Of doc_id, text and more: all but the text, n_shingles, id (a digest of the set), blocks, least, subsets and common (see Scheme.keys)."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            sets = list(shingle_sets(batch, 1, words))
            if sets:
                blocks, least, subsets, common = zip(*(scheme.keys(x) if len(x) else (x, 0, x, x) for x in sets))
                columns = [batch.column(0), *batch.columns[2:], pa.array(map(len, sets), pa.int64()), pa.array(set_ids(sets), pa.int64())]
                columns += [pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64())) for found in (blocks, subsets)]
                columns += [pa.array([x.astype(np.int32) for x in common], pa.list_(pa.int32())), pa.array(least, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names)

    made = StructType.fromDDL("n_shingles long, id long, blocks array<long>, subsets array<long>, common array<int>, least long")
    schema = StructType([docs.schema["doc_id"], *docs.schema.fields[2:], *made.fields])
    names = schema.names
    return docs.mapInArrow(run, schema)


def sets_of(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """id, elements: the sorted hashes as bytes."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            found = list(shingle_sets(batch, 1, words))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(set_ids(found), pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], ["id", "elements"])

    return docs.mapInArrow(run, "id long, elements binary")


def only(rows: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows whose `on` is in `ids`, which is materialised: broadcast if it is small, else a shuffled semi-join."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, on, "left_semi")


def shared_keys(lists: DataFrame) -> DataFrame:
    """key: those with several rows."""
    return stored(lists.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("key"))


def bitmap(keys: DataFrame) -> np.ndarray:
    """Bits by place in a key's hash, set where `keys` has one: at most 8 MB, in 16 bits a key while there are few."""
    bits = min(BITS, max(6, (16 * keys.count()).bit_length()))
    slot = f"(shiftright(key, 8) & {(1 << bits) - 1}L)"
    words = keys.groupBy(F.expr(f"shiftright({slot}, 6)").alias("w")).agg(F.expr(f"bit_or(shiftleft(1L, cast({slot} & 63 AS int)))").alias("b")).toPandas()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)
    return out


def likely(rows: DataFrame, part: int, keys: DataFrame, parts: int = PARTS) -> DataFrame:
    """id, least, key: blocks' keys of this part that the bitmap of `keys` has, so all that are in `keys` and few others."""
    import pyarrow as pa

    bits = bitmap(keys).view(np.uint8)

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            ends = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1]
            key = lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
            slot = (key >> 8) & (8 * len(bits) - 1)
            at = np.flatnonzero((key % parts == part) & (bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 == 1))
            row = np.repeat(np.arange(len(lists)), np.diff(ends))[at]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(row)) for c in range(2)), pa.array(key[at], pa.int64())], ["id", "least", "key"])

    return rows.select("id", "least", "blocks").mapInArrow(run, "id long, least long, key long")


def components(edges: DataFrame) -> DataFrame:
    """id, component (least id reachable) of every id in `edges` (u, v): labels spread and jump until none changes."""
    both = cut(edges.select("u", "v").union(edges.select(F.col("v"), F.col("u"))).filter("u <> v").distinct())
    few = both.count() <= TOGETHER

    def kept(df):
        return cut(df).coalesce(1) if few else cut(df)

    def side(df):
        return F.broadcast(df) if few else df

    both = both.coalesce(1) if few else both
    labels = kept(both.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("c")).select("id", F.least("id", "c").alias("c")))
    while True:
        near = both.join(side(labels), F.col("v") == F.col("id")).groupBy("u").agg(F.min("c").alias("near"))
        spread = labels.join(side(near), F.col("id") == F.col("u")).select("id", F.least("c", "near").alias("c"), F.col("c").alias("old"))
        jump = spread.select(F.col("id").alias("c"), F.col("c").alias("far"))
        spread = kept(spread.join(side(jump), "c", "left").select("id", F.least("c", "far").alias("c"), "old"))
        moved = spread.filter("c <> old").limit(1).count()
        labels = spread.drop("old")
        if not few:
            release(edges.sparkSession)
        if not moved:
            return labels.select("id", F.col("c").alias("component"))


def compared(pairs: DataFrame, sets: DataFrame, scheme: Scheme, small: bool = False) -> DataFrame:
    """Of `pairs` (p, x): np, nx (sizes), h (elements in one of the two only), linked, those elements, and x's sketch.

    small: whether all of `sets` may be broadcast.
    """

    def run(frames):
        for pdf in frames:
            out = []
            for p, x, a, b in zip(pdf["p"], pdf["x"], pdf["a"], pdf["b"]):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                apart = np.setxor1d(a, b, assume_unique=True)
                linked = scheme.linked((len(a) + len(b) - len(apart)) // 2, len(a), len(b))
                out.append((p, x, len(a), len(b), len(apart), bool(linked), apart.view(np.int64), *sketch(b)))
            yield pd.DataFrame(out, columns=["p", "x", "np", "nx", "h", "linked", "apart", *SKETCH])

    pivots, others = (sets.select(F.col("id").alias(k), F.col("elements").alias(e)) for k, e in (("p", "a"), ("x", "b")))
    if small:
        pivots, others = F.broadcast(pivots), F.broadcast(others)
    else:
        pivots, others = (only(each, cut(pairs.select(k).distinct()), k) for each, k in ((pivots, "p"), (others, "x")))
    joined = pairs.join(others, "x").join(pivots, "p")
    return joined.select("p", "x", "a", "b").mapInPandas(run, "p long, x long, np long, nx long, h long, linked boolean, apart array<long>" + "".join(f", {k} long" for k in SKETCH))


def centred(homes: DataFrame) -> DataFrame:
    """homes with `apart` and h as of differences from the home's centre, which is no document: what most of its members have.

    A pivot's own elements are differences of all others; from the centre they are differences of none.
    """
    often = homes.select("p", F.explode("apart").alias("e")).groupBy("p", "e").agg(F.count(F.lit(1)).alias("often"))
    members = homes.groupBy("p").agg(F.count(F.lit(1)).alias("members"))
    flips = often.join(members, "p").filter("2 * often > members").groupBy("p").agg(F.collect_list("e").alias("flip"))
    flip = F.coalesce("flip", F.array().cast("array<long>"))
    apart = F.concat(F.array_except("apart", flip), F.array_except(flip, "apart"))
    return homes.join(flips, "p", "left").withColumn("apart", apart).drop("flip").withColumn("h", F.size("apart").cast("long"))


def kin(homes: DataFrame, scheme: Scheme) -> DataFrame:
    """Links (u, v) enough to connect what links connect among sets with one home: by their common differences from its centre.

    homes: p, x, nx, linked, apart, sketch (see compared()) and x's component so far; a set may have several homes.

    Two sets that differ from the centre by hx and hy elements, m of them the same, differ by hx + hy - 2m from one another, and link
    if that is at most r (|x| + |y|). Let f(x) = hx - r |x|, and let q be the home's set with the least f: all are compared with q.
    A link needs 2m >= f(x) + f(y), f(y) is at least f(q), and that of a y that doesn't link with q is over -f(q), as hy + hq is then
    over r (|y| + |q|). So of the differences that x has in common with any other set, the two share one of the rarest (their number -
    the least m + 1), and that is among the rarest of y by the same count. Sketches are compared where these meet: of sets that share
    a rare difference and nothing else no pair is made.
    """
    r = (1 - scheme.t) / (1 + scheme.t)
    homes = stored(centred(homes).withColumn("f", r.denominator * F.col("h") - r.numerator * F.col("nx")))

    def links(a, b, na, nb):
        common = (F.col(na) + F.col(nb) - F.size(a) - F.size(b)) / 2 + F.size(F.array_intersect(a, b))
        return common * scheme.t.denominator >= scheme.t.numerator * (F.col(na) + F.col(nb) - common)

    first = homes.groupBy("p").agg(F.min_by("x", F.struct("f", "x")).alias("x"))
    first = homes.join(first, ["p", "x"]).select("p", F.col("x").alias("q"), F.col("nx").alias("nq"), F.col("f").alias("fq"), F.col("apart").alias("aq"), F.col("linked").alias("lq"))
    rows = stored(homes.join(first, "p").withColumn("near", links("apart", "aq", "nx", "nq")).drop("aq"))
    # Those that link with the pivot are of one component with those that link with q, if q links with the pivot too.
    tied = F.col("near") | (F.col("linked") & F.col("lq"))
    each = rows.select("p", "x", "component", tied.alias("tied"), "f", "fq", "nx", *SKETCH, F.explode("apart").alias("e"))
    often = each.groupBy("p", "e").agg(F.count(F.lit(1)).alias("often"))
    each = each.join(often.filter("often > 1"), ["p", "e"])

    def rarest(*least):
        return F.col("place") <= F.col("others") - F.greatest(*least, F.lit(1)) + 1

    at_least = F.ceil((F.col("f") + F.col("fq")) / (2 * r.denominator))
    more_than = F.floor((F.col("f") - F.col("fq")) / (2 * r.denominator)) + 1

    place = F.row_number().over(Window.partitionBy("p", "x").orderBy("often", "e"))
    # What x has in common with any other set is among the differences that others have too; with fewer of these it has no link.
    each = each.withColumns({"place": place, "others": F.count(F.lit(1)).over(Window.partitionBy("p", "x"))})
    probe = each.filter(rarest(at_least, more_than)).select("p", "e", F.col("x").alias("v"), F.col("component").alias("cv"), F.col("nx").alias("nv"), *SKETCH)
    index = each.filter(~F.col("tied") & rarest(at_least)).select("p", "e", "x", "component", "nx", *SKETCH)
    same = (F.col("probe.p") == F.col("index.p")) & (F.col("probe.e") == F.col("index.e")) & (F.col("component") != F.col("cv"))
    found = probe.alias("probe").join(index.alias("index"), same & scheme.near("probe.", "index.", "nv", "nx"))
    found = found.select("probe.p", F.least("v", "x").alias("u"), F.greatest("v", "x").alias("v")).distinct()
    a, b = (homes.select("p", F.col("x").alias(k), F.col("nx").alias(f"n{c}"), F.col("apart").alias(c)) for k, c in (("u", "a"), ("v", "b")))
    found = found.join(a, ["p", "u"]).join(b, ["p", "v"]).filter(links("a", "b", "na", "nb")).select("u", "v")
    return rows.filter("near AND x <> q").select(F.col("q").alias("u"), F.col("x").alias("v")).union(found)


def block_edges(lists: DataFrame, docs: DataFrame, nodes: DataFrame, known: DataFrame, scheme: Scheme, words: int) -> DataFrame:
    """Links enough to connect what blocks' lists (key, id) connect, besides the links in `known` (u, v).

    docs: doc_id, text; nodes: a document (doc_id) with the set (id).
    """
    sizes = lists.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    central = cut(lists.join(sizes, "key").groupBy("id").agg(F.sum("n").alias("central")))
    wanted = cut(nodes.join(central, "id", "left_semi").select("doc_id"))
    sets = stored(sets_of(only(docs, wanted, "doc_id"), words).dropDuplicates(["id"]))
    pivots = stored(lists.join(central, "id").groupBy("key").agg(F.max_by("id", F.struct("central", -F.col("id"))).alias("p")))
    pairs = stored(lists.join(pivots, "key").filter("id <> p").select("p", F.col("id").alias("x")).distinct())
    release(docs.sparkSession)
    # Sets travel whole here, and what they differ by with them: in parts as well.
    small = (sets.agg(F.sum(F.length("elements"))).first()[0] or 0) <= BROADCAST_BYTES
    parts, n = [], 1 if small else PARTS
    for k in range(n):
        parts.append(stored(compared(pairs.filter(F.pmod("p", F.lit(n)) == k), sets, scheme, small)))
        release(docs.sparkSession)
    discard(pairs)
    tested = reduce(DataFrame.union, parts)
    edges = cut(known.union(tested.filter("linked").select("p", "x")).distinct())
    label = components(edges)
    # Each set's home is a pivot that it was compared to: of those at most twice as far as the nearest, the one compared to most sets,
    # so that most lists have one home. Sets with one home are compared through it.
    most = tested.groupBy("p").agg(F.count(F.lit(1)).alias("m"))
    ranked = tested.select("p", "x", "h", F.min("h").over(Window.partitionBy("x")).alias("least")).filter("h <= 2 * least").join(most, "p")
    best = ranked.groupBy("x").agg(F.max_by("p", F.struct("m", -F.col("h"), "p")).alias("p"))
    best = cut(best.join(label.select(F.col("id").alias("x"), "component"), "x", "left").withColumn("component", F.coalesce("component", "x")))
    homes = []
    for part in parts:
        homes.append(stored(part.join(best, ["x", "p"])))
        release(docs.sparkSession)
        discard(part)
    homes = reduce(DataFrame.union, homes)
    links = cut(kin(homes, scheme))
    release(docs.sparkSession)
    # Members of one list with different homes that are in different components yet are compared as they are, where sketches allow it.
    at = lists.join(pivots, "key").filter("id <> p").select("key", F.col("id").alias("x"))
    at = at.join(homes.select("x", F.col("p").alias("home"), "component", "nx", *SKETCH), "x")
    mixed = at.groupBy("key").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("home", "component") for f in (F.min, F.max)])
    mixed = mixed.filter("min_home <> max_home AND min_component <> max_component").select("key")
    at = stored(at.join(mixed, "key", "left_semi"))
    left, right = (at.select("key", F.col("x").alias(k), F.col("home").alias(f"h{k}"), F.col("component").alias(f"c{k}"), F.col("nx").alias(f"n{k}"), *SKETCH) for k in ("u", "v"))
    apart = (F.col("hu") < F.col("hv")) & (F.col("cu") != F.col("cv")) & scheme.near("left.", "right.", "nu", "nv")
    cross = left.alias("left").join(right.alias("right"), (F.col("left.key") == F.col("right.key")) & apart)
    cross = cross.select(F.least("u", "v").alias("p"), F.greatest("u", "v").alias("x"))
    cross = cut(cross.distinct())
    release(docs.sparkSession)
    more = compared(cross, sets, scheme, small).filter("linked").select("p", "x")
    return cut(edges.union(links).union(more))


def jaccard_classes(docs: DataFrame, similarity: tuple[int, int] = SIMILARITY, words: int = WORDS, light_below: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (least doc_id reachable by links, itself included).

    Shingles are of `words` lower-cased (A-Z) words; a text with fewer is one shingle; one without words, or null, is linked with
    nothing. Links are between texts: each of the rows that repeat a doc_id has the class of its own text. A row without doc_id has
    its class's least one, null if that class has none. Columns besides doc_id and text are not read, but for those in `carry`,
    which come back with `class`, a number that differs between classes. light_below sets the boundary of light and heavy sets,
    which otherwise follows from cost. Shingles and sets are compared by 64-bit hashes.
    """
    scheme = Scheme(similarity, light_below)
    carried = [F.col(c).alias(f"_{n}") for n, c in enumerate(carry)]
    keyed = stored(signatures(docs.select(F.col("doc_id").cast("long"), "text", *carried), scheme, words))
    rows = stored(keyed.drop("blocks", "subsets", "common", "least"))
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    nodes = cut(rows.filter("n_shingles > 0").groupBy("id").agg(F.min("doc_id").alias("least")))
    # One document stands for each set; those without doc_id all stand for theirs.
    anonymous = F.lit(-(1 << 63))
    docs, chosen = docs.withColumn("doc_id", F.coalesce("doc_id", anonymous)), nodes.select("id", F.coalesce("least", anonymous).alias("doc_id"))
    apart = only(keyed.withColumn("doc_id", F.coalesce("doc_id", anonymous)), cut(chosen.select("doc_id").distinct()), "doc_id")
    subsets = apart.select("id", F.col("n_shingles").alias("n"), F.explode(F.arrays_zip("subsets", "common")).alias("k"))
    subsets = subsets.select("id", "n", F.col("k.subsets").alias("key"), F.col("k.common").alias("common"))
    smallest = subsets.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("n", "id")).alias("least")).filter("m > 1")
    light = subsets.join(smallest, "key").filter("id <> least.id")
    p, q = scheme.t.numerator, scheme.t.denominator
    light = light.filter(q * F.col("common") >= p * (F.col("n") + F.col("least.n") - F.col("common"))).select(F.col("least.id").alias("u"), F.col("id").alias("v"))
    light = cut(light.distinct())
    release(docs.sparkSession)
    keys = apart.agg(F.sum(F.size("blocks"))).first()[0] or 0
    parts, n = [], min(PARTS, 1 + keys // PART_KEYS)
    for k in range(n):
        blocks = apart.select("id", "least", F.explode("blocks").alias("key")).filter(F.pmod("key", F.lit(n)) == k)
        shared = shared_keys(blocks)
        # A join and no broadcast at any size: a key in a third of all sets is split at run time.
        parts.append(stored(likely(apart, k, shared, n).join(shared.hint("merge"), "key", "left_semi").distinct()))
        discard(shared)
        release(docs.sparkSession)
    discard(keyed)
    lists = reduce(DataFrame.union, parts)
    # A set that shares too few blocks with others links with none; what is left of the others' lists is what to compare.
    enough = cut(lists.groupBy("id").agg(F.count(F.lit(1)).alias("m"), F.first("least").alias("l")).filter("m >= l").select("id"))
    lists = only(lists, enough, "id")
    lists = stored(lists.join(shared_keys(lists), "key", "left_semi"))
    release(docs.sparkSession)
    discard(*parts)
    edges = block_edges(lists.drop("least"), docs, chosen, light, scheme, words)
    label = components(edges)
    least = label.join(nodes, "id").groupBy("component").agg(F.min("least").alias("component_id"))
    label = label.join(least, "component")
    found = rows.join(nodes, "id", "left").join(label, "id", "left")
    back = [F.coalesce("component", "id").alias("class"), *(F.col(f"_{n}").alias(c) for n, c in enumerate(carry))] if carry else []
    return found.select("doc_id", "n_shingles", F.coalesce("component_id", "least", "doc_id").alias("component_id"), *back)
