"""Exact order statistics of groups of any size: a sketch brackets the wanted element, exact counts tell what lies below the bracket.

No group is sorted or collected unless it is small. Of a large one, each round takes approximate quantiles (mergeable, of bounded size),
counts the elements below, at and between the two that the wanted rank should be between, and goes on with that open interval, which
has some thousandths of the elements left. Counts are exact, so a sketch that is off costs a round and nothing else.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import held

#: Elements that one task sorts.
LIMIT = 100_000
#: Quantiles of a sketch, and its accuracy (its ranks are off by at most one part in so many).
GRID, ACCURACY = 1000, 10_000
#: Rows of wanted ranks up to which they are broadcast (some hundred bytes each).
FEW = 10_000


def nearest_rank(p: float) -> Column:
    """The rank, from 1, of the element at ceil(p n); the first one for p = 0."""
    return F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("n"))).cast("long")


def order_statistics(df: DataFrame, by: Sequence[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """`by`, n and a column for each of `ranks`: the element of that rank (a column of n, from 1) as a double.

    Nulls and NaN aren't elements; a group without any has no row, and a rank outside of 1 to n gives null. A null in `by` is a group
    of its own. Without `by` the whole table is one group.
    """
    by = list(by)
    # Structs of the keys join null-safely; one constant stands for no keys.
    key = F.struct(*by, F.lit(0).alias("_all")).alias("_key")
    rows = df.select(key, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    counted = held(rows.groupBy("_key").agg(F.count(F.lit(1)).alias("n")))
    nothing = F.lit(None).cast("double")
    pending = None
    for name, rank in ranks.items():
        one = counted.select("_key", F.lit(name).alias("which"), rank.cast("long").alias("left"), F.col("n").alias("inside"), nothing.alias("lo"), nothing.alias("hi"))
        pending = one if pending is None else pending.unionByName(one)
    pending = held(pending.filter("left BETWEEN 1 AND inside"))
    found = []
    while True:
        few = pending.filter(F.col("inside") <= LIMIT)
        place = F.row_number().over(Window.partitionBy("_key", "which").orderBy("_v"))
        found.append(_inside(rows, few).withColumn("place", place).filter("place = left").select("_key", "which", "_v"))
        many = pending.filter(F.col("inside") > LIMIT)
        if many.isEmpty():
            break
        pending, exact = _narrowed(rows, many)
        found.append(exact)
    answers = found[0]
    for more in found[1:]:
        answers = answers.unionByName(more)
    columns = [F.max(F.when(F.col("which") == name, F.col("_v"))).alias(name) for name in ranks]
    out = counted.join(answers.groupBy("_key").agg(*columns), "_key", "left")
    return out.select(*(F.col(f"_key.{b}").alias(b) for b in by), "n", *ranks)


def _inside(rows: DataFrame, pending: DataFrame) -> DataFrame:
    """Rows with each wanted rank of their group whose open interval they are in."""
    side = F.broadcast(pending) if pending.limit(FEW + 1).count() <= FEW else pending
    open_ = (F.col("lo").isNull() | (F.col("_v") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("_v") < F.col("hi")))
    return rows.join(side, "_key").filter(open_)


def _narrowed(rows: DataFrame, pending: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(wanted ranks with a narrower interval, answers)."""
    own = ["_key", "which", "left", "inside", "lo", "hi"]
    grid = F.percentile_approx("_v", [k / GRID for k in range(GRID + 1)], ACCURACY).alias("grid")
    sketch = _inside(rows, pending).groupBy(*own).agg(grid)
    at = F.floor((F.col("left") - 1) * GRID / F.col("inside")).cast("int")
    sketch = held(sketch.select(*own, F.get("grid", F.greatest(at - 1, F.lit(0))).alias("a"), F.get("grid", F.least(at + 2, F.lit(GRID))).alias("b")))
    v, a, b = F.col("_v"), F.col("a"), F.col("b")
    counts = _inside(rows, sketch).groupBy(*own, "a", "b").agg(
        F.count_if(v < a).alias("below"), F.count_if(v == a).alias("at_a"), F.count_if((v > a) & (v < b)).alias("between"), F.count_if((v == b) & (a != b)).alias("at_b")
    )
    left = F.col("left")
    upto = [F.col("below")]
    for part in ("at_a", "between", "at_b"):
        upto.append(upto[-1] + F.col(part))
    low, to_a, mid, to_b = upto

    def case(*values):
        return F.when(left <= low, values[0]).when(left <= to_a, values[1]).when(left <= mid, values[2]).when(left <= to_b, values[3]).otherwise(values[4])

    none = F.lit(None).cast("double")
    judged = held(counts.select(
        "_key", "which", case(left, none, left - to_a, none, left - to_b).cast("long").alias("left"), case(low, none, F.col("between"), none, F.col("inside") - to_b).cast("long").alias("inside"),
        case(F.col("lo"), a, a, b, b).alias("lo"), case(a, a, b, b, F.col("hi")).alias("hi"), case(none, a, none, b, none).alias("_v"),
    ))
    return judged.filter("_v IS NULL").drop("_v"), judged.filter("_v IS NOT NULL").select("_key", "which", "_v")


def median_and_mad(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """`by`, n, median, mad (the median of absolute distances from it), both exact; of an even number the mean of the two in the middle."""
    by = list(by)

    def middle(rows, column, name):
        half = {"_a": F.floor((F.col("n") + 1) / 2), "_b": F.floor((F.col("n") + 2) / 2)}
        return order_statistics(rows, by, column, half).select(*by, "n", ((F.col("_a") + F.col("_b")) / 2).alias(name))

    center = held(middle(df, value, "median"))
    if by:
        on = [F.col(f"l.{b}").eqNullSafe(F.col(f"r.{b}")) for b in by]
    else:
        on = [F.lit(True)]
    side = F.broadcast(center) if center.limit(FEW + 1).count() <= FEW else center
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    apart = df.alias("l").join(side.alias("r"), cond).select(*(F.col(f"l.{b}").alias(b) for b in by), F.abs(F.col(f"l.{value}").cast("double") - F.col("r.median")).alias("_d"))
    spread = middle(apart, "_d", "mad").drop("n")
    if not by:
        return center.crossJoin(spread)  # one row each
    return center.alias("l").join(spread.alias("r"), cond).select(*(F.col(f"l.{b}").alias(b) for b in by), "n", "median", "mad")
