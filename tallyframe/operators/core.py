"""Relational building blocks. Each takes and returns DataFrames; every ranking has a total order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import patterns, vectors
from .store import held
from .trees import tree_closure, tree_paths

__all__ = [
    "allocate_exact", "band_pairs", "dealt", "densify", "first_alike", "first_match", "first_per", "held", "latest_per_key", "mad_anomalies", "month_spine", "mutual_best", "nearest_by_cosine", "recurring", "small", "theil_sen",
    "tree_closure", "tree_paths",
]

#: Rows, and bytes of them as JSON, up to which a dimension-like side is broadcast; a larger one goes through a shuffled join.
SMALL, SMALL_BYTES = 100_000, 8 << 20
#: Rows of a task that sorts a large table more than once.
TASK_ROWS = 1_000_000


def small(df: DataFrame, most: int = SMALL, most_bytes: int = SMALL_BYTES) -> DataFrame:
    """`df` with a broadcast hint if it has at most `most` rows and `most_bytes` bytes; else with that of a shuffled join, as Spark's own estimate may be far too low."""
    rows, size = df.limit(most + 1).agg(F.count(F.lit(1)), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    return F.broadcast(df) if rows <= most and (size or 0) <= most_bytes else df.hint("merge")


def dealt(df: DataFrame, by: Sequence[str], rows: int = TASK_ROWS) -> DataFrame:
    """`df`, a table whose count is cheap, dealt out by `by` to so many tasks that each has some `rows` rows to sort, if Spark's setting gives fewer."""
    tasks = -(-df.count() // rows)
    return df.repartition(tasks, *by) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def first_per(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group in `order`; which Spark cuts to one row a task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def latest_per_key(df: DataFrame, by: Sequence[str], at: str, ties: Sequence[str] = ()) -> DataFrame:
    return first_per(df, by, [F.col(at).desc_nulls_last(), *(F.col(t).desc_nulls_last() for t in ties)])


def first_match(df: DataFrame, rules: DataFrame, key: str, text: Column, keep: Sequence[str]) -> DataFrame:
    """The best rule (by priority, then id) whose pattern is somewhere in `text`, for each row that has one.

    rules: id, pattern, priority and more. Distinct texts are matched, each takes its best rule, and rows find theirs by text.
    """
    rows = df.select(key, text.alias("_text"))
    pairs = patterns.matches(rows.select(F.col("_text").alias("text")), rules)
    best = first_per(pairs.join(small(rules), "pattern"), ["text"], [F.col("priority").asc(), F.col("id").asc()])
    matched = rows.join(small(best.select(F.col("text").alias("_text"), "id", "priority", *keep)), "_text")
    return first_per(matched, [key], [F.col("priority").asc(), F.col("id").asc()]).select(key, *keep)


def mutual_best(pairs: DataFrame, left: str, right: str, order: Sequence[Column]) -> DataFrame:
    """Pairs that are the first choice of both sides. Not a maximum matching: whoever is someone's second choice stays alone."""
    by_left = F.row_number().over(Window.partitionBy(left).orderBy(*order, F.col(right)))
    by_right = F.row_number().over(Window.partitionBy(right).orderBy(*order, F.col(left)))
    ranked = pairs.withColumns({"_l": by_left, "_r": by_right})
    return ranked.filter("_l = 1 AND _r = 1").drop("_l", "_r")


def first_alike(df: DataFrame, key: str, alike: Sequence[str]) -> DataFrame:
    """Of rows that are the same in `alike` the one with the first key.

    For mutual_best() over pairs that depend on these columns alone: whoever pairs with one of such rows pairs with all of them, in the
    same order but for the key, so the first row is preferred to the others by everybody, and these are nobody's best. Pairs then
    grow with the kinds of rows there are and not with the square of equal ones. Keys are unique.
    """
    return first_per(df, alike, [F.col(key)])


def band_pairs(left: DataFrame, right: DataFrame, equal: Sequence[tuple[str, str]], day_left: str, day_right: str, days: int, extra: Column | None = None) -> DataFrame:
    """Pairs equal in some columns and at most `days` apart, with day_gap. Column names of the two sides must differ.

    Days fall into buckets as wide as the band, and the right side is there in three of them, so that a frequent combination of
    the equal columns is spread over its days and not one group.
    """
    width = max(1, days)
    bucket = lambda c: F.floor(F.datediff(F.col(c), F.lit("1970-01-01")) / width)
    l_ = left.withColumn("_b", bucket(day_left))
    r_ = right.withColumn("_c", F.explode(F.array(*(bucket(day_right) + d for d in (-1, 0, 1)))))
    on = F.col("_b") == F.col("_c")
    for a, b in equal:
        on = on & (F.col(a) == F.col(b))
    gap = F.datediff(F.col(day_right), F.col(day_left))
    on = on & (F.abs(gap) <= days)
    joined = l_.join(r_, on if extra is None else on & extra)
    return joined.withColumn("day_gap", F.abs(gap).cast("long")).drop("_b", "_c")


def nearest_by_cosine(candidates: DataFrame, reference: DataFrame, key: str, vector: str, threshold: float, others_only: bool = False) -> DataFrame:
    """Of each candidate the reference (ref_name, ref_vector and more) of the highest cosine, if that reaches `threshold`.

    References are what has been decided before, each ref_name once. Ties go to the first ref_name. others_only: a candidate's own
    name among the references doesn't count.
    """
    others = [c for c in reference.columns if c not in ("ref_name", "ref_vector")]
    best = vectors.nearest(candidates, reference, key, vector, "ref_name", "ref_vector", threshold, others_only)
    return best.join(reference.select("ref_name", *others), "ref_name").select(key, "similarity", "ref_name", *others)


def allocate_exact(items: DataFrame, group: str, item: str, charge_cents: str, item_cents: str) -> DataFrame:
    """share_cents of each item: the charge in proportion to the items, rounded half up, with the last item taking the difference.

    Integer arithmetic throughout, so shares add up to the charge to the cent. Items that are all 0 share equally.
    """
    whole = Window.partitionBy(group)
    rows = items.withColumns({
        "_sum": F.sum(item_cents).over(whole), "_n": F.count(F.lit(1)).over(whole),
        "_rank": F.row_number().over(whole.orderBy(F.col(item).desc())),
    })
    part = F.when(F.col("_sum") == 0, F.expr(f"{charge_cents} div _n")).otherwise(F.expr(f"({charge_cents} * {item_cents} + _sum div 2) div if(_sum = 0, 1, _sum)"))
    rows = rows.withColumn("_part", part).withColumn("_parts", F.sum("_part").over(whole))
    share = F.col("_part") + F.when(F.col("_rank") == 1, F.col(charge_cents) - F.col("_parts")).otherwise(0)
    return rows.withColumn("share_cents", share.cast("long")).drop("_sum", "_n", "_rank", "_part", "_parts")


def month_spine(spark, first, last) -> DataFrame:
    """month: the first day of each month from `first` to `last`, both included."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 month"))).alias("month"))


def densify(facts: DataFrame, spine: DataFrame, keys: DataFrame, on: Sequence[str], values: Sequence[str]) -> DataFrame:
    """A row for each key and month; months without facts have 0. The spine is a calendar, so it is repeated."""
    grid = keys.join(F.broadcast(spine), F.lit(True))
    joined = grid.join(facts, [*on, "month"], "left")
    return joined.withColumns({v: F.coalesce(v, F.lit(0).cast(dict(facts.dtypes)[v])) for v in values})


def recurring(tx: DataFrame, cadences: dict[str, tuple[float, float]], regularity: float, least: int = 3) -> DataFrame:
    """Flows of one merchant and signed amount at regular gaps: merchant_name, flow, amount (absolute), cadence, counts, gaps."""
    by = ["merchant_name", "amount", "flow"]
    gap = F.datediff("posted_on", F.lag("posted_on").over(Window.partitionBy(*by).orderBy("posted_on", "transaction_id")))
    groups = tx.withColumn("gap", gap).groupBy(*by).agg(
        F.count(F.lit(1)).alias("occurrence_count"), F.min("posted_on").alias("first_seen_on"), F.max("posted_on").alias("last_seen_on"),
        F.avg("gap").alias("avg_gap_days"), F.stddev_pop("gap").alias("gap_days_stddev"),
    )
    cadence = F.lit(None).cast("string")
    for name, (low, high) in reversed(cadences.items()):
        cadence = F.when(F.col("avg_gap_days").between(low, high), name).otherwise(cadence)
    regular = F.col("gap_days_stddev") <= F.col("avg_gap_days") * regularity
    found = groups.filter(F.col("occurrence_count") >= least).withColumn("cadence", cadence).filter(F.col("cadence").isNotNull() & regular)
    key = F.md5(F.concat_ws("|", "merchant_name", "flow", F.col("amount").cast("string")))
    return found.select(key.alias("recurring_flow_id"), "merchant_name", "flow", F.abs("amount").alias("amount"), "cadence", "occurrence_count", "first_seen_on", "last_seen_on", "avg_gap_days", "gap_days_stddev")


def mad_anomalies(series: DataFrame, by: Sequence[str], month: str, value: str, z: float, least_amount: float, lookback: int, min_months: int) -> DataFrame:
    """Months among the last `lookback` of each series that stand out: by the modified z-score about the median."""
    center = series.groupBy(*by).agg(F.median(value).alias("center"), F.count(F.lit(1)).alias("n"), F.max(month).alias("last"))
    dev = series.join(center, list(by)).withColumn("dev", F.col(value) - F.col("center"))
    spread = dev.groupBy(*by).agg(F.median(F.abs("dev")).alias("mad"), F.avg(F.abs("dev")).alias("mean_ad"))
    # What makes MAD and mean absolute deviation estimates of a normal deviation.
    scale = F.when(F.col("mad") > 0, F.col("mad") / 0.6745).otherwise(F.col("mean_ad") * 1.253314)
    scored = dev.join(spread, list(by)).withColumn("z", F.try_divide(F.col("dev"), scale))
    recent = F.col(month) > F.add_months(F.col("last"), -lookback)
    return scored.filter((F.col("n") >= min_months) & recent & (F.abs("dev") >= least_amount) & (F.abs("z") >= z)).select(*by, month, value, "center", "dev", "z")


def theil_sen(series: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """slope: the median slope over all pairs of points of a series. Series are short (months)."""
    right = series.select(*by, F.col(x).alias("_x"), F.col(y).alias("_y"))
    pairs = series.join(right, list(by)).filter(F.col(x) < F.col("_x"))
    return pairs.groupBy(*by).agg(F.median((F.col("_y") - F.col(y)) / (F.col("_x") - F.col(x))).alias("slope"))
