"""Mixing sources to target weights: iterative proportional fitting of token weights, then sampling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, words

#: Exponents that flatten each marginal: a dimension's target share is its token share to this power, normalised.
SOURCE, LANG, TOPIC = 0.5, 0.7, 0.0
ROUNDS, TOPICS = 6, 8
#: Expected share of tokens that stay where no probability meets 1.
KEEP = 0.8
#: Of probabilities: rounds, keeps that are tried at once, and by how much a marginal may miss its target.
BOUND_ROUNDS, KEEPS, NEAR = 8, 8, 0.005
#: Of the keep at which a value would stay whole, so much is the most: at that keep itself the fitting hardly converges.
BELOW = 0.999
#: At most so many cells are fitted in one task, without an exchange in each step.
TOGETHER = 20_000


def lead_topic(text: Column, topics: int = TOPICS) -> Column:
    """A topic bucket for tables without a topic column: by MD5 of the text's first word, lower-cased."""
    lead = F.lower(F.regexp_extract(F.coalesce(text, F.lit("")), r"([^\x20\x09-\x0D]+)", 1))
    return F.conv(F.substring(F.md5(lead), 1, 4), 16, 10).cast("long") % topics


def cells_of(docs: DataFrame, topic: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, lang (null: empty), topic (null: -1), tokens (words) of each row."""
    return docs.select(
        "doc_id",
        F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce(lead_topic(F.col("text")) if topic is None else topic.cast("long"), F.lit(-1)).alias("topic"),
        F.size(words(F.col("text"))).cast("long").alias("tokens"),
        *carry,
    )


def held(cells: DataFrame, few: bool) -> DataFrame:
    """As cut(); few: in one partition, so that no window over them needs an exchange."""
    return cut(cells).coalesce(1) if few else cut(cells)


def goals(cells: DataFrame, flatten: dict[str, float], few: bool = False) -> DataFrame:
    """cells with t_<dim>, the tokens of the cell's value of each dimension, and goal_<dim>, those that it should have."""
    for dim in flatten:
        cells = cells.withColumn(f"t_{dim}", F.sum("tokens").over(Window.partitionBy(dim)).cast("double"))
    cells = held(cells, few)
    # Each value counts once: its cells have its tokens between them.
    norms = [F.sum(F.when(F.col(f"t_{dim}") > 0, F.pow(f"t_{dim}", F.lit(power)) * F.col("tokens") / F.col(f"t_{dim}"))).alias(f"norm_{dim}") for dim, power in flatten.items()]
    one = cells.agg(F.sum("tokens").alias("all"), *norms)
    share = {f"goal_{dim}": F.when(F.col(f"t_{dim}") > 0, F.pow(f"t_{dim}", F.lit(power)) / F.col(f"norm_{dim}") * F.col("all")) for dim, power in flatten.items()}
    return cells.crossJoin(F.broadcast(one)).withColumns(share).drop("all", *(f"norm_{dim}" for dim in flatten))


def rake(cells: DataFrame, flatten: dict[str, float], rounds: int = ROUNDS, few: bool = False) -> DataFrame:
    """Weights w of cells (see goals()), by which the tokens of each value come to its goal: iterative proportional fitting.

    cells: one row for each combination of values that occurs. Each step is a window by dimension: one exchange of cells, which
    are few where documents are many, and none if they are in one partition (see held()). Cells without tokens keep weight 1.
    """
    now = cells.withColumn("w", F.lit(1.0))
    for _ in range(rounds):
        for dim in flatten:
            got = F.sum(F.col("tokens") * F.col("w")).over(Window.partitionBy(dim))
            now = now.withColumn("got", got).withColumn("w", F.when(F.col("got") > 0, F.col("w") * F.col(f"goal_{dim}") / F.col("got")).otherwise(F.col("w"))).drop("got")
    return held(now, few)


def calibrate(weighted: DataFrame, flatten: dict[str, float], keep: float = KEEP, rounds: int = BOUND_ROUNDS, few: bool = False) -> DataFrame:
    """Cells with their probability p and the keep that it is for: the tokens of each value by p come to keep times its goal.

    min(1, keep * w) cuts large weights and so misses the targets. Here cells at 1 are fixed and the others make up for them,
    value by value (a Newton step on sum(tokens * min(1, f * u)) = keep * goal for the value's factor f). A value whose goal is
    more than all it has can't be met: keep comes down to the largest of KEEPS values for which all targets are met within NEAR,
    from `keep`, or the largest that no single value rules out, to 1 / the largest weight, where nothing is cut. If none is
    (targets that contradict one another), it is the one with the smallest miss.
    """
    some = F.col("tokens") > 0
    ends = weighted.agg(F.min(F.when(some, F.least(*(F.col(f"t_{d}") / F.col(f"goal_{d}") for d in flatten)))).alias("m"), F.max(F.when(some, F.col("w"))).alias("w"))
    ends = ends.select(F.least(F.lit(float(keep)), BELOW * F.col("m")).alias("hi"), F.col("w").alias("top")).withColumn("lo", F.least("hi", 1 / F.col("top")))
    keeps = ends.select("hi", "lo", F.explode(F.sequence(F.lit(0), F.lit(KEEPS - 1))).alias("k"))
    # The upper end as it is: the power of a ratio would bring rounding into the keep that was asked for.
    value = F.when(F.col("k") == KEEPS - 1, F.col("hi")).otherwise(F.col("lo") * F.pow(F.col("hi") / F.col("lo"), F.col("k") / float(KEEPS - 1)))
    now = weighted.crossJoin(F.broadcast(keeps.select("k", value.alias("keep")))).withColumn("u", F.col("keep") * F.col("w"))

    def sums(df, dim):
        """fixed: tokens of the value's cells at 1; free: those of the others, by u; want: what both should come to."""
        same = Window.partitionBy("k", dim)
        fixed = F.sum(F.when(F.col("u") >= 1, F.col("tokens")).otherwise(0)).over(same).cast("double")
        free = F.sum(F.when(F.col("u") < 1, F.col("tokens") * F.col("u")).otherwise(0.0)).over(same)
        return df.withColumns({"fixed": fixed, "free": free, "want": F.col("keep") * F.col(f"goal_{dim}")})

    newton = (F.col("want") - F.col("fixed")) / F.col("free")
    ratio = F.col("want") / (F.col("fixed") + F.col("free"))
    f = F.when(F.col("fixed") + F.col("free") <= 0, F.lit(1.0)).when(F.col("free") <= 0, F.least(F.lit(1.0), ratio)).when(ratio >= 1, newton).otherwise(F.greatest(newton, ratio / 2))
    for n in range(rounds):
        for dim in flatten:
            now = sums(now, dim).withColumn("u", F.col("u") * F.coalesce(f, F.lit(1.0))).drop("fixed", "free", "want")
        if n % 4 == 3:
            now = held(now, few)  # a plan of fewer exchanges
    now = now.withColumn("miss", F.lit(0.0))
    for dim in flatten:
        now = sums(now, dim).withColumn("miss", F.greatest("miss", F.when(some, F.abs((F.col("fixed") + F.col("free")) / F.col("want") - 1)).otherwise(0.0))).drop("fixed", "free", "want")
    now = held(now.select(*flatten, "w", "k", "keep", F.least(F.lit(1.0), "u").alias("p"), "miss"), few)
    worst = now.groupBy("k").agg(F.max("miss").alias("miss"))
    order = F.struct((F.col("miss") > NEAR).alias("far"), F.when(F.col("miss") > NEAR, F.col("miss")).otherwise(-F.col("k")).alias("by"))
    best = worst.agg(F.min_by("k", order).alias("best"))
    chosen = now.crossJoin(F.broadcast(best)).filter(F.col("k") == F.col("best"))
    # Without any tokens there is nothing to meet.
    return chosen.select(*flatten, "w", F.coalesce("keep", F.lit(float(keep))).alias("keep"), F.coalesce("p", F.lit(float(keep))).alias("p"))


def draw(doc_id: Column) -> Column:
    """A number in [0, 1) that depends on the document's id alone."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 12), 16, 10).cast("double") / float(1 << 48)


def mix(docs: DataFrame, keep: float = KEEP, rounds: int = ROUNDS, topic: Column | None = None, flatten: dict[str, float] | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, source, lang, topic, tokens, weight, probability, kept; and the columns in `carry`.

    Weights are scaled by the fitting so that their mean over tokens is 1. Probabilities are such that what is expected to stay
    meets the targets, for a keep as large as `keep` if that can be (see calibrate()). topic: an expression of the input's columns,
    by default a bucket of the first word. Null source, language or topic is a value of its own; null text has no tokens and weight
    1. Rows with equal doc_id and cell are kept or dropped alike, repeated rows too. An empty table gives an empty one.
    """
    flatten = flatten or {"source": SOURCE, "lang": LANG, "topic": TOPIC}
    rows = cells_of(docs, topic, carry)
    cells = rows.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"))
    cells = cut(cells)
    few = cells.count() <= TOGETHER
    cells = cells.coalesce(1) if few else cells
    weights = cut(calibrate(rake(goals(cells, flatten, few), flatten, rounds, few), flatten, keep, few=few))
    # A cell may hold a third of all rows: both sides are ordinary exchanges, which adaptive execution splits.
    return rows.join(weights, ["source", "lang", "topic"]).select(
        "doc_id", "source", "lang", "topic", "tokens",
        F.col("w").alias("weight"), F.col("p").alias("probability"), (draw(F.col("doc_id")) < F.col("p")).alias("kept"), *carry,
    )
