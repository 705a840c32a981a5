"""Quality rules: base rules, then a hashed n-gram log-likelihood ratio. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, words

#: Hash buckets of the two multinomials; the broadcast table of log ratios has as many rows.
BUCKETS = 1 << 17
#: The trusted side is fitted on so many labelled documents at most, the first by hash of their id.
TRUSTED = 20_000
#: Documents whose mean log ratio is below this are rejected.
THRESHOLD = -0.2


def _pairs(hashes, gap: int):
    """Of an array of hashes: one hash of each element and the one `gap` places later."""
    n = F.greatest(F.size(hashes) - gap, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(1 + gap), n), lambda a, b: F.xxhash64(a, b))


def features(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, base measures, base_failed, and the arrays of word hashes (h1) and word-pair hashes (h2).

    carry: with row, a struct of the input's columns as they were.

    Null text has no words. A window of eight words counts as repeated if it occurs twice or more in the text; n_repeat_words
    is the number of words that such windows cover.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    row = [F.struct(*docs.columns).alias("row")] if carry else []
    keep = ["row"] if carry else []
    split = docs.select("doc_id", text.alias("text"), *row).select("doc_id", "text", *keep, words(F.col("text")).alias("words"), lines.alias("lines"))
    hashed = split.select(
        "doc_id",
        *keep,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h1"),
    )
    hashed = hashed.withColumn("h2", _pairs(F.col("h1"), 1))
    hashed = hashed.withColumn("h4", _pairs(F.col("h2"), 2))  # a column each: an expression that is named twice runs twice
    hashed = hashed.withColumn("h8", _pairs(F.col("h4"), 4))
    # Few texts repeat a window; only these sort theirs.
    some = F.size(F.array_distinct("h8")) < F.size("h8")
    placed = F.when(some, F.sort_array(F.transform("h8", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    hashed = hashed.withColumn("placed", placed)
    near = lambda i: F.get("placed", i)["h"]
    twice = F.filter("placed", lambda x, i: x["h"].eqNullSafe(near(i - 1)) | x["h"].eqNullSafe(near(i + 1)))
    hashed = hashed.withColumn("twice", F.sort_array(F.transform(twice, lambda x: x["i"])))
    gaps = F.transform("twice", lambda x, i: F.least(F.lit(8), F.coalesce(F.get("twice", i + 1) - x, F.lit(8))))
    repeat = F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, g: a + g), F.lit(0)).cast("long")
    return hashed.withColumn("n_repeat_words", repeat).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
        "h1", "h2", *keep,
    )


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, trusted: int = TRUSTED) -> DataFrame:
    """bucket, ratio: log of the trusted side's over the raw corpus's smoothed multinomial, for each bucket that occurs.

    Raw counts are over every document. The trusted side has documents of labels with quality 1 and toxic 0.
    """
    chosen = labels.filter("quality = 1 AND toxic = 0").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(trusted)
    marked = docs.select("doc_id", "text").join(F.broadcast(chosen.withColumn("good", F.lit(1))), "doc_id", "left")
    h1 = F.transform(words(F.col("text")), lambda w: F.xxhash64(w))
    hashed = marked.select("good", h1.alias("h1"))
    hashed = hashed.select("good", F.explode(F.concat("h1", _pairs(F.col("h1"), 1))).alias("h"))
    counts = hashed.groupBy(F.pmod("h", F.lit(buckets)).alias("bucket")).agg(F.count(F.lit(1)).alias("raw"), F.count("good").alias("target"))
    total = counts.agg(F.sum("raw").alias("raws"), F.sum("target").alias("targets"))
    # Each side is smoothed towards the other's total in proportion, so that no trusted side gives a ratio of 0 everywhere.
    share = (F.col("raw") + 0.5) / (F.col("raws") + 0.5 * buckets)
    target = (F.col("target") + 20.0 * share) / (F.col("targets") + 20.0)
    smooth = F.log((F.col("targets") * target + buckets * share) / (F.col("targets") + buckets) / share)
    return counts.crossJoin(F.broadcast(total)).select("bucket", smooth.alias("ratio"))


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, trusted: int = TRUSTED, carry: bool = False) -> DataFrame:
    """One row per input row: the base measures, llr (mean log ratio of its words and word pairs, 0 without words), kept.

    Needs doc_id and text of `docs`, doc_id, quality and toxic of `labels`; other columns are not read. A repeated row gives a
    repeated result. Without trusted labels every ratio is 0, and the base rules alone decide.
    """
    # The table has `buckets` rows whatever the corpus: one array, which reaches the tasks as the value of a scalar subquery.
    ratios = cut(log_ratios(docs, labels, buckets, trusted))
    every = docs.sparkSession.range(buckets).select(F.col("id").alias("bucket")).join(ratios, "bucket", "left")
    rows = F.sort_array(F.collect_list(F.struct("bucket", F.coalesce("ratio", F.lit(0.0)).alias("ratio"))))
    table = every.agg(F.transform(rows, lambda r: r["ratio"]).alias("ratios")).scalar()
    total = F.aggregate(F.concat("h1", "h2"), F.lit(0.0), lambda a, h: a + F.get("table", F.pmod(h, F.lit(buckets)).cast("int")))
    llr = F.coalesce(F.try_divide(total, F.size("h1") + F.size("h2")), F.lit(0.0))
    judged = features(docs, carry).withColumn("table", table).withColumn("llr", llr).drop("h1", "h2", "table")
    judged = judged.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
    # A row is handed on as it is: a filter on the verdict would else be pushed down with its whole expression in it, over and over.
    return judged.select(F.explode(F.array(F.struct(*judged.columns))).alias("judged")).select("judged.*")
