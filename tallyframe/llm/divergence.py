"""Divergence of sources within a language, by the terms that they use: exact sums over all kept terms, split by how common a term is.

A group is a (language, source). Terms that many of a language's groups have (heavy ones) go through dense tiles in numpy, of blocks of
groups by terms. A rare term is a short posting list. Nearly all pairs of groups lack it on both sides, and what a group without a term
has depends on the group alone; so a pair starts from these values for all terms, each group's own counts correct it (those that are
equal at once), and so does each pair of postings of one rare term. Tiles give what heavy terms add to the start. All are whole
numbers, so the parts add up exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lower_ascii, stored, text_chunks, word_hashes

LEAST_DOCUMENTS = 10
TOP = 10
SCALE = 1_000_000_000
#: A term is heavy if more than this share of a language's groups has it, and more than two: to shuffle a pair of postings costs some
#: hundred times as much as a cell of a tile.
HEAVY = 0.1
#: Groups and terms to a tile.
GROUPS, TERMS = 256, 512
#: Bytes of the table of groups up to which it is broadcast.
BROADCAST_BYTES = 8 << 20
_LETTER = np.array([65 <= c <= 90 or 97 <= c <= 122 or c > 127 for c in range(256)])


def _spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last byte of each term of concatenated texts."""
    solid = _LETTER[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = offsets[:-1][(offsets[:-1] < offsets[1:]) & (offsets[:-1] > 0)]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _numbered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Distinct terms, and the number of each term among these."""
    raw = data.tobytes()
    spell = lambda at: [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]
    (_, at, term), check = np.unique(word_hashes(data, starts, ends, 1), return_index=True, return_inverse=True), word_hashes(data, starts, ends, 2)
    known = spell(at)
    if (check != check[at][term]).any():  # two terms with one hash
        every = spell(np.arange(len(starts)))
        place = {w: k for k, w in enumerate(dict.fromkeys(every))}
        known, term = list(place), np.array([place[w] for w in every])
    return [w.decode("utf-8", "replace") for w in known], term


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows that have it) of every two megabytes of text, in lower case (A-Z)."""
    import pyarrow as pa

    names = ["lang", "source", "term", "n", "docs"]

    def run(batches):
        for batch in batches:
            groups: dict[tuple, int] = {}
            group = np.array([groups.setdefault(k, len(groups)) for k in zip(*(batch.column(c).to_pylist() for c in (0, 1)))], np.int64)
            langs, sources = (np.array([k[c] for k in groups], object) for c in (0, 1))
            for lo, _, data, offsets in text_chunks(batch, 2):
                starts, ends = _spans(data, offsets)
                if not len(starts):
                    continue
                words, term = _numbered(lower_ascii(data), starts, ends)
                doc = lo + np.searchsorted(offsets, starts, "right") - 1
                key, n = np.unique(group[doc] * len(words) + term, return_counts=True)
                once = np.unique(doc * len(words) + term)
                held = np.unique(group[once // len(words)] * len(words) + once % len(words), return_counts=True)[1]
                of = key // len(words)
                columns = [pa.array(c, pa.string()) for c in (langs[of], sources[of], np.array(words, object)[key % len(words)])]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n), pa.array(held)], names)

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")


def _p(count: str, total: str, terms: str) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)), in integers of as many digits as it takes."""
    return F.expr(f"1 + ((cast({count} as decimal(20, 0)) + 2) * {SCALE}) div (cast({total} as decimal(20, 0)) + 2 * cast({terms} as decimal(18, 0)))")


def _f(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)); p and q are at most 10^9 + 1, so the square is a long."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _dense(pdf: pd.DataFrame, size: int = GROUPS) -> pd.DataFrame:
    """Sums of one tile, over what the pair would have without its terms: groups (rows without term, p of what they lack) by terms.

    columns i, j: the blocks of `size` groups.
    """
    lacks = pdf[pdf["term"].isna()].drop_duplicates("gid").sort_values("gid")
    has = pdf[pdf["term"].notna()]
    number, terms = pd.factorize(has["term"])
    gids, p0 = lacks["gid"].to_numpy(), lacks["p"].to_numpy()
    p = np.repeat(p0[:, None], len(terms), axis=1)
    p[np.searchsorted(gids, has["gid"].to_numpy()), number] = has["p"].to_numpy()
    i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
    left, right = np.flatnonzero(gids // size == i), np.flatnonzero(gids // size == j)
    out = []
    for a in left:
        others = right[right > a]
        apart, without = p[others] - p[a], p0[others] - p0[a]
        value = (apart * apart // (p[others] + p[a])).sum(axis=1) - len(terms) * (without * without // (p0[others] + p0[a]))
        out.append(pd.DataFrame({"lang": pdf["lang"].iloc[0], "a": gids[a], "b": gids[others], "value": value}))
    return pd.concat(out) if out else pd.DataFrame({"lang": [], "a": [], "b": [], "value": []})


def divergence(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP, heavy: float = HEAVY) -> DataFrame:
    """lang, source, part, item, value, rank of every (lang, source) of rows lang, source, text; null is ''.

    Each language keeps the V terms that `least_documents` of its rows have. Of a group with N occurrences of kept terms, a term with
    count of them has p = 1 + floor(10^9 (count + 2) / (N + 2 V)); f(p, q) = floor((p - q)^2 / (p + q)).
    part `pair`: item is each other source, value the sum of f over all kept terms. part `term`: item is each kept term that the group
    has and uses more than its language, value its f against the language, the first `top`. rank: by value, largest first, then item.

    Every row is a document, repeated doc_ids included. A language with one source has no pairs. Other columns aren't read. heavy: the
    share of a language's groups beyond which a term goes through tiles; results don't depend on it.
    """
    docs = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = stored(term_counts(docs).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("k")).filter(F.col("docs") >= least_documents)
    kept = stored(counts.drop("docs").join(terms.drop("docs"), ["lang", "term"]))
    every = cut(docs.select("lang", "source").distinct())
    sources = every.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    once = kept.groupBy("lang", "term").agg(F.first("total").alias("total"), F.first("k").alias("k"))
    rare_up_to = F.greatest(F.lit(2), F.floor(F.col("sources") * heavy)).alias("most")
    langs = once.join(F.broadcast(sources), "lang").groupBy("lang").agg(
        F.count(F.lit(1)).alias("v"), F.sum("total").alias("all"), F.first(rare_up_to).alias("most")
    )
    langs = cut(sources.join(langs, "lang", "left").na.fill(0, ["v", "all", "most"]))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    gid = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = every.join(own, ["lang", "source"], "left").na.fill(0, ["n"]).withColumn("gid", gid.cast("long")).join(langs, "lang")
    # Without kept terms there is nothing that p0 is used for, and no total to divide by.
    lacking = F.when(F.col("v") > 0, _p("0", "n", "if(v > 0, v, 1)")).otherwise(F.lit(1))
    groups = groups.select("lang", "source", "gid", F.expr(f"gid div {GROUPS}").alias("block"), F.col("n").alias("own"), lacking.cast("long").alias("p0"), "v", "all", "most", "sources")
    groups = cut(groups)
    size = groups.agg(F.sum(F.octet_length("lang") + F.octet_length("source") + 96)).first()[0] or 0
    known = groups.select("lang", "source", "gid", "block", "own", "p0", "v", "all", "most", "sources")
    rows = kept.join(F.broadcast(known) if size <= BROADCAST_BYTES else known, ["lang", "source"])
    rows = rows.withColumns({"p": _p("n", "own", "v").cast("long"), "q": _p("total", "all", "v").cast("long")})
    rows = stored(rows.select("lang", "source", "gid", "block", "term", "p", "q", "p0", (F.col("k") > F.col("most")).alias("heavy"), "sources"))
    pairs = _pairs(groups, rows)
    both = pairs.select("lang", F.col("sa").alias("source"), F.col("sb").alias("item"), "value").union(pairs.select("lang", "sb", "sa", "value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    both = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    over = rows.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f("p", "q").alias("value"))
    return both.union(over.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top))


def _pairs(groups: DataFrame, rows: DataFrame) -> DataFrame:
    """lang, sa, sb, value of each pair of a language's groups, the one with the smaller gid first."""
    blocks = f"(sources - 1) div {GROUPS}"
    # Every pair is met once, in the second one's block.
    other = groups.select("lang", "block", F.col("gid").alias("b"), F.col("source").alias("sb"), F.col("p0").alias("q0"))
    first = groups.select("lang", F.col("gid").alias("a"), F.col("source").alias("sa"), "p0", "v", F.explode(F.expr(f"sequence(block, {blocks})")).alias("block"))
    base = first.join(other, ["lang", "block"]).filter("a < b").select("lang", "a", "b", "sa", "sb", (F.col("v") * _f("p0", "q0")).alias("value"))
    # Rare terms: what a group has against all that lack the term, then what two groups have of one term.
    rare = rows.filter("NOT heavy").select("lang", "term", "gid", "p", "p0", "sources")
    alike = rare.groupBy("lang", "gid", "p", "p0", "sources").agg(F.count(F.lit(1)).alias("m"))
    alike = alike.withColumn("block", F.explode(F.expr(f"sequence(0, {blocks})"))).join(other, ["lang", "block"]).filter("gid <> b")
    no_name = (F.lit(None).cast("string").alias("sa"), F.lit(None).cast("string").alias("sb"))
    alone = alike.select("lang", F.least("gid", "b").alias("a"), F.greatest("gid", "b").alias("b"), *no_name, (F.col("m") * (_f("p", "q0") - _f("p0", "q0"))).alias("value"))
    right = rare.select("lang", "term", F.col("gid").alias("b"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    met = rare.join(right, ["lang", "term"]).filter("gid < b")
    met = met.select("lang", F.col("gid").alias("a"), "b", *no_name, (_f("p", "q") - _f("p", "q0") - _f("p0", "q") + _f("p0", "q0")).alias("value"))
    # Heavy terms: tiles of two blocks of groups by the terms of one part.
    heavy = rows.filter("heavy").select("lang", "block", "gid", "term", "p", "sources")
    parts = cut(heavy.groupBy("lang").agg(F.ceil(F.approx_count_distinct("term") / TERMS).alias("parts")))
    heavy = heavy.join(F.broadcast(parts), "lang").withColumn("tile", F.pmod(F.xxhash64("term"), F.col("parts")))
    lacks = groups.join(F.broadcast(parts), "lang").withColumn("tile", F.explode(F.expr("sequence(0L, parts - 1)")))
    lacks = lacks.select("lang", "block", "gid", F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"), "sources", "tile")
    cells = heavy.drop("parts").select("lang", "block", "gid", "term", "p", "sources", "tile").union(lacks)
    cells = cells.withColumn("o", F.explode(F.expr(f"sequence(0, {blocks})")))
    cells = cells.select("lang", "tile", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "gid", "term", "p")
    dense = cells.groupBy("lang", "tile", "i", "j").applyInPandas(lambda pdf: _dense(pdf), "lang string, a long, b long, value long")
    dense = dense.select("lang", "a", "b", *no_name, "value")
    return base.union(alone).union(met).union(dense).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.max("sa").alias("sa"), F.max("sb").alias("sb")).drop("a", "b")
