"""Licence scans: normalised text compared to templates by Dice coefficient over word bigrams. DataFrame functions only."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .license_texts import TEMPLATES

DICE = 0.8

#: Words that anchors() takes last, as they are frequent in any prose.
COMMON = set(
    "a action all an and any are as at author authors available be by can commercial copies copy do for form free from general if in including is it library"
    " made may must not of on or out performance products program provided public published purpose see source specific subject terms that the this to under"
    " use used version was we with without work you".split()
)


def normalised(text: Column) -> Column:
    """Words of lower-cased (A-Z) letters and digits of ASCII; all else separates."""
    plain = F.regexp_replace(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]+", " ")
    return F.filter(F.split(plain, " "), lambda w: w != "")


def bigrams(words: Column) -> Column:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b)))


def template_bigrams(templates: dict[str, str]) -> dict[str, list[str]]:
    import re

    out = {}
    for name, text in templates.items():
        words = re.findall("[a-z0-9]+", text.lower())
        out[name] = sorted(set(map(" ".join, zip(words, words[1:]))))
    return out


#: Words of a phrase that says where a template may stand, and of the shortest template that is looked for that way.
PHRASE, WINDOW = 3, 12


def phrases(templates: dict[str, str]) -> list[tuple[str, str, int, int]]:
    """(phrase, template, words before it there, the template's words): of each third of a longer template the phrase with most that is rare."""
    import re

    out = []
    for name, text in sorted(templates.items()):
        words = re.findall("[a-z0-9]+", text.lower())
        n = len(words)
        if n < WINDOW:
            continue
        every = [" ".join(words[i : i + PHRASE]) for i in range(n - PHRASE + 1)]
        for k in range(3):
            own = [i for i in range(n * k // 3, min(n * (k + 1) // 3, len(every))) if every.count(every[i]) == 1]
            if own:
                best = max(own, key=lambda i: (sum(w not in COMMON for w in words[i : i + PHRASE]), len(every[i]), -i))
                out.append((every[best], name, best, n))
    return out


def units(text: Column) -> Column:
    """Lines, sentences of lines, paragraphs (between blank lines) and the whole text, each once."""
    return F.array_distinct(F.concat(F.split(text, "\n"), F.split(text, r"[.!?]+[ \t\r]+|\n"), F.split(text, r"\n[ \t\r]*\n"), F.array(text)))


def anchors(grams: dict[str, list[str]], dice: float) -> list[str]:
    """Words of which any unit has one that reaches `dice` with any template.

    Such a unit shares so many bigrams with the template (at the least size that the bound allows) that the bigrams without any
    anchor are too few. Of each template the words in most bigrams, rare ones first, until that holds.
    """
    found: set[str] = set()
    for own in grams.values():
        smallest = min(n for n in range(1, len(own) + 1) if 2 * n >= dice * (n + len(own)) - 1e-9)
        least, left = int(dice * (smallest + len(own)) / 2 - 1e-9) + 1, [set(g.split()) for g in own]
        left = [g for g in left if not g & found]
        while len(left) >= least:
            words = sorted({w for g in left for w in g})
            best = max(words, key=lambda w: (w not in COMMON and len(w) > 1, sum(w in g for g in left), len(w), w))
            found.add(best)
            left = [g for g in left if best not in g]
    return sorted(found)


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, dice: float = DICE) -> DataFrame:
    """One row per distinct doc_id: license (best template's; null: none), dice (of its best unit or window), n_licenses (licences matched).

    A text's units are its lines, their sentences, its paragraphs and the whole. A longer template is also looked for wherever one of
    its phrases (see phrases()) stands, in a window of as many words as it has around that place: in comments, wrapped otherwise, with
    code or text before and after. Templates are named licence or licence/part. Licences that differ in a clause or a version are
    templates of their own, and so are parts of long ones and identifiers: of those that are reached the one with most bigrams in
    common is named, then the one with the larger coefficient, then the first name.

    Texts and units without an anchor word (see anchors()) are left out before anything is split; then a unit is compared only to
    templates whose number of distinct bigrams allows the threshold, and only if enough of its bigrams are in any template at all.
    None of these bounds loses anything. Null and empty texts, and units of fewer than two words, match nothing. Rows that share a
    doc_id are one document with all their texts; repeated rows change nothing. Templates are a parameter and so bounded; they go into
    the plan as constants. Columns besides doc_id and text are not read.
    """
    grams = template_bigrams(templates)
    few, many = (min(map(len, grams.values())), max(map(len, grams.values())))
    ratio = dice / (2 - dice)
    every = F.from_json(F.lit(json.dumps(sorted(set().union(*grams.values())))), "array<string>")
    table = F.from_json(F.lit(json.dumps([{"name": k, "grams": v} for k, v in sorted(grams.items())])), "array<struct<name: string, grams: array<string>>>")
    some = f"(?i)(?<![a-z0-9])(?:{'|'.join(anchors(grams, dice))})(?![a-z0-9])"
    anchored = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.col("text").rlike(some))
    # A unit with too many words has more than the largest template's bigrams allow only if few repeat, so words don't bound it
    # from above; bytes do from below.
    split = anchored.select("doc_id", F.explode(units(F.col("text"))).alias("unit")).filter((F.octet_length("unit") >= 3) & F.col("unit").rlike(some))
    found = split.select("doc_id", normalised(F.col("unit")).alias("words")).filter(F.size("words") > few * ratio)
    found = found.select("doc_id", bigrams(F.col("words")).alias("grams")).filter(F.size("grams").between(few * ratio - 1e-9, many / ratio + 1e-9))
    found = found.filter(F.size(F.array_intersect("grams", every)) >= F.size("grams") * ratio - 1e-9)
    pairs = found.select("doc_id", "grams", F.explode(table).alias("t")).filter(
        F.size("t.grams").between(F.size("grams") * ratio - 1e-9, F.size("grams") / ratio + 1e-9)
    )
    common = F.size(F.array_intersect("grams", "t.grams"))
    value = F.struct((2.0 * common / (F.size("grams") + F.size("t.grams"))).alias("dice"), common.alias("common"))
    best = pairs.select("doc_id", F.col("t.name").alias("name"), value.alias("v")).filter(F.col("v.dice") >= dice)
    best = best.union(_windows(docs, templates, grams, dice)).groupBy("doc_id", "name").agg(F.max("v").alias("v"))
    order = F.struct((-F.col("v.common")).alias("c"), (-F.col("v.dice")).alias("d"), "name")
    family = F.split_part("name", F.lit("/"), F.lit(1))
    one = best.groupBy("doc_id").agg(F.size(F.collect_set(family)).alias("n_licenses"), F.min(order).alias("b"))
    every_doc = docs.select("doc_id").distinct()
    joined = every_doc.join(one.withColumnRenamed("doc_id", "id"), F.col("doc_id").eqNullSafe(F.col("id")), "left")
    return joined.select("doc_id", F.split_part("b.name", F.lit("/"), F.lit(1)).alias("license"), F.round(-F.col("b.d"), 6).alias("dice"), F.coalesce("n_licenses", F.lit(0)).cast("long").alias("n_licenses"))


def _windows(docs: DataFrame, templates: dict[str, str], grams: dict[str, list[str]], dice: float) -> DataFrame:
    """doc_id, name, v (dice, common) of windows that reach the threshold with the template that their phrase is of."""
    known: dict[str, list[dict]] = {}
    for phrase, name, before, n in phrases(templates):
        known.setdefault(phrase, []).append({"name": name, "before": before, "n": n, "grams": grams[name]})
    if not known:
        return docs.sparkSession.createDataFrame([], StructType([docs.schema["doc_id"], *StructType.fromDDL("name string, v struct<dice: double, common: int>").fields]))
    table = F.from_json(F.lit(json.dumps(known)), "map<string, array<struct<name: string, before: int, n: int, grams: array<string>>>>")
    names = F.from_json(F.lit(json.dumps(sorted(known))), "array<string>")
    gap = "[^a-z0-9]+"
    some = f"(?i)(?<![a-z0-9])(?:{'|'.join(p.replace(' ', gap) for p in sorted(known))})(?![a-z0-9])"
    words = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.col("text").rlike(some)).select("doc_id", normalised(F.col("text")).alias("words"))
    spoken = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - (PHRASE - 1), F.lit(1))), lambda i: F.struct(i.alias("i"), F.concat_ws(" ", F.slice("words", i, PHRASE)).alias("phrase")))
    hits = words.select("doc_id", "words", F.explode(F.filter(spoken, lambda x: F.array_contains(names, x["phrase"]))).alias("at"))
    hits = hits.select("doc_id", "words", F.col("at.i").alias("i"), F.explode(F.element_at(table, F.col("at.phrase"))).alias("t"))
    window = F.slice("words", F.greatest(F.col("i") - F.col("t.before"), F.lit(1)), F.col("t.n"))
    found = hits.select("doc_id", "t", bigrams(window).alias("grams"))
    common = F.size(F.array_intersect("grams", "t.grams"))
    value = F.struct((2.0 * common / (F.size("grams") + F.size("t.grams"))).alias("dice"), common.alias("common"))
    return found.select("doc_id", F.col("t.name").alias("name"), value.alias("v")).filter(F.col("v.dice") >= dice)
