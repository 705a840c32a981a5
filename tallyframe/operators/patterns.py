"""Many regular expressions against many texts, as a join on a key: what a match must contain is an index.

A pattern's syntax tree tells which literal text every match of it contains, or of which few literals one. Twelve letters of each of
these literals (six or three of shorter ones), those that fewest texts have, are the pattern's keys; a text's keys are all its runs of as
many letters. Keys are 64-bit hashes: hashes that are alike by chance bring together a text and a pattern that don't match, no more.
Texts' keys are dropped by a bitmap of the patterns' keys before they are shuffled, and the joins are shuffled by their hint: Spark takes
an explosion, also a checkpointed one, to be as large as what it explodes, and would broadcast it. Only texts and
patterns that share a key are matched, so nothing is lost. Patterns that say nothing of the kind (`.*`, `[0-9]+`) meet every text, and
are counted: few in any real configuration, they are broadcast up to a bound.

Equal texts are matched once, however many rows have them.
"""

from __future__ import annotations

import re
from re import _constants as sre
from re import _parser as parser

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import held

#: Letters of a key at least, and how many more it has where literals are as long: short runs are in ever more texts as these grow.
GRAM = 3
GRAMS = (12, 6, GRAM)
#: Bytes of patterns up to which they are broadcast to all texts as they are.
BROADCAST_BYTES = 8 << 20
#: Patterns up to which an index costs more than it saves.
FEW = 64
#: Bits, as a power of two, of the largest bitmap of keys (8 MB).
BITS = 26
#: The syntax whose meaning is beyond doubt in all dialects; a pattern with anything else has no required literal here.
_PLAIN = re.compile(r"(?:[^\\\[\](){}?*+|^$]|\\[dDwWsSbB]|\\[^0-9A-Za-z]|\[\^?(?:[^\\\[\]&]|\\[dDwWsS]|\\[^0-9A-Za-z])+\]|\((?:\?:)?|[){}|^$?*+])*")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Letters that other letters than their own capitals count as, when case doesn't count; and all beyond ASCII.
_FOLDED = re.compile(r"[iksIKS\u0080-\U0010ffff]")


def _required(nodes) -> list[list[str]]:
    """Sets of literals; a match contains at least one of each set."""
    found: list[list[str]] = []
    run = ""

    def end():
        nonlocal run
        if run:
            found.append([run])
        run = ""

    for op, arg in nodes:
        if op is sre.LITERAL:
            run += chr(arg)
        elif op is sre.AT:
            continue
        else:
            end()
            if op is sre.SUBPATTERN:
                found += _required(arg[3])
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
                found += _required(arg[2])
            elif op is sre.BRANCH:
                each = [_required(b) for b in arg[1]]
                if all(each):
                    found.append([literal for b in each for literal in max(b, key=lambda s: min(map(len, s)))])
    end()
    return found


def required_literals(pattern: str) -> list[str] | None:
    """Literals, in lower case (A-Z), one of which every match contains in any case; None if none of use is known.

    Of several such sets the one whose shortest member is longest.
    """
    own = re.sub(r"^\(\?iu?\)", "", pattern)
    folds = own != pattern
    if not _PLAIN.fullmatch(own) or "(?" in own.replace("(?:", ""):
        return None
    try:
        tree = parser.parse(own)
    except (re.error, OverflowError, RecursionError):
        return None
    sets = []
    for literals in _required(tree):
        # Where case doesn't count, only what stands between letters with a wider family is sure.
        parts = [max(_FOLDED.split(x), key=len) if folds else x for x in literals]
        if all(len(x) >= GRAM for x in parts):
            sets.append([x.translate(_LOWER) for x in parts])
    return max(sets, key=lambda s: (min(map(len, s)), -len(s))) if sets else None


def _grams(text: Column, sizes: list[int]) -> Column:
    """The distinct runs of so many letters of a text, in lower case (A-Z)."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def runs(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), lambda i: F.substring(low, i, F.lit(n)))

    return F.array_distinct(F.concat(F.array().cast("array<string>"), *map(runs, sizes)))


def _indexed(patterns: DataFrame) -> DataFrame:
    """Of distinct patterns (pattern): pattern, literal (its place among the alternatives) and gram of each pattern's required literals; a null gram for patterns without."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            out = []
            for pattern in batch.column(0).to_pylist():
                literals = required_literals(pattern)
                if literals is None:
                    out.append((pattern, None, None))
                for k, text in enumerate(literals or ()):
                    size = next(n for n in GRAMS if n <= len(text))
                    out += [(pattern, k, text[i : i + size]) for i in range(len(text) - size + 1)]
            columns = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string()))], ["pattern", "literal", "gram"])

    return patterns.mapInArrow(run, "pattern string, literal int, gram string")


def _bitmap(keys: DataFrame) -> np.ndarray:
    """Bits by place in a key (gram), set where `keys` has one: at most 8 MB, in 16 bits a row while there are few."""
    bits = min(BITS, max(6, (16 * keys.count()).bit_length()))
    slot = f"(gram & {(1 << bits) - 1}L)"
    words = keys.groupBy(F.expr(f"shiftright({slot}, 6)").alias("w")).agg(F.expr(f"bit_or(shiftleft(1L, cast({slot} & 63 AS int)))").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return out


def _likely(texts: DataFrame, sizes: list[int], keys: DataFrame) -> DataFrame:
    """gram, text: the texts' keys that the bitmap of `keys` has, so all that are in `keys` and few others."""
    import pyarrow as pa

    bits = _bitmap(keys).view(np.uint8)

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            ends = lists.offsets.to_numpy()
            key = lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
            slot = key & (8 * len(bits) - 1)
            at = np.flatnonzero(bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 == 1)
            row = np.repeat(np.arange(len(lists)), np.diff(ends))[at]
            yield pa.RecordBatch.from_arrays([pa.array(key[at], pa.int64()), batch.column(0).take(pa.array(row))], ["gram", "text"])

    return texts.select("text", F.transform(_grams(F.col("text"), sizes), lambda g: F.xxhash64(g)).alias("grams")).mapInArrow(run, "gram long, text string")


def _small(df: DataFrame, column: str) -> bool:
    return (df.agg(F.sum(F.octet_length(column) + 64)).first()[0] or 0) <= BROADCAST_BYTES


def matches(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """text, pattern of all matches of rules' patterns (pattern) somewhere in the texts (text), each distinct pair once.

    Null texts match nothing. Patterns are in Java's dialect, as re2_to_java() gives it.
    """
    texts = texts.select("text").filter("text IS NOT NULL").distinct()
    patterns = rules.select("pattern").filter("pattern IS NOT NULL").distinct()
    if patterns.limit(FEW + 1).count() <= FEW and _small(patterns, "pattern"):
        return texts.join(F.broadcast(patterns), F.rlike("text", F.col("pattern")))
    # As bytes they are few and would be left to one task; as work they aren't. Partitions of a given number aren't coalesced.
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = held(texts.repartition(tasks, "text"))
    index = held(_indexed(patterns.repartition(tasks, "pattern")).select("pattern", "literal", F.length("gram").alias("size"), F.when(F.col("gram").isNotNull(), F.xxhash64("gram")).alias("gram")))
    known = index.filter("gram IS NOT NULL")
    sizes = sorted(r[0] for r in known.select("size").distinct().collect())
    # A literal whose rarest letters no text has can't match; its pattern's other alternatives still can.
    often = _likely(texts, sizes, known).groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    rarest = known.join(often.hint("merge"), "gram", "left").groupBy("pattern", "literal").agg(F.min_by("gram", F.struct(F.coalesce("often", F.lit(0)), "gram")).alias("gram"))
    keys = held(rarest.select("pattern", "gram").distinct())
    met = _likely(texts, sizes, keys).join(keys.hint("merge"), "gram").select("text", "pattern").distinct()
    found = held(met.filter(F.rlike("text", F.col("pattern"))))
    rest = index.filter("gram IS NULL").select("pattern")
    if rest.isEmpty():
        return found
    hint = F.broadcast(rest) if _small(rest, "pattern") else rest
    return found.union(texts.join(hint, F.rlike("text", F.col("pattern"))))
