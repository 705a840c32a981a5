"""Column builders: merchant names, regular expressions, similarity, periods, money."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 50 states' postal codes, in alphabetical order.
STATES = (
    "AK AL AR AZ CA CO CT DE FL GA HI IA ID IL IN KS KY LA MA MD ME MI MN MO MS MT NC ND NE NH NJ NM NV NY OH OK OR PA RI SC SD TN TX UT VA VT WA WI WV WY"
).split()

# Rails, processors and domains that card descriptors carry.
RAIL_ID = r"\s+(PPD\s+|CO\s+|WEB\s+|TEL\s+|ARC\s+)?ID:.*$"
RAIL_TAIL = r"\s+(PPD|CCD|WEB|TEL|ARC|POS|PMT)$"
PROCESSOR = r"^(SQ|TST|PP|PY|PAYPAL|GOOGLE|AMZN MKTP US|AMZN MKTP)\s*\*+\s*"
DOMAIN = r"\.(COM|NET|ORG|IO|CO|US)\b"

# Words of account names that say nothing about whose account it is.
GENERIC_TOKENS = ("CHECKING", "SAVINGS", "ACCOUNT", "CARD", "CREDIT", "DEBIT", "BANK")


def merchant_steps(known_cities: tuple[str, ...] = ()) -> list[tuple[str, str, bool]]:
    """(pattern, replacement, everywhere) in order, to be applied to upper-case text. SQL oracles use the same list."""
    states = "|".join(STATES)
    steps = [
        (RAIL_ID, "", False),
        (RAIL_TAIL, "", False),
        (PROCESSOR, "", False),
        (DOMAIN, "", True),
        (r"#?\s*\d{2,}", "", True),
        (r"\bSTORE\b", "", True),
        (rf"\s+[A-Z][A-Z'&.-]*\s+({states})$", "", False),
        (rf"\s+(USA|US|{states})$", "", False),
    ]
    if known_cities:
        steps.append((rf"\s+({'|'.join(escaped(c.upper()) for c in known_cities)})$", "", False))
    return [*steps, (r"\s+", " ", True)]


def normalize_merchant(text: Column, known_cities: tuple[str, ...] = ()) -> Column:
    """A merchant's name from a raw descriptor; null if nothing is left."""
    name = F.upper(text)
    for pattern, replacement, _ in merchant_steps(known_cities):
        name = F.regexp_replace(name, re2_to_java(pattern), replacement)
    return F.nullif(F.trim(name), F.lit(""))


#: What an escape makes literal in RE2 and Java.
SPECIAL = r"([\\^$.|?*+()\[\]{}-])"


def escaped(text: str) -> str:
    """`text` as a pattern that matches it literally in RE2 and Java."""
    return re.sub(SPECIAL, r"\\\1", text)


def regexp_escape(text: Column) -> Column:
    return F.regexp_replace(text, SPECIAL, r"\\$1")


_UNSUPPORTED = re.compile(r"\(\?<?[=!]|\\[1-9]|\(\?>|[*+?}]\+")


def re2_to_java(pattern: str) -> str:
    """A pattern in RE2's dialect as java.util.regex has it; ValueError for what RE2 lacks (backreferences, lookaround).

    $ is the very end, \\s is without the vertical tab, (?i) folds Unicode, and \\b knows ASCII letters only.
    """
    if _UNSUPPORTED.search(re.sub(r"\\[^1-9]", "x", pattern)):
        raise ValueError(f"not an RE2 pattern: {pattern}")
    out, in_class, i = [], False, 0
    word = "[0-9A-Za-z_]"
    while i < len(pattern):
        c = pattern[i : i + 2] if pattern[i] == "\\" else pattern[i]
        if c == r"\s":
            out.append(r" \t\n\f\r" if in_class else r"[ \t\n\f\r]")
        elif c == r"\S" and not in_class:
            out.append(r"[^ \t\n\f\r]")
        elif c == r"\b" and not in_class:
            out.append(f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))")
        elif c == "$" and not in_class:
            out.append(r"\z")
        elif pattern.startswith("(?i)", i):
            out.append("(?iu)")
            c = "(?i)"
        else:
            out.append(c)
            if c == "[" and not in_class:
                in_class = True
                if pattern[i + 1 : i + 2] in ("]", "^"):
                    out.append(pattern[i + 1])
                    c += pattern[i + 1]
                    if pattern[i + 1] == "^" and pattern[i + 2 : i + 3] == "]":
                        out.append("]")
                        c += "]"
            elif c == "]":
                in_class = False
        i += len(c)
    return "".join(out)


def name_tokens(account_name: Column) -> Column:
    """A pattern of the words that tell an account's name apart (four letters or more); null if there are none."""
    kept = F.filter(F.split(F.upper(account_name), " "), lambda t: (F.length(t) >= 4) & ~t.isin(*GENERIC_TOKENS))
    return F.when(F.size(kept) > 0, F.array_join(F.transform(kept, regexp_escape), "|"))


def names(description: Column, tokens: Column) -> Column:
    """Whether a description has one of an account's tokens as a word; false without tokens or description."""
    w = "[0-9A-Za-z_]"
    return F.coalesce(F.rlike(F.upper(description), F.concat(F.lit(f"(?<!{w})("), tokens, F.lit(f")(?!{w})"))), F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null for a zero vector, an error for unequal lengths."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    checked = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of unequal lengths")).cast("double"))
    return checked.otherwise(F.try_divide(dot, norm(a) * norm(b)))


def period_start(period: Column, day: Column) -> Column:
    """The first day of a weekly (Monday), monthly, quarterly or yearly period as a timestamp without zone."""
    unit = {"weekly": "week", "monthly": "month", "quarterly": "quarter", "yearly": "year"}
    out = F.lit(None).cast("timestamp")
    for name, trunc in unit.items():
        out = F.when(period == name, F.date_trunc(trunc, day)).otherwise(out)
    return out.cast("timestamp_ntz")


def month_of(day: Column) -> Column:
    return F.date_trunc("month", day).cast("timestamp_ntz")


def cents(amount: Column) -> Column:
    return F.round(F.abs(amount) * 100).cast("long")


def money(amount: Column) -> Column:
    return amount.cast("decimal(18,2)")


def total(amount: Column) -> Column:
    return F.sum(amount).cast("decimal(38,2)")


def uuid5(namespace: uuid.UUID, name: Column) -> Column:
    """The hex digits of the UUID, version 5, of a name."""
    h = F.sha1(F.concat(F.lit(namespace.bytes), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat(F.substring(h, 1, 12), F.lit("5"), F.substring(h, 14, 3), variant, F.substring(h, 18, 15))


def strptime_to_java(fmt: str) -> str:
    """A strptime format as Spark's datetime pattern."""
    known = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%b": "MMM", "%B": "MMMM"}
    out = []
    for part in re.findall(r"%.|[^%]+", fmt):
        if part[0] == "%" and part not in known:
            raise ValueError(f"unknown directive {part}")
        out.append(known.get(part) or "".join(f"'{c}'" if c.isalpha() else c for c in part))
    return "".join(out)
