"""What users configure: sources, taxonomy, rules, aliases, budgets and places; strict, with missing files as empty lists."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field, fields
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions.exprs import re2_to_java, uuid5

SIGNS = ("signed", "inverted", "debit_credit")
PERIODS = ("weekly", "monthly", "quarterly", "yearly")
FIELDS = ("merchant_name", "description_raw", "account_name", "account_type", "product_name")
#: Ids of configured rows are UUIDv5 in this namespace, so that they stay the same from run to run.
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_DNS, "tallyframe.example")


class ConfigError(ValueError):
    pass


class IngestionError(RuntimeError):
    pass


def stable_id(*parts: str) -> str:
    return uuid.uuid5(NAMESPACE, "|".join(parts)).hex


def stable_ids(*parts: Column) -> Column:
    """stable_id() of columns."""
    return uuid5(NAMESPACE, F.concat_ws("|", *parts))


@dataclass(frozen=True)
class Source:
    """One bank's export: kind csv, ofx or orders; column_map from canonical to the file's names."""

    name: str
    account_name: str = ""
    account_type: str = "checking"
    currency: str = "USD"
    kind: str = "csv"
    column_map: dict = field(default_factory=dict)
    columns: tuple = ()
    skip_rows: int = 0
    date_format: str = "%Y-%m-%d"
    sign: str = "signed"

    def __post_init__(self):
        if self.kind not in ("csv", "ofx", "orders"):
            raise ConfigError(f"{self.name}: kind {self.kind}")
        if self.sign not in SIGNS:
            raise ConfigError(f"{self.name}: sign {self.sign}")
        if self.kind == "csv":
            need = {"posted_on", "description_raw", *(("debit", "credit") if self.sign == "debit_credit" else ("amount",))}
            if missing := need - set(self.column_map):
                raise ConfigError(f"{self.name}: column_map lacks {sorted(missing)}")
            if self.columns and (unknown := set(self.column_map.values()) - set(self.columns)):
                raise ConfigError(f"{self.name}: no columns {sorted(unknown)}")


@dataclass(frozen=True)
class Category:
    path: str
    description: str | None = None

    @property
    def id(self) -> str:
        return stable_id("category", self.path)


@dataclass(frozen=True)
class Rule:
    pattern: str
    applies_to: str
    category: str
    priority: int = 100

    def __post_init__(self):
        check_pattern(self.pattern)
        if self.applies_to not in FIELDS:
            raise ConfigError(f"rule on {self.applies_to}")


@dataclass(frozen=True)
class Alias:
    pattern: str
    canonical_name: str
    priority: int = 100

    def __post_init__(self):
        check_pattern(self.pattern)


@dataclass(frozen=True)
class Budget:
    name: str
    category: str
    period: str
    amount: Decimal
    starts_on: str

    def __post_init__(self):
        if self.period not in PERIODS:
            raise ConfigError(f"budget {self.name}: period {self.period}")
        if Decimal(str(self.amount)) <= 0:
            raise ConfigError(f"budget {self.name}: amount {self.amount}")


def check_pattern(pattern: str) -> str:
    """The pattern as Java has it; ConfigError if it isn't one, or isn't RE2's."""
    try:
        re.compile(pattern)
        return re2_to_java(pattern)
    except (re.error, ValueError) as e:
        raise ConfigError(f"pattern {pattern}: {e}") from e


@dataclass(frozen=True)
class Config:
    sources: tuple = ()
    categories: tuple = ()
    rules: tuple = ()
    aliases: tuple = ()
    budgets: tuple = ()
    places: tuple = ()

    def __post_init__(self):
        paths = {c.path for c in self.categories}
        for kind, name in ((k, x.category) for k, rows in (("rule", self.rules), ("budget", self.budgets)) for x in rows):
            if name not in paths:
                raise ConfigError(f"{kind} for unknown category {name}")
        names = [s.name for s in self.sources]
        if len(set(names)) < len(names):
            raise ConfigError("source names repeat")


def strict(kind: type, row: dict):
    """`row` as `kind`; unknown keys are errors."""
    if unknown := set(row) - {f.name for f in fields(kind)}:
        raise ConfigError(f"{kind.__name__}: unknown {sorted(unknown)}")
    try:
        return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in row.items()})
    except TypeError as e:
        raise ConfigError(str(e)) from e


def flatten(nodes: list, above: str = "") -> list[Category]:
    out = []
    for node in nodes:
        path = f"{above}/{node['name']}" if above else node["name"]
        out += [Category(path, node.get("description")), *flatten(node.get("children", []), path)]
    return out


def load(folder: str) -> Config:
    """sources, taxonomy, rules, merchants, budgets and places .yaml of a folder."""
    from pathlib import Path

    import yaml

    def rows(name):
        path = Path(folder, f"{name}.yaml")
        return (yaml.safe_load(path.read_text()) or []) if path.exists() else []

    return Config(
        tuple(strict(Source, r) for r in rows("sources")), tuple(flatten(rows("taxonomy"))), tuple(strict(Rule, r) for r in rows("rules")),
        tuple(strict(Alias, r) for r in rows("merchants")), tuple(strict(Budget, r) for r in rows("budgets")), tuple(rows("places")),
    )


def seed(spark, config: Config, now) -> dict:
    """The app tables that configuration fills: categories, rules, merchant_aliases, budgets."""
    from tallyframe.schemas import APP

    ids = {c.path: c.id for c in config.categories}
    parent = lambda path: ids.get(path.rpartition("/")[0])
    rows = {
        "categories": [(c.id, now, None, c.path.rpartition("/")[2], parent(c.path), c.description) for c in config.categories],
        "rules": [(stable_id("rule", r.applies_to, r.pattern), now, None, check_pattern(r.pattern), r.applies_to, ids[r.category], r.priority) for r in config.rules],
        "merchant_aliases": [(stable_id("alias", a.pattern), now, None, check_pattern(a.pattern), a.canonical_name, a.priority) for a in config.aliases],
        "budgets": [(stable_id("budget", b.name), now, None, b.name, ids[b.category], b.period, Decimal(str(b.amount)), _day(b.starts_on)) for b in config.budgets],
    }
    return {name: spark.createDataFrame(r, APP[name]) for name, r in rows.items()}


def _day(x):
    import datetime

    return x if isinstance(x, datetime.date) else datetime.date.fromisoformat(str(x))
