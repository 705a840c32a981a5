"""Open read-only SQL and the catalog, as capped, plain records.

Spark has no read-only switch, so run_sql looks at the parsed statement before anything runs: only queries pass, none reads files by
path, and none calls functions that reach into the JVM. This is weaker than an engine that enforces it; give it a session of its own.
"""

from __future__ import annotations

import datetime as dt
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession

from tallyframe.params import Params

#: Logical plans that a query consists of; a statement with anything else is refused.
QUERY_NODES = {
    "Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Limit", "Offset", "Join", "LateralJoin", "Union", "Distinct", "Except", "Intersect", "SubqueryAlias",
    "UnresolvedRelation", "UnresolvedWith", "UnresolvedHaving", "UnresolvedInlineTable", "UnresolvedTableValuedFunction", "UnresolvedSubqueryColumnAliases", "OneRowRelation",
    "LocalRelation", "Generate", "WithWindowDefinition", "Pivot", "Unpivot", "UnpivotTransformed", "Window", "UnionLoop", "CTERelationDef", "CTERelationRef", "WithCTE", "Range", "ResolvedInlineTable", "Tablesample", "Sample",
}
FORBIDDEN_FUNCTIONS = ("java_method", "reflect", "try_reflect", "input_file_name", "read_files", "python_data_source")


class Refused(ValueError):
    pass


def _plans(node):
    """A plan and all plans in it: children, named subqueries, and those in expressions."""
    yield node
    for group in (node.children(), node.innerChildren()):
        it = group.iterator()
        while it.hasNext():
            child = it.next()
            if hasattr(child, "nodeName") and "plans.logical" in child.getClass().getName() or child.getClass().getSimpleName().startswith("Unresolved"):
                yield from _plans(child)


def check(spark: SparkSession, statement: str) -> None:
    """Refused unless the statement is one query."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    except Exception as e:
        raise Refused(f"not a statement: {str(e).splitlines()[0][:300]}") from e
    for node in _plans(plan):
        name = node.getClass().getSimpleName()
        if name not in QUERY_NODES:
            raise Refused(f"only queries are allowed, not {name}")
    text = plan.toString().lower()
    for f in FORBIDDEN_FUNCTIONS:
        if f"{f}(" in text or f"'{f}" in text:
            raise Refused(f"function {f} isn't allowed")


def plain(value):
    """A value as JSON has it: decimals as numbers, dates as ISO text."""
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, (dt.date, dt.datetime)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def distinct_names(columns: list[str]) -> list[str]:
    """Repeated names get _2, _3 and so on."""
    seen: dict[str, int] = {}
    out = []
    for c in columns:
        seen[c] = seen.get(c, 0) + 1
        out.append(c if seen[c] == 1 else f"{c}_{seen[c]}")
    return out


def envelope(df: DataFrame, limit: int) -> dict:
    """row_count, truncated, row_limit, rows: up to `limit` rows; truncated only if there is one more."""
    names = distinct_names(df.columns)
    rows = df.toDF(*[f"c{i}" for i in range(len(names))]).limit(limit + 1).collect()
    return {"row_count": min(len(rows), limit), "truncated": len(rows) > limit, "row_limit": limit, "rows": [dict(zip(names, map(plain, r))) for r in rows[:limit]]}


#: Types that parameters are declared with, and what makes a value one of them.
KINDS: dict[str, Callable] = {
    "string": str, "int": int, "bigint": int, "double": float, "boolean": lambda v: {"true": True, "false": False}[str(v).lower()], "decimal": lambda v: Decimal(str(v)),
    "date": lambda v: v if isinstance(v, dt.date) else dt.date.fromisoformat(v), "timestamp": lambda v: v if isinstance(v, dt.datetime) else dt.datetime.fromisoformat(v),
}


@dataclass(frozen=True)
class Query:
    """A statement with named parameters (:name) of declared types. A parameter that isn't given is null."""

    statement: str
    parameters: dict[str, str] = field(default_factory=dict)
    required: tuple[str, ...] = ()

    def bound(self, given: dict) -> dict:
        """Values for spark.sql(); Refused for a name that isn't declared, a missing one that is required, or a value of another type."""
        if unknown := sorted(set(given) - set(self.parameters)):
            raise Refused(f"unknown parameters {unknown}; there are {sorted(self.parameters)}")
        if missing := [n for n in self.required if given.get(n) is None]:
            raise Refused(f"parameters {missing} are required")
        out = {}
        for name, kind in self.parameters.items():
            value = given.get(name)
            try:
                out[name] = None if value is None else KINDS[kind](value)
            except (ValueError, TypeError, KeyError, ArithmeticError) as e:
                raise Refused(f"parameter {name}: {value!r} isn't a {kind}") from e
        return out


def bind(spark: SparkSession, query: Query, **given) -> DataFrame:
    """The query's rows; values go in as literals and never as text. Refused as in check() and bound()."""
    check(spark, query.statement)
    return spark.sql(query.statement, args=query.bound(given))


#: What users ask by name with bounds, each of which may be left out; over the marts' views.
NAMED = {
    "spend_between": Query(
        """SELECT merchant_name, count(*) AS transaction_count, sum(-amount) AS total_outflow FROM silver_transactions
        WHERE amount < 0 AND (:start IS NULL OR posted_on >= :start) AND (:end IS NULL OR posted_on <= :end) AND (:least IS NULL OR -amount >= :least)
        GROUP BY merchant_name ORDER BY total_outflow DESC, merchant_name""",
        {"start": "date", "end": "date", "least": "decimal"},
    ),
    "months_between": Query(
        "SELECT * FROM gold_monthly_flow WHERE (:start IS NULL OR month >= :start) AND (:end IS NULL OR month <= :end) ORDER BY month", {"start": "date", "end": "date"}
    ),
    "merchant_history": Query(
        "SELECT posted_on, amount, account_name FROM silver_transactions WHERE merchant_name = :merchant AND (:flow IS NULL OR flow = :flow) ORDER BY posted_on, transaction_id",
        {"merchant": "string", "flow": "string"}, ("merchant",),
    ),
}


def run_named(spark: SparkSession, name: str, p: Params = Params(), **given) -> dict:
    """run_sql() of a NAMED query with its parameters."""
    if name not in NAMED:
        return {"error": f"no query {name}; there are {sorted(NAMED)}"}
    try:
        return run_sql(spark, NAMED[name].statement, p, NAMED[name].bound(given))
    except Refused as e:
        return {"error": str(e)}


def run_sql(spark: SparkSession, statement: str, p: Params = Params(), args: dict | None = None) -> dict:
    """The envelope of a query, or {"error": ...} with the tables and columns there are if it names others. args: values of :names."""
    try:
        check(spark, statement)
    except Refused as e:
        return {"error": str(e)}
    group = uuid.uuid4().hex
    sc = spark.sparkContext
    timer = threading.Timer(p.timeout_s, lambda: sc.cancelJobGroup(group))
    by_path = spark.conf.get("spark.sql.runSQLOnFiles", "true")
    timed_out = {"error": f"stopped after {p.timeout_s:g} seconds"}
    began = dt.datetime.now()
    try:
        spark.conf.set("spark.sql.runSQLOnFiles", "false")
        sc.setJobGroup(group, "run_sql", interruptOnCancel=True)
        timer.start()
        return envelope(spark.sql(statement, args=args) if args else spark.sql(statement), p.row_limit)
    except AnalysisException as e:
        return {"error": str(e).splitlines()[0], "schema": catalog(spark)}
    except (PySparkException, Exception) as e:
        if (dt.datetime.now() - began).total_seconds() >= p.timeout_s:
            return timed_out
        return {"error": str(e).splitlines()[0][:500]}
    finally:
        timer.cancel()
        spark.conf.set("spark.sql.runSQLOnFiles", by_path)
        sc.setLocalProperty("spark.jobGroup.id", None)


def catalog(spark: SparkSession) -> dict[str, list[str]]:
    """Tables and views, and their columns."""
    return {t.name: [c.name for c in spark.catalog.listColumns(t.name)] for t in spark.catalog.listTables()}


def describe(spark: SparkSession, table: str) -> list[dict]:
    if not spark.catalog.tableExists(table):
        raise LookupError(f"{table} isn't built; there are {sorted(catalog(spark))}")
    return [{"name": c.name, "type": c.dataType, "nullable": c.nullable} for c in spark.catalog.listColumns(table)]
