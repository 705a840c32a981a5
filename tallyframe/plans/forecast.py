"""Committed and variable forecasts: one task a series, models chosen by rolling-origin error, conformal intervals."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Sequence
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.core import first_per, month_spine, small
from tallyframe.params import Params

#: Fewest months for each model, the cheapest first: of equal errors the earlier one is taken.
NAIVE, MEAN3, THETA, ETS = ("naive", 1), ("mean3", 2), ("theta", 5), ("ets", 8)
STEP_MONTHS = {"monthly": 1, "quarterly": 3, "yearly": 12}
FOLDS, LEAST_TRAIN = 6, 3


def _smoothed(y: np.ndarray, alpha: float) -> tuple[float, float]:
    """Level after simple exponential smoothing, and the one-step squared error."""
    level, error = y[0], 0.0
    for v in y[1:]:
        error += (v - level) ** 2
        level += alpha * (v - level)
    return level, error


def naive(y, h):
    return np.full(h, y[-1])


def mean3(y, h):
    return np.full(h, np.mean(y[-3:]))


def theta(y, h):
    """Smoothing of the series plus half its linear drift."""
    alpha = min(np.linspace(0.02, 0.98, 49), key=lambda a: _smoothed(y, a)[1])
    level, n = _smoothed(y, alpha)[0], len(y)
    slope = np.polyfit(np.arange(n), y, 1)[0]
    steps = np.arange(h) + (1 - (1 - alpha) ** n) / alpha
    return level + slope / 2 * steps


def ets(y, h):
    """Additive error and trend, no season; smoothing by a grid over squared one-step errors."""
    best = None
    for alpha in np.linspace(0.05, 0.95, 10):
        for beta in np.linspace(0.02, alpha, 6):
            level, trend, error = y[0], y[1] - y[0], 0.0
            for v in y[1:]:
                e = v - level - trend
                error += e * e
                level, trend = level + trend + alpha * e, trend + beta * e
            if best is None or error < best[0]:
                best = error, level, trend
    return best[1] + best[2] * np.arange(1, h + 1)


MODELS = [(*NAIVE, naive), (*MEAN3, mean3), (*THETA, theta), (*ETS, ets)]


def scale_of(y: np.ndarray) -> float:
    return float(np.mean(np.abs(np.diff(y)))) if len(y) > 1 else 0.0


def choose(y: np.ndarray, h: int, models=MODELS):
    """(name, points, mase, sorted absolute errors) of the model with the least backtest error; a flat mean if none has any."""
    best = None
    scale = scale_of(y)
    for name, least, model in models:
        if len(y) < least:
            continue
        points = model(y, h)
        if not np.isfinite(points).all():
            continue
        origins = range(max(LEAST_TRAIN, len(y) - FOLDS), len(y))
        errors = [abs(y[i] - model(y[:i], 1)[0]) for i in origins if i >= least]
        if not errors or not np.isfinite(errors).all():
            continue
        mase = float(np.mean(errors)) / scale if scale > 0 else float(np.mean(errors))
        if best is None or mase < best[2]:
            best = name, points, mase, sorted(errors)
    return best or ("mean", np.full(h, float(np.mean(y)) if len(y) else 0.0), None, [])


def half_width(errors: list[float], scale: float, h: int, level: int, floor: float) -> float:
    """Nearest-rank quantile of the errors, not under a share of the scale, growing with the root of the horizon."""
    if not errors:
        return 0.0
    q = errors[min(len(errors) - 1, math.ceil(level / 100 * len(errors)) - 1)]
    return max(q, floor * scale) * math.sqrt(h)


def trend_of(y: np.ndarray, share: float) -> str:
    """rising or falling if a year of the median pairwise slope is more than that share of the mean; else flat."""
    n = len(y)
    mean = float(np.mean(y)) if n else 0.0
    if n < 3 or mean == 0:
        return "flat"
    i, j = np.triu_indices(n, 1)
    year = 12 * float(np.median((y[j] - y[i]) / (j - i)))
    return "rising" if year > share * abs(mean) else "falling" if year < -share * abs(mean) else "flat"


def add_months(day: dt.date, months: int) -> dt.date:
    """The same day some months on, or the month's last."""
    y, m = divmod(day.year * 12 + day.month - 1 + months, 12)
    last = (dt.date(y + (m == 11), (m + 1) % 12 + 1, 1) - dt.timedelta(1)).day
    return dt.date(y, m + 1, min(day.day, last))


def project(flows: list[dict], first: dt.date, horizon: int) -> list[float]:
    """What recurring flows charge in each of `horizon` months from `first`; each date follows from the one before it.

    A flow last seen more than two gaps before `first` has lapsed. A date that falls on a month's missing day stays on the earlier
    one: January 31st, February 28th, March 28th.
    """
    out = [0.0] * horizon
    end = add_months(first, horizon)
    for f in flows:
        gap = max(1.0, float(f["avg_gap_days"] or 0))
        if (first - f["last_seen_on"]).days > 2 * gap:
            continue
        day = f["last_seen_on"]
        while True:
            step = STEP_MONTHS.get(f["cadence"])
            day = add_months(day, step) if step else day + dt.timedelta(days=gap)
            if day >= end:
                break
            if day >= first:
                out[(day.year - first.year) * 12 + day.month - first.month] += float(f["amount"])
    return out


def to_cents(x: float) -> Decimal:
    return Decimal(str(x)).quantize(Decimal("0.01"), ROUND_HALF_UP)


def projected(flows: DataFrame, by: Sequence[str], first: dt.date, horizon: int) -> DataFrame:
    """`by`, month, amount: what project() says, for any number of flows as rows (cadence, amount, avg_gap_days, last_seen_on).

    A flow's dates are a fold over its steps, each from the date before it; it takes few, since a flow that has lapsed has none and
    the last one is within the horizon. Sums by month are all that is grouped.
    """
    end = add_months(first, horizon)
    gap = F.greatest(F.lit(1.0), F.coalesce(F.col("avg_gap_days").cast("double"), F.lit(0.0)))
    months = F.lit(None).cast("int")
    for cadence, n in STEP_MONTHS.items():
        months = F.when(F.col("cadence") == cadence, n).otherwise(months)
    rows = flows.select(*by, F.col("amount").cast("double").alias("amount"), "last_seen_on", months.alias("_months"), F.floor(gap).cast("int").alias("_days"), gap.alias("_gap"))
    rows = rows.filter(F.datediff(F.lit(first), F.col("last_seen_on")) <= 2 * F.col("_gap"))
    # As many steps as the shortest month or the gap's whole days could need.
    steps = F.greatest(F.lit(0), F.floor(F.datediff(F.lit(end), F.col("last_seen_on")) / F.when(F.col("_months").isNotNull(), 28 * F.col("_months")).otherwise(F.col("_days"))).cast("int")) + 1
    after = lambda day: F.when(F.col("_months").isNotNull(), F.add_months(day, F.col("_months"))).otherwise(F.date_add(day, F.col("_days")))
    dates = F.aggregate(F.sequence(F.lit(1), steps), F.array("last_seen_on"), lambda days, _: F.concat(days, F.array(after(F.element_at(days, -1)))))
    due = rows.select(*by, "amount", F.explode(F.slice(dates, 2, steps)).alias("day")).filter((F.col("day") >= F.lit(first)) & (F.col("day") < F.lit(end)))
    return due.groupBy(*by, F.trunc("day", "month").alias("month")).agg(F.sum("amount").alias("amount"))


def forecast_series(committed: np.ndarray, variable: np.ndarray, fixed: Sequence[float], trained_through: dt.date, p: Params, models=MODELS) -> list[dict]:
    """A row for each month of the horizon; none for less history than p.min_history months. fixed: what each will be charged."""
    if len(variable) < p.min_history:
        return []
    name, points, mase, errors = choose(variable, p.horizon, models)
    scale, trend = scale_of(variable), trend_of(committed + variable, p.trend_share)
    rows = []
    for h in range(1, p.horizon + 1):
        c, v = to_cents(max(0.0, fixed[h - 1])), to_cents(max(0.0, float(points[h - 1])))
        w = to_cents(half_width(errors, scale, h, p.interval_level, p.interval_floor))
        rows.append({
            "period_start": add_months(trained_through, h), "horizon": h, "committed": c, "variable": v, "predicted": c + v, "lower": max(Decimal(0), c + v - w),
            "upper": c + v + w, "interval_level": p.interval_level, "model_name": name, "mase": mase, "trend": trend, "trained_through": trained_through,
        })
    return rows


ROWS = (
    "series_kind string, series_key string, series_label string, category_id string, period_start date, horizon int, committed decimal(18,2), variable decimal(18,2), "
    "predicted decimal(18,2), lower decimal(18,2), upper decimal(18,2), interval_level int, model_name string, mase double, trend string, trained_through date"
)


def forecast(history: DataFrame, p: Params = Params(), models=MODELS) -> DataFrame:
    """ROWS of history(): months in order, one group a series, which has p.history_months rows at most."""
    if not 1 <= p.horizon <= p.max_horizon:
        raise ValueError(f"horizon {p.horizon}")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("month")
        head = pdf.iloc[0]
        due = [0.0] * p.max_horizon if head["due"] is None else list(head["due"])
        rows = forecast_series(pdf["committed"].to_numpy(float), pdf["variable"].to_numpy(float), due, pdf["month"].iloc[-1], p, models)
        keys = {k: head[k] for k in ("series_kind", "series_key", "series_label", "category_id")}
        return pd.DataFrame([keys | r for r in rows], columns=[c.split()[0] for c in ROWS.replace("(18,2)", "").split(", ")])

    return history.groupBy("series_kind", "series_key").applyInPandas(run, ROWS)


def committed_and_variable(tx: DataFrame, recurring: DataFrame) -> DataFrame:
    """tx with committed: whether the merchant, flow and amount are a recurring flow's."""
    key = recurring.select("merchant_name", "flow", F.col("amount").alias("_a")).withColumn("committed", F.lit(True))
    on = (tx["merchant_name"] == key["merchant_name"]) & (tx["flow"] == key["flow"]) & (F.abs(tx["amount"]) == F.col("_a"))
    return tx.join(key, on, "left").select(tx["*"], F.coalesce("committed", F.lit(False)).alias("committed"))


def history(tx: DataFrame, recurring: DataFrame, items: DataFrame, budgets: DataFrame, ancestors: DataFrame, today: dt.date, p: Params = Params()) -> DataFrame:
    """series_kind (total, budget), series_key, label, category, month, committed, variable, due: dense over whole months.

    due: what the series' recurring flows will charge in each of p.max_horizon months after these.

    Totals of outflow and inflow are over transactions that aren't transfers, budgets' over spending line items of their subtree. A
    recurring flow belongs to the category that most of its line items have. History begins with the ledger, or p.history_months
    before the end of the last whole month.
    """
    spark = tx.sparkSession
    flows_tx = tx.filter("NOT is_transfer")
    last = add_months(today.replace(day=1), -1)
    begun = flows_tx.agg(F.min("posted_on")).first()[0]
    if begun is None or begun.replace(day=1) > last:
        return spark.createDataFrame([], "series_kind string, series_key string, series_label string, category_id string, month date, committed double, variable double, due array<double>")
    first = max(begun.replace(day=1), add_months(last, 1 - p.history_months))
    spine = month_spine(spark, first, last)
    marked = committed_and_variable(flows_tx, recurring)
    sums = [F.sum(F.when(c, F.abs("amount")).otherwise(0)).cast("double").alias(n) for n, c in (("committed", F.col("committed")), ("variable", ~F.col("committed")))]
    month = F.trunc("posted_on", "month").alias("month")
    totals = marked.groupBy(F.col("flow").alias("series_key"), month).agg(*sums)
    keys = spark.createDataFrame([("total", "outflow", "outflow", None), ("total", "inflow", "inflow", None)], "series_kind string, series_key string, series_label string, category_id string")

    def due(flows):
        """series_key, due: an element a month, of which there are p.max_horizon."""
        ahead = add_months(last, 1)
        sums = projected(flows, ["series_key"], ahead, p.max_horizon)
        month = F.months_between("month", F.lit(ahead)).cast("int")
        each = [F.coalesce(F.sum(F.when(month == h, F.col("amount"))), F.lit(0.0)) for h in range(p.max_horizon)]
        return sums.groupBy("series_key").agg(F.array(*each).alias("due"))

    of_total = due(recurring.withColumn("series_key", F.col("flow")))
    scope = small(budgets.join(ancestors, budgets["category_id"] == ancestors["ancestor_id"]).select(budgets["id"].alias("series_key"), ancestors["category_id"].alias("category_id")))
    spent = items.filter("amount < 0").join(marked.select("transaction_id", "merchant_name", "flow", F.col("amount").alias("_whole"), "committed"), "transaction_id").join(scope, "category_id")
    of_budget = spent.groupBy("series_key", month).agg(*sums)
    votes = items.filter("category_id IS NOT NULL").select("transaction_id", "category_id").join(
        marked.filter("committed").select("transaction_id", "merchant_name", "flow", F.abs("amount").alias("amount")), "transaction_id"
    )
    votes = votes.groupBy("merchant_name", "flow", "amount", "category_id").agg(F.count(F.lit(1)).alias("n"))
    modal = first_per(votes, ["merchant_name", "flow", "amount"], [F.col("n").desc(), F.col("category_id")])
    placed = recurring.filter("flow = 'outflow'").join(modal.select("merchant_name", "flow", "amount", "category_id"), ["merchant_name", "flow", "amount"]).join(scope, "category_id")
    of_budget_flows = due(placed)
    budget_keys = budgets.select(F.lit("budget").alias("series_kind"), F.col("id").alias("series_key"), F.col("name").alias("series_label"), "category_id")

    def dense(keys, facts, own):
        zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
        grid = keys.join(F.broadcast(spine), F.lit(True)).join(facts, ["series_key", "month"], "left").join(own, "series_key", "left")
        return grid.select("series_kind", "series_key", "series_label", "category_id", "month", zero("committed"), zero("variable"), "due")

    return dense(keys, totals, of_total).unionByName(dense(budget_keys, of_budget, of_budget_flows))
