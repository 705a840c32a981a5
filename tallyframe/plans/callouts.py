"""What is worth a look: anomalies, trends, budgets at risk; in one ranked feed."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.core import first_per, mad_anomalies
from tallyframe.params import Params

LEVELS = ("CRITICAL", "WARNING", "INFO")
#: Months in each period; a week is its share of an average month.
PERIOD_MONTHS = {"weekly": 7 / (365.25 / 12), "monthly": 1, "quarterly": 3, "yearly": 12}
_COLUMNS = ("kind", "level", "series_kind", "series_key", "label", "rank", "amount", "expected", "on")


def next_forecasts(forecasts: DataFrame, today: dt.date) -> DataFrame:
    """Each series' forecast for this month or the first after it."""
    ahead = forecasts.filter(F.col("period_start") >= F.lit(today.replace(day=1)))
    return first_per(ahead, ["series_kind", "series_key"], [F.col("period_start")])


def anomalies(history: DataFrame, p: Params = Params()) -> DataFrame:
    """Months far from a series' median; for spending, high ones are warnings."""
    series = history.select("series_kind", "series_key", "series_label", "month", (F.col("committed") + F.col("variable")).alias("spent"))
    found = mad_anomalies(series, ["series_kind", "series_key", "series_label"], "month", "spent", p.anomaly_z, p.anomaly_amount, p.anomaly_months, p.min_history)
    spending = ~((F.col("series_kind") == "total") & (F.col("series_key") == "inflow"))
    high = F.col("z") > 0
    return found.select(
        F.when(high, "SPIKE").otherwise("DIP").alias("kind"), F.when(high == spending, "WARNING").otherwise("INFO").alias("level"), "series_kind", "series_key",
        F.col("series_label").alias("label"), F.abs("z").alias("rank"), F.col("spent").cast("double").alias("amount"), F.col("center").cast("double").alias("expected"), F.col("month").alias("on"),
    )


def trends(forecasts: DataFrame, history: DataFrame, today: dt.date) -> DataFrame:
    """Series that rise or fall: the next forecast against the mean of history."""
    mean = history.groupBy("series_kind", "series_key").agg(F.avg(F.col("committed") + F.col("variable")).alias("mean"))
    rows = next_forecasts(forecasts, today).filter("trend <> 'flat'").join(mean, ["series_kind", "series_key"]).filter("mean > 0")
    change = (F.col("predicted").cast("double") - F.col("mean")) / F.col("mean")
    return rows.select(
        F.concat(F.lit("TREND_"), F.upper("trend")).alias("kind"), F.lit("INFO").alias("level"), "series_kind", "series_key", F.col("series_label").alias("label"),
        F.abs(change).alias("rank"), F.col("predicted").cast("double").alias("amount"), F.col("mean").alias("expected"), F.col("period_start").alias("on"),
    )


def budget_risks(forecasts: DataFrame, budgets: DataFrame, today: dt.date) -> DataFrame:
    """Budgets whose next forecast is over their month's share; critical if the interval's low end is as well."""
    months = F.lit(None).cast("double")
    for period, n in PERIOD_MONTHS.items():
        months = F.when(F.col("period") == period, F.lit(float(n))).otherwise(months)
    caps = budgets.select(F.col("id").alias("series_key"), (F.col("amount").cast("double") / months).alias("cap"))
    rows = next_forecasts(forecasts, today).filter("series_kind = 'budget'").join(caps, "series_key").filter(F.col("predicted") > F.col("cap"))
    return rows.select(
        F.lit("BUDGET_RISK").alias("kind"), F.when(F.col("lower") > F.col("cap"), "CRITICAL").otherwise("WARNING").alias("level"), "series_kind", "series_key",
        F.col("series_label").alias("label"), ((F.col("predicted") - F.col("cap")) / F.col("cap")).alias("rank"), F.col("predicted").cast("double").alias("amount"),
        F.col("cap").alias("expected"), F.col("period_start").alias("on"),
    )


def callouts(history: DataFrame, forecasts: DataFrame, budgets: DataFrame, today: dt.date, limit: int | None = None, p: Params = Params()) -> DataFrame:
    """The feed: by level, then rank, then label; the limit comes after the ranking."""
    rows = anomalies(history, p).unionByName(trends(forecasts, history, today)).unionByName(budget_risks(forecasts, budgets, today)).select(*_COLUMNS)
    place = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level"))
    ordered = rows.orderBy(place, F.col("rank").desc(), "label", "on")
    return ordered if limit is None else ordered.limit(limit)
