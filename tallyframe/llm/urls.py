"""URL filters: dated list entries as validity intervals, joined with captures as of their fetch time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: scheme://user@host:port/path; group 1 is the host, group 2 the first path segment.
URL = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?/?([^/?#]*)"


def host_of(url: Column) -> Column:
    """Lower-cased host without user, port and final dot; null for anything that isn't scheme://host."""
    return F.nullif(F.rtrim(F.lower(F.regexp_extract(url, URL, 1)), F.lit(".")), F.lit(""))


def keys_of(url: Column) -> Column:
    """What entries can name of a URL: its host, each domain it is in (with a dot before), host/first path segment."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("."), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    part = F.nullif(F.regexp_extract(url, URL, 2), F.lit(""))
    prefix = F.when(part.isNotNull(), F.array(F.concat(host, F.lit("/"), part))).otherwise(F.array().cast("array<string>"))
    return F.when(host.isNotNull(), F.concat(F.array(host), domains, prefix))


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, valid_from, valid_to (null: still listed) of dated entries (pattern, action add or remove, dated).

    An entry holds until the next one for its pattern. Of entries of one pattern and date, a removal wins. Repeated additions
    continue one another. Entries without pattern, date or a known action are left out.
    """
    known = entries.filter("pattern IS NOT NULL AND dated IS NOT NULL AND action IN ('add', 'remove')")
    days = known.groupBy("pattern", "dated").agg(F.max("action").alias("action"))
    until = F.lead("dated").over(Window.partitionBy("pattern").orderBy("dated"))
    return days.select("pattern", "action", F.col("dated").alias("valid_from"), until.alias("valid_to")).filter("action = 'add'").drop("action")


def listed(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (id, url, fetched) with host, listed, n_entries and pattern (the least) of entries active at fetch time.

    One row per distinct (id, url, fetched). A URL without a host, or null, and a capture without a fetch time are on no list. The
    join is on the pattern with the interval as its condition: a pattern has at most one interval at a time, and a host with a
    large share of all captures is split at run time.
    """
    rows = captures.select("id", "url", "fetched", F.explode_outer(keys_of(F.col("url"))).alias("key"))
    valid = intervals(entries)
    active = (F.col("key") == F.col("pattern")) & (F.col("fetched") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to")))
    found = rows.join(valid, active, "left").groupBy("id", "url", "fetched").agg(F.count_distinct("pattern").alias("n_entries"), F.min("pattern").alias("pattern"))
    return found.select("id", "url", "fetched", host_of(F.col("url")).alias("host"), (F.col("n_entries") > 0).alias("listed"), "n_entries", "pattern")


def _number(x: Column) -> Column:
    return F.conv(F.substring(F.md5(x), 1, 6), 16, 10).cast("long")


def derived_entries(pages: DataFrame) -> DataFrame:
    """A dated list for tables that have none: a quarter of all hosts by MD5, added on a day of 2024, half of them removed later and
    a third of those added again; and a domain that is listed all the time."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).filter("host IS NOT NULL").distinct()
    x = hosts.withColumn("h", _number(F.col("host"))).filter("h % 4 = 0").withColumn("h", F.expr("h div 4"))
    day = F.lit("2024-01-01").cast("date")
    at = lambda days: F.date_add(day, days.cast("int"))
    add = x.select(F.col("host").alias("pattern"), F.lit("add").alias("action"), at(F.col("h") % 200).alias("dated"))
    remove = x.filter("h % 2 = 0").select("host", F.lit("remove"), at(F.col("h") % 200 + 30))
    again = x.filter("h % 6 = 0").select("host", F.lit("add"), at(F.col("h") % 200 + 90))
    always = pages.sparkSession.createDataFrame([(".cheap-pills.example.com", "add")], "pattern string, action string").withColumn("dated", day)
    return add.union(remove).union(again).union(always)


def derived_captures(pages: DataFrame) -> DataFrame:
    """id, url, fetched: a fetch day of 2024 by page_id, for tables that have none."""
    days = F.pmod(F.col("page_id") * 7919, F.lit(366)).cast("int")
    return pages.select(F.col("page_id").alias("id"), "url", F.date_add(F.lit("2024-01-01").cast("date"), days).alias("fetched"))
