"""Exact sums and interval bounds of the driver's orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteward.functions import exact as E
from siteward.sources.tables import table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def lines(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("site"), F.col("l_extendedprice").alias("price"), "l_discount")


@query("exact_sums", "SELECT l_suppkey AS site, round(fsum(l_extendedprice / 3), 4) AS total, CAST(1 AS BIGINT) AS bounded FROM lineitem GROUP BY 1")
def sums(spark, d):
    """Thirds of prices by site, added exactly; the bounds are at most one step apart on each side."""
    out = E.exact_sums(lines(spark, d), F.col("price") / 3, ["site"])
    return out.select("site", F.round("value", 4).alias("total"), F.col("value").between(F.col("low"), F.col("high")).cast("long").alias("bounded"))


@query("interval_bounds", "SELECT l_suppkey AS site, round(fsum((0.05 - l_discount) * (l_extendedprice - CASE WHEN l_discount <= 0.05 THEN 1 ELSE -1 END)), 4) AS least, round(fsum((0.05 - l_discount) * (l_extendedprice + CASE WHEN l_discount <= 0.05 THEN 1 ELSE -1 END)), 4) AS most FROM lineitem GROUP BY 1")
def bounds(spark, d):
    """Least and most of a weighted sum of prices that are known to one unit."""
    rows = lines(spark, d).select("site", (0.05 - F.col("l_discount")).alias("f"), (F.col("price") - 1).alias("a"), (F.col("price") + 1).alias("b"))
    return E.box_extrema(rows, "f", "a", "b", ["site"]).select("site", F.round("least", 4).alias("least"), F.round("most", 4).alias("most"))
