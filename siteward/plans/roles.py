"""The tables' roles: each is a DataFrame and the SQL common table expression that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteward.functions.stats import rank_percentile
from siteward.sources.tables import table

RADIUS = 500.0


def pct_sql(x: str, by: str = "") -> str:
    """Average-rank percentile of x as SQL."""
    more = f", {by}" if by else ""
    total = f"PARTITION BY {by}" if by else ""
    return f"((rank() OVER (PARTITION BY {x} IS NULL{more} ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}{more}) - 1) / 2.0) / count({x}) OVER ({total}))"


def units(spark: SparkSession, d: str) -> DataFrame:
    """Customers with order features; region_spend repeats on all units of a region's nation."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("unit")).agg(
        F.count("*").alias("orders_n"), F.round(F.sum("o_totalprice"), 2).alias("spend"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("urgent_n")
    )
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("unit"), F.col("c_nationkey").alias("nation"), F.round("c_acctbal", 2).alias("balance"))
    n = F.broadcast(table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region")))
    rows = c.join(n, "nation").join(o, "unit", "left").fillna({"orders_n": 0, "spend": 0.0, "urgent_n": 0})
    by_nation = rows.groupBy("nation").agg(F.round(F.sum("spend"), 2).alias("nation_spend"))
    return rows.join(F.broadcast(by_nation), "nation").select("unit", "nation", "region", "balance", "orders_n", "spend", "urgent_n", "nation_spend")


UNITS = """o AS (SELECT o_custkey, count(*) AS orders_n, round(sum(o_totalprice), 2) AS spend, count(*) FILTER (o_orderpriority LIKE '1%') AS urgent_n FROM orders GROUP BY 1),
u0 AS (SELECT c_custkey AS unit, c_nationkey AS nation, n_regionkey AS region, round(c_acctbal, 2) AS balance, coalesce(orders_n, 0) AS orders_n, coalesce(spend, 0.0) AS spend, coalesce(urgent_n, 0) AS urgent_n
  FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN o ON o_custkey = c_custkey),
units AS (SELECT u0.*, nation_spend FROM u0 JOIN (SELECT nation, round(sum(spend), 2) AS nation_spend FROM u0 GROUP BY 1) USING (nation))"""


def supply(spark: SparkSession, d: str) -> DataFrame:
    """Lines by the supplier's nation (unit) and part type (item): n, quantity; d: all lines of the unit."""
    lines = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_quantity")
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("item"))
    supp = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("unit"))
    rows = lines.join(supp, "l_suppkey").join(parts, "l_partkey")
    return rows.groupBy("unit", "item").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


SUPPLY = """supply AS (SELECT s_nationkey AS unit, p_type AS item, count(*) AS n, round(sum(l_quantity), 2) AS quantity
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
GRID = """grid AS (SELECT a.unit, b.item, coalesce(s.n, 0) AS n FROM (SELECT DISTINCT unit FROM supply) a CROSS JOIN (SELECT DISTINCT item FROM supply) b LEFT JOIN supply s ON s.unit = a.unit AND s.item = b.item)"""


def panel(spark: SparkSession, d: str, first: int = 1996, last: int = 2000) -> DataFrame:
    """Orders by region, item (priority), year, month in whole years."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    n = F.broadcast(table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("region")))
    o = table(spark, d, "orders").select("o_custkey", "o_orderdate", F.col("o_orderpriority").alias("item"))
    o = o.filter((F.col("o_orderdate") >= F.lit(f"{first}-01-01").cast("timestamp")) & (F.col("o_orderdate") < F.lit(f"{last + 1}-01-01").cast("timestamp")))
    rows = o.join(c, "o_custkey").join(n, "c_nationkey")
    return rows.groupBy("region", "item", F.year("o_orderdate").cast("long").alias("year"), F.month("o_orderdate").cast("long").alias("month")).agg(F.count("*").cast("double").alias("value"))


PANEL = """panel AS (SELECT n_regionkey AS region, o_orderpriority AS item, CAST(year(o_orderdate) AS BIGINT) AS year, CAST(month(o_orderdate) AS BIGINT) AS month, CAST(count(*) AS DOUBLE) AS value
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '2001-01-01' GROUP BY 1, 2, 3, 4)"""


def sites(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as sites in a plane of 10,000 by about 10,000."""
    n = F.broadcast(table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("region")))
    s = table(spark, d, "supplier").join(n, "s_nationkey")
    return s.select(
        F.col("s_suppkey").alias("site"), F.pmod(F.col("s_suppkey") * 7919, F.lit(10000)).cast("double").alias("x"), F.pmod(F.col("s_suppkey") * 104729, F.lit(10007)).cast("double").alias("y"),
        F.col("s_nationkey").alias("unit"), "region", F.round("s_acctbal", 2).alias("score"),
    )


SITES = """sites AS (SELECT s_suppkey AS site, CAST((s_suppkey * 7919) % 10000 AS DOUBLE) AS x, CAST((s_suppkey * 104729) % 10007 AS DOUBLE) AS y, s_nationkey AS unit, n_regionkey AS region, round(s_acctbal, 2) AS score
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def people(spark: SparkSession, d: str) -> DataFrame:
    """Customers as population points, without the ranks of ``cells``."""
    n = F.broadcast(table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("region")))
    return _points(table(spark, d, "customer").join(n, "c_nationkey"))


def _points(c: DataFrame, *more) -> DataFrame:
    return c.select(
        F.col("c_custkey").alias("cell"), F.pmod(F.col("c_custkey") * 6151, F.lit(10000)).cast("double").alias("x"), F.pmod(F.col("c_custkey") * 3079, F.lit(10007)).cast("double").alias("y"),
        (F.pmod(F.col("c_custkey"), F.lit(97)) + 1).cast("double").alias("population"), *more, F.col("c_nationkey").alias("unit"), "region",
    )


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Customers as population points; need is the rank percentile of a low balance."""
    n = F.broadcast(table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("region")))
    c = table(spark, d, "customer").join(n, "c_nationkey").withColumn("_b", -F.round("c_acctbal", 2))
    return _points(rank_percentile(c, "_b", "_p"), F.round("_p", 6).alias("need"))


CELLS = f"""c0 AS (SELECT *, -round(c_acctbal, 2) AS b FROM customer JOIN nation ON c_nationkey = n_nationkey),
cells AS (SELECT c_custkey AS cell, CAST((c_custkey * 6151) % 10000 AS DOUBLE) AS x, CAST((c_custkey * 3079) % 10007 AS DOUBLE) AS y, CAST(c_custkey % 97 + 1 AS DOUBLE) AS population,
  round({pct_sql("b")}, 6) AS need, c_nationkey AS unit, n_regionkey AS region FROM c0)"""
COVER = f"""cover AS (SELECT site, cell, sqrt((s.x - c.x) * (s.x - c.x) + (s.y - c.y) * (s.y - c.y)) AS distance, 1.0 AS weight FROM sites s JOIN cells c
  ON sqrt((s.x - c.x) * (s.x - c.x) + (s.y - c.y) * (s.y - c.y)) <= {RADIUS} + 1e-9)"""
