"""Regions of the plane as polygons, one a nation: blocks, blocks with a hole, triangles and pairs of strips."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteward.operators import polygons as G
from siteward.plans.roles import CELLS, SITES, cells, sites
from siteward.sources.tables import checkpointed, table

QUERIES, SQL = {}, {}
WIDE, HIGH = 2000, 2002


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def outlines(spark, d):
    """region, wkt of every nation, in five rows of five."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("region"))
    x, y = F.pmod("region", F.lit(5)) * WIDE, F.floor(F.col("region") / 5) * HIGH
    at = lambda a, b: F.concat_ws(" ", (x + a).cast("string"), (y + b).cast("string"))
    ring = lambda *ps: F.concat(F.lit("("), F.concat_ws(", ", *[at(*p) for p in ps]), F.lit(")"))
    block = ring((0, 0), (WIDE, 0), (WIDE, HIGH), (0, HIGH), (0, 0))
    hole = ring((500, 500), (500, 1500), (1500, 1500), (1500, 500), (500, 500))
    strips = [ring((a, 0), (a + 400, 0), (a + 400, HIGH), (a, HIGH)) for a in (0, 1600)]
    one = lambda *rs: F.concat(F.lit("POLYGON ("), F.concat_ws(", ", *rs), F.lit(")"))
    many = F.concat(F.lit("MULTIPOLYGON (("), F.concat_ws("), (", *strips), F.lit("))"))
    k = F.pmod("region", F.lit(4))
    return n.select("region", F.when(k == 0, one(block)).when(k == 1, one(block, hole)).when(k == 2, one(ring((0, 0), (WIDE, 0), (0, HIGH)))).otherwise(many).alias("wkt"))


_IN = f"""CASE n_nationkey % 4 WHEN 0 THEN true WHEN 1 THEN NOT (u > 500 AND u < 1500 AND v > 500 AND v < 1500) WHEN 2 THEN u * {HIGH} + v * {WIDE} <= {WIDE} * {HIGH} ELSE u <= 400 OR u >= 1600 END"""


def _sql(points, key):
    return f"""po AS (SELECT {key} AS k, n_nationkey, x - (n_nationkey % 5) * {WIDE} AS u, y - (n_nationkey // 5) * {HIGH} AS v FROM {points} CROSS JOIN nation),
hi AS (SELECT k, min(n_nationkey) AS region FROM po WHERE u BETWEEN 0 AND {WIDE} AND v BETWEEN 0 AND {HIGH} AND {_IN} GROUP BY 1)"""


@query("cell_regions", f"WITH {CELLS}, {_sql('cells', 'cell')} SELECT cell, hi.region FROM cells LEFT JOIN hi ON k = cell")
def regions(spark, d):
    """The polygon that each cell lies in."""
    return G.region_of(cells(spark, d), checkpointed(outlines(spark, d))).select("cell", "region")


@query("sites_in_polygons", f"WITH {SITES}, {_sql('sites', 'site')} SELECT site, unit FROM sites WHERE site IN (SELECT k FROM hi)")
def held(spark, d):
    """Sites that lie in any of the polygons."""
    s = sites(spark, d).withColumnRenamed("site", "cell")
    return G.within_any(s, checkpointed(outlines(spark, d))).select(F.col("cell").alias("site"), "unit")


@query("polygon_population", f"WITH {CELLS}, {_sql('cells', 'cell')} SELECT n_nationkey AS region, count(cell) AS cells, coalesce(sum(population), 0) AS population FROM nation LEFT JOIN hi ON region = n_nationkey LEFT JOIN cells ON cell = k GROUP BY 1")
def population(spark, d):
    """Cells and population of every polygon, empty ones too."""
    c, shapes = checkpointed(cells(spark, d)), checkpointed(outlines(spark, d))
    rows = G.region_of(c, shapes).filter("region IS NOT NULL").join(c.select("cell", "population"), "cell")
    total = rows.groupBy("region").agg(F.count("*").alias("cells"), F.sum("population").alias("population"))
    return shapes.select("region").join(total, "region", "left").fillna(0, ["cells"]).fillna(0.0, ["population"])
