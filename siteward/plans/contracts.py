"""Rows handed from stage to stage through their contracts, written once and read back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siteward.operators import handoff as H
from siteward.plans import stage2
from siteward.plans.roles import CELLS, COVER, PANEL, SITES, panel
from siteward.plans.stage3 import described_cover
from siteward.sources import contracts as C

QUERIES, SQL = {}, {}
LEAD = 1.02  # a season is told if it holds that many times the next one's orders


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _released(spark, d):
    """bundle, release, confidence, recommended, fallback: one row an order priority."""
    month = F.col("month")
    season = F.when(month.between(3, 5), "spring").when(month.between(6, 8), "summer").when(month.between(9, 11), "autumn").otherwise("winter")
    by = panel(spark, d).groupBy(F.col("item").alias("bundle"), season.alias("season")).agg(F.sum("value").alias("v"))
    best = by.groupBy("bundle").agg(F.array_sort(F.collect_list(F.struct((-F.col("v")).alias("v"), "season"))).alias("s"))  # four seasons
    told = F.coalesce(-F.get("s", F.lit(0))["v"] >= -F.get("s", F.lit(1))["v"] * LEAD, F.lit(False))
    names = [F.when(told, F.get("s", F.lit(i))["season"]).alias(n) for i, n in enumerate(("recommended", "fallback"))]
    return best.select("bundle", F.when(told, "ACTIONABLE").otherwise(H.ABSTAINS).alias("release"), F.when(told, "HIGH").otherwise("LOW").alias("confidence"), *names)


def _sites(spark, d):
    rows = described_cover(spark, d).select("site", "population", F.col("su").alias("unit"), F.col("sr").alias("region"), F.col("cu").alias("_u"), F.col("cr").alias("_r"))
    part = lambda c: F.sum(F.when(c, F.col("population")).otherwise(0.0))
    unit, region = F.col("unit") == F.col("_u"), F.col("region") == F.col("_r")
    reach = rows.groupBy("site", "unit", "region").agg(F.sum("population").alias("raw"), part(unit).alias("own"), part(~unit).alias("crossing"), part(~region).alias("far"))
    order = Window.partitionBy("unit").orderBy(F.col("raw").desc(), "site")
    reach = reach.withColumn("place", F.row_number().over(order)).withColumn("spare", F.lead("site").over(order))
    return reach.crossJoin(F.broadcast(_released(spark, d)))  # one row an order priority


_ROWS = f"""WITH {SITES}, {CELLS}, {COVER}, {PANEL}, e AS (SELECT s.site, s.unit, s.region, sum(population) AS raw, sum(CASE WHEN c.unit = s.unit THEN population ELSE 0 END)::DOUBLE AS own,
  sum(CASE WHEN c.unit <> s.unit THEN population ELSE 0 END)::DOUBLE AS crossing, sum(CASE WHEN c.region <> s.region THEN population ELSE 0 END)::DOUBLE AS far FROM cover JOIN cells c USING (cell) JOIN sites s ON s.site = cover.site GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER w AS place, lead(site) OVER w AS spare FROM e WINDOW w AS (PARTITION BY unit ORDER BY raw DESC, site)),
m AS (SELECT item AS bundle, CASE WHEN month BETWEEN 3 AND 5 THEN 'spring' WHEN month BETWEEN 6 AND 8 THEN 'summer' WHEN month BETWEEN 9 AND 11 THEN 'autumn' ELSE 'winter' END AS season, sum(value) AS v FROM panel GROUP BY 1, 2),
z AS (SELECT bundle, season, lead(season) OVER w AS second, row_number() OVER w AS n, coalesce(v >= lead(v) OVER w * {LEAD}::DOUBLE, false) AS told FROM m WINDOW w AS (PARTITION BY bundle ORDER BY v DESC, season)),
t AS (SELECT bundle, CASE WHEN told THEN 'ACTIONABLE' ELSE '{H.ABSTAINS}' END AS release, CASE WHEN told THEN 'HIGH' ELSE 'LOW' END AS confidence, CASE WHEN told THEN season END AS recommended, CASE WHEN told THEN second END AS fallback FROM z WHERE n = 1),
ho AS (SELECT k.*, t.* FROM k CROSS JOIN t)"""


@query("site_handoff", f"{_ROWS} SELECT * FROM ho")
def site_handoff(spark, d):
    rows = _sites(spark, d)
    return C.handed_on(rows, H.site_contract(["ACTIONABLE"], rows.columns))


@query(
    "site_handoff_report",
    f"""{_ROWS}, v AS (SELECT count(*) AS rows, count(*) FILTER (release <> '{H.ABSTAINS}') AS a, count(*) FILTER (confidence <> 'LOW') AS b FROM ho)
SELECT 'row does not abstain' AS rule, rows, a AS violations FROM v WHERE a > 0 UNION ALL SELECT 'confidence is not low', rows, b FROM v WHERE b > 0""",
)
def report(spark, d):
    """What the rows break if the official release names no season."""
    rows = _sites(spark, d)
    return C.audited(rows, H.site_contract(["ACTIONABLE"], rows.columns, abstain=True)).filter("violations > 0")


@query(
    "gap_handoff",
    f"""WITH {stage2._COMP}, gh AS (SELECT unit, item AS bundle, need, round({stage2._ADD}, 6) AS gap FROM comp)
SELECT unit, bundle, round(need, 6) AS need, gap, row_number() OVER (PARTITION BY unit ORDER BY gap DESC, bundle) AS place FROM gh""",
)
def gap_handoff(spark, d):
    need = stage2._components(spark, d).select("unit", "item", F.round("need", 6).alias("need"))
    rows = stage2.QUERIES["service_gap"](spark, d).select("unit", "item", "gap").join(need, ["unit", "item"]).withColumnRenamed("item", "bundle")
    place = F.row_number().over(Window.partitionBy("unit").orderBy(F.col("gap").desc(), "bundle"))
    return C.handed_on(rows.withColumn("place", place), H.gap_contract())
