"""Stability, forms, gates, rechecks and staged objectives on the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from siteward.operators import fieldwork as W
from siteward.plans.roles import CELLS, COVER, SITES, cells, sites
from siteward.plans.stage3 import cover
from siteward.plans.stage4 import _PL, plans
from siteward.sources.tables import checkpointed, table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_SHARE = "count(DISTINCT plan) AS plans, round(count(DISTINCT plan) / (SELECT count(DISTINCT plan) FROM pl), 6)::DOUBLE AS stability"


@query("plan_stability", f"WITH {SITES}, {_PL} SELECT s.site, {_SHARE} FROM sites s LEFT JOIN (SELECT plan, site FROM pl) p ON p.site = s.site GROUP BY 1")
def stability(spark, d):
    return W.plan_stability(sites(spark, d), plans(spark, d).select("plan", "site"), "site")


@query(
    "cluster_stability",
    f"WITH {SITES}, {_PL} SELECT c.cluster, {_SHARE} FROM (SELECT DISTINCT site % 7 AS cluster FROM sites) c LEFT JOIN (SELECT plan, site % 7 AS cluster FROM pl) p ON p.cluster = c.cluster GROUP BY 1",
)
def clusters(spark, d):
    cluster = (F.col("site") % 7).alias("cluster")
    return W.plan_stability(sites(spark, d).select(cluster), plans(spark, d).select("plan", cluster), "cluster")


@query("field_form", f"WITH {SITES} SELECT site, unit, 'UNKNOWN' AS parking, 'UNKNOWN' AS power, 'UNKNOWN' AS verification_date, CAST(0 AS BIGINT) AS field_verified FROM sites")
def form(spark, d):
    f = W.field_form(sites(spark, d), ["site", "unit"], ["parking", "power"], ["field_verified"])
    return f.withColumn("field_verified", F.col("field_verified").cast("long"))


@query(
    "field_results",
    f"""WITH {SITES} SELECT site, unit, CASE WHEN site % 3 = 0 THEN 'unknown' WHEN site % 4 IN (0, 3) THEN 'verified' WHEN site % 4 = 1 THEN 'not_verified' ELSE 'unknown' END AS field_status,
CASE WHEN site % 3 <> 0 AND site % 4 <> 2 THEN '2024-01-05' END AS verified_on FROM sites""",
)
def results(spark, d):
    """Notes of two thirds of the sites: words for yes and no, and words that are neither, with dates written in two ways."""
    k = F.col("site") % 4
    word = F.when(k == 0, " Yes").when(k == 1, "FAIL").when(k == 2, "later").otherwise("verified")
    s = sites(spark, d)
    notes = s.filter("site % 3 <> 0").select("site", word.alias("word"), F.when(k == 2, "soon").when(k == 0, "2024/01/05").otherwise("20240105").alias("day"))
    merged = W.merged_results(s.select("site", "unit"), notes, "site", "word", "day")
    return merged.withColumn("verified_on", F.date_format("verified_on", "yyyy-MM-dd"))


@query(
    "gated_travel",
    f"""WITH {SITES} SELECT 'confirmed' AS base, site, CAST(site * 7 % 60 AS DOUBLE) AS minutes, '{W.TRAVEL_ENABLED}' AS status FROM sites
UNION ALL SELECT 'unconfirmed', site, NULL, '{W.TRAVEL_DISABLED}' FROM sites""",
)
def travel(spark, d):
    s = sites(spark, d).select("site", F.pmod(F.col("site") * 7, F.lit(60)).alias("minutes"), F.lit(f" {W.CONFIRMED_EVIDENCE.lower()}").alias("seen"), F.lit(False).alias("guess"))
    both = [W.gated_travel(s, ok, "minutes", "seen", "guess").select(F.lit(name).alias("base"), "site", F.col("final_travel_minutes").alias("minutes"), F.col("final_travel_input_status").alias("status")) for name, ok in (("confirmed", True), ("unconfirmed", False))]
    return both[0].unionByName(both[1])


@query(
    "selection_recheck",
    f"""WITH {SITES}, {_PL}, r AS (SELECT plan, s.site, s.unit, s.region, CASE WHEN s.site % 9 = 0 THEN 1 ELSE 0 END AS k FROM (SELECT plan, site FROM pl) p JOIN sites s ON s.site = p.site),
a AS (SELECT plan, max(c) AS a FROM (SELECT plan, unit, count(*) AS c FROM r GROUP BY 1, 2) GROUP BY 1), b AS (SELECT plan, max(c) AS b FROM (SELECT plan, region, count(*) AS c FROM r GROUP BY 1, 2) GROUP BY 1),
n AS (SELECT plan, count(*) AS n, count(DISTINCT site) AS u, max(k) AS k FROM r GROUP BY 1)
SELECT n.plan, concat_ws('|', CASE WHEN n <> 10 OR u <> n THEN 'visits' END, CASE WHEN k = 1 THEN 'overlap' END, CASE WHEN a > 1 THEN 'unit' END, CASE WHEN b > 4 THEN 'region' END) AS faults FROM n JOIN a ON a.plan = n.plan JOIN b ON b.plan = n.plan""",
)
def recheck(spark, d):
    s = sites(spark, d).select("site", "unit", "region", (F.col("site") % 9 == 0).cast("int").alias("known_overlap"))
    return W.recheck(plans(spark, d), s, 10, {"unit": 1, "region": 4}, "known_overlap")


RETAINED = {"total_population": 0.95, "need_weighted": 0.9, "min_region": 0.8, "high_need": 0.9}
_METRICS = f"""{SITES}, {CELLS}, {COVER}, pc AS (SELECT DISTINCT site % 40 AS plan, cell FROM cover), po AS (SELECT region, sum(population) AS whole FROM cells GROUP BY 1),
pr AS (SELECT plan, region, sum(population) AS p FROM pc JOIN cells USING (cell) GROUP BY 1, 2), mr AS (SELECT q.plan, min(floor(coalesce(p, 0) / whole * 1000000 + 1e-9)) AS min_region FROM (SELECT DISTINCT plan FROM pc) q CROSS JOIN po LEFT JOIN pr ON pr.plan = q.plan AND pr.region = po.region GROUP BY 1),
me AS (SELECT plan, CAST(sum(population) AS BIGINT) AS total_population, sum(CAST(round(population * need * 1000) AS BIGINT)) AS need_weighted, CAST(sum(CASE WHEN need >= 0.8 THEN population ELSE 0 END) AS BIGINT) AS high_need, plan * 17 % 11 AS cost FROM pc JOIN cells USING (cell) GROUP BY 1),
pm AS (SELECT me.*, CAST(min_region AS BIGINT) AS min_region FROM me JOIN mr ON mr.plan = me.plan)"""


def _metrics(spark, d):
    """Forty plans, each of the sites of one remainder: whole-numbered metrics of what they cover."""
    c = cells(spark, d).select("cell", "region", "population", "need")
    held = checkpointed(cover(spark, d).select((F.col("site") % 40).alias("plan"), "cell").distinct().join(c, "cell"))
    p = F.col("population")
    sums = held.groupBy("plan").agg(
        F.sum(p).cast("long").alias("total_population"),
        F.sum(F.round(p * F.col("need") * 1000).cast("long")).alias("need_weighted"),
        F.sum(F.when(F.col("need") >= 0.8, p).otherwise(0.0)).cast("long").alias("high_need"),
    )
    whole = c.groupBy("region").agg(F.sum("population").alias("whole"))
    ratio = held.groupBy("plan", "region").agg(F.sum("population").alias("p")).join(F.broadcast(whole), "region")  # one row a region
    least = ratio.groupBy("plan").agg(F.count("*").alias("n"), F.min(F.floor(F.col("p") / F.col("whole") * 1_000_000 + 1e-9)).alias("least"))
    least = least.crossJoin(F.broadcast(whole.agg(F.count("*").alias("regions"))))
    least = least.select("plan", F.when(F.col("n") == F.col("regions"), F.col("least")).otherwise(0).cast("long").alias("min_region"))
    return checkpointed(sums.join(least, "plan").withColumn("cost", F.pmod(F.col("plan") * 17, F.lit(11))))


def _staged() -> str:
    steps, ends = [], []
    for name, stages in W.SCENARIOS.items():
        at = "pm"
        for k, metric in enumerate(stages):
            to = f"{name}_{k}"
            steps.append(f"{to} AS (SELECT * FROM {at} WHERE {metric} >= ceil((SELECT max({metric}) FROM {at}) * {RETAINED[metric] if name != 'equity_hard' or k else 1.0} - 1e-9))")
            at = to
        ends.append(f"(SELECT '{name}' AS scenario, plan FROM {at} ORDER BY cost, plan LIMIT 1)")
    return f"WITH {_METRICS}, {', '.join(steps)} {' UNION ALL '.join(ends)}"


@query("lexicographic_choice", _staged())
def staged(spark, d):
    m = _metrics(spark, d)
    found = []
    for name, stages in W.SCENARIOS.items():
        kept = RETAINED | ({"min_region": 1.0} if name == "equity_hard" else {})
        found.append(W.lexicographic(m, stages, kept, "cost").select(F.lit(name).alias("scenario"), "plan"))
    return reduce(lambda a, b: a.union(b), found)


@query(
    "distance_by_names",
    """WITH p AS (SELECT s_suppkey AS site, CASE WHEN s_suppkey % 11 <> 0 THEN 34.0 + (s_suppkey * 7919 % 1000) / 250.0 END AS lat, 126.0 + (s_suppkey * 104729 % 1000) / 300.0 AS lon FROM supplier)
SELECT site, round(sqrt((lat - 37.0) * (lat - 37.0) + (lon - 127.0) * (lon - 127.0)), 5) AS planar,
round(2 * 6371008.8::DOUBLE * asin(sqrt(sin(radians(37.0 - lat) / 2) * sin(radians(37.0 - lat) / 2) + cos(radians(lat)) * cos(radians(37.0)) * sin(radians(127.0 - lon) / 2) * sin(radians(127.0 - lon) / 2))), 2) AS globe FROM p""",
)
def distances(spark, d):
    k = F.col("s_suppkey")
    lat = F.when(k % 11 != 0, 34.0 + F.pmod(k * 7919, F.lit(1000)) / 250.0)
    here, there = (lat, 126.0 + F.pmod(k * 104729, F.lit(1000)) / 300.0), (F.lit(37.0), F.lit(127.0))
    known = lambda c, n: F.when(c < float("inf"), F.round(c, n))
    planar, globe = W.distance_by_names(("x", "y"), here, there), W.distance_by_names(("lat", "lon"), here, there)
    return table(spark, d, "supplier").select(k.alias("site"), known(planar, 5).alias("planar"), known(globe, 2).alias("globe"))


@query(
    "affected_shocks",
    """WITH s AS (SELECT p_brand AS feature, p_type AS item, avg(p_partkey % 97 - 48) AS shift FROM part GROUP BY 1, 2), u AS (SELECT DISTINCT p_brand AS feature, p_type AS item FROM part WHERE p_partkey % 3 = 0)
SELECT feature, count(*) AS items, round(avg(abs(shift)), 6) AS mean_shift, round(max(abs(shift)), 6) AS largest FROM s JOIN u USING (feature, item) GROUP BY 1""",
)
def shocks(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("feature"), F.col("p_type").alias("item"), F.col("p_partkey").alias("k"))
    return W.affected(p.groupBy("feature", "item").agg(F.avg(F.col("k") % 97 - 48).alias("shift")), p.filter("k % 3 = 0"))
