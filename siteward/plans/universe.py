"""Candidate universes, bounds, ablation and evidence on the driver's tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from siteward.operators import spatial as X
from siteward.operators import universe as U
from siteward.plans import stage2
from siteward.plans.roles import CELLS, COVER, PANEL, RADIUS, SITES, SUPPLY, cells, panel, people, sites, supply
from siteward.plans.stage3 import cover, discs
from siteward.plans.stage4 import _PL, plans
from siteward.sources.tables import table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_B = f"WITH {SITES}, {CELLS}, {COVER}"
_K = "row_number() OVER (PARTITION BY unit ORDER BY score DESC, site)"


@query(
    "candidate_sets",
    f"""WITH {SITES}, k AS (SELECT site, {_K} AS k, row_number() OVER (PARTITION BY unit, site % 7 ORDER BY score DESC, site) AS c FROM sites)
SELECT 'top3' AS universe, site FROM k WHERE k <= 3 UNION ALL SELECT 'top5', site FROM k WHERE k <= 5 UNION ALL SELECT 'representatives', site FROM k WHERE c = 1""",
)
def sets(spark, d):
    return U.candidate_sets(sites(spark, d).withColumn("cluster", F.col("site") % 7), {"top3": 3, "top5": 5})


_BOUND = f"""{_B}, p AS (SELECT site, cell, population FROM cover JOIN cells USING (cell)), f AS (SELECT site, sum(population) AS own FROM p GROUP BY 1), o AS (SELECT a.site, b.site AS other, sum(a.population) AS s FROM p a JOIN p b ON a.cell = b.cell AND a.site <> b.site GROUP BY 1, 2),
m AS (SELECT a.site, a.own, b.own - coalesce(s, 0) AS g, row_number() OVER (PARTITION BY a.site ORDER BY b.own - coalesce(s, 0) DESC) AS k FROM f a LEFT JOIN f b ON a.site <> b.site LEFT JOIN o ON o.site = a.site AND o.other = b.site),
ub AS (SELECT site, round(max(own), 4) AS own, round(max(own) + coalesce(sum(g) FILTER (k <= 3), 0), 4) AS upper FROM m GROUP BY 1)"""


@query("forced_bounds", f"{_BOUND} SELECT * FROM ub")
def bounds(spark, d):
    return U.forced_bounds(discs(spark, d), people(spark, d), 4)


@query("zero_fixings", f"{_BOUND} SELECT * FROM ub WHERE upper < 6000.0 - 2e-8 * 6000.0")
def fixings(spark, d):
    return U.zero_fixings(bounds(spark, d), 6000.0)


@query(
    "anchored_cuts",
    f"""{_B}, {_PL}, h AS (SELECT DISTINCT plan, cell FROM pl JOIN cover USING (site)), p AS (SELECT site, cell, population FROM cover JOIN cells USING (cell))
SELECT a.plan AS anchor, p.site, round(sum(population), 4) AS gain FROM p CROSS JOIN (SELECT DISTINCT plan FROM pl) a WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.plan = a.plan AND h.cell = p.cell) AND NOT EXISTS (SELECT 1 FROM pl WHERE pl.plan = a.plan AND pl.site = p.site) GROUP BY 1, 2""",
)
def cuts(spark, d):
    return U.anchored_cuts(partial(X.range_join, radius=RADIUS), cells(spark, d), plans(spark, d), sites(spark, d))


@query(
    "component_ablation",
    f"""WITH {stage2._COMP} SELECT 'baseline' AS run, unit, item, round(0.7 * need + 0.3 * extra, 6) AS score FROM comp UNION ALL SELECT 'neutral_need', unit, item, round(0.7 * 50 + 0.3 * extra, 6) FROM comp UNION ALL SELECT 'neutral_extra', unit, item, round(0.7 * need + 0.3 * 50, 6) FROM comp
UNION ALL SELECT 'renormalize_need', unit, item, round(extra, 6) FROM comp UNION ALL SELECT 'renormalize_extra', unit, item, round(need, 6) FROM comp""",
)
def ablation(spark, d):
    return U.component_ablation(stage2._components(spark, d), stage2.W, ["unit", "item"])


@query(
    "prior_grid",
    f"""WITH {SUPPLY}, t AS (SELECT unit, item, n, sum(n) OVER (PARTITION BY unit) AS d FROM supply), m AS (SELECT *, sum(n) OVER (PARTITION BY item) / sum(d) OVER (PARTITION BY item) AS mu FROM t)
SELECT s.s AS strength, unit, item, round((n + s.s * mu) / (d + s.s), 6) AS share FROM m CROSS JOIN (VALUES (5.0::DOUBLE), (20.0::DOUBLE), (80.0::DOUBLE)) s(s)""",
)
def priors(spark, d):
    s = supply(spark, d)
    total = s.groupBy("unit").agg(F.sum("n").alias("d"))
    return U.prior_grid(s.join(total, "unit").select("unit", "item", "n", "d"), "n", "d", [5, 20, 80], ["unit", "item"])


@query("dominant_bundle", f"WITH {SUPPLY} SELECT unit, item, round(n / sum(n) OVER (PARTITION BY unit), 6) AS share FROM supply QUALIFY row_number() OVER (PARTITION BY unit ORDER BY n DESC, item) = 1")
def dominant(spark, d):
    return U.dominant_bundle(supply(spark, d).select("unit", "item", "n"), "unit", "item", "n")


@query("population_split", f"{_B} SELECT site, round(sum(CASE WHEN cell % 3 = 0 THEN population ELSE 0 END), 4)::DOUBLE AS inside, round(sum(CASE WHEN cell % 3 <> 0 THEN population ELSE 0 END), 4)::DOUBLE AS outside FROM cover JOIN cells USING (cell) GROUP BY 1")
def split(spark, d):
    c = cells(spark, d).withColumn("rural", (F.col("cell") % 3 == 0).cast("int"))
    return U.population_split(X.range_join(sites(spark, d), c, RADIUS, (), (), ("population", "rural")), c, "rural")


@query("region_targets", f"WITH {CELLS}, r AS (SELECT region, round(sum(CASE WHEN cell % 3 = 0 THEN population ELSE 0 END) / sum(population), 6) AS ratio FROM cells GROUP BY 1) SELECT region, ceil(floor(ratio * 1000000 + 1e-9) * 0.95 - 1e-12) / 1000000 AS floor FROM r")
def targets(spark, d):
    r = cells(spark, d).groupBy("region").agg(F.round(F.sum(F.when(F.col("cell") % 3 == 0, F.col("population")).otherwise(0.0)) / F.sum("population"), 6).alias("ratio"))
    return U.region_targets(r, 0.95)


@query(
    "operational_blockers",
    f"""WITH {SITES}, s AS (SELECT site, region, site % 4 AS skill, site % 5 AS day FROM sites), t AS (SELECT n_regionkey AS region, n_nationkey % 4 AS skill FROM nation WHERE n_nationkey % 3 = 0), v AS (SELECT DISTINCT n_regionkey AS region FROM nation WHERE n_nationkey % 7 = 0), w AS (SELECT DISTINCT n_nationkey % 4 AS day FROM nation)
SELECT site, CASE WHEN NOT EXISTS (SELECT 1 FROM t WHERE t.region = s.region AND t.skill = s.skill) THEN 'no_team' WHEN NOT EXISTS (SELECT 1 FROM v WHERE v.region = s.region) THEN 'no_vehicle' WHEN NOT EXISTS (SELECT 1 FROM w WHERE w.day = s.day) THEN 'no_date' ELSE 'none' END AS blocker FROM s""",
)
def chain(spark, d):
    n, k = table(spark, d, "nation"), F.col("n_nationkey")
    s = sites(spark, d).select("site", "region", (F.col("site") % 4).alias("skill"), (F.col("site") % 5).alias("day"))
    region = F.col("n_regionkey").alias("region")
    return U.blockers(s, [("team", n.filter(k % 3 == 0).select(region, (k % 4).alias("skill")), ["region", "skill"]), ("vehicle", n.filter(k % 7 == 0).select(region), ["region"]), ("date", n.select((k % 4).alias("day")), ["day"])])


@query("solver_log", "SELECT CAST(o_orderkey % 50 AS BIGINT) AS run, CAST(max(o_orderkey) AS DOUBLE) AS primal, CAST(max(o_orderkey) * 2 AS DOUBLE) AS dual, CAST(max(o_orderkey) AS BIGINT) AS nodes FROM orders GROUP BY 1")
def log(spark, d):
    """Lines of made-up solver logs, three an order: the last of each kind counts."""
    k = F.col("o_orderkey")
    word = lambda x: x.cast("string")
    lines = F.array(F.concat(F.lit("Primal bound      "), word(k), F.lit(".0 (feasible)")), F.concat(F.lit("  Dual bound: "), word(k * 2), F.lit(".0e0")), F.concat(F.lit("Nodes             "), word(k)), F.lit("presolve done"))
    o = table(spark, d, "orders").select((k % 50).cast("long").alias("run"), k.alias("n"), F.explode(lines).alias("line"))
    return U.solver_log(o, "run", "line")


@query(
    "synthetic_instance",
    """WITH n AS (SELECT (SELECT count(*) FROM nation) AS u, (SELECT count(*) FROM supplier) AS s, (SELECT count(*) FROM part) AS c), k AS (SELECT u, greatest(1, s // u) AS se, greatest(5, c // u) AS ce FROM n),
s AS (SELECT unnest(range(u * se)) AS site, se, u FROM k), c AS (SELECT unnest(range(u * ce)) AS cell, ce FROM k), d AS (SELECT cell, ce, cell // ce AS unit, CAST((cell * 13) % 29 + 1 AS DOUBLE) AS population FROM c)
SELECT site, count(*) AS cells, sum(population) AS population FROM s JOIN d ON d.unit = site // se OR (d.unit = (site // se + 1) % u AND cell % ce < 5) GROUP BY 1""",
)
def synthetic(spark, d):
    """A made-up instance as large as the tables: a unit a nation, sites and cells as many as suppliers and parts."""
    units, s, c = (table(spark, d, name).count() for name in ("nation", "supplier", "part"))
    _, _, cover_ = U.synthetic_instance(spark, units, max(1, s // units), max(5, c // units))
    return cover_.groupBy("site").agg(F.count("*").alias("cells"), F.sum("population").alias("population"))


_RULES = {"years": "years >= 5", "level": "mean >= 20", "steady": "spread <= 0.6 * mean"}


@query(
    "abstention_summary",
    f"""WITH {PANEL}, y AS (SELECT region, item, year, sum(value) AS v FROM panel GROUP BY 1, 2, 3), e AS (SELECT region * 10 + CAST(substr(item, 1, 1) AS BIGINT) AS id, count(*) AS years, avg(v) AS mean, max(v) - min(v) AS spread FROM y GROUP BY region, item),
f AS (SELECT id, years >= 5 AS a, mean >= 20 AS b, spread <= 0.6 * mean AS c FROM e) SELECT id, concat_ws('|', CASE WHEN NOT a THEN 'years' END, CASE WHEN NOT b THEN 'level' END, CASE WHEN NOT c THEN 'steady' END) AS reasons, CASE WHEN a AND b AND c THEN 'release' ELSE 'abstain' END AS decision FROM f""",
)
def abstain(spark, d):
    y = panel(spark, d).groupBy("region", "item", "year").agg(F.sum("value").alias("v"))
    e = y.groupBy((F.col("region") * 10 + F.substring("item", 1, 1).cast("long")).cast("long").alias("id")).agg(F.count("*").alias("years"), F.avg("v").alias("mean"), (F.max("v") - F.min("v")).alias("spread"))
    return U.abstention(e, "id", _RULES)


@query(
    "plan_distance",
    f"WITH {SITES}, {_PL}, p AS (SELECT DISTINCT plan FROM pl) SELECT a.plan AS plan_a, b.plan AS plan_b, (SELECT count(*) FROM (SELECT site FROM pl WHERE plan IN (a.plan, b.plan) GROUP BY site HAVING count(*) = 1)) AS distance FROM p a JOIN p b ON a.plan < b.plan",
)
def distance(spark, d):
    return U.plan_distance(plans(spark, d))
