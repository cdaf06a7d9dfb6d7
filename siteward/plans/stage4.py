"""Visit plans on the driver's tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from siteward.operators import network as R
from siteward.operators import planning as P
from siteward.operators import spatial as X
from siteward.plans.roles import CELLS, COVER, RADIUS, SITES, cells, pct_sql, sites
from siteward.plans.stage3 import cover
from siteward.sources.tables import checkpointed, fingerprint, table

QUERIES, SQL = {}, {}
VISITS, POOL = 10, 600


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_B = f"WITH {SITES}, {CELLS}, {COVER}"


def pool(spark, d, most=POOL):
    """The candidates of the searches below: the best three of every unit, ``most`` in all; an error if that dropped a unit."""
    return checkpointed(P.reduced(sites(spark, d), "unit", "site", "score", 3, most)).withColumn("cluster", F.pmod(F.col("site"), F.lit(40))).withColumn("is_proxy", (F.col("site") % 5 == 0).cast("int")).withColumn("cost", F.pmod(F.col("site") * 11, F.lit(23)).cast("double"))


@query("candidate_blend", f"WITH {SITES}, t AS (SELECT site, score AS a, x AS b, y AS c FROM sites) SELECT site, round(0.5 * {pct_sql('a')} + 0.3 * {pct_sql('b')} + 0.2 * {pct_sql('c')}, 6) AS score FROM t")
def blend(spark, d):
    return P.candidate_blend(sites(spark, d).select("site", F.col("score").alias("a"), F.col("x").alias("b"), F.col("y").alias("c")), {"a": 0.5, "b": 0.3, "c": 0.2})


@query(
    "reduce_candidates",
    f"""WITH {SITES}, k AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY score DESC, site) AS k FROM sites QUALIFY k <= 3)
SELECT site, unit, score FROM k QUALIFY row_number() OVER (ORDER BY CASE WHEN k = 1 THEN 0 ELSE 1 END, score DESC, site) <= 40""",
)
def reduce(spark, d):
    return P.reduced(sites(spark, d), "unit", "site", "score", 3, 40).select("site", "unit", "score")


@query(
    "incidence_compression",
    f"""{_B}, t AS (SELECT cell, string_agg(CAST(site AS VARCHAR), ',' ORDER BY site) AS coverers FROM (SELECT DISTINCT cell, site FROM cover) GROUP BY 1)
SELECT region, coverers, count(*) AS cells, round(sum(population), 4) AS population FROM cells JOIN t USING (cell) GROUP BY 1, 2""",
)
def compression(spark, d):
    s = checkpointed(sites(spark, d))
    g = P.incidence_groups(lambda c, what, carry: X.coverers(s, c, RADIUS, what, carry), checkpointed(cells(spark, d)))
    return g.select("region", F.array_join(F.transform("coverers", lambda s: s.cast("string")), ",").alias("coverers"), "cells", "population")


@query(
    "candidate_equivalence",
    f"""{_B}, s AS (SELECT site, string_agg(CAST(cell AS VARCHAR), ',' ORDER BY cell) AS sig FROM cover GROUP BY 1), r AS (SELECT s.site, sig, region, CASE WHEN site % 5 = 0 THEN 1 ELSE 0 END AS px FROM s JOIN sites USING (site))
SELECT site, region, members FROM (SELECT *, count(*) OVER (PARTITION BY sig, region) AS members, row_number() OVER (PARTITION BY sig, region ORDER BY px, site) AS k FROM r) WHERE k = 1""",
)
def equivalence(spark, d):
    s = sites(spark, d).withColumn("is_proxy", (F.col("site") % 5 == 0).cast("int"))
    return P.equivalents(cover(spark, d), s, ["region"]).select("site", "region", "members")


@query(
    "candidate_dominance",
    f"""{_B}, s AS (SELECT q.site, list(cell) AS c, min(region) AS region, CAST(min((q.site * 11) % 23) AS DOUBLE) AS cost FROM cover q JOIN sites USING (site) GROUP BY 1)
SELECT a.site, min(b.site) AS by FROM s a JOIN s b ON a.region = b.region AND a.site <> b.site AND b.cost <= a.cost AND list_has_all(b.c, a.c) AND (len(a.c) < len(b.c) OR b.cost < a.cost OR b.site < a.site) GROUP BY 1""",
)
def dominance(spark, d):
    s = checkpointed(sites(spark, d).withColumn("cost", F.pmod(F.col("site") * 11, F.lit(23)).cast("double")))
    return P.dominated(partial(X.range_join, radius=RADIUS), s, "region", "cost", cells(spark, d))


CAPS = {"unit": 2, "region": 4, "cluster": 1}


_POOL = f"""k AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY score DESC, site) AS k FROM sites QUALIFY k <= 3),
po AS (SELECT site, unit, region, site % 40 AS cluster FROM k QUALIFY row_number() OVER (ORDER BY CASE WHEN k = 1 THEN 0 ELSE 1 END, score DESC, site) <= {POOL})"""
_TAKEN = lambda c: f"(SELECT count(*) FROM po c WHERE list_contains(st.chosen, c.site) AND c.{c} = po.{c}) < {CAPS[c]}"
_GREEDY = f"""WITH RECURSIVE {SITES}, {CELLS}, {COVER}, {_POOL}, cv AS MATERIALIZED (SELECT po.site, cell, population FROM po JOIN cover USING (site) JOIN cells c USING (cell)),
st AS (SELECT CAST(0 AS BIGINT) AS step, CAST([] AS BIGINT[]) AS chosen, CAST([] AS BIGINT[]) AS held, CAST(NULL AS BIGINT) AS site, CAST(0 AS DOUBLE) AS gain
UNION ALL SELECT step + 1, list_append(chosen, b.site), list_concat(held, b.new), b.site, b.gain FROM st, LATERAL (SELECT p.site, coalesce(g.gain, 0) AS gain, coalesce(g.new, []) AS new
  FROM (SELECT * FROM po WHERE NOT list_contains(st.chosen, site) AND {_TAKEN('unit')} AND {_TAKEN('region')} AND {_TAKEN('cluster')}) p
  LEFT JOIN (SELECT site, sum(population) AS gain, list(cell) AS new FROM cv WHERE NOT list_contains(st.held, cell) GROUP BY 1) g ON g.site = p.site ORDER BY round(coalesce(g.gain, 0), 6) DESC, p.site LIMIT 1) b WHERE step < {VISITS}),
gr AS (SELECT step, site, round(gain, 4) AS gain, round(sum(gain) OVER (ORDER BY step), 4) AS covered FROM st WHERE step > 0)"""


@query("greedy_plan", f"{_GREEDY} SELECT * FROM gr")
def greedy(spark, d):
    p = pool(spark, d)
    return P.greedy_plan(cover(spark, d).join(p.select("site"), "site"), cells(spark, d), p, VISITS, CAPS)


@query("frontier_marginals", f"{_GREEDY} SELECT step AS visits, covered, round(covered - coalesce(lag(covered) OVER (ORDER BY step), 0), 4) AS marginal, round((covered - coalesce(lag(covered) OVER (ORDER BY step), 0)) / first(covered) OVER (ORDER BY step), 6) AS share_of_first FROM gr")
def frontier(spark, d):
    return P.frontier_marginals(greedy(spark, d))


@query("swap_improve", None)
def swap(spark, d):
    p = pool(spark, d)
    plan = P.plan_of(cover(spark, d).join(p.select("site"), "site"), cells(spark, d), p, CAPS)
    start = [s for s, _ in plan.greedy(VISITS)]
    done = plan.swapped(start)
    return spark.createDataFrame([("greedy", len(start), round(plan.value(start), 4)), ("swapped", len(done), round(plan.value(done), 4)), ("bound", VISITS, round(plan.bound(VISITS), 4))], "plan string, visits long, covered double")


@query("exact_plan", None)
def exact(spark, d):
    p = pool(spark, d)
    plan = P.plan_of(cover(spark, d).join(p.select("site"), "site"), cells(spark, d), p, {"unit": 2})
    best, bound, proven = plan.exact(4)
    gap, good = P.gap_certification(plan.value(best), bound)
    return spark.createDataFrame([(",".join(map(str, sorted(best))), round(plan.value(best), 4), round(bound, 4), round(gap, 6), int(good), int(proven))], "sites string, covered double, bound double, gap double, accepted long, proven long")


def plans(spark, d):
    """Three plans: the best site of every unit, the best three of every region, the best ten by score."""
    s = sites(spark, d)
    a, b = X.shortlist(s, "unit", "site", "score", 1), X.shortlist(s, "region", "site", "score", 3)
    c = s.orderBy(F.col("score").desc(), "site").limit(VISITS)
    named = lambda x, n: x.select(F.lit(n).alias("plan"), "site")
    return named(a, "unit").union(named(b, "region")).union(named(c, "top"))


_PL = """pl AS (SELECT 'unit' AS plan, site FROM (SELECT site FROM sites QUALIFY row_number() OVER (PARTITION BY unit ORDER BY score DESC, site) = 1)
UNION ALL SELECT 'region', site FROM (SELECT site FROM sites QUALIFY row_number() OVER (PARTITION BY region ORDER BY score DESC, site) <= 3) UNION ALL SELECT 'top', site FROM (SELECT site FROM sites ORDER BY score DESC, site LIMIT 10))"""


@query(
    "plan_metrics",
    f"""{_B}, {_PL}, r AS (SELECT plan, cell, count(*) AS n FROM pl JOIN cover USING (site) GROUP BY 1, 2), g AS (SELECT plan, region, sum(population) AS u, sum(population * n) AS v FROM r JOIN cells USING (cell) GROUP BY 1, 2),
t AS (SELECT region, sum(population) AS a FROM cells GROUP BY 1), e AS (SELECT p.plan, t.region, a, coalesce(u, 0) AS u, coalesce(v, 0) AS v FROM (SELECT DISTINCT plan FROM pl) p CROSS JOIN t LEFT JOIN g ON g.plan = p.plan AND g.region = t.region)
SELECT plan, round(sum(u), 4) AS unique_population, round(sum(v), 4) AS naive_population, count(*) FILTER (u > 0) AS regions, round(min(u / a), 6) AS least_ratio, round(sum(u * u) / (sum(u) * sum(u)), 6) AS hhi FROM e GROUP BY 1""",
)
def metrics(spark, d):
    return P.plan_metrics(plans(spark, d), cover(spark, d), cells(spark, d))


@query("selection_frequency", f"WITH {SITES}, {_PL} SELECT site, count(DISTINCT plan) AS plans, round(count(DISTINCT plan) / 3.0, 6)::DOUBLE AS frequency FROM pl GROUP BY 1")
def frequency(spark, d):
    return P.selection_frequency(plans(spark, d))


@query(
    "plan_jaccard",
    f"""WITH {SITES}, {_PL}, p AS (SELECT a.plan AS plan_a, b.plan AS plan_b FROM (SELECT DISTINCT plan FROM pl) a JOIN (SELECT DISTINCT plan FROM pl) b ON a.plan < b.plan),
c AS (SELECT plan_a, plan_b, (SELECT count(*) FROM pl x JOIN pl y USING (site) WHERE x.plan = plan_a AND y.plan = plan_b) AS shared, (SELECT count(DISTINCT site) FROM pl WHERE plan IN (plan_a, plan_b)) AS u FROM p)
SELECT plan_a, plan_b, shared, round(shared / u, 6) AS jaccard FROM c""",
)
def jaccard(spark, d):
    return P.plan_jaccard(plans(spark, d))


@query(
    "unique_contribution",
    f"""{_B}, {_PL}, o AS (SELECT plan, cell, min(site) AS site FROM pl JOIN cover USING (site) GROUP BY 1, 2 HAVING count(*) = 1), c AS (SELECT plan, site, round(sum(population), 4) AS contribution FROM o JOIN cells USING (cell) GROUP BY 1, 2)
SELECT plan, site, coalesce(contribution, 0.0) AS contribution FROM pl LEFT JOIN c USING (plan, site)""",
)
def contribution(spark, d):
    return P.unique_contribution(plans(spark, d), cover(spark, d), cells(spark, d))


@query(
    "equity_kpis",
    f"""{_B}, {_PL}, k AS (SELECT DISTINCT cell FROM pl JOIN cover USING (site) WHERE plan = 'unit'), g AS (SELECT region, coalesce(sum(population) FILTER (k.cell IS NOT NULL), 0) AS covered, sum(population) AS total FROM cells c LEFT JOIN k ON k.cell = c.cell GROUP BY 1),
i AS (SELECT *, row_number() OVER (ORDER BY covered, region) AS i FROM g)
SELECT count(*) AS regions, round(min(covered / total), 6) AS least_ratio, round(avg(covered / total), 6) AS mean_ratio, round(2 * sum(i * covered) / (count(*) * sum(covered)) - (count(*) + 1) / count(*), 6) AS gini, round(sum(covered * covered) / (sum(covered) * sum(covered)), 6) AS hhi FROM i""",
)
def equity(spark, d):
    k = plans(spark, d).filter("plan = 'unit'").join(cover(spark, d), "site").select("cell").distinct().withColumn("hit", F.lit(1))
    g = cells(spark, d).join(k, "cell", "left").groupBy("region").agg(F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("population"))), F.lit(0.0)).alias("covered"), F.sum("population").alias("total"))
    return P.equity_kpis(g)


_VAL = "va AS (SELECT site, 'b' || b.b AS bundle, CAST((site * 31 + b.b * 17) % 101 AS DOUBLE) AS value FROM sites CROSS JOIN range(5) b(b))"


def values(spark, d):
    b = spark.range(5).withColumnRenamed("id", "b")
    return sites(spark, d).crossJoin(F.broadcast(b)).select("site", F.concat(F.lit("b"), F.col("b").cast("string")).alias("bundle"), F.pmod(F.col("site") * 31 + F.col("b") * 17, F.lit(101)).cast("double").alias("value"))


@query("bundle_top1", f"WITH {SITES}, {_VAL} SELECT site, bundle, value FROM va QUALIFY row_number() OVER (PARTITION BY site ORDER BY value DESC, bundle) = 1")
def top1(spark, d):
    return P.bundle_top1(values(spark, d))


# What is best for each site alone is an upper bound; here each bundle is the best of some site, so it is the optimum.
@query("bundle_assignment_min1", f"WITH {SITES}, {_VAL}, {_POOL} SELECT site, bundle, value FROM va JOIN po USING (site) QUALIFY row_number() OVER (PARTITION BY site ORDER BY value DESC, bundle) = 1")
def assignment(spark, d):
    return P.bundle_assignment(values(spark, d).join(pool(spark, d).select("site"), "site"))


_ROAD = "rd AS (SELECT n_nationkey AS u, CAST((n_nationkey * 7 + k.k * 3 + 1) % 25 AS INTEGER) AS w, CAST((n_nationkey * 13 + k.k * 5) % 11 + 2 AS DOUBLE) AS minutes FROM nation CROSS JOIN range(3) k(k))"


@query(
    "network_isochrone",
    f"""WITH RECURSIVE {_ROAD}, sp AS (SELECT n_nationkey AS source, n_nationkey AS vertex, 0.0::DOUBLE AS minutes FROM nation WHERE n_nationkey % 5 = 0
UNION SELECT source, w, sp.minutes + rd.minutes FROM sp JOIN rd ON sp.vertex = rd.u WHERE sp.minutes + rd.minutes <= 15) SELECT source, vertex, min(minutes) AS minutes FROM sp GROUP BY 1, 2""",
)
def isochrone(spark, d):
    n, k = table(spark, d, "nation"), spark.range(3).withColumnRenamed("id", "k")
    key = F.col("n_nationkey")
    roads = n.crossJoin(F.broadcast(k)).select(key.alias("u"), F.pmod(key * 7 + F.col("k") * 3 + 1, F.lit(25)).cast("int").alias("w"), (F.pmod(key * 13 + F.col("k") * 5, F.lit(11)) + 2).cast("double").alias("minutes"))
    return R.shortest_minutes(checkpointed(roads), n.filter(key % 5 == 0).select(key.alias("vertex")), 15.0)


_TAG = "CASE s_suppkey % 4 WHEN 0 THEN '50' WHEN 1 THEN '30 mph;40 mph' WHEN 2 THEN 'none' ELSE '200' END"


@query("speed_from_tags", "SELECT s_suppkey AS site, round(CAST(CASE s_suppkey % 4 WHEN 0 THEN 50 WHEN 1 THEN 30 * 1.609344::DOUBLE WHEN 2 THEN CASE WHEN s_suppkey % 3 = 0 THEN 100 ELSE 30 END ELSE 120 END AS DOUBLE), 6) AS speed FROM supplier")
def speed(spark, d):
    k = F.col("s_suppkey")
    tag = F.when(k % 4 == 0, "50").when(k % 4 == 1, "30 mph;40 mph").when(k % 4 == 2, "none").otherwise("200")
    s = table(spark, d, "supplier").select(k.alias("site"), tag.alias("tag"), F.when(k % 3 == 0, "motorway").otherwise("lane").alias("way"))
    return P.speed_from_tags(s, "tag", "way", {"motorway": 100.0}).select("site", "speed")


@query(
    "submodular_bound",
    f"""{_B}, k AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY score DESC, site) AS k FROM sites QUALIFY k <= 3), po AS (SELECT site FROM k QUALIFY row_number() OVER (ORDER BY CASE WHEN k = 1 THEN 0 ELSE 1 END, score DESC, site) <= {POOL}),
g AS (SELECT site, sum(population) AS g FROM cover JOIN cells USING (cell) JOIN po USING (site) GROUP BY 1), t AS (SELECT g FROM g ORDER BY g DESC LIMIT {VISITS}) SELECT round(sum(g), 4) AS bound FROM t""",
)
def bound(spark, d):
    p = pool(spark, d)
    plan = P.plan_of(cover(spark, d).join(p.select("site"), "site"), cells(spark, d), p, CAPS)
    return spark.createDataFrame([(round(plan.bound(VISITS), 4),)], "bound double")



@query(
    "operational_options",
    """WITH b AS (SELECT n_nationkey AS base, n_regionkey AS region FROM nation WHERE n_nationkey % 3 = 0), t AS (SELECT base, 'team' || base AS team, CAST(base % 4 AS BIGINT) AS skill FROM b), v AS (SELECT base, 'van' || base AS van FROM b WHERE base % 2 = 0),
d AS (SELECT team, CAST(k.k AS BIGINT) AS day FROM t CROSS JOIN range(5) k(k) WHERE (skill + k.k) % 2 = 0), s AS (SELECT s_suppkey AS site, n_regionkey AS region, CAST(s_suppkey % 4 AS BIGINT) AS skill, CAST(s_suppkey % 5 AS BIGINT) AS day FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT DISTINCT s.site, t.team, v.van, d.day FROM s JOIN b ON b.region = s.region JOIN t ON t.base = b.base AND t.skill = s.skill JOIN v ON v.base = b.base JOIN d ON d.team = t.team AND d.day = s.day""",
)
def options(spark, d):
    """Sites x teams x vehicles x days through chained inner joins."""
    n = table(spark, d, "nation")
    b = n.filter(F.col("n_nationkey") % 3 == 0).select(F.col("n_nationkey").alias("base"), F.col("n_regionkey").alias("region"))
    name = lambda p: F.concat(F.lit(p), F.col("base").cast("string"))
    t = b.select("base", name("team").alias("team"), (F.col("base") % 4).cast("long").alias("skill"))
    v = b.filter(F.col("base") % 2 == 0).select("base", name("van").alias("van"))
    days = t.crossJoin(spark.range(5).withColumnRenamed("id", "day")).filter((F.col("skill") + F.col("day")) % 2 == 0).select("team", "day")
    s = sites(spark, d).select("site", "region", (F.col("site") % 4).cast("long").alias("skill"), (F.col("site") % 5).cast("long").alias("day"))
    return s.join(b, "region").join(t, ["base", "skill"]).join(v, "base").join(days, ["team", "day"]).select("site", "team", "van", "day").dropDuplicates()


_TEXT = lambda c: f"CASE WHEN {c} IS NULL THEN '~' ELSE length({c}::VARCHAR) || ':' || {c}::VARCHAR END"
_HASHED = ["o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus"]


@query(
    "frame_fingerprint",
    f"""WITH h AS (SELECT md5(concat_ws(',', {", ".join(map(_TEXT, _HASHED))})) AS h FROM orders)
SELECT count(*) AS n, coalesce(sum(('0x' || h[1:15])::BIGINT), 0)::VARCHAR || '-' || coalesce(sum(('0x' || h[16:30])::BIGINT), 0)::VARCHAR AS fingerprint FROM h""",
)
def frame_fingerprint(spark, d):
    """Content hash of a whole table, whatever the order of its rows."""
    return fingerprint(table(spark, d, "orders"), _HASHED)


@query(
    "snapshot_diff",
    """WITH a AS (SELECT s_suppkey AS id, s_nationkey AS v FROM supplier WHERE s_suppkey % 10 <> 0), b AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 7 = 0 THEN s_nationkey + 1 ELSE s_nationkey END AS v FROM supplier WHERE s_suppkey % 9 <> 0)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL OUTER JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.v <> b.v""",
)
def diff(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("v"))
    a = s.filter(F.col("id") % 10 != 0).select("id", "v", F.lit(1).alias("ina"))
    b = s.filter(F.col("id") % 9 != 0).select("id", F.when(F.col("id") % 7 == 0, F.col("v") + 1).otherwise(F.col("v")).alias("w"), F.lit(1).alias("inb"))
    both = a.join(b, "id", "full_outer")
    kind = F.when(F.col("ina").isNull(), "added").when(F.col("inb").isNull(), "removed").when(F.col("v") != F.col("w"), "changed")
    return both.withColumn("change", kind).filter("change IS NOT NULL").select("id", "change")
