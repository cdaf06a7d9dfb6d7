"""Contracts, queues and panels on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteward.operators import contracts as C
from siteward.operators import graph as G
from siteward.operators import need as N
from siteward.operators import spatial as X
from siteward.plans import stage1, stage3, stage4
from siteward.plans.roles import CELLS, COVER, SITES, cells, pct_sql, sites, units
from siteward.sources.tables import checkpointed, table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_RULES = {
    "price_positive": "o_totalprice > 0",
    "known_status": "o_orderstatus IN ('O', 'F', 'P')",
    "date_in_range": "o_orderdate BETWEEN TIMESTAMP '1995-01-01 00:00:00' AND TIMESTAMP '2001-12-31 00:00:00'",
    "urgent_is_dear": "o_orderpriority <> '1-URGENT' OR o_totalprice > 1000",
}


@query("expectation_audit", " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) AS rows, count(*) FILTER (NOT coalesce({c}, FALSE)) AS violations FROM orders" for n, c in _RULES.items()))
def audit(spark, d):
    return C.audit(table(spark, d, "orders"), {n: F.expr(c) for n, c in _RULES.items()})


def _word(k: int, m: int) -> str:
    return f"CASE (s_suppkey * {k}) % {m} WHEN 0 THEN ' No' WHEN 1 THEN 'unknown' ELSE 'YES ' END"


@query(
    "feasibility_context",
    f"""WITH w AS (SELECT s_suppkey AS site, lower(trim({_word(7, 11)})) AS a, lower(trim({_word(5, 13)})) AS b, lower(trim({_word(3, 17)})) AS c FROM supplier),
k AS (SELECT site, CAST((a = 'yes')::INT + (b = 'yes')::INT + (c = 'yes')::INT AS BIGINT) AS yes, CAST((a = 'no')::INT + (b = 'no')::INT + (c = 'no')::INT AS BIGINT) AS no FROM w)
SELECT site, yes, no, 3 - yes - no AS unknown, CASE WHEN no > 0 THEN 'blocked' WHEN 3 - yes - no > 0 THEN 'unknown' ELSE 'ready' END AS status FROM k""",
)
def feasibility(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("site"), F.expr(_word(7, 11)).alias("a"), F.expr(_word(5, 13)).alias("b"), F.expr(_word(3, 17)).alias("c"))
    return C.feasibility(s, "site", ["a", "b", "c"])


@query(
    "field_validation_queue",
    f"""WITH {SITES}, f AS (SELECT site, round(0.6 * {pct_sql('score')} + 0.4 * {pct_sql('x')}, 6) AS priority, CAST(CASE WHEN site % 17 = 0 THEN 1 ELSE 0 END AS BIGINT) AS must FROM sites)
SELECT site, priority, must, row_number() OVER (ORDER BY must DESC, priority DESC, site) AS place FROM f QUALIFY place <= 25""",
)
def queue(spark, d):
    s = sites(spark, d)
    return C.field_queue(s, s.filter(F.col("site") % 17 == 0), {"score": 0.6, "x": 0.4}, 25).select("site", "priority", "must", "place")


@query("robust_core", f"WITH {SITES}, {stage4._PL} SELECT site, count(DISTINCT plan) AS plans, round(count(DISTINCT plan) / 3.0, 6)::DOUBLE AS frequency FROM pl GROUP BY 1 HAVING count(DISTINCT plan) / 3.0 >= 0.6")
def core(spark, d):
    return C.robust_core(stage4.frequency(spark, d), 0.6)


@query(
    "proxy_resolution",
    f"""WITH {SITES}, r AS (SELECT a.site AS proxy, b.site, round(sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)), 6) AS distance FROM sites a JOIN sites b ON a.region = b.region WHERE a.site % 5 = 0 AND b.site % 5 <> 0)
SELECT proxy, site, distance, row_number() OVER (PARTITION BY proxy ORDER BY distance, site) AS place FROM r QUALIFY place <= 2""",
)
def proxies(spark, d):
    return C.proxy_resolution(sites(spark, d).withColumn("is_proxy", (F.col("site") % 5 == 0).cast("int")))


@query("nearest_three", f"WITH {SITES}, {CELLS} SELECT cell, row_number() OVER (PARTITION BY cell ORDER BY dd, site) AS place, site, round(dd, 6) AS distance FROM (SELECT cell, site, {stage3._NEAR} AS dd FROM cells c CROSS JOIN sites s) QUALIFY place <= 3")
def nearest_three(spark, d):
    return C.nearest_k(cells(spark, d), sites(spark, d), 3)


@query(
    "haversine_distance",
    """WITH p AS (SELECT s_suppkey AS site, 36.0 + (s_suppkey * 7919 % 1000) / 500.0 AS lat, 127.0 + (s_suppkey * 104729 % 1000) / 400.0 AS lon FROM supplier),
a AS (SELECT site, pow(sin((radians(37.5) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(37.5)) * pow(sin((radians(128.2) - radians(lon)) / 2), 2) AS a FROM p)
SELECT site, round(2 * 6371.0088 * asin(sqrt(least(greatest(a, 0), 1))), 4) AS km FROM a""",
)
def haversine(spark, d):
    k = F.col("s_suppkey")
    p = table(spark, d, "supplier").select(k.alias("site"), (36.0 + F.pmod(k * 7919, F.lit(1000)) / 500.0).alias("lat"), (127.0 + F.pmod(k * 104729, F.lit(1000)) / 400.0).alias("lon"))
    return C.great_circle(p, "site", 37.5, 128.2)


@query("json_properties", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def properties(spark, d):
    e = table(spark, d, "events").select("user_id", F.from_json("props", "k bigint").getField("k").alias("k"))
    return e.groupBy("k").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


_SER = "SELECT user_id AS unit, CAST(day(ts) AS BIGINT) % 4 AS step, CAST(count(*) % 2 AS BIGINT) AS v FROM events GROUP BY 1, 2"


@query("series_representatives", f"WITH s AS ({_SER}), h AS (SELECT unit, string_agg(step || ':' || v, '|' ORDER BY step, v) AS h FROM s GROUP BY 1) SELECT min(unit) AS representative, count(*) AS members FROM h GROUP BY h")
def representatives(spark, d):
    e = table(spark, d, "events")
    s = e.groupBy(F.col("user_id").alias("unit"), F.pmod(F.dayofmonth("ts").cast("long"), F.lit(4)).alias("step")).agg(F.pmod(F.count("*"), F.lit(2)).alias("v"))
    return C.series_representatives(s, "unit", "step", "v")


@query(
    "rank_auc",
    f"""WITH {stage1.UNITS}, m AS (SELECT median(spend) AS m FROM units), r AS (SELECT {stage1._rank('balance')} AS r, CASE WHEN spend > m THEN 1 ELSE 0 END AS y FROM units, m)
SELECT count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n, round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc FROM r""",
)
def auc(spark, d):
    u = checkpointed(units(spark, d).select("balance", "spend"))
    m = u.agg(F.median("spend").alias("m"))
    return C.rank_auc(u.crossJoin(F.broadcast(m)).select("balance", F.when(F.col("spend") > F.col("m"), 1).otherwise(0).alias("y")), "balance", "y")


@query(
    "exposure_change_panel",
    f"""WITH {SITES}, {CELLS}, {COVER}, a AS (SELECT site, round(sum(population), 4) AS v FROM cover JOIN cells USING (cell) WHERE distance <= 250 + 1e-9 GROUP BY 1), b AS (SELECT site, round(sum(population), 4) AS v FROM cover JOIN cells USING (cell) GROUP BY 1)
SELECT b.site, coalesce(a.v, 0.0) AS before, b.v AS after, CASE WHEN a.v > 0 THEN round((b.v - a.v) / a.v, 6) END AS change FROM b LEFT JOIN a USING (site)""",
)
def change(spark, d):
    def reach(r):
        return X.range_join(sites(spark, d), cells(spark, d), r, carry_cells=("population",)).groupBy("site").agg(F.round(F.sum("population"), 4).alias("v"))

    return C.exposure_change(reach(250.0), reach(500.0), "site", "v")


@query("radius_distribution", f"WITH {SITES}, {CELLS}, {COVER} SELECT count(*) AS pairs, round(quantile_cont(distance, 0.25), 6) AS q25, round(quantile_cont(distance, 0.5), 6) AS q50, round(quantile_cont(distance, 0.75), 6) AS q75, round(max(distance), 6) AS most FROM cover")
def radius_distribution(spark, d):
    return stage3.cover(spark, d).agg(F.count("*").alias("pairs"), *[F.round(F.percentile("distance", p), 6).alias(n) for n, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))], F.round(F.max("distance"), 6).alias("most"))


@query(
    "hazard_leave_one_out",
    """WITH h AS (SELECT user_id AS unit, CAST(day(ts) AS BIGINT) % 3 AS period, count(*) FILTER (value > 60) AS hot FROM events GROUP BY 1, 2), p AS (SELECT DISTINCT period AS held FROM h),
o AS (SELECT held, unit, avg(hot) AS o FROM h JOIN p ON period <> held GROUP BY 1, 2), b AS (SELECT o.held, hot AS v, o FROM o JOIN h ON h.unit = o.unit AND h.period = o.held)
SELECT held, count(*) AS n, CASE WHEN stddev_pop(v) > 1e-15 AND stddev_pop(o) > 1e-15 THEN round(corr(v, o), 6) END AS rho FROM b GROUP BY 1""",
)
def leave_one_out(spark, d):
    e = table(spark, d, "events")
    h = e.groupBy(F.col("user_id").alias("unit"), F.pmod(F.dayofmonth("ts").cast("long"), F.lit(3)).alias("period")).agg(F.count_if(F.col("value") > 60).alias("hot"))
    return C.held_out_stability(checkpointed(h), "unit", "period", "hot")


@query(
    "most_feasible_visits",
    f"""WITH {SITES}, c AS (SELECT DISTINCT region, unit, site // 3 * 1000 + unit AS cluster FROM sites), u AS (SELECT region, unit, least(3, count(*)) AS n FROM c GROUP BY 1, 2), r AS (SELECT least(8, sum(n)) AS n FROM u GROUP BY region)
SELECT CAST(sum(n) AS BIGINT) AS visits FROM r""",
)
def visits(spark, d):
    s = sites(spark, d).withColumn("cluster", F.floor(F.col("site") / 3) * 1000 + F.col("unit"))
    return spark.createDataFrame([(G.most_visits(s, 8, 3),)], "visits long")


@query("spectral_metrics", None)
def spectral(spark, d):
    rho = {(r["a"], r["b"]): r["rho"] for r in N.spearman_pairs(units(spark, d), "unit", stage1.NAMES).collect()}  # one row a pair of features
    return spark.createDataFrame([(k, round(v, 6)) for k, v in G.spectral_metrics(stage1.NAMES, rho).items()], "metric string, value double")


@query("hierarchical_order", None)
def hierarchical(spark, d):
    rho = {(r["a"], r["b"]): r["rho"] for r in N.spearman_pairs(units(spark, d), "unit", stage1.NAMES).collect()}
    order = G.average_linkage(stage1.NAMES, {k: ((1 - v) / 2) ** 0.5 for k, v in rho.items()})
    return spark.createDataFrame(list(enumerate(order, 1)), "place long, feature string")


@query("joint_assignment", None)
def joint(spark, d):
    """A team, vehicle and day for as many of the first five sites as have an option."""
    rows = G.collected(stage4.options(spark, d))
    options = [(r["site"], r["team"], r["van"], r["day"]) for r in rows]
    first = sorted({o[0] for o in options})[:5]
    found = G.joint_assignment(options, first) or []
    return spark.createDataFrame(found, "site long, team string, van string, day long")
