"""Reviews of runs on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siteward.operators import need as N
from siteward.operators import review as R
from siteward.plans import stage1, stage2, stage3, stage4
from siteward.plans.roles import PANEL, SITES, panel, sites, units
from siteward.sources.tables import checkpointed

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


PROFILES = {"default": {"demand": 0.5, "wealth": 0.3, "context": 0.2}, "demand_first": {"demand": 0.7, "wealth": 0.2, "context": 0.1}, "wealth_first": {"demand": 0.2, "wealth": 0.7, "context": 0.1}}
_AX = "ax AS (SELECT unit, ((a + b) / 2 + c) / 2 AS demand, d AS wealth, e AS context FROM m)"
_RUNS = " UNION ALL ".join(f"SELECT '{p}' AS profile, unit, round({w['demand']} * demand + {w['wealth']} * wealth + {w['context']} * context, 6) AS score FROM ax" for p, w in PROFILES.items())
_RANKED = f"WITH {stage1._MATRIX}, {_AX}, ru AS ({_RUNS}), rr AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY score DESC, unit) AS rank FROM ru)"


def _runs(spark, d):
    long = N.feature_scores(units(spark, d), stage1.FEATURES)
    axes = N.axis_scores(long, N.spec_frame(spark, stage1.FEATURES), ["unit"])
    return checkpointed(R.profile_runs(axes, PROFILES))


@query("profile_scores", f"{_RANKED} SELECT profile, unit, score, rank FROM rr")
def profile_scores(spark, d):
    return _runs(spark, d)


@query(
    "profile_certification",
    f"""{_RANKED}, b AS (SELECT a.profile, a.rank, z.rank AS r0 FROM rr a JOIN rr z ON z.unit = a.unit AND z.profile = 'default'),
c AS (SELECT profile, round(avg(abs(rank - r0)), 6) AS mean_shift, round(count(*) FILTER (rank <= 30 AND r0 <= 30) / count(*) FILTER (rank <= 30 OR r0 <= 30), 6) AS overlap FROM b GROUP BY 1)
SELECT *, CASE WHEN mean_shift <= 100 AND overlap >= 0.2 THEN 'CERTIFIED' ELSE 'EXPLORATORY_FRAGILE' END AS verdict FROM c""",
)
def certification(spark, d):
    return R.certified(_runs(spark, d), "default", 100.0, 0.2, 30)


@query("axis_responsiveness", f"{_RANKED} SELECT a.profile, round(avg(abs(a.rank - z.rank)), 6) AS mean_shift, max(abs(a.rank - z.rank)) AS max_shift FROM rr a JOIN rr z ON z.unit = a.unit AND z.profile = 'default' WHERE a.profile <> 'default' GROUP BY 1")
def responsiveness(spark, d):
    r = _runs(spark, d)
    base = r.filter("profile = 'default'").select("unit", F.col("rank").alias("r0"))
    both = r.filter("profile <> 'default'").join(base, "unit").withColumn("s", F.abs(F.col("rank") - F.col("r0")))
    return both.groupBy("profile").agg(F.round(F.avg("s"), 6).alias("mean_shift"), F.max("s").cast("long").alias("max_shift"))


@query(
    "cross_bundle_separation",
    f"WITH {stage1._RANKED}, p AS (" + " UNION ALL ".join(f"SELECT abs(round(corr({a}, {b}), 6)) AS v FROM r" for a, b in stage1._PAIRS) + ") SELECT count(*) AS pairs, round(median(v), 6) AS median_abs, count(*) FILTER (v >= 0.8) AS over_80, count(*) FILTER (v >= 0.95) AS over_95 FROM p",
)
def separation(spark, d):
    p = N.spearman_pairs(units(spark, d), "unit", stage1.NAMES).select(F.abs("rho").alias("v"))
    return p.agg(F.count("*").alias("pairs"), F.round(F.median("v"), 6).alias("median_abs"), F.count_if(F.col("v") >= 0.8).alias("over_80"), F.count_if(F.col("v") >= 0.95).alias("over_95"))


_WEIGHTS = [("front", "1-URGENT", 0.6), ("front", "2-HIGH", 0.4), ("back", "3-MEDIUM", 0.5), ("back", "4-NOT SPECIFIED", 0.3), ("back", "5-LOW", 0.2)]
_W = "w(bundle, item, w) AS (VALUES " + ", ".join(f"('{b}', '{i}', {w}::DOUBLE)" for b, i, w in _WEIGHTS) + ")"


@query("bundle_seasonality", f"WITH {stage2._MOD}, {_W}, me AS (SELECT item, month, avg(modifier) AS v FROM md GROUP BY 1, 2) SELECT bundle, month, round(sum(w * v), 6) AS modifier FROM me JOIN w USING (item) GROUP BY 1, 2")
def bundle_seasonality(spark, d):
    return R.bundle_seasonality(stage2.modifiers(spark, d), spark.createDataFrame(_WEIGHTS, "bundle string, item string, w double"), "item")


@query(
    "monthly_resolution",
    f"""WITH {PANEL}, y AS (SELECT item, year, month, sum(value) AS v FROM panel GROUP BY 1, 2, 3), t AS (SELECT item, month, sum(v) AS t, count(*) AS n FROM y GROUP BY 1, 2),
r AS (SELECT item, year, corr(v, (t - v) / (n - 1)) AS rho FROM y JOIN t USING (item, month) GROUP BY 1, 2), o AS (SELECT item, round(avg(rho), 6) AS rho FROM r GROUP BY 1) SELECT item, rho, CASE WHEN rho >= 0.3 THEN 'month' ELSE 'season' END AS resolution FROM o""",
)
def resolution(spark, d):
    return R.monthly_resolution(panel(spark, d), "item", 0.3)


@query(
    "normalization_sensitivity",
    f"""WITH {PANEL}, {stage2._CAL}, s AS (SELECT item, year, month, sum(value) AS v FROM panel GROUP BY 1, 2, 3), n AS (SELECT item, month, round(avg(v), 6) AS raw, round(avg(v / calendar_days), 6) AS per_day, round(avg(v / working_days), 6) AS per_working_day FROM s JOIN cal USING (year, month) GROUP BY 1, 2),
l AS (SELECT item, month, 'raw' AS variant, raw AS value FROM n UNION ALL SELECT item, month, 'per_day', per_day FROM n UNION ALL SELECT item, month, 'per_working_day', per_working_day FROM n)
SELECT item, variant, month AS best FROM l QUALIFY row_number() OVER (PARTITION BY item, variant ORDER BY value DESC, month) = 1""",
)
def normalization(spark, d):
    s = panel(spark, d).groupBy("item", "year", "month").agg(F.sum("value").alias("v")).join(F.broadcast(stage2.calendar(spark, d)), ["year", "month"])
    n = s.groupBy("item", "month").agg(F.avg("v").alias("raw"), F.avg(F.col("v") / F.col("calendar_days")).alias("per_day"), F.avg(F.col("v") / F.col("working_days")).alias("per_working_day"))
    return R.best_by_variant(n, ["item"], ["raw", "per_day", "per_working_day"])


@query(
    "region_bootstrap",
    f"""WITH {PANEL}, b AS (SELECT region, row_number() OVER (ORDER BY region) - 1 AS i FROM (SELECT DISTINCT region FROM panel)), n AS (SELECT count(*) AS n FROM b),
dr AS (SELECT r.r, (3 + r.r * 7919 + k.k * 104729 + r.r * k.k * 31) % n.n AS i FROM range(200) r(r), n, range(100) k(k) WHERE k.k < n.n), pk AS (SELECT r, region, count(*) AS times FROM dr JOIN b USING (i) GROUP BY 1, 2),
s AS (SELECT region, item, month, sum(value) AS v FROM panel GROUP BY 1, 2, 3), t AS (SELECT r, item, month, sum(v * times) AS v FROM s JOIN pk USING (region) GROUP BY 1, 2, 3),
f AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY r, item ORDER BY v DESC, month) = 1) SELECT item, month, round(count(*) / 200.0, 6)::DOUBLE AS probability FROM f GROUP BY 1, 2""",
)
def region_bootstrap(spark, d):
    return R.block_resampled_primary(panel(spark, d), "region", "item", 200)


@query(
    "eb_season_grid",
    f"""WITH {PANEL}, v AS (SELECT item, month, avg(value) AS v FROM panel GROUP BY 1, 2), t AS (SELECT month, sum(v) AS t, count(*) AS n FROM v GROUP BY 1)
SELECT item, month, s.s AS strength, round((1 - s.s) * v + s.s * ((t - v) / (n - 1)), 6) AS value FROM v JOIN t USING (month) CROSS JOIN (VALUES (0.0::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) s(s)""",
)
def season_grid(spark, d):
    return R.shrunk_grid(panel(spark, d), ["item"], [0.0, 0.25, 0.5, 0.75])


@query(
    "variance_gate",
    f"""WITH {PANEL}, y AS (SELECT item, year, month, sum(value) AS v FROM panel GROUP BY 1, 2, 3), z AS (SELECT *, avg(v) OVER (PARTITION BY item) AS g, avg(v) OVER (PARTITION BY item, month) AS m FROM y),
o AS (SELECT item, round(sum((m - g) * (m - g)) / sum((v - g) * (v - g)), 6) AS ratio FROM z GROUP BY 1) SELECT item, ratio, CASE WHEN ratio >= 0.25 THEN 'composition' ELSE 'baseline' END AS chosen FROM o""",
)
def gate(spark, d):
    return R.variance_gate(panel(spark, d), "item", 0.25)


@query(
    "what_when_models",
    f"""WITH {stage2._BUNDLE}, pk(bundle, peak) AS (VALUES ('one', 0.9::DOUBLE), ('two', 0.6::DOUBLE), ('rest', 0.75::DOUBLE)), r AS (SELECT unit, bundle, score, round(score * peak, 6) AS joint, round(score + 20.0 * peak, 6) AS bounded FROM bs JOIN pk USING (bundle))
SELECT unit, first(bundle ORDER BY score DESC, bundle) AS hierarchical, first(bundle ORDER BY joint DESC, bundle) AS joint, first(bundle ORDER BY bounded DESC, bundle) AS bounded FROM r GROUP BY 1""",
)
def what_when(spark, d):
    peaks = spark.createDataFrame([("one", 0.9), ("two", 0.6), ("rest", 0.75)], "bundle string, peak double")
    return R.what_when(stage2.bundle_scores(spark, d).select("unit", "bundle", "score"), peaks, 0.2)


@query(
    "need_replication",
    f"""WITH {stage1._RANKED}, f AS (SELECT regr_slope(spend, balance) AS s, regr_intercept(spend, balance) AS i FROM r), e AS (SELECT unit, round(spend - s * balance - i, 4) AS residual FROM r, f)
SELECT unit, residual, row_number() OVER (ORDER BY residual DESC, unit) AS place FROM e""",
)
def replication(spark, d):
    ranked = checkpointed(N.ranked_columns(units(spark, d), "unit", ["spend", "balance"]))
    fit = ranked.agg(F.regr_slope("spend", "balance").alias("s"), F.regr_intercept("spend", "balance").alias("i"))
    e = checkpointed(ranked.crossJoin(F.broadcast(fit)).select("unit", F.round(F.col("spend") - F.col("s") * F.col("balance") - F.col("i"), 4).alias("residual")))
    from siteward.functions.stats import ordered_rank

    return ordered_rank(e, "residual", "unit", "place").select("unit", "residual", "place")


@query(
    "spatial_leakage",
    f"""WITH {stage2._FIT}, s AS (SELECT unit, n_regionkey AS region, string_agg(printf('%.3f', season_score), '|' ORDER BY bundle, month) AS sig FROM fit JOIN nation ON unit = n_nationkey GROUP BY 1, 2)
SELECT region, count(*) AS units, count(DISTINCT sig) AS profiles FROM s GROUP BY 1""",
)
def leakage(spark, d):
    from siteward.sources.tables import table

    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("unit"), F.col("n_regionkey").alias("region"))
    rows = stage2._fit(spark, d).join(F.broadcast(n), "unit").withColumn("at", F.concat("bundle", F.lpad(F.col("month").cast("string"), 2, "0")))
    return R.profile_signatures(rows, "region", "unit", "at", "season_score")


_EXPO = stage3._EXP


@query(
    "baseline_plans",
    f"""{_EXPO}, s AS (SELECT sites.*, coalesce(raw, 0) AS raw FROM sites LEFT JOIN ex USING (site)), u AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY unit ORDER BY score DESC, site) = 1), t AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY score DESC, site) AS t FROM s)
SELECT 'score' AS plan, site FROM (SELECT site FROM s ORDER BY score DESC, site LIMIT 10) UNION ALL SELECT 'exposure', site FROM (SELECT site FROM s ORDER BY raw DESC, site LIMIT 10)
UNION ALL SELECT 'unit_best', site FROM (SELECT site FROM u ORDER BY score DESC, site LIMIT 10) UNION ALL SELECT 'round_robin', site FROM (SELECT site FROM t ORDER BY t, region LIMIT 10)""",
)
def baselines(spark, d):
    e = stage3.exposure(spark, d).select("site", "raw")
    s = checkpointed(sites(spark, d).join(e, "site", "left").withColumn("raw", F.coalesce("raw", F.lit(0.0))))
    return R.baseline_plans(s, 10)


@query(
    "candidate_ladder",
    f"""WITH {SITES}, k AS (SELECT 'top' || n.n AS step, n.n, sum(score) AS covered FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY score DESC, site) AS k FROM sites) CROSS JOIN (VALUES (1), (3), (5)) n(n) WHERE k <= n.n GROUP BY 1, 2),
c AS (SELECT step, round(covered, 4) AS covered FROM k), w AS (SELECT covered AS w FROM c WHERE step = 'top5') SELECT step, covered, round(greatest(0, (w - covered) / w), 6) AS loss, CASE WHEN greatest(0, (w - covered) / w) <= 0.02 THEN 'retain' ELSE 'promote' END AS decision FROM c, w""",
)
def ladder(spark, d):
    order = Window.partitionBy("unit").orderBy(F.col("score").desc(), "site")
    s = sites(spark, d).withColumn("k", F.row_number().over(order))
    n = F.broadcast(spark.createDataFrame([(1,), (3,), (5,)], "n int"))
    steps = s.join(n, F.col("k") <= F.col("n")).groupBy(F.concat(F.lit("top"), F.col("n").cast("string")).alias("step")).agg(F.round(F.sum("score"), 4).alias("covered"))
    return R.candidate_ladder(steps, 0.02)


@query("seed_spread", "WITH pm AS (" + stage4.SQL["plan_metrics"] + ") " + " UNION ALL ".join(f"SELECT '{n}' AS metric, round(CAST(min({n}) AS DOUBLE), 6) AS least, round(CAST(max({n}) AS DOUBLE), 6) AS most, round(stddev_pop({n}), 6) AS sd FROM pm" for n in ("unique_population", "least_ratio", "hhi")))
def seed_spread(spark, d):
    return R.spread(stage4.metrics(spark, d), ["unique_population", "least_ratio", "hhi"])


@query(
    "gap_certification",
    f"""WITH g AS ({stage4.SQL['submodular_bound']}), t AS (SELECT bound, round(bound * 0.997, 4) AS incumbent FROM g) SELECT incumbent, bound, round((bound - incumbent) / incumbent, 6) AS gap, CAST((bound - incumbent) / incumbent <= 0.005 AS BIGINT) AS accepted FROM t""",
)
def gap_certification(spark, d):
    from siteward.operators.planning import GAP_ACCEPTED

    b = stage4.bound(spark, d).withColumn("incumbent", F.round(F.col("bound") * 0.997, 4))
    gap = (F.col("bound") - F.col("incumbent")) / F.col("incumbent")
    return b.select("incumbent", "bound", F.round(gap, 6).alias("gap"), (gap <= GAP_ACCEPTED).cast("long").alias("accepted"))
