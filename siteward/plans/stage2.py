"""Service gaps, bundles and seasons on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siteward.functions.stats import rank_percentile, safe_corr
from siteward.operators import gap as G
from siteward.operators import season as S
from siteward.plans.roles import GRID, PANEL, SUPPLY, panel, pct_sql, supply
from siteward.sources.tables import checkpointed, metric_bounds, table

QUERIES, SQL = {}, {}
STRENGTH = 50.0
HOLIDAYS = ["1996-01-01", "1996-12-25", "1997-01-01", "1997-12-25", "1998-01-01", "1998-12-25", "1999-01-01", "1999-12-25", "2000-01-01", "2000-12-25"]


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _grid(spark, d):
    s = supply(spark, d).select("unit", "item", "n")
    return G.dense_counts(s, "unit", "item", F.col("n"), "n").withColumn("n", F.col("n").cast("long"))


@query("supply_aggregation", f"WITH {SUPPLY}, {GRID} SELECT unit, item, CAST(n AS BIGINT) AS n, CAST(sum(n) OVER (PARTITION BY unit) AS BIGINT) AS d FROM grid")
def supply_aggregation(spark, d):
    return _grid(spark, d).withColumn("d", F.sum("n").over(Window.partitionBy("unit")))


_EB = f"{SUPPLY}, {GRID}, g AS (SELECT unit, item, n, sum(n) OVER (PARTITION BY unit) AS d FROM grid), eb AS (SELECT *, least(1, greatest(0, (n + {STRENGTH} * (sum(n) OVER (PARTITION BY item) / sum(d) OVER (PARTITION BY item))) / (d + {STRENGTH}))) AS share FROM g)"


@query("eb_share", f"WITH {_EB} SELECT unit, item, round(share, 8) AS share FROM eb")
def eb_share(spark, d):
    g = supply_aggregation(spark, d)
    return G.empirical_bayes_share(g, "n", "d", STRENGTH, "share", ["item"]).select("unit", "item", F.round("share", 8).alias("share"))


@query("access_excess", "SELECT s_suppkey AS site, round(greatest(0, ln(1 + (s_suppkey * 31) % 97) - ln(1 + (s_suppkey * 17) % 89)), 6) AS excess FROM supplier")
def access(spark, d):
    s = table(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("site"), F.round(G.access_excess(F.pmod(F.col("s_suppkey") * 31, F.lit(97)), F.pmod(F.col("s_suppkey") * 17, F.lit(89))), 6).alias("excess"))


@query(
    "supply_rate_gap",
    f"""WITH {SUPPLY}, p AS (SELECT c_nationkey AS unit, count(*) AS pop FROM customer GROUP BY 1), r AS (SELECT n_regionkey AS region, item, sum(n) AS n FROM supply JOIN nation ON unit = n_nationkey GROUP BY 1, 2),
q AS (SELECT n_regionkey AS region, sum(pop) AS pop FROM p JOIN nation ON unit = n_nationkey GROUP BY 1), t AS (SELECT region, item, n * 1000.0 / pop AS rate FROM r JOIN q USING (region))
SELECT region, item, round(rate, 6) AS rate, round(100 - 100 * {pct_sql('rate', 'item')}, 6) AS gap FROM t""",
)
def rate_gap(spark, d):
    n = F.broadcast(table(spark, d, "nation").select(F.col("n_nationkey").alias("unit"), F.col("n_regionkey").alias("region")))
    s = supply(spark, d).join(n, "unit").groupBy("region", "item").agg(F.sum("n").alias("n"))
    p = table(spark, d, "customer").select(F.col("c_nationkey").alias("unit")).join(n, "unit").groupBy("region").agg(F.count("*").alias("pop"))
    r = s.join(p, "region").withColumn("rate", F.col("n") * 1000.0 / F.col("pop"))
    return rank_percentile(r, "rate", "p", ["item"]).select("region", "item", F.round("rate", 6).alias("rate"), F.round(100 - 100 * F.col("p"), 6).alias("gap"))


def _components(spark, d):
    """need: how little of an item a unit supplies; extra: how its share differs from its other items."""
    g = eb_share(spark, d)
    g = G.differential(g, "unit", "share", "diff").withColumn("diff", F.round("diff", 8)).withColumn("scarce", -F.col("share"))
    g = rank_percentile(g, "scarce", "a", ["item"])
    g = rank_percentile(g, "diff", "b", ["item"])
    return g.select("unit", "item", F.round(F.col("a") * 100, 6).alias("need"), F.round(100 - F.col("b") * 100, 6).alias("extra"))


_COMP = f"{_EB}, e2 AS (SELECT unit, item, round(share, 8) AS share FROM eb), e3 AS (SELECT *, round(share - avg(share) OVER (PARTITION BY unit), 8) AS diff, -share AS less FROM e2), comp AS (SELECT unit, item, round(100 * {pct_sql('less', 'item')}, 6) AS need, round(100 - 100 * {pct_sql('diff', 'item')}, 6) AS extra FROM e3)"
W = {"need": 0.7, "extra": 0.3}
_ADD = "(0.7 * need + 0.3 * extra)"
_FORMULA = {
    "weighted_additive": _ADD,
    "bounded_geometric": "exp(0.7 * ln(greatest(need, 5)) + 0.3 * ln(greatest(extra, 5)))",
    "minimum_bottleneck_hybrid": f"0.7 * {_ADD} + 0.3 * least(need, extra)",
    "rank_composite": f"0.7 * 100 * {pct_sql('need')} + 0.3 * 100 * {pct_sql('extra')}",
}


def _gap(formula):
    def run(spark, d):
        g = G.combined(_components(spark, d), W, formula, "gap").withColumn("gap", F.round("gap", 6))
        return g.select("unit", "item", "gap", F.row_number().over(Window.partitionBy("item").orderBy(F.col("gap").desc(), "unit")).cast("long").alias("rank"))

    return run


for _name, _f in (("service_gap", "weighted_additive"), ("gap_formula_geometric", "bounded_geometric"), ("gap_formula_bottleneck", "minimum_bottleneck_hybrid"), ("gap_formula_rank", "rank_composite")):
    QUERIES[_name] = _gap(_f)
    SQL[_name] = f"WITH {_COMP}, t AS (SELECT unit, item, round({_FORMULA[_f]}, 6) AS gap FROM comp) SELECT unit, item, gap, row_number() OVER (PARTITION BY item ORDER BY gap DESC, unit) AS rank FROM t"

BUNDLES = [("alpha", "ECONOMY", 1.0), ("beta", "STANDARD", 0.4), ("beta", "PROMO", 0.6), ("gamma", "SMALL", 0.5), ("gamma", "MEDIUM", 0.3), ("gamma", "LARGE", 0.2)]


def _bundles(spark, d):
    """Weights over the items there are, in order of name: a bundle of one, of two and of the rest."""
    items = sorted(r["item"] for r in table(spark, d, "part").select(F.col("p_type").alias("item")).distinct().collect())  # a dimension
    return spark.createDataFrame([("one", items[0], 1.0), ("two", items[1], 0.4), ("two", items[2], 0.6)] + [("rest", i, 1.0 / (len(items) - 3)) for i in items[3:]], "bundle string, item string, w double")


_BUNDLE = f"""{_COMP}, sc AS (SELECT unit, item, round({_ADD}, 6) AS gap FROM comp), it AS (SELECT item, row_number() OVER (ORDER BY item) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT p_type AS item FROM part)),
bw AS (SELECT item, CASE WHEN i = 1 THEN 'one' WHEN i <= 3 THEN 'two' ELSE 'rest' END AS bundle, CASE WHEN i = 1 THEN 1.0 WHEN i = 2 THEN 0.4 WHEN i = 3 THEN 0.6 ELSE 1.0 / (n - 3) END AS w FROM it),
bs AS (SELECT unit, bundle, round(sum(w * gap), 6) AS score FROM sc JOIN bw USING (item) GROUP BY 1, 2)"""


@query("bundle_scores", f"WITH {_BUNDLE} SELECT unit, bundle, score, row_number() OVER (PARTITION BY bundle ORDER BY score DESC, unit) AS rank FROM bs")
def bundle_scores(spark, d):
    return G.bundle_scores(QUERIES["service_gap"](spark, d), _bundles(spark, d), "unit", "item", "gap")


@query(
    "service_ndcg",
    f"""WITH {_COMP}, x AS (SELECT unit, item, round({_ADD}, 6) AS gap FROM comp), y AS (SELECT unit, item, round({_FORMULA['minimum_bottleneck_hybrid']}, 6) AS gap FROM comp),
p AS (SELECT unit, item, 4 - row_number() OVER (PARTITION BY unit ORDER BY gap DESC, item) AS rel FROM x), q AS (SELECT unit, item, row_number() OVER (PARTITION BY unit ORDER BY gap DESC, item) AS q FROM y),
gg AS (SELECT q.unit, sum((pow(2.0, greatest(coalesce(rel, 0), 0)) - 1) / log2(q + 1.0)) AS dcg FROM q LEFT JOIN p ON p.unit = q.unit AND p.item = q.item AND rel > 0 WHERE q <= 3 GROUP BY 1)
SELECT unit, round(dcg / (7 / log2(2.0) + 3 / log2(3.0) + 1 / log2(4.0)), 6) AS ndcg3 FROM gg""",
)
def ndcg(spark, d):
    return G.ndcg3(QUERIES["service_gap"](spark, d), QUERIES["gap_formula_bottleneck"](spark, d), "unit", "item", "gap")


@query(
    "specialty_run_compare",
    f"""WITH {_COMP}, x AS (SELECT unit, item, round({_ADD}, 6) AS a, round({_FORMULA['bounded_geometric']}, 6) AS b FROM comp),
r AS (SELECT item, rank() OVER (PARTITION BY item ORDER BY a) + (count(*) OVER (PARTITION BY item, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY item ORDER BY b) + (count(*) OVER (PARTITION BY item, b) - 1) / 2.0 AS rb,
  row_number() OVER (PARTITION BY item ORDER BY a DESC, unit) AS pa, row_number() OVER (PARTITION BY item ORDER BY b DESC, unit) AS pb FROM x)
SELECT item, round(corr(ra, rb), 6) AS rho, count(*) FILTER (pa <= 5 AND pb <= 5) AS top5_shared FROM r GROUP BY 1""",
)
def specialty_compare(spark, d):
    a, b = QUERIES["service_gap"](spark, d).select("unit", "item", F.col("gap").alias("a"), F.col("rank").alias("pa")), QUERIES["gap_formula_geometric"](spark, d).select("unit", "item", F.col("gap").alias("b"), F.col("rank").alias("pb"))
    both = a.join(b, ["unit", "item"])
    over = lambda c: Window.partitionBy("item").orderBy(c)
    mean = lambda c: F.rank().over(over(c)) + (F.count("*").over(Window.partitionBy("item", c)) - 1) / 2.0
    both = both.withColumn("ra", mean("a")).withColumn("rb", mean("b"))
    return both.groupBy("item").agg(F.round(safe_corr("ra", "rb"), 6).alias("rho"), F.count_if((F.col("pa") <= 5) & (F.col("pb") <= 5)).alias("top5_shared"))


_CAL = f"""cal AS (SELECT CAST(year(day) AS BIGINT) AS year, CAST(month(day) AS BIGINT) AS month, count(*) AS calendar_days, count(*) FILTER (isodow(day) < 6 AND day NOT IN ({', '.join(f"DATE '{h}'" for h in HOLIDAYS)})) AS working_days
  FROM (SELECT CAST(unnest(generate_series(DATE '1996-01-01', DATE '2000-12-31', INTERVAL 1 DAY)) AS DATE) AS day) GROUP BY 1, 2)"""


@query("working_day_calendar", f"WITH {_CAL} SELECT * FROM cal")
def calendar(spark, d):
    return S.working_day_calendar(spark, 1996, 2000, HOLIDAYS)


_MOD = f"{PANEL}, {_CAL}, rt AS (SELECT p.*, value / working_days AS rate FROM panel p JOIN cal USING (year, month)), mm AS (SELECT *, rate / avg(rate) OVER (PARTITION BY region, item, year) AS m FROM rt), md AS (SELECT item, year, month, round(avg(m), 6) AS modifier FROM mm GROUP BY 1, 2, 3)"


@query("seasonal_modifiers", f"WITH {_MOD} SELECT * FROM md")
def modifiers(spark, d):
    return S.monthly_modifiers(panel(spark, d), calendar(spark, d), "region", "item", "value")


@query(
    "modifier_shrinkage",
    f"""WITH {_MOD}, b AS (SELECT item, month, x.modifier AS x, y.modifier AS y FROM (SELECT * FROM md WHERE year = 1998) x JOIN (SELECT * FROM md WHERE year = 1999) y USING (item, month)),
f AS (SELECT item, round(corr(x, y), 6) AS rho FROM b GROUP BY 1), t AS (SELECT item, rho, CASE WHEN rho >= 0.6 THEN 'high' WHEN rho >= 0.2 THEN 'medium' ELSE 'low' END AS tier FROM f)
SELECT item, month, rho, tier, round(least(greatest(1 + (CASE tier WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.5 ELSE 0.0 END) * ((x + y) / 2 - 1), 0.85), 1.15), 6) AS modifier FROM b JOIN t USING (item)""",
)
def shrinkage(spark, d):
    return S.shrunk_modifiers(checkpointed(modifiers(spark, d)), "item", 1998, 1999)


_HAZ = """h AS (SELECT user_id AS unit, CAST(day(ts) AS BIGINT) % 6 AS period, count(*) FILTER (value > 80) AS hot, count(*) FILTER (value < 20) AS cold FROM events GROUP BY 1, 2)"""


def _pos(c: str) -> str:
    return f"CASE WHEN {c} > 0 THEN 100 * (rank() OVER (PARTITION BY {c} > 0 ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0) / count(*) FILTER ({c} > 0) OVER () ELSE 0 END"


@query("hazard_risk_monthly", f"WITH {_HAZ} SELECT unit, period, hot, cold, round((0.6 * ({_pos('hot')}) + 0.4 * ({_pos('cold')})), 6) AS risk FROM h")
def hazard(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("unit"), F.pmod(F.dayofmonth("ts").cast("long"), F.lit(6)).alias("period"), "value")
    return S.hazard_risk(e, "unit", "period", "value", {"hot": (">", 80.0, 0.6), "cold": ("<", 20.0, 0.4)})


_FIT = f"""{PANEL}, pr AS (SELECT item AS bundle, month, avg(value) AS v FROM panel GROUP BY 1, 2), pp AS (SELECT bundle, month, round(100 * v / max(v) OVER (PARTITION BY bundle), 6) AS season_score FROM pr),
bu AS (SELECT n_nationkey AS unit, CAST((n_nationkey * 37) % 101 AS DOUBLE) AS base FROM nation), fit AS (SELECT unit, bundle, month, season_score, base, round(0.6 * season_score + 0.4 * base, 6) AS fit FROM bu CROSS JOIN pp)"""


def _fit(spark, d):
    pr = panel(spark, d).groupBy(F.col("item").alias("bundle"), "month").agg(F.avg("value").alias("v"))
    pp = pr.select("bundle", "month", F.round(100 * F.col("v") / F.max("v").over(Window.partitionBy("bundle")), 6).alias("season_score"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("unit"), F.pmod(F.col("n_nationkey") * 37, F.lit(101)).cast("double").alias("base"))
    return S.month_fit(n, pp, "unit", "bundle", "base", 0.6)


@query("region_bundle_month_fit", f"WITH {_FIT} SELECT unit, bundle, month, fit FROM fit")
def month_fit(spark, d):
    return _fit(spark, d).select("unit", "bundle", "month", "fit")


@query(
    "primary_fallback_month",
    f"""WITH {_FIT}, a AS (SELECT unit, bundle, month AS primary_month, fit AS primary_fit FROM fit QUALIFY row_number() OVER (PARTITION BY unit, bundle ORDER BY fit DESC, month) = 1),
b AS (SELECT unit, bundle, month AS fallback_month, fit AS fallback_fit FROM fit JOIN a USING (unit, bundle) WHERE (month - 1) // 3 <> (primary_month - 1) // 3 QUALIFY row_number() OVER (PARTITION BY unit, bundle ORDER BY fit DESC, month) = 1)
SELECT * FROM a LEFT JOIN b USING (unit, bundle)""",
)
def primary_fallback(spark, d):
    return S.primary_fallback(_fit(spark, d), ["unit", "bundle"])


_SEASON = f"""{_FIT}, ss AS (SELECT unit, bundle, CASE WHEN month IN (12, 1, 2) THEN 'winter' WHEN month <= 5 THEN 'spring' WHEN month <= 8 THEN 'summer' ELSE 'autumn' END AS season, fit FROM fit),
sm AS (SELECT unit, bundle, season, round(avg(fit), 6) AS fit FROM ss GROUP BY 1, 2, 3), sr AS (SELECT *, row_number() OVER (PARTITION BY unit, bundle ORDER BY fit DESC, CASE season WHEN 'winter' THEN 0 WHEN 'spring' THEN 1 WHEN 'summer' THEN 2 ELSE 3 END) AS k FROM sm),
sf AS (SELECT unit, bundle, max(season) FILTER (k = 1) AS first, max(season) FILTER (k = 2) AS second, round(max(fit) FILTER (k = 1) - max(fit) FILTER (k = 2), 6) AS margin FROM sr GROUP BY 1, 2)"""


@query("season_fit", f"WITH {_SEASON} SELECT * FROM sf")
def season_fit(spark, d):
    return S.season_fit(_fit(spark, d), ["unit", "bundle"])


@query("season_release", f"WITH {_SEASON} SELECT unit, bundle, CASE WHEN margin >= 0.5 THEN first END AS first, CASE WHEN margin >= 0.5 THEN second END AS second, margin, CAST(CASE WHEN margin >= 0.5 THEN 1 ELSE 0 END AS BIGINT) AS signal FROM sf")
def season_release(spark, d):
    return S.released(season_fit(spark, d), 0.5)


@query(
    "cross_year_transfer",
    f"""WITH {PANEL}, t AS (SELECT region, item, month, value AS vt, row_number() OVER (PARTITION BY region, item ORDER BY value DESC, month) AS rt FROM panel WHERE year = 1998),
h AS (SELECT region, item, month, value AS vh, row_number() OVER (PARTITION BY region, item ORDER BY value DESC, month) AS rh FROM panel WHERE year = 1999), b AS (SELECT * FROM t JOIN h USING (region, item, month)),
g AS (SELECT region, item, max(month) FILTER (rt = 1) AS train_month, max(month) FILTER (rh = 1) AS held_month, max(rh) FILTER (rt = 1) AS place, max(vh) FILTER (rh = 1) AS best, max(vh) FILTER (rt = 1) AS got,
  CASE WHEN stddev_pop(vt) > 1e-15 AND stddev_pop(vh) > 1e-15 THEN round(corr(vt, vh), 6) END AS rho FROM b GROUP BY 1, 2)
SELECT region, item, train_month, held_month, CAST(place = 1 AS BIGINT) AS top1, CAST(place <= 2 AS BIGINT) AS top2, round((best - got) / best, 6) AS regret, rho FROM g""",
)
def transfer(spark, d):
    return S.cross_year_transfer(checkpointed(panel(spark, d)), ["region", "item"], 1998, 1999)


@query(
    "cross_year_consensus",
    f"""WITH {PANEL}, r AS (SELECT *, row_number() OVER (PARTITION BY region, item, year ORDER BY value DESC, month) AS r FROM panel),
c AS (SELECT region, item, month, round(avg(r), 6) AS mean_rank, max(r) AS worst_rank, CAST(sum(12 - r) AS BIGINT) AS borda FROM r GROUP BY 1, 2, 3)
SELECT *, row_number() OVER (PARTITION BY region, item ORDER BY mean_rank, worst_rank, month) AS place FROM c""",
)
def consensus(spark, d):
    return S.consensus(panel(spark, d), ["region", "item"])


def _left_out(col: str, typed: str) -> str:
    return f"""WITH {PANEL}, x AS (SELECT DISTINCT {col} AS removed FROM panel), k AS (SELECT removed, item, month, round(avg(value), 6) AS value FROM panel JOIN x ON {col} <> removed GROUP BY 1, 2, 3)
SELECT removed, item, month AS best, value FROM k QUALIFY row_number() OVER (PARTITION BY removed, item ORDER BY value DESC, month) = 1"""


@query("lomo", _left_out("month", "BIGINT"))
def lomo(spark, d):
    return S.leave_out(checkpointed(panel(spark, d)), "month", "item", "month")


@query("loso", _left_out("region", "INTEGER"))
def loso(spark, d):
    return S.leave_out(checkpointed(panel(spark, d)), "region", "item", "month")


@query(
    "month_permutation_null",
    f"""WITH {PANEL}, p AS (SELECT item, year, month, sum(value) AS value FROM panel GROUP BY 1, 2, 3), v AS (SELECT item, month, avg(value) AS v FROM p GROUP BY 1, 2), b AS (SELECT item, round(max(v) - avg(v), 6) AS spread FROM v GROUP BY 1),
m AS (SELECT p.*, r.r, row_number() OVER (PARTITION BY item, year, r.r ORDER BY (month * 7919 + r.r * 104729 + year * 31) % 1009, month) AS label FROM p CROSS JOIN range(1, 100) r(r)),
n AS (SELECT item, r, label, avg(value) AS v FROM m GROUP BY 1, 2, 3), s AS (SELECT item, r, round(max(v) - avg(v), 6) AS null_spread FROM n GROUP BY 1, 2)
SELECT item, spread, round((1 + count(*) FILTER (null_spread >= spread)) / (count(*) + 1), 6) AS p_value FROM s JOIN b USING (item) GROUP BY 1, 2""",
)
def permutation(spark, d):
    p = checkpointed(panel(spark, d).groupBy("item", "year", "month").agg(F.sum("value").alias("value")))
    return S.permutation_null(p, ["item"], 99)


@query(
    "common_shock",
    f"""WITH {PANEL}, y AS (SELECT item, year, sum(value) AS v FROM panel GROUP BY 1, 2), r AS (SELECT a.item, a.year, b.v / a.v AS ratio FROM y a JOIN y b ON a.item = b.item AND b.year = a.year + 1)
SELECT year, round(exp(avg(ln(ratio))), 6) AS shock, count(*) AS items FROM r GROUP BY 1""",
)
def common_shock(spark, d):
    y = panel(spark, d).groupBy("item", "year").agg(F.sum("value").alias("v"))
    a, b = y.select("item", "year", F.col("v").alias("x")), y.select("item", (F.col("year") - 1).alias("year"), F.col("v").alias("y"))
    return a.join(b, ["item", "year"]).groupBy("year").agg(F.round(F.exp(F.avg(F.log(F.col("y") / F.col("x")))), 6).alias("shock"), F.count("*").alias("items"))


@query(
    "suppression_bounds",
    """WITH m AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN '*' WHEN o_orderkey % 3 = 0 THEN '1,2' || (o_orderkey % 90 + 10) ELSE CAST(o_orderkey % 500 AS VARCHAR) END AS raw FROM orders)
SELECT id, TRY_CAST(replace(trim(raw), ',', '') AS DOUBLE) AS value, CASE WHEN raw = '*' THEN 0.0::DOUBLE ELSE TRY_CAST(replace(raw, ',', '') AS DOUBLE) END AS low, CASE WHEN raw = '*' THEN 4.0::DOUBLE ELSE TRY_CAST(replace(raw, ',', '') AS DOUBLE) END AS high FROM m""",
)
def suppression(spark, d):
    k = F.col("o_orderkey")
    raw = F.when(k % 10 == 0, "*").when(k % 3 == 0, F.concat(F.lit("1,2"), (k % 90 + 10).cast("string"))).otherwise((k % 500).cast("string"))
    v, low, high = metric_bounds(F.col("raw"))
    return table(spark, d, "orders").select(k.alias("id"), raw.alias("raw")).select("id", v.alias("value"), low.alias("low"), high.alias("high"))


@query(
    "bundle_differentiation",
    f"""WITH {_FIT}, t AS (SELECT unit, bundle, fit / sum(fit) OVER (PARTITION BY unit, bundle) AS p FROM fit)
SELECT unit, bundle, round(-sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) / ln(count(*)), 6) AS entropy FROM t GROUP BY 1, 2""",
)
def differentiation(spark, d):
    f = _fit(spark, d).withColumn("p", F.col("fit") / F.sum("fit").over(Window.partitionBy("unit", "bundle")))
    return f.groupBy("unit", "bundle").agg(F.round(-F.sum(F.when(F.col("p") > 0, F.col("p") * F.log("p")).otherwise(0.0)) / F.log(F.count("*").cast("double")), 6).alias("entropy"))


RULES = [("STRONG_SINGLE", 2.0, 0.5), ("ROBUST_PAIR", 0.5, 0.0)]


@query("release_classifier", f"WITH {_SEASON} SELECT unit, bundle, margin, CASE WHEN margin >= 2.0 THEN 'STRONG_SINGLE' WHEN margin >= 0.5 THEN 'ROBUST_PAIR' ELSE 'NO_STRONG_PREFERENCE' END AS release FROM sf")
def release(spark, d):
    label = F.when(F.col("margin") >= RULES[0][1], RULES[0][0]).when(F.col("margin") >= RULES[1][1], RULES[1][0]).otherwise("NO_STRONG_PREFERENCE")
    return season_fit(spark, d).select("unit", "bundle", "margin", label.alias("release"))


@query(
    "boundary_sensitivity",
    f"""WITH {_FIT}, s AS (SELECT k.k AS shift, unit, bundle, ((month - 1 + 12 - k.k) % 12) // 3 AS part, fit FROM fit CROSS JOIN range(3) k(k)), m AS (SELECT shift, unit, bundle, part, round(avg(fit), 6) AS v FROM s GROUP BY 1, 2, 3, 4)
SELECT shift, unit, bundle, part, v FROM m QUALIFY row_number() OVER (PARTITION BY shift, unit, bundle ORDER BY v DESC, part) = 1""",
)
def boundary(spark, d):
    shifts = spark.range(3).withColumnRenamed("id", "shift")
    s = _fit(spark, d).crossJoin(F.broadcast(shifts)).withColumn("part", F.floor(F.pmod(F.col("month") - 1 + 12 - F.col("shift"), F.lit(12)) / 3).cast("long"))
    m = s.groupBy("shift", "unit", "bundle", "part").agg(F.round(F.avg("fit"), 6).alias("v"))
    return m.withColumn("k", F.row_number().over(Window.partitionBy("shift", "unit", "bundle").orderBy(F.col("v").desc(), "part"))).filter("k = 1").drop("k")
