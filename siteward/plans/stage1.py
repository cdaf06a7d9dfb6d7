"""Need scores on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteward.functions.scalers import scaled, scaled_by_group, transformed, turned
from siteward.operators import need as N
from siteward.plans.roles import UNITS, pct_sql, units
from siteward.sources.tables import table

FEATURES = (
    N.Feature("orders_n", "volume", "demand"),
    N.Feature("urgent_n", "volume", "demand"),
    N.Feature("spend", "value", "demand", 1, "log1p"),
    N.Feature("balance", "means", "wealth", -1),
    N.Feature("nation_spend", "context", "context", 1, "identity", "nation"),
)
WEIGHTS = {"demand": 0.5, "wealth": 0.3, "context": 0.2}
NAMES = ["orders_n", "urgent_n", "spend", "balance", "nation_spend"]
QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return add


def _both(method):
    def run(spark, d):
        u = units(spark, d).select("unit", "spend")
        up = scaled(u, "spend", "up", method, 1)
        return up.select("unit", F.round("up", 6).alias("up"), F.round(turned(F.col("up"), -1), 6).alias("down"))

    return run


_Q = "q AS (SELECT quantile_cont(spend, 0.01) AS lo, quantile_cont(spend, 0.99) AS hi, median(spend) AS m, quantile_cont(spend, 0.25) AS q1, quantile_cont(spend, 0.75) AS q3 FROM units)"
_OUT = "SELECT unit, round(greatest(least(s, 100), 0), 6) AS up, round(greatest(least(100 - s, 100), 0), 6) AS down FROM t"
QUERIES["scaler_rank_pct"] = _both("rank_percentile")
SQL["scaler_rank_pct"] = f"WITH {UNITS}, t AS (SELECT unit, 100 * {pct_sql('spend')} AS s FROM units) {_OUT}"
QUERIES["scaler_winsor_pct"] = _both("winsorized_percentile")
SQL["scaler_winsor_pct"] = f"WITH {UNITS}, {_Q}, w AS (SELECT unit, least(greatest(spend, lo), hi) AS v FROM units, q), t AS (SELECT unit, 100 * {pct_sql('v')} AS s FROM w) {_OUT}"
QUERIES["scaler_robust_minmax"] = _both("robust_minmax")
SQL["scaler_robust_minmax"] = f"WITH {UNITS}, {_Q}, t AS (SELECT unit, CASE WHEN hi > lo THEN (least(greatest(spend, lo), hi) - lo) / (hi - lo) * 100 ELSE 50 END AS s FROM units, q) {_OUT}"
QUERIES["scaler_robust_z"] = _both("robust_z")
SQL["scaler_robust_z"] = f"""WITH {UNITS}, {_Q}, k AS (SELECT median(abs(spend - m)) AS mad FROM units, q),
t AS (SELECT unit, (CASE WHEN w > 0 THEN least(greatest((spend - m) / w, -3), 3) ELSE 0 END + 3) / 6 * 100 AS s
  FROM units, q, (SELECT CASE WHEN mad > 0 THEN 1.4826 * mad ELSE (q3 - q1) / 1.349 END AS w FROM k, q)) {_OUT}"""


@query(
    "transform_log1p_sqrt_binary",
    "SELECT p_partkey AS part, round(ln(1 + p_retailprice), 6) AS log_price, round(sqrt(p_size), 6) AS root_size, CAST(CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS DOUBLE) AS large FROM part",
)
def transforms(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("part"), F.round(transformed(F.col("p_retailprice"), "log1p"), 6).alias("log_price"), F.round(transformed(F.col("p_size"), "sqrt"), 6).alias("root_size"), transformed(F.col("p_size") - 25, "binary").alias("large"))


@query(
    "region_repeated_scaling",
    f"WITH {UNITS}, g AS (SELECT DISTINCT nation, nation_spend AS v FROM units), s AS (SELECT nation, 100 * {pct_sql('v')} AS s FROM g) SELECT unit, nation, round(s, 6) AS score FROM units JOIN s USING (nation)",
)
def region_repeated(spark, d):
    u = units(spark, d).select("unit", "nation", "nation_spend")
    return scaled_by_group(u, "nation", "nation_spend", "score", method="rank_percentile").select("unit", "nation", F.round("score", 6).alias("score"))


def _winsor(table_: str, x: str, key: str, out: str, down: bool = False) -> str:
    v = f"(SELECT {key}, least(greatest({x}, lo), hi) AS v FROM {table_}, (SELECT quantile_cont({x}, 0.01) AS lo, quantile_cont({x}, 0.99) AS hi FROM {table_}))"
    s = f"100 * {pct_sql('v')}"
    return f"{out} AS (SELECT {key}, {'100 - ' + s if down else s} AS s FROM {v})"


_MATRIX = f"""{UNITS}, ul AS (SELECT *, ln(1 + spend) AS ls FROM units), nn AS (SELECT DISTINCT nation, nation_spend FROM units),
{_winsor('units', 'orders_n', 'unit', 'f1')}, {_winsor('units', 'urgent_n', 'unit', 'f2')}, {_winsor('ul', 'ls', 'unit', 'f3')}, {_winsor('units', 'balance', 'unit', 'f4', True)}, {_winsor('nn', 'nation_spend', 'nation', 'f5')},
m AS (SELECT unit, nation, f1.s AS a, f2.s AS b, f3.s AS c, f4.s AS d, f5.s AS e FROM units JOIN f1 USING (unit) JOIN f2 USING (unit) JOIN f3 USING (unit) JOIN f4 USING (unit) JOIN f5 USING (nation))"""
_SCORE = f"{_MATRIX}, sc AS (SELECT unit, round(0.5 * (((a + b) / 2 + c) / 2) + 0.3 * d + 0.2 * e, 6) AS score FROM m)"


@query(
    "need_score",
    f"WITH {_SCORE} SELECT unit, score, row_number() OVER (ORDER BY score DESC, unit) AS rank, rank() OVER (ORDER BY score DESC) AS tied_rank, count(*) OVER (PARTITION BY score) AS tie_size FROM sc",
)
def need_score(spark, d):
    return N.need_score(units(spark, d), FEATURES, WEIGHTS)


def _drop(name: str) -> str:
    """The score without one feature, its group and axis closing ranks."""
    vol = {"a": "b", "b": "a"}.get(name, "(a + b) / 2")
    dem = f"{vol}" if name == "c" else f"(({vol}) + c) / 2"
    parts = [("0.5", dem)] + ([] if name == "d" else [("0.3", "d")]) + ([] if name == "e" else [("0.2", "e")])
    return f"round(({' + '.join(f'{w} * ({x})' for w, x in parts)}) / ({' + '.join(w for w, _ in parts)}), 6)"


def _fifty(name: str) -> str:
    v = {k: ("50" if k == name else k) for k in "abcde"}
    return f"round(0.5 * (((({v['a']} + {v['b']}) / 2.0) + {v['c']}) / 2.0) + 0.3 * {v['d']} + 0.2 * {v['e']}, 6)"


_RUNS = " UNION ALL ".join(
    [f"SELECT 'baseline' AS scenario, unit, {_fifty('')} AS score FROM m"]
    + [f"SELECT 'renormalize_{n}' AS scenario, unit, {_drop(k)} AS score FROM m UNION ALL SELECT 'neutral_{n}' AS scenario, unit, {_fifty(k)} AS score FROM m" for k, n in zip("abcde", NAMES, strict=True)]
)


@query("need_ablation_grid", f"WITH {_MATRIX} {_RUNS}")
def ablation_grid(spark, d):
    return N.ablation(units(spark, d), FEATURES, WEIGHTS)


_RANKS = "row_number() OVER (ORDER BY {s} DESC, unit)"
_COMPARE = """cmp AS (SELECT b.unit, b.score AS x, v.score AS y FROM base b JOIN var v USING (unit)),
rk AS (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry,
  row_number() OVER (ORDER BY x DESC, unit) AS px, row_number() OVER (ORDER BY y DESC, unit) AS py FROM cmp)"""


def _jac(k: int) -> str:
    return f"round(count(*) FILTER (px <= {k} AND py <= {k}) / count(*) FILTER (px <= {k} OR py <= {k}), 6) AS top{k}_jaccard"


@query(
    "score_run_comparison",
    f"""WITH {_MATRIX}, base AS (SELECT unit, {_fifty('')} AS score FROM m), var AS (SELECT unit, {_drop('d')} AS score FROM m), {_COMPARE}
SELECT count(*) AS n, round(avg(abs(y - x)), 6) AS mae, round(sqrt(avg((y - x) * (y - x))), 6) AS rmse, round(corr(rx, ry), 6) AS spearman, round(median(abs(py - px)), 6) AS shift_median,
round(quantile_cont(abs(py - px), 0.95), 6) AS shift_p95, max(abs(py - px)) AS shift_max, {_jac(10)}, {_jac(20)}, {_jac(30)} FROM rk""",
)
def run_comparison(spark, d):
    runs = N.ablation(units(spark, d), FEATURES, WEIGHTS)
    pick = lambda s: runs.filter(F.col("scenario") == s).select("unit", "score")
    return N.compare_runs(pick("baseline"), pick("renormalize_balance"))


@query(
    "kendall_tau_nations",
    """WITH n AS (SELECT c_nationkey AS k, round(sum(c_acctbal), 2) AS x, count(*) AS y FROM customer GROUP BY 1)
SELECT round(sum(sign(a.x - b.x) * sign(a.y - b.y)) / (sqrt(sum(abs(sign(a.x - b.x)))) * sqrt(sum(abs(sign(a.y - b.y))))), 6) AS tau FROM n a JOIN n b ON a.k < b.k""",
)
def kendall(spark, d):
    n = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.round(F.sum("c_acctbal"), 2).alias("x"), F.count("*").alias("y"))
    return N.kendall_tau_b(n, "x", "y").select(F.round("tau", 6).alias("tau"))


@query(
    "kendall_tau_units",
    f"""WITH {UNITS}, n AS (SELECT unit AS k, orders_n AS x, spend AS y FROM units)
SELECT round(sum(sign(a.x - b.x) * sign(a.y - b.y)) / (sqrt(sum(abs(sign(a.x - b.x)))) * sqrt(sum(abs(sign(a.y - b.y))))), 6) AS tau FROM n a JOIN n b ON a.k < b.k""",
)
def kendall_units(spark, d):
    """All customers: number of orders against what they spent."""
    return N.kendall_tau_b(units(spark, d), "orders_n", "spend").select(F.round("tau", 6).alias("tau"))


@query(
    "score_inequality",
    f"""WITH {_SCORE}, r AS (SELECT score AS v, row_number() OVER (ORDER BY score) AS i FROM sc), g AS (SELECT 2 * sum(i * v) / (count(*) * sum(v)) - (count(*) + 1) / count(*) AS g FROM r),
s AS (SELECT region, sum(score) AS s FROM sc JOIN units USING (unit) GROUP BY 1), p AS (SELECT region, sum(spend) AS s FROM units GROUP BY 1)
SELECT round((SELECT g FROM g), 6) AS gini, round((SELECT sum(s * s) / (sum(s) * sum(s)) FROM s), 6) AS hhi, round((SELECT sum(abs(s.s / (SELECT sum(s) FROM s) - p.s / (SELECT sum(s) FROM p))) / 2 FROM s JOIN p USING (region)), 6) AS tvd""",
)
def inequality(spark, d):
    u = units(spark, d)
    scored = N.need_score(u, FEATURES, WEIGHTS).join(u.select("unit", "region", "spend"), "unit")
    g = N.gini(scored, "score")
    from siteward.functions.stats import hhi

    h = scored.groupBy("region").agg(F.sum("score").alias("s")).agg(hhi("s").alias("hhi"))
    t = N.total_variation(N.region_distribution(scored, "region", "score"), N.region_distribution(scored, "region", "spend"), "region")
    return g.crossJoin(h).crossJoin(t).select(F.round("gini", 6).alias("gini"), F.round("hhi", 6).alias("hhi"), F.round("tvd", 6).alias("tvd"))


def _rank(x: str) -> str:
    return f"rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0"


_PAIRS = [(a, b) for i, a in enumerate(NAMES) for b in NAMES[i + 1 :]]
_RANKED = f"{UNITS}, r AS (SELECT unit, {', '.join(f'{_rank(n)} AS {n}' for n in NAMES)} FROM units)"


@query("spearman_pairs", f"WITH {_RANKED} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round(corr({a}, {b}), 6) AS rho FROM r" for a, b in _PAIRS))
def spearman(spark, d):
    return N.spearman_pairs(units(spark, d), "unit", NAMES)


@query(
    "high_corr_ledger",
    f"WITH {_RANKED}, p AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS rho FROM r" for a, b in _PAIRS) + ") SELECT a, b, rho, CASE WHEN abs(rho) >= 0.8 THEN 'near' WHEN abs(rho) >= 0.5 THEN 'related' ELSE 'weak' END AS grade FROM p WHERE abs(rho) >= 0.3",
)
def ledger(spark, d):
    p = N.spearman_pairs(units(spark, d), "unit", NAMES).filter(F.abs("rho") >= 0.3)
    return p.select("a", "b", "rho", F.when(F.abs("rho") >= 0.8, "near").when(F.abs("rho") >= 0.5, "related").otherwise("weak").alias("grade"))


@query(
    "corr_quality",
    f"WITH {_RANKED}, p AS (" + " UNION ALL ".join(f"SELECT abs(round(corr({a}, {b}), 6)) AS v, {1 if {a, b} <= {'orders_n', 'urgent_n', 'spend'} else 0} AS inside FROM r" for a, b in _PAIRS) + """)
SELECT round(median(v) FILTER (inside = 1), 6) AS within_median, round(median(v) FILTER (inside = 0), 6) AS between_median, count(*) FILTER (v >= 0.8) AS high_pairs FROM p""",
)
def corr_quality(spark, d):
    inside = F.col("a").isin("orders_n", "urgent_n", "spend") & F.col("b").isin("orders_n", "urgent_n", "spend")
    p = N.spearman_pairs(units(spark, d), "unit", NAMES).select(F.abs("rho").alias("v"), inside.alias("inside"))
    return p.agg(F.round(F.median(F.when(F.col("inside"), F.col("v"))), 6).alias("within_median"), F.round(F.median(F.when(~F.col("inside"), F.col("v"))), 6).alias("between_median"), F.count_if(F.col("v") >= 0.8).alias("high_pairs"))


@query(
    "partial_spearman",
    f"""WITH {_RANKED}, f AS (SELECT regr_slope(spend, orders_n) AS sx, regr_intercept(spend, orders_n) AS ix, regr_slope(balance, orders_n) AS sy, regr_intercept(balance, orders_n) AS iy FROM r)
SELECT round(corr(spend - sx * orders_n - ix, balance - sy * orders_n - iy), 6) AS rho FROM r, f""",
)
def partial(spark, d):
    return N.partial_spearman(units(spark, d), "unit", "spend", "balance", "orders_n")


@query(
    "mixed_granularity_spearman",
    f"""WITH {UNITS}, g AS (SELECT nation, median(balance) AS balance, first(nation_spend) AS s FROM units GROUP BY 1),
r AS (SELECT {_rank('balance')} AS rb, {_rank('s')} AS rs FROM g) SELECT count(*) AS n, round(corr(rb, rs), 6) AS rho FROM r""",
)
def mixed(spark, d):
    g = units(spark, d).groupBy("nation").agg(F.median("balance").alias("balance"), F.max("nation_spend").alias("nation_spend"))
    return N.spearman_pairs(g, "nation", ["balance", "nation_spend"]).select("n", "rho")


@query(
    "feature_manifest",
    f"WITH {UNITS} " + " UNION ALL ".join(f"SELECT '{n}' AS feature, count(*) AS n, count(*) - count({n}) AS nulls, count(DISTINCT {n}) AS uniques, CAST(CASE WHEN count(DISTINCT {n}) <= 1 THEN 1 ELSE 0 END AS BIGINT) AS constant FROM units" for n in NAMES),
)
def manifest(spark, d):
    return N.feature_manifest(units(spark, d), NAMES)


GATES = (("spearman_min", "spearman", ">=", 0.9), ("shift_p95_max", "shift_p95", "<=", 200.0), ("top20_min", "top20_jaccard", ">=", 0.5))


@query(
    "quality_gates",
    f"""WITH {_MATRIX}, base AS (SELECT unit, {_fifty('')} AS score FROM m), var AS (SELECT unit, {_drop('d')} AS score FROM m), {_COMPARE},
v AS (SELECT round(corr(rx, ry), 6) AS spearman, round(quantile_cont(abs(py - px), 0.95), 6) AS shift_p95, {_jac(20)} FROM rk) """
    + " UNION ALL ".join(f"SELECT '{g}' AS gate_id, round(CAST({c} AS DOUBLE), 6) AS observed, '{op}' AS comparison, CAST({t} AS DOUBLE) AS threshold, CAST(CASE WHEN {c} {op} {t} THEN 1 ELSE 0 END AS BIGINT) AS passed FROM v" for g, c, op, t in GATES),
)
def gates(spark, d):
    return N.quality_gates(run_comparison(spark, d), GATES)


@query(
    "block_bootstrap",
    f"""WITH {UNITS}, s AS (SELECT nation, sum(balance) AS s, count(balance) AS c, row_number() OVER (ORDER BY nation) - 1 AS i FROM units GROUP BY 1), n AS (SELECT count(*) AS n FROM s),
d AS (SELECT r.r AS replicate, (1 + r.r * 7919 + k.k * 104729 + r.r * k.k * 31) % n.n AS i FROM range(50) r(r), n, range(1000) k(k) WHERE k.k < n.n)
SELECT replicate, round(sum(s) / sum(c), 6) AS mean FROM d JOIN s USING (i) GROUP BY 1""",
)
def bootstrap(spark, d):
    return N.block_bootstrap(units(spark, d), "nation", "balance", 50)
