"""Residual ranks and the bootstrap of correlation quality over the driver's units."""

from __future__ import annotations

from siteward.operators import correlation as K
from siteward.plans.roles import UNITS, pct_sql, units
from siteward.plans.stage1 import NAMES
from siteward.sources.tables import checkpointed

QUERIES, SQL = {}, {}
REPLICATES = 200
AXES = {"orders_n": "volume", "urgent_n": "volume", "spend": "volume", "balance": "wealth", "nation_spend": "wealth"}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_P = f"WITH {UNITS}, p AS (SELECT unit, region, {', '.join(f'{pct_sql(n)} AS {n}' for n in NAMES)} FROM units)"


def _stepwise(features, controls, by=""):
    """Controls made orthogonal one after another and taken out of the features: the same residuals as least squares."""
    over = f"OVER (PARTITION BY {by})" if by else "OVER ()"
    names = [*controls, *features]
    out = [f"s0 AS (SELECT unit, {', '.join(f'{n} - avg({n}) {over} AS {n}' for n in names)} FROM p)"]
    for i, c in enumerate(controls):
        rest = [n for n in names if n not in controls[: i + 1]]
        out.append(f"s{i + 1} AS (SELECT unit, {', '.join(f'{n} - {c} * coalesce(sum({n} * {c}) OVER () / nullif(sum({c} * {c}) OVER (), 0), 0) AS {n}' for n in rest)} FROM s{i})")
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    return ", ".join(out) + " " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round(corr({a}, {b}), 6) AS rho FROM s{len(controls)}" for a, b in pairs)


@query("residual_pairs_one_control", f"{_P}, {_stepwise(['spend', 'balance', 'urgent_n'], ['orders_n'])}")
def one(spark, d):
    return K.residual_pairs(units(spark, d), "unit", ["spend", "balance", "urgent_n"], ["orders_n"])


@query("residual_pairs_three_controls", f"{_P}, {_stepwise(['spend', 'balance'], ['orders_n', 'urgent_n', 'nation_spend'])}")
def three(spark, d):
    return K.residual_pairs(units(spark, d), "unit", ["spend", "balance"], ["orders_n", "urgent_n", "nation_spend"])


@query("residual_pairs_by_region", f"{_P}, {_stepwise(['spend', 'balance', 'urgent_n'], ['orders_n', 'nation_spend'], 'region')}")
def by_region(spark, d):
    return K.residual_pairs(units(spark, d), "unit", ["spend", "balance", "urgent_n"], ["orders_n", "nation_spend"], "region")


def pairs(spark, d):
    return checkpointed(K.bootstrap_pairs(units(spark, d), "unit", "nation", NAMES, REPLICATES))


_PAIRS = [(a, b) for i, a in enumerate(NAMES) for b in NAMES[i + 1 :]]
_rk = lambda n: f"rank() OVER (PARTITION BY replicate ORDER BY {n}) + (count(*) OVER (PARTITION BY replicate, {n}) - 1) / 2.0 AS {n}"
#: Copies of whole blocks, ranked and correlated anew in each replicate.
_BOOT = f"""WITH {UNITS}, bl AS (SELECT nation, row_number() OVER (ORDER BY nation) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT nation FROM units)),
dr AS (SELECT r.r AS replicate, nation FROM range({REPLICATES}) r(r), range(1000) k(k), bl WHERE k.k < n AND i = (1 + r.r * 7919 + k.k * 104729 + r.r * k.k * 31) % n UNION ALL SELECT -1, nation FROM bl),
cp AS (SELECT replicate, {', '.join(_rk(n) for n in NAMES)} FROM dr JOIN units USING (nation)),
sd AS (SELECT replicate, {', '.join(f'stddev_pop({n}) > 1e-9 AS v_{n}' for n in NAMES)}, {', '.join(f'corr({a}, {b}) AS c_{a}_{b}' for a, b in _PAIRS)} FROM cp GROUP BY 1),
pr AS ({' UNION ALL '.join(f"SELECT replicate, '{a}' AS a, '{b}' AS b, CASE WHEN v_{a} AND v_{b} THEN round(c_{a}_{b}, 9) END AS rho FROM sd" for a, b in _PAIRS)})"""
_AX = "CASE WHEN {0} IN ('balance', 'nation_spend') THEN 'wealth' ELSE 'volume' END"
_STATS = """count(value) FILTER (replicate >= 0) AS n, round(max(value) FILTER (replicate = -1), 6) AS point, round(avg(value) FILTER (replicate >= 0), 6) AS mean, round(stddev_samp(value) FILTER (replicate >= 0), 6) AS sd,
round(quantile_cont(value, 0.05) FILTER (replicate >= 0), 6) AS low, round(median(value) FILTER (replicate >= 0), 6) AS middle, round(quantile_cont(value, 0.95) FILTER (replicate >= 0), 6) AS high"""


@query(
    "bootstrap_quality",
    f"""{_BOOT}, ax AS (SELECT replicate, abs(rho) AS v, {_AX.format('a')} = {_AX.format('b')} AS same FROM pr WHERE rho IS NOT NULL),
rk AS (SELECT *, rank() OVER (PARTITION BY replicate ORDER BY v) + (count(*) OVER (PARTITION BY replicate, v) - 1) / 2.0 AS r FROM ax),
q AS (SELECT replicate, median(v) AS median_all, median(v) FILTER (same) AS median_within, median(v) FILTER (NOT same) AS median_between, median(v) FILTER (same) - median(v) FILTER (NOT same) AS contrast,
  (sum(r) FILTER (same) - count(*) FILTER (same) * (count(*) FILTER (same) + 1) / 2.0) / nullif(count(*) FILTER (same) * count(*) FILTER (NOT same), 0) AS auc,
  count(*) FILTER (NOT same AND v >= 0.8) / nullif(count(*) FILTER (NOT same), 0) AS cross_80, count(*) FILTER (NOT same AND v >= 0.9) / nullif(count(*) FILTER (NOT same), 0) AS cross_90,
  count(*) FILTER (v >= 0.9) / count(*) AS high_90, max(v) AS largest FROM rk GROUP BY 1),
di AS (SELECT replicate, a, {_AX.format('a')} AS xa, {_AX.format('b')} AS xb, avg(sqrt(greatest(0, (1 - coalesce(rho, 0)) / 2))) AS d FROM (SELECT replicate, a, b, rho FROM pr UNION ALL SELECT replicate, b, a, rho FROM pr) GROUP BY ALL),
si AS (SELECT replicate, avg(coalesce((other - own) / nullif(greatest(own, other), 0), 0)) AS silhouette FROM (SELECT replicate, a, min(d) FILTER (xa = xb) AS own, min(d) FILTER (xa <> xb) AS other FROM di GROUP BY 1, 2) WHERE own IS NOT NULL AND other IS NOT NULL GROUP BY 1),
lg AS (UNPIVOT (SELECT * FROM q JOIN si USING (replicate)) ON {', '.join(K.METRICS)} INTO NAME metric VALUE value)
SELECT metric, {_STATS} FROM lg GROUP BY 1""",
)
def quality(spark, d):
    """Confidence of ten metrics of correlation quality over 200 draws of whole nations."""
    return K.bootstrap_quality(pairs(spark, d), AXES)


@query(
    "bootstrap_edges",
    f"""{_BOOT}, pt AS (SELECT a, b, sign(rho) AS s FROM pr WHERE replicate = -1),
sg AS (SELECT pr.a, pr.b, round(avg(CASE WHEN sign(rho) = s THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS same_sign FROM pr JOIN pt ON pt.a = pr.a AND pt.b = pr.b WHERE replicate >= 0 AND rho IS NOT NULL GROUP BY 1, 2)
SELECT a, b, max(same_sign) AS same_sign, {_STATS} FROM (SELECT replicate, a, b, rho AS value FROM pr) JOIN sg USING (a, b) GROUP BY 1, 2""",
)
def edges(spark, d):
    return K.bootstrap_edges(pairs(spark, d))
