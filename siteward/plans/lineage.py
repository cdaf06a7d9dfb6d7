"""Ablation of three services by the features of customers that feed them."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteward.functions.stats import rank_percentile
from siteward.operators import lineage as L
from siteward.plans.roles import UNITS, pct_sql, units

QUERIES, SQL = {}, {}
LINEAGE = [
    ("care", "context", "balance"), ("care", "context", "spend"), ("care", "age", "orders_n"), ("care", "supply", "urgent_n"), ("care", "public", "nation_spend"),
    ("cure", "context", "balance"), ("cure", "age", "orders_n"), ("cure", "age", "urgent_n"), ("cure", "supply", "spend"),
    ("test", "context", "spend"), ("test", "context", "urgent_n"), ("test", "context", "orders_n"), ("test", "public", "nation_spend"),
]
WEIGHTS = [("context", 0.4), ("age", 0.25), ("supply", 0.2), ("public", 0.15)]
SWAPS = [("supply", "public"), ("public", "supply"), ("age", "context")]
FEATURES, TOP = ["balance", "spend", "orders_n", "urgent_n", "nation_spend"], 20


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _tables(spark, d):
    long = units(spark, d).select("unit", *[F.col(c).cast("double").alias(c) for c in FEATURES]).unpivot(["unit"], FEATURES, "feature", "v")
    long = rank_percentile(long, "v", "p", ["feature"], few=True)
    features = long.select("unit", "feature", F.round(100 * F.col("p"), 6).alias("value"))
    return features, spark.createDataFrame(LINEAGE, "item string, component string, feature string"), spark.createDataFrame(WEIGHTS, "component string, weight double")


_values = lambda rows: ", ".join(str(r) for r in rows)
_LEDGER = f"""lin AS (SELECT * FROM (VALUES {_values(LINEAGE)}) l(item, component, feature)), wt AS (SELECT component, CAST(weight AS DOUBLE) AS weight FROM (VALUES {_values(WEIGHTS)}) w(component, weight)),
sw AS (SELECT * FROM (VALUES {_values(SWAPS)}) s(component, other)), pr AS (SELECT DISTINCT item, component FROM lin),
led AS (SELECT 'baseline::primary' AS run_id, 'baseline' AS scope, 'primary' AS target, 'baseline' AS mode, NULL AS component, NULL AS feature, NULL AS other
  UNION ALL SELECT DISTINCT 'component::' || component || '::' || m, 'component', component, m, component, NULL, NULL FROM pr CROSS JOIN (VALUES ('neutral'), ('renormalize')) m(m)
  UNION ALL SELECT DISTINCT 'source_feature::' || component || '::' || feature, 'source_feature', feature, 'left_out', component, feature, NULL FROM lin
  UNION ALL SELECT 'swap::' || component || '::' || other, 'swap', component, 'substitute_' || other, component, NULL, other FROM sw),
hit AS (SELECT DISTINCT run_id, p.item FROM led JOIN pr p USING (component) WHERE (feature IS NULL OR EXISTS (SELECT 1 FROM lin WHERE lin.item = p.item AND lin.component = p.component AND lin.feature = led.feature))
  AND (other IS NULL OR EXISTS (SELECT 1 FROM pr q WHERE q.item = p.item AND q.component = led.other)))"""


@query("lineage_ledger", f"WITH {_LEDGER} SELECT run_id, scope, target, mode, count(item) AS items FROM led LEFT JOIN hit USING (run_id) GROUP BY 1, 2, 3, 4")
def ledger(spark, d):
    """Runs over the lineage that has rows in the tables: a feature counts only where a unit has a value."""
    features, lineage, _ = _tables(spark, d)
    fed = lineage.join(features.filter("value IS NOT NULL").select("feature").distinct(), "feature", "left_semi")
    return L.run_ledger(fed, SWAPS).groupBy("run_id", "scope", "target", "mode").agg(F.count_distinct("item").alias("items"))


_F = " UNION ALL ".join(f"SELECT unit, '{c}' AS feature, round(100 * {pct_sql(c)}, 6) AS v FROM units" for c in FEATURES)
_ALL = f"""WITH {UNITS}, {_LEDGER}, ft AS ({_F}),
cv AS (SELECT run_id, unit, item, l.component, CASE WHEN led.mode = 'neutral' AND led.component = l.component THEN 50.0 ELSE coalesce(round(avg(v) FILTER (led.feature IS NULL OR NOT (led.component = l.component AND led.feature = l.feature)), 9), 50.0) END AS v
  FROM led CROSS JOIN lin l JOIN ft ON ft.feature = l.feature GROUP BY run_id, unit, item, l.component, led.mode, led.component, led.feature),
cs AS (SELECT c.run_id, c.unit, c.item, c.component, coalesce(o.v, c.v) AS v FROM cv c JOIN led USING (run_id) LEFT JOIN cv o ON led.other IS NOT NULL AND led.component = c.component AND o.run_id = c.run_id AND o.unit = c.unit AND o.item = c.item AND o.component = led.other
  WHERE NOT (led.mode = 'renormalize' AND led.component = c.component)),
sc AS (SELECT run_id, unit, item, round(sum(weight * v) / sum(weight), 9) AS s FROM cs JOIN wt USING (component) GROUP BY 1, 2, 3),
rk AS (SELECT *, row_number() OVER (PARTITION BY run_id, item ORDER BY s DESC, unit) AS k FROM sc)
SELECT r.run_id, r.item, CASE WHEN h.item IS NULL THEN 0 ELSE 1 END AS touched, count(*) AS units, round(avg(abs(r.s - b.s)), 6) AS mean_change, round(max(abs(r.s - b.s)), 6) AS max_change,
  round(count(*) FILTER (r.k <= {TOP} AND b.k <= {TOP}) / least(count(*), {TOP}), 6) AS top_kept FROM rk r JOIN rk b ON b.run_id = 'baseline::primary' AND b.unit = r.unit AND b.item = r.item
LEFT JOIN hit h ON h.run_id = r.run_id AND h.item = r.item GROUP BY 1, 2, 3"""


@query("lineage_ablation", _ALL)
def ablation(spark, d):
    features, lineage, weights = _tables(spark, d)
    return L.lineage_ablation(features, lineage, weights, L.run_ledger(lineage, SWAPS), TOP)
