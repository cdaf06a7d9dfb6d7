"""Nested choice of seasonal representations and the null of their grid, over the driver's orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteward.operators import nested as N
from siteward.plans.roles import PANEL, panel
from siteward.sources.tables import checkpointed

QUERIES, SQL = {}, {}
WEIGHTS, REPLICATES = (0.0, 0.5, 1.0), 200


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def dense(spark, d):
    return checkpointed(N.dense(panel(spark, d)))


_DENSE = f"""{PANEL}, ky AS (SELECT region, item, year, month FROM (SELECT DISTINCT region FROM panel) CROSS JOIN (SELECT DISTINCT item FROM panel) CROSS JOIN (SELECT DISTINCT year FROM panel) CROSS JOIN (SELECT unnest(range(1, 13)) AS month)),
dn AS (SELECT region, item, year, month, coalesce(value, 0)::DOUBLE AS value FROM ky LEFT JOIN panel USING (region, item, year, month))"""


def _profiles(source, by=""):
    one = lambda x: f"coalesce({x} / nullif(avg({x}) OVER (PARTITION BY {by}region, item, year), 0), 1)"
    return f"""sh AS (SELECT *, coalesce(value / nullif(sum(value) OVER (PARTITION BY {by}region, year, month), 0), 0) AS share FROM {source}),
rp AS (SELECT {by}region, item, year, (month - 1) // 3 + 1 AS season, {one('value')} AS level, {one('share')} AS share, {one('ln(1 + value)')} AS log FROM sh),
pf AS (SELECT {by}region, item, year, season, c.c AS candidate, CASE c.c {' '.join(f"WHEN '{f}:{a}' THEN {'avg' if a == 'mean' else 'median'}({f})" for f in N.REPRESENTATIONS for a in N.AGGREGATES)} END AS profile
  FROM rp CROSS JOIN (VALUES {', '.join(f"('{f}:{a}')" for f in N.REPRESENTATIONS for a in N.AGGREGATES)}) c(c) GROUP BY {by}region, item, year, season, c.c)"""


@query("season_profiles", f"WITH {_DENSE}, {_profiles('dn')} SELECT region, item, year, CAST(season AS BIGINT) AS season, candidate, round(profile, 6) AS profile FROM pf")
def profiles(spark, d):
    return N.profiles(dense(spark, d)).withColumn("profile", F.round("profile", 6))


@query(
    "nested_choice",
    f"""WITH {_DENSE}, {_profiles('dn')}, yr AS (SELECT DISTINCT year FROM pf),
fo AS (SELECT o.year AS outer_, i.year AS inner_, i.year AS test, t.year AS train FROM yr o, yr i, yr t WHERE o.year <> i.year AND t.year NOT IN (o.year, i.year) UNION ALL SELECT o.year, o.year, o.year, t.year FROM yr o, yr t WHERE o.year <> t.year),
tr AS (SELECT outer_, inner_, test, candidate, item, season, region, avg(profile) AS own FROM pf JOIN fo ON year = train GROUP BY ALL),
po AS (SELECT *, avg(own) OVER (PARTITION BY outer_, inner_, candidate, item, season) AS pooled FROM tr),
er AS (SELECT outer_, inner_, po.candidate, w.w AS weight, avg(abs((1 - w.w) * own + w.w * pooled - profile)) AS error FROM po JOIN pf ON pf.year = test AND pf.candidate = po.candidate AND pf.item = po.item AND pf.season = po.season AND pf.region = po.region
  CROSS JOIN (VALUES {', '.join(f'({w}::DOUBLE)' for w in WEIGHTS)}) w(w) GROUP BY ALL),
be AS (SELECT outer_, candidate, weight, round(avg(error), 9) AS inner_error, row_number() OVER (PARTITION BY outer_ ORDER BY round(avg(error), 9), candidate, weight) AS k FROM er WHERE inner_ <> outer_ GROUP BY outer_, candidate, weight)
SELECT be.outer_ AS outer, be.candidate, be.weight, round(inner_error, 6) AS inner_error, round(e.error, 6) AS outer_error, round(f.error, 6) AS first_error
FROM be JOIN er e ON e.outer_ = be.outer_ AND e.inner_ = be.outer_ AND e.candidate = be.candidate AND e.weight = be.weight AND be.k = 1 JOIN er f ON f.outer_ = be.outer_ AND f.inner_ = be.outer_ AND f.candidate = 'level:mean' AND f.weight = 0""".replace("AS outer,", 'AS "outer",'),
)
def choice(spark, d):
    """The representation chosen within the other years, and its error in each year."""
    return N.nested_choice(N.profiles(dense(spark, d)), WEIGHTS)


@query(
    "season_grid_null",
    f"""WITH {_DENSE}, mx AS (SELECT r.r AS replicate, region, item, year, CASE WHEN r.r < 0 THEN month ELSE row_number() OVER (PARTITION BY r.r, region, item, year ORDER BY md5(concat_ws(':', r.r, region, item, year, month))) END AS month, value FROM dn CROSS JOIN range(-1, {REPLICATES}) r(r)),
{_profiles('mx', 'replicate, ')}, mn AS (SELECT replicate, candidate, item, season, avg(profile) AS m FROM pf GROUP BY ALL),
ma AS (SELECT replicate, candidate, item, round(coalesce((list_reverse_sort(list(m))[1] - list_reverse_sort(list(m))[2]) / nullif(avg(m), 0), 0), 9) AS margin FROM mn GROUP BY ALL),
se AS (SELECT candidate, item, margin AS seen FROM ma WHERE replicate < 0), la AS (SELECT replicate, item, max(margin) AS largest FROM ma WHERE replicate >= 0 GROUP BY ALL)
SELECT candidate, item, round(any_value(seen), 6) AS margin, round((1 + count(*) FILTER (margin >= seen)) / {REPLICATES + 1}.0, 6)::DOUBLE AS p, round((1 + count(*) FILTER (largest >= seen)) / {REPLICATES + 1}.0, 6)::DOUBLE AS p_grid
FROM ma JOIN se USING (candidate, item) JOIN la USING (replicate, item) WHERE replicate >= 0 GROUP BY 1, 2""",
)
def grid_null(spark, d):
    """Whether any season stands out, for each candidate and for the grid as a whole, by 200 shuffles of months."""
    return N.grid_null(dense(spark, d), REPLICATES)
