"""Interfaces, costs, tiers and certification on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteward.functions.stats import rank_percentile
from siteward.operators import interface as I
from siteward.operators import planning as P
from siteward.operators import spatial as X
from siteward.plans.roles import CELLS, COVER, PANEL, SITES, UNITS, cells, panel, pct_sql, sites, units
from siteward.plans.stage3 import cover, described_cover
from siteward.plans.stage4 import _PL, plans
from siteward.sources.tables import ceil_share, field_status, floor_share, holidays, iso_date, korean_wgs84, monthly_utilisation, table, unit_interval, valid_address

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_B = f"WITH {SITES}, {CELLS}, {COVER}"


@query("pairs_within_distance", f"WITH {SITES} SELECT a.site AS site_i, b.site AS site_j, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS distance FROM sites a JOIN sites b ON a.site < b.site WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 900 + 1e-9")
def pairs(spark, d):
    return X.pairs_within(sites(spark, d), 900.0).withColumn("distance", F.round("distance", 6))


@query(
    "unit_interval",
    "WITH b AS (SELECT min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier) SELECT s_suppkey AS site, round((s_acctbal - lo) / (hi - lo), 6) AS up, round(1 - (s_acctbal - lo) / (hi - lo), 6) AS down FROM supplier, b",
)
def interval(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("site"), F.col("s_acctbal").alias("v"))
    b = F.broadcast(s.agg(F.min("v").alias("lo"), F.max("v").alias("hi")))
    s = s.crossJoin(b)
    return s.select("site", F.round(unit_interval(F.col("v"), F.col("lo"), F.col("hi")), 6).alias("up"), F.round(unit_interval(F.col("v"), F.col("lo"), F.col("hi"), True), 6).alias("down"))


@query(
    "month_entropy",
    f"WITH {PANEL}, m AS (SELECT item, month, sum(value) AS v FROM panel GROUP BY 1, 2), t AS (SELECT item, sum(v) AS t, count(*) AS k FROM m GROUP BY 1) SELECT item, round(sum(-v / t * ln(v / t)) / ln(max(k)), 6) AS entropy FROM m JOIN t USING (item) GROUP BY 1",
)
def entropy(spark, d):
    return I.normalised_entropy(panel(spark, d).groupBy("item", "month").agg(F.sum("value").alias("v")), "item", "v")


_DATE = "CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 2 THEN strftime(o_orderdate, '%Y%m%d') WHEN 3 THEN strftime(o_orderdate, '%Y.%m.%d') ELSE 'soon' END"


@query("date_words", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 < 4 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def dates(spark, d):
    """Dates written in four ways, and words that are none."""
    k, shape = F.col("o_orderkey") % 5, lambda f: F.date_format("o_orderdate", f)
    word = F.when(k == 0, shape("yyyy-MM-dd")).when(k == 1, shape("yyyy/MM/dd")).when(k == 2, shape("yyyyMMdd")).when(k == 3, shape("yyyy.MM.dd")).otherwise("soon")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.date_format(iso_date(word), "yyyy-MM-dd").alias("day"))


@query(
    "coordinate_predicates",
    """WITH p AS (SELECT s_suppkey AS site, 25.0 + (s_suppkey * 37 % 200) / 10.0 AS lat, CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE 118.0 + (s_suppkey * 53 % 200) / 10.0 END AS lon, CASE s_suppkey % 4 WHEN 0 THEN ' Unknown' WHEN 1 THEN NULL ELSE s_name END AS address FROM supplier)
SELECT site, CAST(CASE WHEN lat BETWEEN 30 AND 40 AND lon BETWEEN 120 AND 135 THEN 1 ELSE 0 END AS BIGINT) AS inside, CAST(CASE WHEN address IS NOT NULL AND lower(trim(address)) <> 'unknown' THEN 1 ELSE 0 END AS BIGINT) AS addressed FROM p""",
)
def coordinates(spark, d):
    k = F.col("s_suppkey")
    lat, lon = 25.0 + F.pmod(k * 37, F.lit(200)) / 10.0, F.when(k % 11 == 0, F.lit(None).cast("double")).otherwise(118.0 + F.pmod(k * 53, F.lit(200)) / 10.0)
    address = F.when(k % 4 == 0, " Unknown").when(k % 4 == 1, F.lit(None).cast("string")).otherwise(F.col("s_name"))
    return table(spark, d, "supplier").select(k.alias("site"), korean_wgs84(lat, lon).cast("long").alias("inside"), valid_address(address).cast("long").alias("addressed"))


@query("field_status_words", "SELECT s_suppkey AS site, CASE s_suppkey % 6 WHEN 0 THEN 'verified' WHEN 1 THEN 'not_verified' WHEN 2 THEN 'not_verified' WHEN 3 THEN 'verified' ELSE 'unknown' END AS status FROM supplier")
def statuses(spark, d):
    k = F.col("s_suppkey") % 6
    word = F.when(k == 0, " Pass").when(k == 1, "Not-verified").when(k == 2, "0").when(k == 3, "YES").when(k == 4, "perhaps")
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("site"), field_status(word).alias("status"))


@query("readiness_prior", "SELECT s_suppkey AS site, greatest(0.2, CASE WHEN s_suppkey % 3 = 0 THEN 0.9 ELSE 0.2 END, CASE WHEN s_suppkey % 5 = 0 THEN 0.6 ELSE 0.2 END)::DOUBLE AS prior, CAST(CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS active FROM supplier")
def prior(spark, d):
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier").select(k.alias("site"), (k % 3 == 0).cast("int").alias("a"), F.when(k % 5 == 0, 1).alias("b"))
    return s.select("site", I.readiness_prior({"a": 0.9, "b": 0.6}, 0.2).alias("prior"), I.active("a", "b").cast("long").alias("active"))


_SPELT = (" MM", "° C", "km/h", "mm ")
_EXPECTED = {"view": ["mm"], "click": ["c", "celsius"], "error": ["m/s", "km/h"], "refund": ["cm"]}


@query(
    "unit_contract",
    f"""WITH want(variable, expected) AS (VALUES {', '.join(f"('{k}', '{','.join(v)}')" for k, v in _EXPECTED.items())}), seen AS (SELECT DISTINCT event_type AS variable, {list(_SPELT)}[user_id % 4 + 1] AS spelt FROM events),
p AS (SELECT variable, replace(replace(lower(spelt), ' ', ''), '°', '') AS unit FROM seen)
SELECT variable, coalesce(unit, 'missing') AS unit, expected, CAST(coalesce(list_contains(string_split(expected, ','), unit), false) AS BIGINT) AS good FROM want LEFT JOIN p USING (variable)""",
)
def contract(spark, d):
    """Every spelling of a unit that readings of a kind of event come with."""
    spelt = F.element_at(F.array(*map(F.lit, _SPELT)), (F.col("user_id") % 4 + 1).cast("int"))
    seen = table(spark, d, "events").select(F.col("event_type").alias("variable"), spelt.alias("unit")).distinct()
    return I.unit_contract(seen, _EXPECTED)


@query(
    "canonical_sites",
    """WITH s AS (SELECT s_suppkey // 2 * 2 AS k, s_suppkey, s_nationkey AS unit FROM supplier), c AS (SELECT CASE WHEN s_suppkey % 50 < 2 THEN k ELSE s_suppkey END AS site, unit, CASE WHEN s_suppkey % 13 = 0 THEN NULL ELSE 1.0 END AS x FROM s), n AS (SELECT n_nationkey AS unit, n_regionkey AS region FROM nation WHERE n_nationkey <> 7)
SELECT c.site, c.unit, n.region, CASE WHEN count(*) OVER (PARTITION BY site) > 1 THEN 'repeated' WHEN x IS NULL THEN 'coordinate' WHEN n.region IS NULL THEN 'unit' ELSE 'none' END AS fault FROM c LEFT JOIN n USING (unit)""",
)
def canonical(spark, d):
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier").select(F.when(k % 50 < 2, k - k % 2).otherwise(k).alias("site"), F.col("s_nationkey").alias("unit"), F.when(k % 13 != 0, 1.0).alias("x"), F.lit(2.0).alias("y"))
    n = table(spark, d, "nation").filter("n_nationkey <> 7").select(F.col("n_nationkey").alias("unit"), F.col("n_regionkey").alias("region"))
    return I.canonical_points(s, "site", n).select("site", "unit", "region", "fault")


_LONG = "SELECT s_suppkey AS site, 'b' || (l_partkey % 5) AS bundle, min(s_nationkey) AS unit, max(l_quantity) AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2"


def _long(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("unit"))
    l = table(spark, d, "lineitem").select("l_suppkey", F.concat(F.lit("b"), (F.col("l_partkey") % 5).cast("string")).alias("bundle"), F.col("l_quantity").alias("value"))
    return l.join(s, "l_suppkey").withColumnRenamed("l_suppkey", "site")


@query("interface_sites", f"WITH i AS ({_LONG}) SELECT site, min(unit) AS unit FROM i GROUP BY 1")
def interface_sites(spark, d):
    return I.split_interface(_long(spark, d), "site", "bundle", ["unit"], ["value"])[0]


@query("interface_bundles", f"WITH i AS ({_LONG}) SELECT site, bundle, value FROM i")
def interface_bundles(spark, d):
    return I.split_interface(_long(spark, d), "site", "bundle", ["unit"], ["value"])[1]


@query(
    "policy_cells",
    f"WITH {CELLS}, q AS (SELECT quantile_cont(need, 0.8) AS q FROM cells) SELECT cell, round(population * need, 6) AS need_weighted, CASE WHEN need >= q THEN population ELSE 0.0 END AS high_need FROM cells, q",
)
def policy(spark, d):
    return I.policy_cells(cells(spark, d)).select("cell", F.round("need_weighted", 6).alias("need_weighted"), "high_need")


def _tm() -> str:
    import math

    n = I.FLATTENING / (2 - I.FLATTENING)
    a, e = I.AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64), 2 * math.sqrt(n) / (1 + n)
    al = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    s0 = math.sin(math.radians(I.LAT0))
    x0 = math.atan(math.sinh(math.atanh(s0) - e * math.atanh(e * s0)))
    zero = a * (x0 + sum(c * math.sin(2 * k * x0) for k, c in enumerate(al, 1)))
    sh, ch = lambda v: f"(exp({v}) - exp(-({v}))) / 2", lambda v: f"(exp({v}) + exp(-({v}))) / 2"
    ath = lambda v: f"0.5 * ln((1 + {v}) / (1 - {v}))"
    east = " + ".join(["eta"] + [f"{c!r} * cos({2 * k} * xi) * ({sh(f'{2 * k} * eta')})" for k, c in enumerate(al, 1)])
    north = " + ".join(["xi"] + [f"{c!r} * sin({2 * k} * xi) * ({ch(f'{2 * k} * eta')})" for k, c in enumerate(al, 1)])
    return f"""WITH p AS (SELECT s_suppkey AS site, 34.0 + (s_suppkey * 7919 % 1000) / 250.0 AS lat, 126.0 + (s_suppkey * 104729 % 1000) / 300.0 AS lon FROM supplier), s AS (SELECT site, sin(radians(lat)) AS s, radians(lon - {I.LON0}) AS w FROM p),
q AS (SELECT site, w, {ath('s')} - {e!r} * ({ath(f'({e!r} * s)')}) AS z FROM s), t AS (SELECT site, w, {sh('z')} AS t FROM q), c AS (SELECT site, atan2(t, cos(w)) AS xi, sin(w) / sqrt(1 + t * t) AS r FROM t), k AS (SELECT site, xi, {ath('r')} AS eta FROM c)
SELECT site, round({I.EAST0} + {I.SCALE * a!r} * ({east}), 3) AS east, round({I.NORTH0} + {I.SCALE!r} * ({a!r} * ({north}) - {zero!r}), 3) AS north FROM k"""


@query("projected_plane", _tm())
def plane(spark, d):
    k = F.col("s_suppkey")
    east, north = I.projected(34.0 + F.pmod(k * 7919, F.lit(1000)) / 250.0, 126.0 + F.pmod(k * 104729, F.lit(1000)) / 300.0)
    return table(spark, d, "supplier").select(k.alias("site"), F.round(east, 3).alias("east"), F.round(north, 3).alias("north"))


_STEMS = ("visits_", "lat_", "score_v0_", "month_", "need_rank_", "beds_", "outreach_", "spend_", "balance_", "")
_KINDS = ((r"(?:key|_id|name)$", "identifier"), (r"^(?:lat|lon)_|_wgs84$", "coordinate"), (r"_v0(?:$|_)", "legacy"), (r"visits|outcome", "outcome"), (r"outreach", "outreach"), (r"month|season", "temporal"), (r"capacity|beds", "capacity"), (r"rank|score", "derived"))
_TYPES = f"""nm AS (SELECT DISTINCT {list(_STEMS)}[p_partkey % 10 + 1] || replace(lower(p_brand), '#', '') || CASE WHEN p_partkey % 10 = 9 THEN '_id' ELSE '' END AS name FROM part),
ty AS (SELECT name, CASE {' '.join(f"WHEN regexp_matches(name, '{r}') THEN '{k}'" for r, k in _KINDS)} ELSE 'measure' END AS kind FROM nm)"""


@query("column_types", f"WITH {_TYPES} SELECT name, kind FROM ty")
def types(spark, d):
    """Kinds of the measures that a long table names: one for a stem and brand of the parts."""
    k = F.col("p_partkey") % 10
    stem = F.element_at(F.array(*map(F.lit, _STEMS)), (k + 1).cast("int"))
    name = F.concat(stem, F.translate(F.lower("p_brand"), "#", ""), F.when(k == 9, "_id").otherwise(""))
    return I.column_types(table(spark, d, "part").select(name.alias("name")).distinct(), _KINDS, "measure")


@query("leakage_names", f"WITH {_TYPES} SELECT name, kind AS reason FROM ty WHERE kind NOT IN ('measure', 'derived')")
def leakage(spark, d):
    """Names that may not enter a score, with the reason."""
    return types(spark, d).filter(~F.col("kind").isin("measure", "derived")).select("name", F.col("kind").alias("reason"))


@query("discriminating_features", "SELECT min(c_name) AS feature FROM customer GROUP BY c_nationkey, c_mktsegment, floor(c_acctbal / 500)")
def discriminate(spark, d):
    """Customers as features: those of one nation, segment and band of balance are aliases of the first of them."""
    keys = ["c_nationkey", "c_mktsegment", "band"]
    c = table(spark, d, "customer").withColumn("band", F.floor(F.col("c_acctbal") / 500))
    first = c.groupBy(*keys).agg(F.min("c_name").alias("alias_of"))
    ledger = c.join(first, keys).select(F.col("c_name").alias("feature"), "alias_of").filter("feature <> alias_of")
    return I.discriminating(c.select(F.col("c_name").alias("feature")), ledger)


@query("stable_feature_ids", "SELECT feature, 'F' || lpad(CAST(row_number() OVER (ORDER BY feature) AS VARCHAR), 3, '0') AS stable_id FROM (SELECT DISTINCT lower(p_brand) || '_' || lower(p_type) AS feature FROM part)")
def stable(spark, d):
    return I.stable_ids(table(spark, d, "part").select(F.concat_ws("_", F.lower("p_brand"), F.lower("p_type")).alias("feature")).distinct())


@query(
    "group_composites",
    f"WITH {UNITS}, p AS (SELECT unit, {pct_sql('orders_n')} AS a, {pct_sql('urgent_n')} AS b, {pct_sql('balance')} AS c FROM units) SELECT unit, 'volume' AS grp, round((a + b) / 2, 6) AS composite FROM p UNION ALL SELECT unit, 'means', round(c, 6) FROM p",
)
def composites(spark, d):
    u = units(spark, d).select("unit", *[F.col(c).cast("double").alias(c) for c in ("orders_n", "urgent_n", "balance")])
    long = u.unpivot(["unit"], ["orders_n", "urgent_n", "balance"], "feature", "value").withColumn("grp", F.when(F.col("feature") == "balance", "means").otherwise("volume"))
    return I.group_composites(long, "unit")


@query("policy_context_scaled", f"WITH {UNITS}, g AS (SELECT region, min(nation_spend) AS v FROM units GROUP BY 1), s AS (SELECT region, 100 - 100 * {pct_sql('v')} AS s FROM g) SELECT unit, round(s, 6) AS context FROM units JOIN s USING (region)")
def context(spark, d):
    """A value of the region, scaled over regions and sent back to its units."""
    u = units(spark, d)
    g = rank_percentile(u.groupBy("region").agg(F.min("nation_spend").alias("v")), "v", "p")
    return u.join(g, "region").select("unit", F.round(100 - 100 * F.col("p"), 6).alias("context"))


@query("transit_fit", f"WITH {UNITS} SELECT unit, round(100 * {pct_sql('orders_n')}, 6) AS fit FROM units")
def transit(spark, d):
    return rank_percentile(units(spark, d).select("unit", "orders_n"), "orders_n", "p").select("unit", F.round(100 * F.col("p"), 6).alias("fit"))


@query(
    "cost_coefficients",
    f"""WITH {SITES}, c AS (SELECT site, CASE WHEN site % 7 = 0 THEN NULL ELSE CAST((site * 13) % 50 - 5 AS DOUBLE) END AS t, CASE WHEN site % 6 = 0 THEN 1 ELSE 0 END AS o, score AS p FROM sites), m AS (SELECT median(t) AS m FROM c)
SELECT site, round(greatest(0, coalesce(t, m)) + o * 1000 + row_number() OVER (ORDER BY p DESC, site) * 1e-6, 6) AS cost FROM c, m""",
)
def costs(spark, d):
    k = F.col("site")
    s = sites(spark, d).select("site", F.when(k % 7 != 0, F.pmod(k * 13, F.lit(50)) - 5).alias("t"), F.when(k % 6 == 0, "Known").otherwise("unknown").alias("o"), "score")
    return I.cost_coefficients(s, "site", "t", "o", "score").select("site", F.round("cost", 6).alias("cost"))


@query("share_limits", "SELECT s_suppkey AS site, CAST(floor(s_suppkey * 0.35 + 1e-9) AS BIGINT) AS low, CAST(ceil(s_suppkey * 0.35 - 1e-9) AS BIGINT) AS high, round(1 / (1 + s_suppkey / 1000), 6)::DOUBLE AS closeness, ceil(floor(0.525217979 * 1000000 + 1e-9) * 0.95 - 1e-12) / 1000000 AS retained FROM supplier")
def limits(spark, d):
    k = F.col("s_suppkey")
    kept = ceil_share(F.floor(F.lit(0.525217979) * 1_000_000 + 1e-9), 0.95) / 1_000_000
    return table(spark, d, "supplier").select(k.alias("site"), floor_share(k, 0.35).alias("low"), ceil_share(k, 0.35).alias("high"), F.round(1 / (1 + k / 1000), 6).alias("closeness"), kept.alias("retained"))


@query(
    "source_categories",
    """WITH p AS (SELECT p_partkey AS part, p_brand AS b FROM part), t AS (SELECT b FROM p GROUP BY 1 ORDER BY count(*) DESC, b LIMIT 6) SELECT part, CASE WHEN b IN (SELECT b FROM t) THEN b ELSE 'other' END AS category FROM p""",
)
def categories(spark, d):
    return I.source_categories(table(spark, d, "part").select(F.col("p_partkey").alias("part"), "p_brand"), "part", "p_brand")


@query(
    "holdout_validation",
    f"""WITH {UNITS}, m AS (SELECT CAST(unit % 4 AS BIGINT) AS item, nation, sum(spend * (orders_n + 1)) / sum(orders_n + 1) AS m, max(balance) AS h FROM units GROUP BY 1, 2),
r AS (SELECT item, rank() OVER (PARTITION BY item ORDER BY m) + (count(*) OVER (PARTITION BY item, m) - 1) / 2.0 AS rm, rank() OVER (PARTITION BY item ORDER BY h) + (count(*) OVER (PARTITION BY item, h) - 1) / 2.0 AS rh FROM m)
SELECT item, count(*) AS regions, round(corr(rm, rh), 6) AS rho, CAST(CASE WHEN round(corr(rm, rh), 6) > 0 THEN 1 ELSE 0 END AS BIGINT) AS concordant FROM r GROUP BY 1""",
)
def validation(spark, d):
    u = units(spark, d).withColumn("item", F.pmod(F.col("unit"), F.lit(4)).cast("long")).withColumn("w", F.col("orders_n") + 1)
    return I.weighted_validation(u, u.groupBy("item", "nation").agg(F.max("balance").alias("h")), "item", "nation", "spend", "w", "h")


@query(
    "priority_tiers",
    f"""WITH {SITES}, {_PL}, f AS (SELECT site, max(CASE WHEN plan = 'unit' THEN 1 ELSE 0 END) AS a, max(CASE WHEN plan = 'region' THEN 1 ELSE 0 END) AS b FROM pl GROUP BY 1), q AS (SELECT site, score FROM sites ORDER BY score DESC, site LIMIT 40),
t AS (SELECT q.site, score, CASE WHEN q.site % 9 = 0 THEN 'P0' WHEN a = 1 AND b = 1 THEN 'A' WHEN a = 1 OR b = 1 THEN 'B' ELSE 'D' END AS tier FROM q LEFT JOIN f USING (site))
SELECT site, tier, row_number() OVER (ORDER BY CASE tier WHEN 'P0' THEN 0 WHEN 'A' THEN 1 WHEN 'B' THEN 2 ELSE 4 END, score DESC, site) AS place FROM t""",
)
def tiers(spark, d):
    """A queue of the first forty sites; its length is the feature."""
    q = sites(spark, d).orderBy(F.col("score").desc(), "site").limit(40).select("site", "score", (F.col("site") % 9 == 0).cast("int").alias("is_proxy"), F.lit(0).alias("fallbacks"))
    return I.priority_tiers(q, plans(spark, d), "unit", "region", "top").select("site", "tier", "place")


@query("unit_need_of_sites", f"WITH {SITES}, {CELLS}, u AS (SELECT unit, round(avg(need), 6) AS unit_mean FROM cells GROUP BY 1) SELECT site, unit_mean FROM sites LEFT JOIN u USING (unit)")
def unit_need(spark, d):
    return I.unit_means(sites(spark, d), cells(spark, d)).select("site", "unit_mean")


@query("aligned_coverage", f"{_B} SELECT site, cell, 1.0::DOUBLE AS weight FROM cover WHERE site % 2 = 0 AND cell % 3 = 0")
def align(spark, d):
    return I.aligned(cover(spark, d), sites(spark, d).filter("site % 2 = 0"), cells(spark, d).filter("cell % 3 = 0"), True)


@query("matrix_record", f"{_B} SELECT (SELECT count(*) FROM sites) AS sites, (SELECT count(*) FROM cells) AS cells, (SELECT count(*) FROM cover) AS entries, round((SELECT count(*) FROM cover) / ((SELECT count(*) FROM sites) * (SELECT count(*) FROM cells)), 8)::DOUBLE AS density")
def record(spark, d):
    return I.matrix_record(cover(spark, d), sites(spark, d), cells(spark, d))


@query(
    "final_aliases",
    """WITH RECURSIVE l AS (SELECT s_suppkey AS source, s_suppkey // 2 AS target FROM supplier WHERE s_suppkey > 1), r AS (SELECT source, target FROM l UNION ALL SELECT r.source, l.target FROM r JOIN l ON r.target = l.source) SELECT source, min(target) AS target FROM r GROUP BY 1""",
)
def aliases(spark, d):
    s = table(spark, d, "supplier").filter("s_suppkey > 1")
    return I.final_aliases(s.select(F.col("s_suppkey").alias("source"), F.floor(F.col("s_suppkey") / 2).cast("long").alias("target")))


@query("best_seed", f"WITH {SITES} SELECT region, site, score FROM sites QUALIFY row_number() OVER (PARTITION BY region ORDER BY score DESC, site) = 1")
def seed(spark, d):
    return I.best_of(sites(spark, d), ["region"], "score", "max", "site").select("region", "site", "score")


_AUD = "(SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'max' ELSE 'min' END AS sense, CAST(1000 + n_nationkey AS DOUBLE) AS incumbent, CAST(1000 + n_nationkey AS DOUBLE) + ((n_nationkey * 7) % 13 - 2) * (CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE -1 END) AS bound FROM nation)"


def _audited(spark, d):
    k = F.col("n_nationkey")
    inc = (1000 + k).cast("double")
    return table(spark, d, "nation").select(k.alias("id"), F.when(k % 2 == 0, "max").otherwise("min").alias("sense"), inc.alias("incumbent"), (inc + (F.pmod(k * 7, F.lit(13)) - 2) * F.when(k % 2 == 0, 1).otherwise(-1)).alias("bound"))


@query(
    "gap_audit",
    f"""WITH a AS (SELECT *, CASE WHEN sense = 'max' THEN bound - incumbent ELSE incumbent - bound END AS v FROM {_AUD}), g AS (SELECT *, CASE WHEN v >= -1e-7 THEN greatest(v, 0) / incumbent END AS g FROM a)
SELECT id, round(g, 9) AS gap, CASE WHEN g <= 1e-9 THEN 'exact' WHEN g <= 0.005 + 1e-12 THEN 'near_optimal' ELSE 'uncertified' END AS class FROM g""",
)
def gaps(spark, d):
    return I.gap_audit(_audited(spark, d)).select("id", "gap", "class")


@query("combined_bounds", f"SELECT CAST(id % 5 AS BIGINT) AS plan, sense, CASE WHEN sense = 'max' THEN min(bound) ELSE max(bound) END AS bound FROM {_AUD} GROUP BY 1, 2")
def bounds(spark, d):
    return I.combined_bound(_audited(spark, d).withColumn("plan", (F.col("id") % 5).cast("long")), ["plan"])


def _stages(spark, d):
    return _audited(spark, d).select((F.col("id") % 6).cast("long").alias("run"), F.floor(F.col("id") / 6 + 1).cast("long").alias("stage"), "sense", F.col("incumbent").alias("objective"), "bound").filter("NOT (run = 3 AND stage = 2)")


_RUNS = f"""ru AS (SELECT run, count(*) AS stages, max(stage) AS l, max(greatest(0, CASE WHEN sense = 'max' THEN bound - incumbent ELSE incumbent - bound END) / incumbent) AS w FROM (SELECT CAST(id % 6 AS BIGINT) AS run, id // 6 + 1 AS stage, * FROM {_AUD}) WHERE NOT (run = 3 AND stage = 2) GROUP BY 1),
rc AS (SELECT run, stages, round(w, 9) AS worst_gap, CASE WHEN l <> stages THEN 'incomplete' WHEN w <= 1e-9 THEN 'optimal' WHEN w <= 0.005 THEN 'certified_near_optimal' ELSE 'feasible_uncertified' END AS class FROM ru)"""


@query("certified_runs", f"WITH {_RUNS} SELECT * FROM rc")
def certified(spark, d):
    return I.certified_runs(_stages(spark, d))


@query(
    "frontier_certification",
    f"WITH {_RUNS} SELECT a.run AS low, b.run AS high, a.class AS low_class, b.class AS high_class, CASE WHEN a.class IN ('optimal', 'certified_near_optimal') AND b.class IN ('optimal', 'certified_near_optimal') THEN 'certified_endpoints' ELSE 'inconclusive_gap' END AS claim FROM rc a JOIN rc b ON b.run = a.run + 1",
)
def frontier(spark, d):
    m = spark.createDataFrame([(k, k + 1) for k in range(5)], "low long, high long")
    return I.annotated_marginals(m, certified(spark, d).select(F.col("run").alias("visits"), "class")).select("low", "high", "low_class", "high_class", "claim")


@query(
    "travel_scenarios",
    """WITH t AS (SELECT s_suppkey AS site, CASE WHEN s_suppkey % 6 <> 0 THEN CAST(s_suppkey * 7 % 60 AS DOUBLE) END AS east, CASE WHEN s_suppkey % 4 <> 0 THEN CAST(s_suppkey * 11 % 60 AS DOUBLE) END AS west FROM supplier), u AS (SELECT site, 'east' AS scenario, east AS minutes, 'east' AS base FROM t UNION ALL SELECT site, 'west', west, 'west' FROM t
UNION ALL SELECT site, 'nearest', least(east, west), CASE WHEN east IS NOT NULL AND (west IS NULL OR east <= west) THEN 'east' WHEN west IS NOT NULL THEN 'west' END FROM t) SELECT *, CASE WHEN minutes IS NULL THEN 'unavailable' ELSE 'available' END AS status FROM u""",
)
def travel(spark, d):
    k = F.col("s_suppkey")
    t = table(spark, d, "supplier").select(k.alias("site"), F.when(k % 6 != 0, F.pmod(k * 7, F.lit(60)).cast("double")).alias("east"), F.when(k % 4 != 0, F.pmod(k * 11, F.lit(60)).cast("double")).alias("west"))
    return I.travel_scenarios(t, ["east", "west"])


@query(
    "evidence_audit",
    """WITH e AS (SELECT s_suppkey AS site, s_suppkey % 5 <> 0 AS ok, CASE WHEN s_suppkey % 3 <> 0 THEN s_name END AS address, CASE WHEN s_suppkey % 2 = 0 THEN 'x' END AS owner FROM supplier), m AS (SELECT site, NOT ok OR address IS NULL AS a, NOT ok OR owner IS NULL AS o FROM e)
SELECT site, CAST(a::INT + o::INT AS BIGINT) AS missing, concat_ws('|', CASE WHEN a THEN 'address' END, CASE WHEN o THEN 'owner' END) AS blockers FROM m""",
)
def evidence(spark, d):
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier").select(k.alias("site"), (k % 5 != 0).alias("confirmed"), F.when(k % 3 != 0, F.col("s_name")).alias("address"), F.when(k % 2 == 0, "x").alias("owner"))
    return I.evidence_audit(s, s, ["address", "owner"])


@query(
    "temporal_evidence_table",
    f"WITH {PANEL} SELECT item, round(max(value) FILTER (month <= 3), 6) AS q1, round(max(value) FILTER (month BETWEEN 4 AND 6), 6) AS q2, round(max(value) FILTER (month > 6), 6) AS later, round(max(value), 6) AS worst FROM panel GROUP BY 1",
)
def evidence_table(spark, d):
    p = panel(spark, d).withColumn("part", F.when(F.col("month") <= 3, "q1").when(F.col("month") <= 6, "q2").otherwise("later"))
    return I.evidence_table(p, "item", "part", ["q1", "q2", "later"], "value")


_COLUMNS = ("o_orderstatus", "o_orderpriority", "o_custkey")


@query("column_profile", " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) AS rows, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS uniques, min(CAST({c} AS VARCHAR)) AS low, max(CAST({c} AS VARCHAR)) AS high FROM orders" for c in _COLUMNS))
def profile(spark, d):
    return I.column_profile(table(spark, d, "orders"), _COLUMNS)


@query("compressed_values", f"{_B} SELECT count(*) AS cells, round(coalesce(sum(population), 0), 4)::DOUBLE AS population FROM cells WHERE cell IN (SELECT cell FROM cover WHERE site IN (1, 3, 5, 7, 9))")
def values(spark, d):
    chosen = [1, 3, 5, 7, 9]
    return I.group_values(P.incidence_groups(cover(spark, d).filter(F.col("site").isin(chosen)), cells(spark, d)), chosen)


@query("cross_unit_share", f"{_B} SELECT k.site, round(sum(CASE WHEN c.unit <> s.unit THEN population ELSE 0 END) / sum(population), 6) AS share FROM cover k JOIN cells c USING (cell) JOIN sites s ON s.site = k.site GROUP BY 1")
def cross(spark, d):
    return I.cross_share(described_cover(spark, d), sites(spark, d), cells(spark, d))


@query("holiday_dates", "SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day, 'day ' || day(ts) AS name FROM events WHERE day(ts) % 2 = 0")
def holiday(spark, d):
    """JSON answers of a holiday service, one a day of events; days off are listed once."""
    e = table(spark, d, "events").select(F.to_date("ts").alias("t")).distinct()
    item = F.array(F.struct(F.date_format("t", "yyyyMMdd").cast("long").alias("locdate"), F.concat(F.lit("day "), F.dayofmonth("t").cast("string")).alias("dateName"), F.when(F.dayofmonth("t") % 2 == 0, "Y").otherwise("N").alias("isHoliday")))
    body = F.struct(F.struct(F.struct(item.alias("item")).alias("items")).alias("body")).alias("response")
    rows = holidays(e.select(F.to_json(F.struct(body)).alias("j")), "j")
    return rows.select(F.date_format("date", "yyyy-MM-dd").alias("day"), "name")


@query(
    "monthly_utilisation",
    """SELECT CAST(year(o_orderdate) AS BIGINT) AS year, CAST(month(o_orderdate) AS BIGINT) AS month, CASE WHEN n_name < 'F' THEN 'first' WHEN n_name < 'J' THEN 'middle' ELSE 'last' END AS region, o_orderpriority AS service, CAST(sum(o_custkey) AS BIGINT) AS persons, CAST(count(*) * 1000 AS BIGINT) AS visits
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 GROUP BY 1, 2, 3, 4""",
)
def utilisation(spark, d):
    """Rows as a yearbook writes them: one province, districts merged into regions, counts with commas."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", F.concat(F.lit("province "), F.col("n_regionkey").cast("string")).alias("province"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey").join(n, "c_nationkey")
    o = table(spark, d, "orders").select("o_custkey", "o_orderdate", F.col("o_orderpriority").alias("service")).join(c, "o_custkey")
    half = F.when(F.col("n_name") < "F", "first ").when(F.col("n_name") < "J", "middle ").otherwise("last ")
    rows = o.select(F.year("o_orderdate").cast("string").alias("year"), F.month("o_orderdate").cast("string").alias("month"), "province", F.concat(half, "n_name").alias("district"), "service", F.format_number("o_custkey", 0).alias("persons"), F.lit("1,000").alias("visits"))
    return monthly_utilisation(rows, "province 1", {"first": "first", "middle": "middle", "last": "last"})
