"""Hand-over between stages: interfaces split and checked, costs, tiers, certification, evidence."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteward.functions.stats import ordered_rank, quantiles, rank_percentile, safe_corr, average_rank
from siteward.operators.spatial import described
from siteward.sources.tables import checkpointed

#: The Korean unified plane (GRS80, origin 38 N 127.5 E, scale 0.9996, false origin 1,000,000 / 2,000,000 m).
AXIS, FLATTENING, SCALE, LAT0, LON0, EAST0, NORTH0 = 6378137.0, 1 / 298.257222101, 0.9996, 38.0, 127.5, 1_000_000.0, 2_000_000.0
#: Retention of lexicographic plans, and the gap that certifies a run.
ACCEPTED_GAP = 0.005


def projected(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Metres east and north of a transverse Mercator plane, by its third-order series (millimetres within 3 degrees)."""
    n = FLATTENING / (2 - FLATTENING)
    a = AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)

    def conformal(phi: Column) -> Column:
        s = F.sin(phi)
        return F.sinh(F.atanh(s) - e * F.atanh(e * s))

    t = conformal(F.radians(lat))
    way = F.radians(lon - LON0)
    xi, eta = F.atan2(t, F.cos(way)), F.atanh(F.sin(way) / F.sqrt(1 + t * t))
    east = eta + sum(c * F.cos(2 * k * xi) * F.sinh(2 * k * eta) for k, c in enumerate(alpha, 1))
    north = xi + sum(c * F.sin(2 * k * xi) * F.cosh(2 * k * eta) for k, c in enumerate(alpha, 1))
    s0 = math.sin(math.radians(LAT0))
    x0 = math.atan(math.sinh(math.atanh(s0) - e * math.atanh(e * s0)))
    zero = a * (x0 + sum(c * math.sin(2 * k * x0) for k, c in enumerate(alpha, 1)))
    return EAST0 + SCALE * a * east, NORTH0 + SCALE * (a * north - zero)


def split_interface(rows: DataFrame, site: str, bundle: str, of_site: Sequence[str], of_bundle: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(one row a site, one row a site and bundle) of a long interface; columns of a site must agree on its rows."""
    same = [(F.min(c).eqNullSafe(F.max(c)), c) for c in of_site]
    checks = [F.when(~ok, F.raise_error(F.lit(f"{c} differs within a site"))).otherwise(F.min(c)).alias(c) for ok, c in same]
    return rows.groupBy(site).agg(*checks), rows.groupBy(site, bundle).agg(*[F.max(c).alias(c) for c in of_bundle])


def policy_cells(cells: DataFrame, share: float = 0.8) -> DataFrame:
    """cells with need within 0..1, need-weighted population, and population of cells at or above the quantile of need."""
    cells = checkpointed(cells)
    top = F.broadcast(cells.agg(F.max("need").alias("_top")))  # one row
    rows = checkpointed(cells.crossJoin(top).withColumn("need", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(F.col("_top") > 1.000001, F.col("need") / 100).otherwise(F.col("need"))))).drop("_top"))
    cut = F.broadcast(quantiles(rows, "need", {"_cut": share}))  # one row
    rows = rows.crossJoin(cut).withColumn("need_weighted", F.col("population") * F.col("need"))
    return rows.withColumn("high_need", F.when(F.col("need") >= F.col("_cut"), F.col("population")).otherwise(0.0)).drop("_cut")


def cost_coefficients(candidates: DataFrame, key: str, travel: str, overlap: str, priority: str, scale: float = 1.0, penalty: float = 1000.0, tie: float = 1e-6) -> DataFrame:
    """key, cost: travel (missing: the median, not below 0), a penalty for known overlap, and a trace of the priority's place."""
    rows = checkpointed(candidates.select(key, F.col(travel).cast("double").alias("t"), F.lower(F.trim(F.col(overlap).cast("string"))).isin("known", "yes", "true", "1", "confirmed", "high").alias("o"), F.coalesce(F.col(priority).cast("double"), F.lit(0.0)).alias("p")))
    mid = F.broadcast(quantiles(rows, "t", {"_m": 0.5}))  # one row
    placed = ordered_rank(rows, "p", key, "place").crossJoin(mid)
    cost = F.greatest(F.lit(0.0), F.coalesce("t", "_m", F.lit(0.0))) * scale + F.when(F.col("o"), penalty).otherwise(0.0) + F.col("place") * tie
    return placed.select(key, cost.alias("cost"))


def readiness_prior(flags: Mapping[str, float], default: float) -> Column:
    """The greatest prior among the flags that are 1."""
    return F.greatest(F.lit(default), *[F.when(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) == 1, v).otherwise(default) for c, v in flags.items()])


def active(*columns: str) -> Column:
    """All flags are true; null is not."""
    out = F.lit(True)
    for c in columns:
        out = out & F.coalesce(F.col(c).cast("boolean"), F.lit(False))
    return out


def unit_contract(units: DataFrame, expected: Mapping[str, Sequence[str]]) -> DataFrame:
    """variable, unit, expected, good: units of measurement against the spellings that are allowed."""
    spark = units.sparkSession
    want = spark.createDataFrame([(k, ",".join(v)) for k, v in expected.items()], "variable string, expected string")
    plain = F.regexp_replace(F.lower(F.trim("unit")), "[ °]", "")
    return want.join(units, "variable", "left").select("variable", F.coalesce(plain, F.lit("missing")).alias("unit"), "expected", F.when(F.array_contains(F.split("expected", ","), plain), 1).otherwise(0).cast("long").alias("good"))


def canonical_points(points: DataFrame, key: str, region_of: DataFrame, unit: str = "unit") -> DataFrame:
    """points with the region re-derived from their unit, and what is wrong with each: a null or repeated key, a
    coordinate that is not finite, an unknown unit."""
    n = F.count("*").over(Window.partitionBy(key))
    rows = points.join(region_of.select(unit, F.col("region").alias("_region")), unit, "left").withColumn("_n", n)
    bad = F.when(F.col(key).isNull(), "key").when(F.col("_n") > 1, "repeated").when(F.col("x").isNull() | F.col("y").isNull() | F.isnan("x") | F.isnan("y"), "coordinate").when(F.col("_region").isNull(), "unit")
    return rows.withColumn("region", F.col("_region")).withColumn("fault", F.coalesce(bad, F.lit("none"))).drop("_region", "_n")


def source_categories(df: DataFrame, key: str, source: str, top: int = 6) -> DataFrame:
    """key, category: the most frequent sources by name, all others as ``other``; no source is ``unknown``."""
    rows = df.select(key, F.coalesce(F.trim(F.col(source)), F.lit("unknown")).alias("source"))
    names = rows.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "source").limit(top).select("source", F.lit(1).alias("_in"))
    return rows.join(F.broadcast(names), "source", "left").select(key, F.when(F.col("_in") == 1, F.col("source")).otherwise("other").alias("category"))


def column_types(columns: DataFrame, rules: Sequence[tuple[str, str]], other: str) -> DataFrame:
    """name, kind: the first rule (regex, kind) that a column's name holds."""
    kind = F.lit(other)
    for regex, value in reversed(rules):
        kind = F.when(F.rlike(F.lower("name"), F.lit(regex)), value).otherwise(kind)
    return columns.select("name", kind.alias("kind"))


def discriminating(features: DataFrame, ledger: DataFrame) -> DataFrame:
    """Features without those that a ledger (feature, alias_of) names as another's alias; of aliases of one another the smaller id stays."""
    ends = ledger.select(F.greatest("feature", "alias_of").alias("feature")).distinct()
    return features.join(ends, "feature", "left_anti")


def group_composites(long: DataFrame, key: str) -> DataFrame:
    """key, grp, composite: the mean of the average-rank percentiles of a group's features.  long: key, feature, grp, value."""
    long = rank_percentile(checkpointed(long), "value", "p", ["feature"], few=True)
    return long.groupBy(key, "grp").agg(F.round(F.avg("p"), 6).alias("composite"))


def stable_ids(features: DataFrame) -> DataFrame:
    """feature, stable_id: F001, F002, ... in the order of names; one row a feature."""
    place = F.row_number().over(Window.orderBy("feature"))
    return features.select("feature", F.concat(F.lit("F"), F.lpad(place.cast("string"), 3, "0")).alias("stable_id"))


def normalised_entropy(rows: DataFrame, by: str, value: str) -> DataFrame:
    """by, entropy: -sum(p ln p) / ln k over the positive values of a group; 0 for one of them or none."""
    own = rows.filter(F.col(value) > 0)
    total = own.groupBy(by).agg(F.sum(value).alias("_t"), F.count("*").alias("_k"))
    p = F.col(value) / F.col("_t")
    parts = own.join(total, by).groupBy(by).agg(F.sum(-p * F.ln(p)).alias("_h"), F.max("_k").alias("_k"))
    return rows.select(by).distinct().join(parts, by, "left").select(by, F.round(F.when(F.col("_k") > 1, F.col("_h") / F.ln("_k")).otherwise(0.0), 6).alias("entropy"))


def weighted_validation(scores: DataFrame, holdout: DataFrame, item: str, region: str, score: str, weight: str, against: str) -> DataFrame:
    """item, regions, rho, concordant: weighted regional means of a score against a measure that was held out."""
    mean = scores.groupBy(item, region).agg((F.sum(F.col(score) * F.col(weight)) / F.sum(weight)).alias("m"))
    both = checkpointed(mean.join(holdout.select(item, region, F.col(against).cast("double").alias("h")), [item, region]))
    ranked = average_rank(average_rank(both, "m", "rm", [item]), "h", "rh", [item])
    out = ranked.groupBy(item).agg(F.count("*").alias("regions"), F.round(safe_corr("rm", "rh"), 6).alias("rho"))
    return out.withColumn("concordant", F.when(F.col("rho") > 0, 1).otherwise(0).cast("long"))


def priority_tiers(queue: DataFrame, plans: DataFrame, first: str, second: str, third: str) -> DataFrame:
    """queue (site, score, is_proxy, fallbacks) with membership in three plans, a tier and its place."""
    flags = plans.groupBy("site").agg(*[F.max(F.when(F.col("plan") == p, 1).otherwise(0)).alias(f"in_{n}") for n, p in (("first", first), ("second", second), ("third", third))])
    rows = queue.join(flags, "site", "left").fillna(0, ["in_first", "in_second", "in_third"])
    both, one = (F.col("in_first") == 1) & (F.col("in_second") == 1), (F.col("in_first") == 1) | (F.col("in_second") == 1)
    tier = F.when((F.col("is_proxy") == 1) & (F.coalesce("fallbacks", F.lit(0)) == 0), "P0").when(both, "A").when(one, "B").otherwise("D")
    order = Window.orderBy(F.when(F.col("tier") == "P0", 0).when(F.col("tier") == "A", 1).when(F.col("tier") == "B", 2).otherwise(4), F.col("score").desc(), "site")
    return rows.withColumn("tier", tier).withColumn("place", F.row_number().over(order).cast("long"))  # a queue of bounded length


def unit_means(sites: DataFrame, cells: DataFrame, value: str = "need") -> DataFrame:
    """sites with the mean of a cell value over their unit."""
    mean = cells.groupBy("unit").agg(F.round(F.avg(value), 6).alias("unit_mean"))
    return sites.join(mean, "unit", "left")


def aligned(cover: DataFrame, sites: DataFrame, cells: DataFrame, binary: bool = False) -> DataFrame:
    """Coverage of the given sites and cells alone; weights as 1 if binary."""
    rows = cover.join(sites.select("site").distinct(), "site", "left_semi").join(cells.select("cell").distinct(), "cell", "left_semi")
    return rows.select("site", "cell", (F.lit(1.0) if binary else F.col("weight")).alias("weight"))


def matrix_record(cover: DataFrame, sites: DataFrame, cells: DataFrame) -> DataFrame:
    """One row: sites, cells, stored entries, density."""
    n, m = sites.agg(F.count_distinct("site").alias("sites")), cells.agg(F.count_distinct("cell").alias("cells"))
    k = cover.agg(F.count("*").alias("entries"))
    return n.crossJoin(m).crossJoin(k).withColumn("density", F.round(F.try_divide(F.col("entries"), F.col("sites") * F.col("cells")), 8))


def final_aliases(ledger: DataFrame, rounds: int = 40) -> DataFrame:
    """source, target: each id's last representative, chains of (source, target) followed by doubling."""
    now = checkpointed(ledger.select("source", "target"))
    for _ in range(rounds):
        far = now.select(F.col("source").alias("_s"), F.col("target").alias("_t"))
        after = checkpointed(now.join(far, now["target"] == far["_s"], "left").select("source", F.coalesce("_t", "target").alias("target"), F.col("_t").isNotNull().alias("_moved")))
        now = after.select("source", "target")
        if not after.filter("_moved").limit(1).count():
            return now
    raise RuntimeError("aliases go round in a ring")


def best_of(rows: DataFrame, by: Sequence[str], value: str, sense: str, key: str) -> DataFrame:
    """Per group the row of the best value (sense max or min), ties to the smaller key."""
    order = F.col(value).desc() if sense == "max" else F.col(value).asc()
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(order, key))).filter("_k = 1").drop("_k")


def gap_audit(rows: DataFrame, accepted: float = ACCEPTED_GAP) -> DataFrame:
    """rows (sense, incumbent, bound) with the relative gap, whether the bound lies on its side, and a class."""
    inc, bound = F.col("incumbent"), F.col("bound")
    slack = 1e-10 * F.greatest(F.lit(1.0), F.abs(inc), F.abs(bound))
    ahead = F.when(F.col("sense") == "max", bound - inc).otherwise(inc - bound)
    gap = F.when(ahead >= -slack, F.greatest(F.lit(0.0), ahead) / F.greatest(F.abs(inc), F.lit(1e-12)))
    return rows.withColumn("gap", F.round(gap, 9)).withColumn("class", F.when(gap <= 1e-9, "exact").when(gap <= accepted + 1e-12, "near_optimal").otherwise("uncertified"))


def combined_bound(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """The tightest valid bound of each group: the smallest of a maximisation, the largest of a minimisation."""
    return rows.groupBy(*by, "sense").agg(F.when(F.first("sense") == "max", F.min("bound")).otherwise(F.max("bound")).alias("bound"))


def certified_runs(stages: DataFrame, accepted: float = ACCEPTED_GAP) -> DataFrame:
    """run, stages, worst_gap, class: a run is certified if each of its stages, numbered from 1 without a hole, is."""
    inc, bound = F.col("objective"), F.col("bound")
    gap = F.greatest(F.lit(0.0), F.when(F.col("sense") == "max", bound - inc).otherwise(inc - bound)) / F.greatest(F.abs(inc), F.lit(1.0))
    runs = stages.withColumn("_gap", gap).groupBy("run").agg(F.count("*").alias("stages"), F.max("stage").alias("_last"), F.count_distinct("stage").alias("_n"), F.max("_gap").alias("_worst"))
    whole = (F.col("_last") == F.col("stages")) & (F.col("_n") == F.col("stages"))
    return runs.select("run", "stages", F.round("_worst", 9).alias("worst_gap"), F.when(~whole, "incomplete").when(F.col("_worst") <= 1e-9, "optimal").when(F.col("_worst") <= accepted, "certified_near_optimal").otherwise("feasible_uncertified").alias("class"))


def annotated_marginals(marginals: DataFrame, runs: DataFrame) -> DataFrame:
    """marginals (low, high) with the classes of both end points, and whether a claim about them is allowed."""
    one = lambda c, n: runs.select(F.col("visits").alias(c), F.col("class").alias(n))
    both = marginals.join(one("low", "low_class"), "low", "left").join(one("high", "high_class"), "high", "left")
    good = F.col("low_class").isin("optimal", "certified_near_optimal") & F.col("high_class").isin("optimal", "certified_near_optimal")
    return both.withColumn("claim", F.when(F.coalesce(good, F.lit(False)), "certified_endpoints").otherwise("inconclusive_gap"))


def travel_scenarios(rows: DataFrame, bases: Sequence[str]) -> DataFrame:
    """site, scenario, minutes, base: each base by itself, and the nearest of them (ties to the first named)."""
    parts = [F.struct(F.lit(b).alias("scenario"), F.col(b).alias("minutes"), F.lit(b).alias("base")) for b in bases]
    least = F.least(*bases)
    near = F.coalesce(*[F.when(F.col(b) == least, F.lit(b)) for b in bases])
    parts.append(F.struct(F.lit("nearest").alias("scenario"), least.alias("minutes"), near.alias("base")))
    out = rows.select("site", F.explode(F.array(*parts)).alias("s")).select("site", "s.*")
    return out.withColumn("status", F.when(F.col("minutes").isNotNull(), "available").otherwise("unavailable"))


def evidence_audit(sites: DataFrame, evidence: DataFrame, required: Sequence[str]) -> DataFrame:
    """site, missing, blockers: which required fields no confirmed evidence row of the site holds."""
    seen = evidence.filter(F.coalesce("confirmed", F.lit(False))).groupBy("site").agg(*[F.max(F.when(F.col(c).isNotNull(), 1).otherwise(0)).alias(c) for c in required])
    rows = sites.select("site").join(seen, "site", "left").fillna(0, [*required])
    names = F.array_compact(F.array(*[F.when(F.col(c) == 0, F.lit(c)) for c in required]))
    return rows.select("site", F.size(names).cast("long").alias("missing"), F.array_join(names, "|").alias("blockers"))


def evidence_table(rows: DataFrame, key: str, kind: str, kinds: Sequence[str], value: str) -> DataFrame:
    """key, one column a kind, and the worst of them."""
    wide = rows.groupBy(key).pivot(kind, [*kinds]).agg(F.round(F.max(value), 6))
    return wide.withColumn("worst", F.greatest(*kinds))


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """name, rows, nulls, uniques, smallest and largest as text, in one pass."""
    rows = [F.struct(F.lit(c).alias("name"), F.count("*").alias("rows"), F.count_if(F.col(c).isNull()).alias("nulls"), F.count_distinct(c).alias("uniques"), F.min(F.col(c).cast("string")).alias("low"), F.max(F.col(c).cast("string")).alias("high")) for c in columns]
    return df.agg(F.array(*rows).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def group_values(groups: DataFrame, chosen: Sequence) -> DataFrame:
    """One row: cells and population of the compressed groups that the chosen sites cover."""
    hit = F.arrays_overlap("coverers", F.array(*[F.lit(c) for c in chosen]))
    return groups.filter(hit).agg(F.coalesce(F.sum("cells"), F.lit(0)).alias("cells"), F.round(F.coalesce(F.sum("population"), F.lit(0.0)), 4).alias("population"))


def cross_share(cover: DataFrame, sites: DataFrame, cells: DataFrame) -> DataFrame:
    """site, share: the part of the population that a site reaches outside its own unit."""
    rows = described(described(cover, cells, "cell", population="population", cu="unit"), sites, "site", su="unit")
    out = F.sum(F.when(F.col("cu") != F.col("su"), F.col("population")).otherwise(0.0))
    return rows.groupBy("site").agg(F.round(F.try_divide(out, F.sum("population")), 6).alias("share"))
