"""Review of runs: profiles, responsiveness, resolution, normalisation, resampling, leakage, ladders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import fsum

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteward.functions.stats import ordered_rank, rounded, safe_corr
from siteward.operators.need import in_order
from siteward.sources.tables import checkpointed


def profile_runs(axes: DataFrame, profiles: Mapping[str, Mapping[str, float]], key: str = "unit") -> DataFrame:
    """profile, key, score, rank: every weight profile as rows of one job over axis scores (key, axis, score).

    Ranks come from counted scores, so that no task orders a whole profile; a null score has no rank."""
    # fsum: weights that add up to 1 stay as they are, whatever their order
    shares = {p: {a: float(w) / fsum(ws.values()) for a, w in ws.items()} for p, ws in profiles.items()}
    runs = F.array(*[F.struct(F.lit(p).alias("profile"), rounded(in_order(ws)[0]).alias("score"), F.count_if(F.col("axis").isin(*ws)).alias("_n")) for p, ws in shares.items()])
    out = axes.filter(F.col("axis").isin(*{a for ws in shares.values() for a in ws})).groupBy(key).agg(runs.alias("_runs"))
    out = checkpointed(out.select(F.inline("_runs"), key).filter("_n > 0").select("profile", key, "score"))
    ranked = ordered_rank(out.filter("score IS NOT NULL"), "score", key, by=["profile"]).select("profile", key, "score", "rank")
    return ranked.unionByName(out.filter("score IS NULL").withColumn("rank", F.lit(None).cast("long")))


def certified(runs: DataFrame, base: str, most_shift: float, least_overlap: float, top: int, key: str = "unit") -> DataFrame:
    """Per profile: mean rank shift against the base profile, overlap of the first ``top``, and a verdict."""
    one = runs.filter(F.col("profile") == base).select(key, F.col("rank").alias("r0"))
    both = runs.join(one, key)
    shared = F.count_if((F.col("rank") <= top) & (F.col("r0") <= top)) / F.count_if((F.col("rank") <= top) | (F.col("r0") <= top))
    out = both.groupBy("profile").agg(F.round(F.avg(F.abs(F.col("rank") - F.col("r0"))), 6).alias("mean_shift"), F.round(shared, 6).alias("overlap"))
    good = (F.col("mean_shift") <= most_shift) & (F.col("overlap") >= least_overlap)
    return out.withColumn("verdict", F.when(good, "CERTIFIED").otherwise("EXPLORATORY_FRAGILE"))


def bundle_seasonality(modifiers: DataFrame, weights: DataFrame, item: str) -> DataFrame:
    """bundle, month, modifier: convex combinations of the items' mean modifiers."""
    mean = modifiers.groupBy(item, "month").agg(F.avg("modifier").alias("m"))
    return mean.join(F.broadcast(weights), item).groupBy("bundle", "month").agg(F.round(F.sum(F.col("w") * F.col("m")), 6).alias("modifier"))


def monthly_resolution(panel: DataFrame, item: str, least: float) -> DataFrame:
    """item, rho (mean correlation of a year with the mean of the others), resolution month or season."""
    years = panel.groupBy(item, "year", "month").agg(F.sum("value").alias("v"))
    total = years.groupBy(item, "month").agg(F.sum("v").alias("t"), F.count("*").alias("n"))
    rest = years.join(total, [item, "month"]).withColumn("other", (F.col("t") - F.col("v")) / (F.col("n") - 1))
    rho = rest.groupBy(item, "year").agg(safe_corr("v", "other").alias("rho"))
    out = rho.groupBy(item).agg(F.round(F.avg("rho"), 6).alias("rho"))
    return out.withColumn("resolution", F.when(F.col("rho") >= least, "month").otherwise("season"))


def best_by_variant(rows: DataFrame, keys: Sequence[str], variants: Sequence[str]) -> DataFrame:
    """keys, variant, best month: each variant column's own best month."""
    long = rows.unpivot([*keys, "month"], [*variants], "variant", "value")
    order = Window.partitionBy(*keys, "variant").orderBy(F.round("value", 6).desc(), "month")
    return long.withColumn("k", F.row_number().over(order)).filter("k = 1").select(*keys, "variant", F.col("month").alias("best"))


def block_resampled_primary(panel: DataFrame, block: str, item: str, replicates: int, seed: int = 3) -> DataFrame:
    """item, month, probability that the month is best when whole blocks are drawn with replacement
    (replicate r's k-th draw is block number (seed + r * 7919 + k * 104729 + r * k * 31) mod blocks)."""
    names = panel.select(block).distinct()
    numbered = names.withColumn("i", F.row_number().over(Window.orderBy(block)) - 1)  # one row a block
    n = numbered.count()
    draws = panel.sparkSession.range(replicates).withColumnRenamed("id", "r").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    draws = draws.withColumn("i", F.pmod(F.lit(seed) + F.col("r") * 7919 + F.col("k") * 104729 + F.col("r") * F.col("k") * 31, F.lit(n)))
    picked = draws.join(F.broadcast(numbered), "i").groupBy("r", block).agg(F.count("*").alias("times"))
    sums = panel.groupBy(block, item, "month").agg(F.sum("value").alias("v"))
    total = sums.join(F.broadcast(picked), block).groupBy("r", item, "month").agg(F.sum(F.col("v") * F.col("times")).alias("v"))
    first = total.withColumn("k", F.row_number().over(Window.partitionBy("r", item).orderBy(F.col("v").desc(), "month"))).filter("k = 1")
    return first.groupBy(item, "month").agg(F.round(F.count("*") / replicates, 6).alias("probability"))


def shrunk_grid(panel: DataFrame, keys: Sequence[str], strengths: Sequence[float]) -> DataFrame:
    """keys, month, strength, value shrunk toward the month's leave-one-out mean over all keys."""
    v = panel.groupBy(*keys, "month").agg(F.avg("value").alias("v"))
    total = v.groupBy("month").agg(F.sum("v").alias("t"), F.count("*").alias("n"))
    grid = F.broadcast(panel.sparkSession.createDataFrame([(float(s),) for s in strengths], "strength double"))
    rows = v.join(F.broadcast(total), "month").crossJoin(grid)
    loo = (F.col("t") - F.col("v")) / (F.col("n") - 1)
    return rows.select(*keys, "month", "strength", F.round((1 - F.col("strength")) * F.col("v") + F.col("strength") * loo, 6).alias("value"))


def variance_gate(panel: DataFrame, item: str, least: float) -> DataFrame:
    """item, ratio of between-month to total variance, and which estimator the gate opens."""
    mean = Window.partitionBy(item)
    rows = panel.groupBy(item, "year", "month").agg(F.sum("value").alias("v")).withColumn("all", F.avg("v").over(mean)).withColumn("m", F.avg("v").over(Window.partitionBy(item, "month")))
    ratio = F.try_divide(F.sum((F.col("m") - F.col("all")) * (F.col("m") - F.col("all"))), F.sum((F.col("v") - F.col("all")) * (F.col("v") - F.col("all"))))
    out = rows.groupBy(item).agg(F.round(ratio, 6).alias("ratio"))
    return out.withColumn("chosen", F.when(F.col("ratio") >= least, "composition").otherwise("baseline"))


def what_when(scores: DataFrame, timing: DataFrame, lam: float) -> DataFrame:
    """unit, bundle chosen first by score alone (hierarchical), by score times timing (joint), and by
    score plus a bounded share of timing; scores: unit, bundle, score; timing: bundle, peak (0..1)."""
    rows = scores.join(F.broadcast(timing), "bundle").withColumn("joint", F.round(F.col("score") * F.col("peak"), 6)).withColumn("bounded", F.round(F.col("score") + lam * 100 * F.col("peak"), 6))
    pick = lambda c: F.min_by("bundle", F.struct((-F.col(c)).alias("s"), F.col("bundle")))
    return rows.groupBy("unit").agg(pick("score").alias("hierarchical"), pick("joint").alias("joint"), pick("bounded").alias("bounded"))


def profile_signatures(rows: DataFrame, region: str, unit: str, month: str, value: str) -> DataFrame:
    """region, units, different monthly profiles: few profiles for many units point to leakage."""
    sig = rows.groupBy(region, unit).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(month, value))), lambda s: F.format_string("%.3f", s[value])), "|").alias("sig"))
    return sig.groupBy(region).agg(F.count("*").alias("units"), F.count_distinct("sig").alias("profiles"))


def candidate_ladder(steps: DataFrame, accepted: float) -> DataFrame:
    """step, covered, loss against the widest set, decision: retain the narrow set, or promote to the next."""
    widest = steps.agg(F.max_by("covered", "step").alias("_w"))
    loss = F.greatest(F.lit(0.0), F.try_divide(F.col("_w") - F.col("covered"), F.col("_w")))
    return steps.crossJoin(F.broadcast(widest)).select("step", "covered", F.round(loss, 6).alias("loss"), F.when(loss <= accepted, "retain").otherwise("promote").alias("decision"))


def baseline_plans(sites: DataFrame, visits: int) -> DataFrame:
    """plan, site: the best by score, by exposure, one a unit, and round-robin over regions."""
    def first(order, name: str) -> DataFrame:
        return sites.orderBy(*order).limit(visits).select(F.lit(name).alias("plan"), "site")

    top = sites.withColumn("_u", F.row_number().over(Window.partitionBy("unit").orderBy(F.col("score").desc(), "site")))
    turn = sites.withColumn("_t", F.row_number().over(Window.partitionBy("region").orderBy(F.col("score").desc(), "site")))
    out = first([F.col("score").desc(), "site"], "score").unionByName(first([F.col("raw").desc(), "site"], "exposure"))
    out = out.unionByName(top.filter("_u = 1").orderBy(F.col("score").desc(), "site").limit(visits).select(F.lit("unit_best").alias("plan"), "site"))
    return out.unionByName(turn.orderBy("_t", "region").limit(visits).select(F.lit("round_robin").alias("plan"), "site"))


def spread(metrics: DataFrame, names: Sequence[str]) -> DataFrame:
    """metric, least, most, sd over the rows of a run table."""
    long = metrics.select(*[F.col(n).cast("double").alias(n) for n in names]).unpivot([], [*names], "metric", "value")
    return long.groupBy("metric").agg(F.round(F.min("value"), 6).alias("least"), F.round(F.max("value"), 6).alias("most"), F.round(F.stddev_pop("value"), 6).alias("sd"))
