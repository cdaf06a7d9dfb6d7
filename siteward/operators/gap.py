"""Service gaps: supply per unit and item, empirical-Bayes shares, access excess, formulas, bundles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteward.functions.stats import rank_percentile

GEOMETRIC_FLOOR = 5.0
BOTTLENECK = (0.7, 0.3)


def dense_counts(facts: DataFrame, unit: str, item: str, value: Column, out: str) -> DataFrame:
    """Sum of value for every unit x item, 0 where there is none; both lists are dimension-sized."""
    grid = facts.select(unit).distinct().crossJoin(F.broadcast(facts.select(item).distinct()))
    return grid.join(facts.groupBy(unit, item).agg(F.sum(value).alias(out)), [unit, item], "left").withColumn(out, F.coalesce(out, F.lit(0)))


def empirical_bayes_share(df: DataFrame, num: str, den: str, strength: float, out: str, by: Sequence[str] = ()) -> DataFrame:
    """(num + strength * mu) / (den + strength), mu the pooled share of the group, within 0..1."""
    if by:
        over = Window.partitionBy(*by)
        mu = F.try_divide(F.sum(num).over(over).cast("double"), F.sum(den).over(over).cast("double"))
        share = (F.col(num) + strength * F.coalesce(mu, F.lit(0.0))) / (F.col(den) + strength)
        return df.withColumn(out, F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)))
    pooled = df.agg(F.coalesce(F.try_divide(F.sum(num).cast("double"), F.sum(den).cast("double")), F.lit(0.0)).alias("_mu"))
    share = (F.col(num) + strength * F.col("_mu")) / (F.col(den) + strength)
    return df.crossJoin(F.broadcast(pooled)).withColumn(out, F.least(F.lit(1.0), F.greatest(F.lit(0.0), share))).drop("_mu")


def access_excess(special: Column, general: Column) -> Column:
    """How much further the special service is, in logs; never negative."""
    return F.greatest(F.lit(0.0), F.log1p(special) - F.log1p(general))


def differential(df: DataFrame, unit: str, value: str, out: str) -> DataFrame:
    """A unit's value of an item minus its mean over items."""
    return df.withColumn(out, F.col(value) - F.avg(value).over(Window.partitionBy(unit)))


def combined(df: DataFrame, weights: Mapping[str, float], formula: str, out: str) -> DataFrame:
    """Components of 0..100 in one score."""
    total = sum(weights.values())
    parts = [(F.col(c), w / total) for c, w in weights.items()]
    added = sum((c * w for c, w in parts), F.lit(0.0))
    if formula == "weighted_additive":
        return df.withColumn(out, added)
    if formula == "bounded_geometric":
        return df.withColumn(out, F.exp(sum((F.log(F.greatest(c, F.lit(GEOMETRIC_FLOOR))) * w for c, w in parts), F.lit(0.0))))
    if formula == "minimum_bottleneck_hybrid":
        return df.withColumn(out, BOTTLENECK[0] * added + BOTTLENECK[1] * F.least(*[c for c, _ in parts]))
    if formula != "rank_composite":
        raise ValueError(f"unknown formula {formula}")
    for c in weights:
        df = rank_percentile(df, c, f"_p_{c}")
    score = sum((F.col(f"_p_{c}") * 100 * (w / total) for c, w in weights.items()), F.lit(0.0))
    return df.withColumn(out, score).drop(*[f"_p_{c}" for c in weights])


def bundle_scores(scores: DataFrame, bundles: DataFrame, unit: str, item: str, score: str) -> DataFrame:
    """unit, bundle, score, rank within the bundle: fixed convex combinations (bundle, item, w) of items."""
    out = scores.join(F.broadcast(bundles), item).groupBy(unit, "bundle").agg(F.round(F.sum(F.col("w") * F.col(score)), 6).alias("score"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("bundle").orderBy(F.col("score").desc(), unit)).cast("long"))


def ndcg3(base: DataFrame, other: DataFrame, unit: str, item: str, score: str) -> DataFrame:
    """Per unit NDCG@3: the base run's first three items have relevance 3, 2, 1."""
    order = Window.partitionBy(unit).orderBy(F.col(score).desc(), item)
    true = base.withColumn("_p", F.row_number().over(order)).filter("_p <= 3").select(unit, item, (4 - F.col("_p")).alias("rel"))
    seen = other.withColumn("_q", F.row_number().over(order)).filter("_q <= 3").select(unit, item, "_q")
    gain = F.sum((F.pow(F.lit(2.0), F.coalesce("rel", F.lit(0))) - 1) / F.log2(F.col("_q") + 1.0))
    got = seen.join(true, [unit, item], "left").groupBy(unit).agg(gain.alias("dcg"))
    best = true.groupBy(unit).agg(F.sum((F.pow(F.lit(2.0), "rel") - 1) / F.log2(5.0 - F.col("rel"))).alias("ideal"))
    return got.join(best, unit).select(unit, F.round(F.col("dcg") / F.col("ideal"), 6).alias("ndcg3"))
