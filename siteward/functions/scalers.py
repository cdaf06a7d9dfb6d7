"""Scalers of one value column to 0..100, with direction, and the transforms before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteward.functions.stats import clip, quantiles, quantiles_at, rank_percentile, value_positions
from siteward.sources.tables import checkpointed

SCALERS = ("rank_percentile", "winsorized_percentile", "robust_minmax", "robust_z")


def transformed(x: Column, kind: str) -> Column:
    """identity, log1p and sqrt (null below their domain), or binary (1 above 0)."""
    if kind == "log1p":
        return F.when(x > -1, F.log1p(x))
    if kind == "sqrt":
        return F.when(x >= 0, F.sqrt(x))
    if kind == "binary":
        return F.when(x > 0, 1.0).when(x.isNotNull(), 0.0)
    if kind != "identity":
        raise ValueError(f"unknown transform {kind}")
    return x.cast("double")


def turned(score: Column, direction: int) -> Column:
    """0..100, so that more means more need."""
    return clip(score if direction > 0 else 100.0 - score, 0.0, 100.0)


def scaled(df: DataFrame, value: str, out: str, method: str = "winsorized_percentile", direction: int = 1, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """df with value scaled to 0..100 over all its rows."""
    if method == "rank_percentile":
        return rank_percentile(df, value, "_p").withColumn(out, turned(F.col("_p") * 100, direction)).drop("_p")
    x = F.col(value)
    if method == "robust_z":
        df = df.crossJoin(F.broadcast(quantiles(df, value, {"_m": 0.5, "_q1": 0.25, "_q3": 0.75})))
        far = df.select(F.abs(x - F.col("_m")).alias("_far"))
        df = df.crossJoin(F.broadcast(quantiles(far, "_far", {"_mad": 0.5})))
        width = F.when(F.col("_mad") > 0, 1.4826 * F.col("_mad")).otherwise((F.col("_q3") - F.col("_q1")) / 1.349)
        z = F.when(width > 0, clip((x - F.col("_m")) / width, -3.0, 3.0)).otherwise(0.0)
        return df.withColumn(out, turned((z + 3) / 6 * 100, direction)).drop("_m", "_q1", "_q3", "_mad")
    bounds = quantiles(df, value, {"_lo": low, "_hi": high})
    df = df.crossJoin(F.broadcast(bounds))
    if method == "winsorized_percentile":
        df = df.withColumn("_w", clip(x, F.col("_lo"), F.col("_hi")))
        return rank_percentile(df, "_w", "_p").withColumn(out, turned(F.col("_p") * 100, direction)).drop("_lo", "_hi", "_w", "_p")
    if method != "robust_minmax":
        raise ValueError(f"unknown scaler {method}")
    span = F.col("_hi") - F.col("_lo")
    score = F.when(span > 0, (clip(x, F.col("_lo"), F.col("_hi")) - F.col("_lo")) / span * 100).otherwise(50.0)
    return df.withColumn(out, turned(score, direction)).drop("_lo", "_hi")


def scaled_by_group(df: DataFrame, group: str, value: str, out: str, **options) -> DataFrame:
    """A value that repeats on all rows of a group is scaled on one row per group, then sent back."""
    once = df.select(group, value).dropDuplicates([group])
    return df.join(scaled(once, value, out, **options).select(group, out), group, "left")


def scaled_long(long: DataFrame, method: str = "winsorized_percentile", low: float = 0.01, high: float = 0.99) -> DataFrame:
    """long (feature, direction, value, ...) with value replaced by its score within the feature.

    All features are scaled in one job.  The different values are placed once, by one shuffle; bounds are
    read off the same places, and a clipped value has those of all values that are clipped to it."""
    x, by = F.col("value"), ["feature"]
    at = checkpointed(value_positions(long, "value", by, few=True))
    if method == "robust_z":
        mid = checkpointed(quantiles_at(at, "value", {"_m": 0.5, "_q1": 0.25, "_q3": 0.75}, by))  # one row a feature
        far = long.join(F.broadcast(mid), by).select("feature", F.abs(x - F.col("_m")).alias("_far"))
        mad = quantiles(far, "_far", {"_mad": 0.5}, by)
        width = F.when(F.col("_mad") > 0, 1.4826 * F.col("_mad")).otherwise((F.col("_q3") - F.col("_q1")) / 1.349)
        score = (F.when(width > 0, clip((x - F.col("_m")) / width, -3.0, 3.0)).otherwise(0.0) + 3) / 6 * 100
        long = long.join(F.broadcast(mid.join(mad, by)), by).withColumn("_s", score).drop("_m", "_q1", "_q3", "_mad")
    elif method == "rank_percentile":
        share = at.select("feature", "value", ((F.col("less") + (F.col("same") + 1) / 2) / F.col("total") * 100).alias("_s"))
        long = long.join(share, ["feature", "value"], "left")
    else:
        bounds = F.broadcast(checkpointed(quantiles_at(at, "value", {"_lo": low, "_hi": high}, by)))  # one row a feature
        if method == "robust_minmax":
            span, v = F.col("_hi") - F.col("_lo"), clip(x, F.col("_lo"), F.col("_hi"))
            long = long.join(bounds, by).withColumn("_s", F.when(span > 0, (v - F.col("_lo")) / span * 100).otherwise(50.0)).drop("_lo", "_hi")
        else:
            inside = at.join(bounds, by)
            under, over = F.col("value") <= F.col("_lo"), F.col("value") >= F.col("_hi")
            ends = inside.groupBy("feature").agg(F.sum(F.when(under, F.col("same")).otherwise(0)).alias("_under"), F.sum(F.when(over, F.col("same")).otherwise(0)).alias("_over"))
            half = F.when(F.col("_lo") == F.col("_hi"), (F.col("total") + 1) / 2).when(under, (F.col("_under") + 1) / 2)
            place = half.when(over, F.col("total") - F.col("_over") + (F.col("_over") + 1) / 2).otherwise(F.col("less") + (F.col("same") + 1) / 2)
            share = inside.join(F.broadcast(ends), by).select("feature", "value", (place / F.col("total") * 100).alias("_s"))
            long = long.join(share, ["feature", "value"], "left")
    return long.withColumn("score", clip(F.when(F.col("direction") > 0, F.col("_s")).otherwise(100.0 - F.col("_s")), 0.0, 100.0)).drop("_s", "value", "direction")
