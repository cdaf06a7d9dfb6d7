"""Ablation by lineage: which feature feeds which component of which item, the runs that follow, and what each changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteward.sources.tables import assert_unique, checkpointed

NEUTRAL = 50.0
PIECES = 64


def run_ledger(lineage: DataFrame, swaps: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """run_id, scope, target, mode, item, component, feature, other: every run and each component of an item that
    it touches; a run that touches none has one row whose item is null, so that no run is missing.

    ``lineage``: item, component, feature.  Runs follow from it by sets alone: ``baseline::primary``; each component set
    to neutral, or left out with the other weights renormalised; each (component, feature) left out; and each of ``swaps``
    (component, other): the other's value in the component's place, for the items that have both.  Ids are made of
    names, so they don't depend on order; ids that two runs share (names that hold ``::``) fail at run time."""
    pairs = lineage.select("item", "component").distinct()
    none = F.lit(None).cast("string")
    start = pairs.limit(0).select("item", "component")
    base = start.sparkSession.range(1).select(F.lit("baseline::primary").alias("run_id"), F.lit("baseline").alias("scope"), F.lit("primary").alias("target"), F.lit("baseline").alias("mode"), none.alias("item"), none.alias("component"), none.alias("feature"), none.alias("other"))
    modes = pairs.select("item", "component", F.explode(F.array(F.lit("neutral"), F.lit("renormalize"))).alias("mode"))
    parts = modes.select(F.concat_ws("::", F.lit("component"), "component", "mode").alias("run_id"), F.lit("component").alias("scope"), F.col("component").alias("target"), "mode", "item", "component", none.alias("feature"), none.alias("other"))
    fed = lineage.select("item", "component", "feature").distinct()
    sources = fed.select(F.concat_ws("::", F.lit("source_feature"), "component", "feature").alias("run_id"), F.lit("source_feature").alias("scope"), F.col("feature").alias("target"), F.lit("left_out").alias("mode"), "item", "component", "feature", none.alias("other"))
    out = base.unionByName(parts).unionByName(sources)
    for component, other in swaps:
        both = pairs.filter(F.col("component") == component).join(pairs.filter(F.col("component") == other).select("item"), "item", "left_semi")
        asked = start.sparkSession.range(1).select(F.lit(component).alias("component"), F.lit(other).alias("other")).join(both, "component", "left")
        out = out.unionByName(asked.select(F.lit(f"swap::{component}::{other}").alias("run_id"), F.lit("swap").alias("scope"), F.lit(component).alias("target"), F.lit(f"substitute_{other}").alias("mode"), "item", F.when(F.col("item").isNotNull(), F.col("component")).alias("component"), none.alias("feature"), "other"))
    return assert_unique(out, ["run_id", "item", "component", "feature"])


def _tops(rows: DataFrame, keys: Sequence[str], most: int) -> DataFrame:
    """The best ``most`` units of every key (ties to the smaller unit): first in pieces, so that no task orders all units."""
    order = [F.col("score").desc(), "unit"]
    piece = F.pmod(F.xxhash64("unit"), F.lit(PIECES))
    first = rows.withColumn("_p", piece).withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "_p").orderBy(*order))).filter(F.col("_k") <= most)
    return first.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_k") <= most).select(*keys, "unit")


def component_values(features: DataFrame, lineage: DataFrame) -> DataFrame:
    """unit, item, component, n, total, value: the mean of a component's features that the unit has (0 to 100), neutral if it has none."""
    fed = features.join(F.broadcast(lineage.select("item", "component", "feature").distinct()), "feature")  # one row a feature of an item
    out = fed.groupBy("unit", "item", "component").agg(F.count("value").alias("n"), F.sum("value").alias("total"))
    return out.withColumn("value", F.round(F.coalesce(F.col("total") / F.col("n"), F.lit(NEUTRAL)), 9))


def lineage_ablation(features: DataFrame, lineage: DataFrame, weights: DataFrame, ledger: DataFrame, top: int) -> DataFrame:
    """run_id, item, touched, units, mean_change, max_change, top_kept: one row for every run and item.

    ``features``: unit, feature, value, one row a pair (null or NaN: the unit lacks it); ``weights``: component, weight, above 0.  A score is the
    weighted mean of an item's components.  Only the components that a run touches are computed
    again: the score follows from the old one and the difference, so the rows made are the touched ones, not units x runs x
    items.  A component left without features is neutral, and so is an item left without components.  Items that a run
    doesn't touch have no change and keep all of their ``top`` units.  top_kept: the share of the baseline's best units still there."""
    features = features.select("unit", "feature", F.nanvl(F.col("value").cast("double"), F.lit(None).cast("double")).alias("value"))
    small = F.broadcast(weights.select("component", "weight"))
    values = checkpointed(component_values(features, lineage).join(small, "component"))
    base = values.groupBy("unit", "item").agg(F.sum(F.col("weight") * F.col("value")).alias("sum"), F.sum("weight").alias("of"))
    base = checkpointed(base.withColumn("score", F.round(F.col("sum") / F.col("of"), 9)))
    touched = F.broadcast(ledger.filter("item IS NOT NULL").select("run_id", "mode", "item", "component", "feature", "other"))  # a row a component and run
    rows = values.join(touched, ["item", "component"])

    plain = rows.filter("feature IS NULL AND other IS NULL").withColumn("new", F.when(F.col("mode") == "neutral", NEUTRAL))
    less = rows.filter("feature IS NOT NULL").join(features.withColumnRenamed("value", "_out"), ["unit", "feature"], "left")
    left = F.col("n") - F.when(F.col("_out").isNotNull(), 1).otherwise(0)
    rest = F.col("total") - F.coalesce("_out", F.lit(0.0))
    less = less.withColumn("new", F.round(F.when(left > 0, rest / left).otherwise(NEUTRAL), 9))
    theirs = values.select("unit", "item", F.col("component").alias("other"), F.col("value").alias("new"))
    swapped = rows.filter("other IS NOT NULL").join(theirs, ["unit", "item", "other"])
    columns = ["run_id", "mode", "unit", "item", "weight", "value", "new"]
    changed = plain.select(*columns).unionByName(less.select(*columns)).unionByName(swapped.select(*columns)).join(base, ["unit", "item"])
    alone = F.col("of") - F.col("weight") <= 1e-12
    dropped = F.when(alone, NEUTRAL).otherwise((F.col("sum") - F.col("weight") * F.col("value")) / (F.col("of") - F.col("weight")))
    kept = (F.col("sum") + F.col("weight") * (F.col("new") - F.col("value"))) / F.col("of")
    after = F.round(F.when(F.col("mode") == "renormalize", dropped).otherwise(kept), 9)
    changed = checkpointed(changed.select("run_id", "item", "unit", F.col("score").alias("before"), after.alias("score")))

    change = F.abs(F.col("score") - F.col("before"))
    found = changed.groupBy("run_id", "item").agg(F.avg(change).alias("mean_change"), F.max(change).alias("max_change"))
    first = checkpointed(_tops(base.select("item", "unit", "score"), ["item"], top))
    again = _tops(changed.select("run_id", "item", "unit", "score"), ["run_id", "item"], top)
    same = again.join(first, ["item", "unit"]).groupBy("run_id", "item").agg(F.count("*").alias("_same"))
    whole = base.groupBy("item").agg(F.count("*").alias("units"))
    runs = ledger.select("run_id").distinct().crossJoin(F.broadcast(whole))  # one row a run and item
    out = runs.join(found, ["run_id", "item"], "left").join(same, ["run_id", "item"], "left")
    hit = F.col("mean_change").isNotNull()
    share = F.when(hit, F.coalesce("_same", F.lit(0)) / F.least("units", F.lit(top))).otherwise(1.0)
    return out.select("run_id", "item", hit.cast("int").alias("touched"), "units", F.round(F.coalesce("mean_change", F.lit(0.0)), 6).alias("mean_change"), F.round(F.coalesce("max_change", F.lit(0.0)), 6).alias("max_change"), F.round(share, 6).alias("top_kept"))
