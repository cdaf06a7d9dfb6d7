"""Choice among seasonal representations: nested folds of years, and the permutation null of the whole grid.

A candidate is a representation of monthly values, an aggregate of a season's months and, in the nested choice, a
weight of the pooled profile.  Folds, replicates and candidates are rows of one job each; no fold is a loop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteward.sources.tables import checkpointed

REPRESENTATIONS = ("level", "share", "log")
AGGREGATES = ("mean", "median")
CELL = ["region", "item", "year"]


def dense(panel: DataFrame) -> DataFrame:
    """panel (region, item, year, month, value) with a zero in each month that a region, item and year lacks."""
    months = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(12).cast("long"))).alias("month")
    keys = panel.select("region").distinct().crossJoin(F.broadcast(panel.select("item").distinct())).crossJoin(F.broadcast(panel.select("year").distinct()))  # dimensions
    return keys.select(*CELL, months).join(panel, [*CELL, "month"], "left").fillna({"value": 0.0})


def _unit_mean(x: Column, cell: Window) -> Column:
    mean = F.avg(x).over(cell)
    return F.when(mean > 0, x / mean).otherwise(1.0)


def profiles(panel: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, region, item, year, season (1 to 4), candidate, profile: monthly values in each representation, divided by their
    mean of the year, and aggregated by seasons of three months.  panel is dense."""
    by = [*by]
    cell, month = Window.partitionBy(*by, *CELL), Window.partitionBy(*by, "region", "year", "month")
    rows = panel.withColumn("_share", F.coalesce(F.try_divide("value", F.sum("value").over(month)), F.lit(0.0)))
    forms = {"level": F.col("value"), "share": F.col("_share"), "log": F.log1p("value")}
    rows = rows.select(*by, *CELL, (F.floor((F.col("month") - 1) / 3) + 1).cast("long").alias("season"), *[_unit_mean(forms[f], cell).alias(f) for f in REPRESENTATIONS])
    out = [F.avg(f).alias(f"{f}:mean") for f in REPRESENTATIONS] + [F.median(f).alias(f"{f}:median") for f in REPRESENTATIONS]  # of three months
    wide = rows.groupBy(*by, *CELL, "season").agg(*out)
    return wide.unpivot([*by, *CELL, "season"], [f"{f}:{a}" for f in REPRESENTATIONS for a in AGGREGATES], "candidate", "profile")


def folds(years: Sequence[int]) -> list[tuple[int, int, int, int]]:
    """(outer, inner, test, train) years: inner folds test one training year by the others, without the outer year; those
    with inner = outer test the outer year by all others."""
    inner = [(o, i, i, t) for o in years for i in years for t in years if len({o, i, t}) == 3]
    return inner + [(o, o, o, t) for o in years for t in years if t != o]


def nested_choice(rows: DataFrame, weights: Sequence[float]) -> DataFrame:
    """One row an outer year: the candidate with the least mean error over its inner folds, that error, and its error and
    that of the first candidate in the outer year.

    An error is the mean absolute difference of profiles; a prediction blends a region's mean of the training years with
    the mean of all regions by the candidate's weight.  A fold joins its training years alone, so that no value of an
    outer year is part of its own choice, not even as a rounding error.  Ties go to the candidate that comes first."""
    rows = checkpointed(rows)
    years = sorted(r[0] for r in rows.select("year").distinct().collect())
    if len(years) < 3:
        raise ValueError("a nested choice needs three years")
    plan = F.broadcast(rows.sparkSession.createDataFrame(folds(years), "outer long, inner long, test long, year long"))
    keys = ["outer", "inner", "test", "candidate", "item", "season"]
    trained = rows.join(plan, "year").groupBy(*keys, "region").agg(F.avg("profile").alias("own"))
    pooled = trained.groupBy(*keys).agg(F.avg("own").alias("pooled"))
    seen = rows.select(F.col("year").alias("test"), "candidate", "item", "season", "region", "profile")
    both = trained.join(pooled, keys).join(seen, ["test", "candidate", "item", "season", "region"])
    both = both.withColumn("weight", F.explode(F.array(*[F.lit(float(w)) for w in weights])))
    miss = F.abs((1 - F.col("weight")) * F.col("own") + F.col("weight") * F.col("pooled") - F.col("profile"))
    error = both.groupBy("outer", "inner", "candidate", "weight").agg(F.avg(miss).alias("error"))
    error = checkpointed(error)
    inside = error.filter("inner <> outer").groupBy("outer", "candidate", "weight").agg(F.round(F.avg("error"), 9).alias("inner_error"))
    best = inside.groupBy("outer").agg(F.min(F.struct("inner_error", "candidate", "weight")).alias("b")).select("outer", "b.*")
    outside = error.filter("inner = outer").drop("inner")
    first = outside.filter((F.col("candidate") == f"{REPRESENTATIONS[0]}:{AGGREGATES[0]}") & (F.col("weight") == float(weights[0]))).select("outer", F.col("error").alias("first_error"))
    out = best.join(outside, ["outer", "candidate", "weight"]).join(first, "outer")
    return out.select("outer", "candidate", "weight", F.round("inner_error", 6).alias("inner_error"), F.round("error", 6).alias("outer_error"), F.round("first_error", 6).alias("first_error"))


def shuffled(panel: DataFrame, replicates: int) -> DataFrame:
    """replicate and the panel with each region, item and year's twelve months in an order of hashes (MD5 of replicate,
    region, item, year, month); replicate -1 is the panel itself.  Totals of a year stay."""
    every = panel.withColumn("replicate", F.explode(F.sequence(F.lit(-1).cast("long"), F.lit(replicates - 1).cast("long"))))
    mixed = F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in ("replicate", *CELL, "month")]))
    place = F.row_number().over(Window.partitionBy("replicate", *CELL).orderBy(mixed)).cast("long")
    return every.select("replicate", *CELL, F.when(F.col("replicate") < 0, F.col("month")).otherwise(place).alias("month"), "value")


def margins(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, candidate, item, margin: how far the strongest season of the mean profile is above the next, over the mean."""
    mean = rows.groupBy(*by, "candidate", "item", "season").agg(F.avg("profile").alias("m"))
    each = mean.groupBy(*by, "candidate", "item").agg(F.sort_array(F.collect_list("m"), asc=False).alias("m"), F.avg("m").alias("all"))  # four seasons
    return each.select(*by, "candidate", "item", F.round(F.coalesce(F.try_divide(F.col("m")[0] - F.col("m")[1], F.col("all")), F.lit(0.0)), 9).alias("margin"))


def grid_null(panel: DataFrame, replicates: int) -> DataFrame:
    """candidate, item, margin, p, p_grid: the share of shuffles (and the panel itself) with a margin at least as large for
    that candidate; and with one at least as large for any candidate of the item, which holds for the whole grid."""
    found = checkpointed(margins(profiles(shuffled(panel, replicates), ["replicate"]), ["replicate"]))
    seen = found.filter("replicate < 0").select("candidate", "item", F.col("margin").alias("seen"))
    null = found.filter("replicate >= 0")
    largest = null.groupBy("replicate", "item").agg(F.max("margin").alias("largest"))
    rows = null.join(F.broadcast(seen), ["candidate", "item"]).join(largest, ["replicate", "item"])
    count = lambda c: (1 + F.count_if(c >= F.col("seen"))) / F.lit(replicates + 1.0)
    out = rows.groupBy("candidate", "item").agg(F.first("seen").alias("margin"), count(F.col("margin")).alias("p"), count(F.col("largest")).alias("p_grid"))
    return out.select("candidate", "item", F.round("margin", 6).alias("margin"), F.round("p", 6).alias("p"), F.round("p_grid", 6).alias("p_grid"))
