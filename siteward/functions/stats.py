"""Column builders and distributed ranks with the exact tie and edge rules of the engine.

Global ranks never gather a table in one task: values are counted first, dealt into ranges by
approximate quantiles, ranked inside their range and shifted by the counts of the ranges before.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteward.sources.tables import checkpointed

RANGES = 64


def clip(x: Column, low, high) -> Column:
    """x within low..high; a null stays null (greatest and least alone would take the bound for it)."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.when(x.isNotNull(), F.least(F.greatest(x, lit(low)), lit(high)))


def rounded(x: Column, digits: int = 6) -> Column:
    """x rounded half away from zero as most SQL engines do: scaled, rounded to a whole number, scaled back.  Spark's own
    ``round`` goes by the decimal text, which parts from it where a value lies within a bit of a half."""
    scale = float(10**digits)
    return F.round(x.cast("double") * scale, 0) / scale


def value_positions(df: DataFrame, value: str, by: Sequence[str] = (), few: bool = False, weight: str | None = None) -> DataFrame:
    """by, value, less (rows below it), same (rows at it), total; nulls are left out; a row counts ``weight`` times.

    Without ``by``, or with ``few`` large groups, values are dealt into RANGES ranges a group; many
    groups are ranked by one window each."""
    by = [*by]
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg((F.sum(weight) if weight else F.count("*")).alias("same"))
    if by and not few:
        below = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        return counts.withColumn("less", F.coalesce(F.sum("same").over(below), F.lit(0))).withColumn("total", F.sum("same").over(Window.partitionBy(*by)))
    # Written once: cuts, sums and ranks below read it, and not what it was made of.
    counts = checkpointed(counts)
    cuts = counts.groupBy(*by).agg(F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)], 1000).alias("_cuts"))
    spread = counts.join(F.broadcast(cuts), by) if by else counts.crossJoin(F.broadcast(cuts))
    spread = spread.withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    sums = spread.groupBy(*by, "_range").agg(F.sum("same").alias("_n"))  # RANGES rows a group at most
    ahead, every = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    sums = sums.select(*by, "_range", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"), F.sum("_n").over(every).alias("total"))
    below = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = spread.join(F.broadcast(sums), [*by, "_range"])
    return out.withColumn("less", F.col("_before") + F.coalesce(F.sum("same").over(below), F.lit(0))).drop("_range", "_before")


def quantiles(df: DataFrame, value: str, points: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """by and one column per point: exact quantiles with linear interpolation.

    They are read off the ranked distinct values, so no task holds all values of a group, as an exact
    percentile aggregate does; groups are few (features) or none."""
    return quantiles_at(value_positions(df, value, by, few=True), value, points, by)


def quantiles_at(at: DataFrame, value: str, points: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """quantiles of values whose positions are known."""
    out = []
    for name, p in points.items():
        h = (F.col("total") - 1) * p
        low, high = F.floor(h), F.ceil(h)
        pick = lambda k: F.max(F.when((F.col("less") <= k) & (k < F.col("less") + F.col("same")), F.col(value)))
        out.append((pick(low) + (pick(high) - pick(low)) * F.max(h - low)).alias(name))
    return at.groupBy(*by).agg(*out)


def rank_percentile(df: DataFrame, value: str, out: str, by: Sequence[str] = (), few: bool = False) -> DataFrame:
    """df with the average-rank percentile (0 to 1) of value; null where value is null."""
    at = value_positions(df, value, by, few)
    at = at.select(*by, F.col(value), ((F.col("less") + (F.col("same") + 1) / 2) / F.col("total")).alias(out))
    return df.join(at, [*by, value], "left")


def average_rank(df: DataFrame, value: str, out: str, by: Sequence[str] = (), few: bool = False) -> DataFrame:
    """df with the average rank (1 is the smallest) of value."""
    at = value_positions(df, value, by, few)
    return df.join(at.select(*by, F.col(value), (F.col("less") + (F.col("same") + 1) / 2).alias(out)), [*by, value], "left")


def ordered_rank(df: DataFrame, score: str, key: str, out: str = "rank", tied: str | None = None, size: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """df with its place by score, highest first, then key; and, if named, the tied rank and tie size; in each of a few
    large groups, if ``by`` names them."""
    by = [*by]
    at = value_positions(df, score, by, few=True).select(*by, score, (F.col("total") - F.col("less") - F.col("same")).alias("_above"), F.col("same").alias("_same"))
    df = df.join(at, [*by, score])
    place = F.row_number().over(Window.partitionBy(*by, score).orderBy(key))
    df = df.withColumn(out, (F.col("_above") + place).cast("long"))
    if tied:
        df = df.withColumn(tied, (F.col("_above") + 1).cast("long"))
    if size:
        df = df.withColumn(size, F.col("_same").cast("long"))
    return df.drop("_above", "_same")


def safe_corr(x: str, y: str) -> Column:
    """Pearson correlation; null where one side is constant."""
    flat = (F.coalesce(F.stddev_pop(x), F.lit(0.0)) <= 1e-15) | (F.coalesce(F.stddev_pop(y), F.lit(0.0)) <= 1e-15)
    both = (F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)) > 1)
    top = F.covar_pop(x, y)
    return F.when(both & ~flat, F.try_divide(top, F.stddev_pop(F.when(F.col(y).isNotNull(), F.col(x))) * F.stddev_pop(F.when(F.col(x).isNotNull(), F.col(y)))))


def gini(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Gini coefficient of non-negative values; 0 for an empty or all-zero group.

    Equal values are counted, so that no task sorts a table: n rows of v behind ``less`` others hold the
    places less + 1 to less + n."""
    rows = df.select(*by, F.greatest(F.col(value), F.lit(0.0)).alias("_v"))
    at = value_positions(rows, "_v", by)
    s, less, v = F.col("same").cast("double"), F.col("less").cast("double"), F.col("_v")
    n, total = F.sum(s), F.sum(v * s)
    out = F.when(total > 0, 2 * F.sum(v * (s * less + s * (s + 1) / 2)) / (n * total) - (n + 1) / n).otherwise(0.0)
    return at.groupBy(*by).agg(out.alias("gini"))


def hhi(value: str) -> Column:
    """Herfindahl index from an aggregate of non-negative values; 0 if all are zero."""
    return F.when(F.sum(value) > 0, F.sum(F.col(value) * F.col(value)) / (F.sum(value) * F.sum(value))).otherwise(0.0)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    rad = F.radians
    a = F.pow(F.sin((rad(lat2) - rad(lat1)) / 2), 2) + F.cos(rad(lat1)) * F.cos(rad(lat2)) * F.pow(F.sin((rad(lon2) - rad(lon1)) / 2), 2)
    return 2 * 6371.0088 * F.asin(F.sqrt(clip(a, 0.0, 1.0)))


def circular_month_distance(a: Column, b: Column) -> Column:
    return F.least(F.abs(a - b), 12 - F.abs(a - b))
