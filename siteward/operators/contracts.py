"""Contracts and hand-offs: expectations in one pass, status words, queues, fallbacks, panels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteward.functions.stats import haversine_km, rank_percentile
from siteward.operators.spatial import nearest
from siteward.sources.tables import tri_state


def audit(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """rule, rows, violations: every expectation (true is good, null is a violation) in one aggregate."""
    rows = [F.struct(F.lit(n).alias("rule"), F.count("*").alias("rows"), F.count_if(~F.coalesce(c, F.lit(False))).alias("violations")) for n, c in rules.items()]
    return df.agg(F.array(*rows).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def feasibility(df: DataFrame, key: str, flags: Sequence[str]) -> DataFrame:
    """key, known, unknown, status: yes/no/unknown words per flag; unknown is never counted as no."""
    states = [tri_state(F.col(f)) for f in flags]
    count = lambda v: sum((F.when(s == v, 1).otherwise(0) for s in states), F.lit(0)).cast("long")
    out = df.select(key, count(1).alias("yes"), count(0).alias("no"), count(-1).alias("unknown"))
    return out.withColumn("status", F.when(F.col("no") > 0, "blocked").when(F.col("unknown") > 0, "unknown").otherwise("ready"))


def field_queue(sites: DataFrame, mandatory: DataFrame, weights: Mapping[str, float], most: int) -> DataFrame:
    """place, site: mandatory sites first, then by weighted rank fractions; a bounded queue is the feature."""
    out = sites
    long = out.select("site", *[F.col(c).cast("double").alias(c) for c in weights]).unpivot(["site"], [*weights], "feature", "value")
    long = rank_percentile(long, "value", "p", ["feature"], few=True)
    part = sum((F.when(F.col("feature") == c, F.coalesce("p", F.lit(0.5)) * w).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    score = long.groupBy("site").agg(F.round(F.sum(part), 6).alias("priority"))
    rows = score.join(mandatory.select("site", F.lit(1).alias("must")).distinct(), "site", "left").withColumn("must", F.coalesce("must", F.lit(0)).cast("long"))
    top = rows.orderBy(F.col("must").desc(), F.col("priority").desc(), "site").limit(most)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.col("must").desc(), F.col("priority").desc(), "site")).cast("long"))  # ``most`` rows


def robust_core(frequency: DataFrame, least: float = 0.67) -> DataFrame:
    """Sites chosen in at least that share of plans."""
    return frequency.filter(F.col("frequency") >= least).select("site", "plans", "frequency")


def proxy_resolution(sites: DataFrame, top: int = 2) -> DataFrame:
    """proxy, place, site: the nearest real sites of the same region for every proxy (``is_proxy`` = 1)."""
    proxies = sites.filter("is_proxy = 1").select(F.col("site").alias("cell"), "x", "y", "region")
    return nearest(proxies, sites.filter("is_proxy = 0"), top, ["region"]).withColumnRenamed("cell", "proxy")


def nearest_k(cells: DataFrame, sites: DataFrame, k: int) -> DataFrame:
    """cell, place, site, distance of the k nearest sites."""
    return nearest(cells, sites, k)


def great_circle(points: DataFrame, key: str, lat0: float, lon0: float) -> DataFrame:
    return points.select(key, F.round(haversine_km(F.col("lat"), F.col("lon"), F.lit(lat0), F.lit(lon0)), 4).alias("km"))


def series_representatives(rows: DataFrame, unit: str, step: str, value: str) -> DataFrame:
    """representative, members: units with equal series share one, found by a content hash."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(step, value))), lambda s: F.concat_ws(":", s[step].cast("string"), s[value].cast("string"))), "|")
    return rows.groupBy(unit).agg(F.sha2(text, 256).alias("h")).groupBy("h").agg(F.min(unit).alias("representative"), F.count("*").alias("members")).select("representative", "members")


def rank_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve by the rank sum, ties at half."""
    from siteward.functions.stats import average_rank

    r = average_rank(df.select(score, label), score, "r").agg(F.sum(F.when(F.col(label) == 1, F.col("r"))).alias("s"), F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    return r.select("p", "n", F.round(F.try_divide(F.col("s") - F.col("p") * (F.col("p") + 1) / 2, (F.col("p") * F.col("n")).cast("double")), 6).alias("auc"))


def exposure_change(narrow: DataFrame, wide: DataFrame, key: str, value: str) -> DataFrame:
    """key, before, after, relative change (null where nothing was before)."""
    both = narrow.select(key, F.col(value).alias("before")).join(wide.select(key, F.col(value).alias("after")), key, "full_outer")
    both = both.select(key, F.coalesce("before", F.lit(0.0)).alias("before"), F.coalesce("after", F.lit(0.0)).alias("after"))
    return both.withColumn("change", F.when(F.col("before") > 0, F.round((F.col("after") - F.col("before")) / F.col("before"), 6)))


def held_out_stability(rows: DataFrame, unit: str, period: str, value: str) -> DataFrame:
    """held, n, rho between the held-out period and the mean of the others, over units."""
    from siteward.functions.stats import safe_corr

    periods = rows.select(F.col(period).alias("held")).distinct()
    rest = rows.join(F.broadcast(periods), F.col(period) != F.col("held")).groupBy("held", unit).agg(F.avg(value).alias("o"))
    mine = rows.select(F.col(period).alias("held"), unit, F.col(value).cast("double").alias("v"))
    return mine.join(rest, ["held", unit]).groupBy("held").agg(F.count("*").alias("n"), F.round(safe_corr("v", "o"), 6).alias("rho"))
