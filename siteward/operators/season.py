"""Months and seasons: calendars, modifiers, shrinkage, hazards, fits, transfer and resampling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteward.functions.stats import clip, rank_percentile, safe_corr

SEASONS = {12: "winter", 1: "winter", 2: "winter", 3: "spring", 4: "spring", 5: "spring", 6: "summer", 7: "summer", 8: "summer", 9: "autumn", 10: "autumn", 11: "autumn"}
ORDER = {"winter": 0, "spring": 1, "summer": 2, "autumn": 3}
MODIFIER_RANGE = (0.85, 1.15)


def season_of(month: Column) -> Column:
    return F.when(month.isin(12, 1, 2), "winter").when(month.between(3, 5), "spring").when(month.between(6, 8), "summer").otherwise("autumn")


def season_order(season: Column) -> Column:
    return F.when(season == "winter", 0).when(season == "spring", 1).when(season == "summer", 2).otherwise(3)


def working_day_calendar(spark: SparkSession, first_year: int, last_year: int, holidays: Sequence[str]) -> DataFrame:
    """year, month, calendar_days, working_days: weekdays that are no holiday."""
    days = spark.sql(f"SELECT explode(sequence(DATE'{first_year}-01-01', DATE'{last_year}-12-31')) AS day")
    free = spark.createDataFrame([(h,) for h in sorted(set(holidays))], "h string").select(F.to_date("h").alias("day"), F.lit(1).alias("off"))
    rows = days.join(F.broadcast(free), "day", "left")
    return rows.groupBy(F.year("day").cast("long").alias("year"), F.month("day").cast("long").alias("month")).agg(
        F.count("*").alias("calendar_days"), F.count_if((F.weekday("day") < 5) & F.col("off").isNull()).alias("working_days")
    )


def monthly_modifiers(panel: DataFrame, calendar: DataFrame, region: str, item: str, value: str) -> DataFrame:
    """item, year, month, modifier: rate per working day over the year's mean, averaged over regions."""
    rate = panel.join(F.broadcast(calendar), ["year", "month"]).withColumn("rate", F.col(value) / F.col("working_days"))
    mean = F.avg("rate").over(Window.partitionBy(region, item, "year"))
    rate = rate.withColumn("m", F.try_divide("rate", mean))
    return rate.groupBy(item, "year", "month").agg(F.round(F.avg("m"), 6).alias("modifier"))


def shrunk_modifiers(modifiers: DataFrame, item: str, first: int, second: int) -> DataFrame:
    """item, month, rho of the two years, tier, modifier shrunk toward 1 by the tier's share and kept in range."""
    a = modifiers.filter(F.col("year") == first).select(item, "month", F.col("modifier").alias("x"))
    b = modifiers.filter(F.col("year") == second).select(item, "month", F.col("modifier").alias("y"))
    both = a.join(b, [item, "month"])
    fit = both.groupBy(item).agg(F.round(safe_corr("x", "y"), 6).alias("rho"))
    tier = F.when(F.col("rho") >= 0.6, "high").when(F.col("rho") >= 0.2, "medium").otherwise("low")
    share = F.when(F.col("tier") == "high", 1.0).when(F.col("tier") == "medium", 0.5).otherwise(0.0)
    out = both.join(F.broadcast(fit), item).withColumn("tier", tier)
    mean = (F.col("x") + F.col("y")) / 2
    return out.select(item, "month", "rho", "tier", F.round(clip(1 + share * (mean - 1), *MODIFIER_RANGE), 6).alias("modifier"))


def positive_percentile(df: DataFrame, value: str, out: str) -> DataFrame:
    """0 for values of 0 or less; the others' average-rank percentile among themselves, times 100."""
    df = df.withColumn("_v", F.when(F.col(value) > 0, F.col(value)))
    df = rank_percentile(df, "_v", "_p")
    return df.withColumn(out, F.coalesce(F.col("_p") * 100, F.lit(0.0))).drop("_v", "_p")


def hazard_risk(daily: DataFrame, unit: str, period: str, value: str, hazards: Mapping[str, tuple[str, float, float]]) -> DataFrame:
    """unit, period, risk: days past each hazard's threshold ((op, threshold, weight)), as positive percentiles, weighted."""
    flags = [F.count_if(F.col(value) > t if op == ">" else F.col(value) < t).cast("double").alias(name) for name, (op, t, _) in hazards.items()]
    out = daily.groupBy(unit, period).agg(*flags)
    for name in hazards:
        out = positive_percentile(out, name, f"{name}_pct")
    total = sum(w for _, _, w in hazards.values())
    risk = sum((F.col(f"{n}_pct") * (w / total) for n, (_, _, w) in hazards.items()), F.lit(0.0))
    return out.select(unit, period, *[F.col(n).cast("long").alias(n) for n in hazards], F.round(risk, 6).alias("risk"))


def month_fit(units: DataFrame, profile: DataFrame, unit: str, bundle: str, base: str, weight: float) -> DataFrame:
    """Every unit x (bundle, month): weight * season score + (1 - weight) * the unit's own score."""
    return units.crossJoin(F.broadcast(profile)).withColumn("fit", F.round(weight * F.col("season_score") + (1 - weight) * F.col(base), 6))


def primary_fallback(fit: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The best month, and the best month of another quarter; ties go to the earlier month."""
    order = [F.col("fit").desc(), F.col("month")]
    first = fit.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_k = 1")
    first = first.select(*keys, F.col("month").alias("primary_month"), F.col("fit").alias("primary_fit"))
    quarter = lambda m: F.floor((m - 1) / 3)
    rest = fit.join(first, [*keys]).filter(quarter(F.col("month")) != quarter(F.col("primary_month")))
    second = rest.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_k = 1")
    return first.join(second.select(*keys, F.col("month").alias("fallback_month"), F.col("fit").alias("fallback_fit")), [*keys], "left")


def season_fit(fit: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The two best seasons by mean fit, their margin; ties in the order winter, spring, summer, autumn."""
    mean = fit.groupBy(*keys, season_of(F.col("month")).alias("season")).agg(F.round(F.avg("fit"), 6).alias("fit"))
    order = Window.partitionBy(*keys).orderBy(F.col("fit").desc(), season_order(F.col("season")))
    ranked = mean.withColumn("k", F.row_number().over(order)).filter("k <= 2")
    pick = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c)))
    return ranked.groupBy(*keys).agg(pick("season", 1).alias("first"), pick("season", 2).alias("second"), F.round(pick("fit", 1) - pick("fit", 2), 6).alias("margin"))


def released(seasons: DataFrame, least: float) -> DataFrame:
    """Seasons whose margin is below ``least`` are withheld."""
    signal = F.col("margin") >= least
    return seasons.withColumn("signal", F.when(signal, 1).otherwise(0).cast("long")).withColumn("first", F.when(signal, F.col("first"))).withColumn("second", F.when(signal, F.col("second")))


def cross_year_transfer(panel: DataFrame, keys: Sequence[str], train: int, held: int) -> DataFrame:
    """Per key: whether the train year's best month is the held year's, among its top two, and the regret."""
    def ranked(year: int, rank: str, value: str) -> DataFrame:
        rows = panel.filter(F.col("year") == year)
        order = Window.partitionBy(*keys).orderBy(F.col("value").desc(), "month")
        return rows.select(*keys, "month", F.col("value").alias(value), F.row_number().over(order).alias(rank))

    both = ranked(train, "rt", "vt").join(ranked(held, "rh", "vh"), [*keys, "month"])
    at = lambda c, r: F.max(F.when(F.col(r) == 1, F.col(c)))
    out = both.groupBy(*keys).agg(at("month", "rt").alias("train_month"), at("month", "rh").alias("held_month"), at("rh", "rt").alias("place"), at("vh", "rh").alias("best"), at("vh", "rt").alias("got"), F.round(safe_corr("vt", "vh"), 6).alias("rho"))
    return out.select(*keys, "train_month", "held_month", (F.col("place") == 1).cast("long").alias("top1"), (F.col("place") <= 2).cast("long").alias("top2"), F.round(F.try_divide(F.col("best") - F.col("got"), F.col("best")), 6).alias("regret"), "rho")


def consensus(panel: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key and month: mean, worst and Borda rank over years, and its place by (mean, worst, month)."""
    months = 12
    year = Window.partitionBy(*keys, "year").orderBy(F.col("value").desc(), "month")
    ranked = panel.withColumn("r", F.row_number().over(year))
    out = ranked.groupBy(*keys, "month").agg(F.round(F.avg("r"), 6).alias("mean_rank"), F.max("r").cast("long").alias("worst_rank"), F.sum(months - F.col("r")).cast("long").alias("borda"))
    order = Window.partitionBy(*keys).orderBy("mean_rank", "worst_rank", "month")
    return out.withColumn("place", F.row_number().over(order).cast("long"))


def leave_out(panel: DataFrame, left_out: str, item: str, group: str) -> DataFrame:
    """Best month of each item when one group of rows is left out, for every group: one job over a removal table."""
    removed = panel.select(F.col(left_out).alias("removed")).distinct()
    kept = panel.join(F.broadcast(removed), F.col(left_out) != F.col("removed"))
    mean = kept.groupBy("removed", item, group).agg(F.round(F.avg("value"), 6).alias("value"))
    order = Window.partitionBy("removed", item).orderBy(F.col("value").desc(), group)
    return mean.withColumn("k", F.row_number().over(order)).filter("k = 1").select("removed", item, F.col(group).alias("best"), F.col("value"))


def permutation_null(panel: DataFrame, keys: Sequence[str], replicates: int) -> DataFrame:
    """Per key: spread (best minus mean) and p = (1 + #replicates with at least that) / (n + 1), where a
    replicate relabels the months of every year by the order of (month * 7919 + r * 104729 + year * 31) mod 1009."""
    reps = panel.sparkSession.range(1, replicates + 1).withColumnRenamed("id", "r")
    base = panel.groupBy(*keys, "month").agg(F.avg("value").alias("v")).groupBy(*keys).agg(F.round(F.max("v") - F.avg("v"), 6).alias("spread"))
    mixed = panel.crossJoin(F.broadcast(reps))
    block = Window.partitionBy(*keys, "year", "r")
    code = F.pmod(F.col("month") * 7919 + F.col("r") * 104729 + F.col("year") * 31, F.lit(1009))
    mixed = mixed.withColumn("label", F.row_number().over(block.orderBy(code, "month")))
    null = mixed.groupBy(*keys, "r", "label").agg(F.avg("value").alias("v")).groupBy(*keys, "r").agg(F.round(F.max("v") - F.avg("v"), 6).alias("null_spread"))
    joined = null.join(base, [*keys])
    return joined.groupBy(*keys, "spread").agg(F.round((1 + F.count_if(F.col("null_spread") >= F.col("spread"))) / (F.count("*") + 1), 6).alias("p_value"))
