"""Between a plan and the field: stability of choices, forms, results, travel gates, rechecks, staged objectives."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteward.functions.stats import haversine_km
from siteward.sources.tables import assert_unique, ceil_share, field_status, iso_date

# Words of the travel contract.
CONFIRMED_EVIDENCE = "CONFIRMED_TEAM_BASE_NETWORK"
TRAVEL_ENABLED = "ENABLED_CONFIRMED_TEAM_BASE_NETWORK"
TRAVEL_DISABLED = "DISABLED_UNCONFIRMED_TEAM_BASE"

# The metrics of each scenario in the order in which they are optimised; cost is least last.
SCENARIOS = {
    "efficiency": ("total_population", "need_weighted", "min_region"),
    "balanced": ("need_weighted", "min_region", "total_population"),
    "equity": ("min_region", "high_need", "need_weighted"),
    "equity_hard": ("min_region", "high_need", "need_weighted"),
}


def plan_stability(eligible: DataFrame, chosen: DataFrame, by: str) -> DataFrame:
    """by, plans, stability: in how many plans every eligible ``by`` is chosen, and their share of all plans; 0 if in
    none.  What plans chose beyond the eligible ones plays no part."""
    total = F.broadcast(chosen.agg(F.count_distinct("plan").alias("_all")))  # one row
    held = chosen.groupBy(by).agg(F.count_distinct("plan").alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    rows = eligible.select(by).distinct().join(held, by, "left").crossJoin(total)
    return rows.select(by, n.alias("plans"), F.round(F.coalesce(F.try_divide(n, F.col("_all")), F.lit(0.0)), 6).alias("stability"))


def field_form(sites: DataFrame, identity: Sequence[str], states: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """A form per site: nothing is known until it is written down, and no flag is set."""
    return sites.select(*identity, *[F.lit("UNKNOWN").alias(c) for c in (*states, "verification_date")], *[F.lit(False).alias(c) for c in flags])


def merged_results(queue: DataFrame, results: DataFrame, key: str, status: str, date: str) -> DataFrame:
    """queue with the normalised status and date of each row's result; a row without one stays unknown, and a result
    that comes twice is an error."""
    rows = assert_unique(results.select(key, F.col(status).alias("_word"), F.col(date).alias("_date")), [key])
    merged = queue.join(rows, key, "left")
    return merged.withColumns({"field_status": field_status(F.col("_word")), "verified_on": iso_date(F.col("_date"))}).drop("_word", "_date")


def gated_travel(sites: DataFrame, confirmed: bool, travel: str, evidence: str, diagnostic: str | None = None) -> DataFrame:
    """sites with ``final_travel_minutes`` and ``final_travel_input_status``.

    Without a confirmed base both the source and the final minutes are null.  With one, every row must come from the
    confirmed network, be no diagnosis, and hold finite minutes of 0 or more: any other row is an error at run time."""
    if not confirmed:
        none = F.lit(None).cast("double")
        return sites.withColumns({travel: none, "final_travel_minutes": none, "final_travel_input_status": F.lit(TRAVEL_DISABLED)})
    value = F.col(travel).try_cast("double")
    fault = F.when(F.coalesce(F.upper(F.trim(evidence)) != CONFIRMED_EVIDENCE, F.lit(True)), "travel: no confirmed network")
    if diagnostic:
        fault = fault.when(F.coalesce(F.col(diagnostic), F.lit(True)), "travel: a diagnosis is never final")
    fault = fault.when(value.isNull() | F.isnan(value) | (value < 0) | (value == float("inf")), "travel: minutes are missing or negative")
    good = F.when(fault.isNotNull(), F.raise_error(fault).cast("double")).otherwise(value)
    return sites.withColumns({travel: good, "final_travel_minutes": good, "final_travel_input_status": F.lit(TRAVEL_ENABLED)})


def recheck(chosen: DataFrame, sites: DataFrame, visits: int, caps: Mapping[str, int], overlap: str) -> DataFrame:
    """plan, faults: what a plan breaks (its number of visits, unknown sites, excluded overlaps, caps by column)."""
    rows = chosen.select("plan", "site").join(sites.withColumn("_known", F.lit(1)), "site", "left")
    out = rows.groupBy("plan").agg(
        ((F.count("*") != visits) | (F.count_distinct("site") != F.count("*"))).alias("_visits"),
        (F.count_if(F.col("_known").isNull()) > 0).alias("_unknown"),
        (F.count_if(F.col(overlap) == 1) > 0).alias("_overlap"),
    )
    for column, most in caps.items():
        own = rows.filter(F.col(column).isNotNull()).groupBy("plan", column).agg(F.count("*").alias("_n"))
        out = out.join(own.groupBy("plan").agg((F.max("_n") > most).alias(f"_{column}")), "plan", "left")
    names = ["visits", "unknown", "overlap", *caps]
    return out.select("plan", F.array_join(F.array_compact(F.array(*[F.when(F.col(f"_{n}"), F.lit(n)) for n in names])), "|").alias("faults"))


def lexicographic(metrics: DataFrame, stages: Sequence[str], retention: Mapping[str, float], cost: str, key: str = "plan") -> DataFrame:
    """key: the plan of least cost (ties to the smaller key) among those that hold, stage after stage, the retained share
    of the best value left.  Metrics are whole numbers."""
    rows = metrics
    for metric in stages:
        best = F.broadcast(rows.agg(F.max(metric).alias("_best")))  # one row
        rows = rows.crossJoin(best).filter(F.col(metric) >= ceil_share(F.col("_best"), retention[metric])).drop("_best")
    return rows.orderBy(cost, key).limit(1).select(key)


def distance_by_names(names: tuple[str, str], first: tuple[Column, Column], second: tuple[Column, Column]) -> Column:
    """Metres between two points: on the globe if the names are of latitude and longitude, else in the plane; infinite
    where a coordinate is missing."""
    (a1, a2), (b1, b2) = first, second
    if "lat" in names[0].lower() or "lon" in names[1].lower():
        far = 1000.0 * haversine_km(a1, a2, b1, b2)
    else:
        far = F.hypot(a1 - b1, a2 - b2)
    return F.coalesce(far, F.lit(float("inf")))


def affected(shocks: DataFrame, uses: DataFrame) -> DataFrame:
    """feature, items, mean_shift, largest: shocks of a feature, over the items that depend on it alone."""
    own = shocks.join(uses.select("feature", "item").distinct(), ["feature", "item"])
    size = F.abs("shift")
    return own.groupBy("feature").agg(F.count("*").alias("items"), F.round(F.avg(size), 6).alias("mean_shift"), F.round(F.max(size), 6).alias("largest"))
