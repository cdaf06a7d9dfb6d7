"""Need scores from feature groups and axes, ablation by scenario rows, and comparison of runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteward.functions.scalers import scaled_long, transformed
from siteward.functions.stats import average_rank, clip, gini, ordered_rank, rank_percentile, rounded, safe_corr, value_positions
from siteward.sources.tables import checkpointed


class Feature(NamedTuple):
    name: str
    group: str
    axis: str
    direction: int = 1
    transform: str = "identity"
    repeats_on: str | None = None  # the column of whose groups the value is a property


def feature_scores(units: DataFrame, features: Sequence[Feature], key: str = "unit", scaler: str = "winsorized_percentile") -> DataFrame:
    """key, feature, score (0..100) in long form.

    Features of the units are scaled over units; a feature that repeats on groups is scaled on one
    row per group and sent back.  Each kind is one job whatever the number of features."""
    spark = units.sparkSession
    units = checkpointed(units)
    turn = F.broadcast(spark.createDataFrame([(f.name, f.direction) for f in features], "feature string, direction int"))
    parts = []
    for group in sorted({f.repeats_on for f in features}, key=lambda g: g or ""):
        mine = [f for f in features if f.repeats_on == group]
        at = group or key
        rows = units.select(at, *[transformed(F.col(f.name), f.transform).alias(f.name) for f in mine])
        rows = rows.dropDuplicates([group]) if group else rows
        # The long matrix is written once; places, bounds and scores read it.
        long = checkpointed(rows.unpivot([at], [f.name for f in mine], "feature", "value").join(turn, "feature"))
        part = scaled_long(long, scaler).select(at, "feature", "score")
        parts.append(units.select(key, group).join(part, group).select(key, "feature", "score") if group else part)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def spec_frame(spark: SparkSession, features: Sequence[Feature]) -> DataFrame:
    return spark.createDataFrame([(f.name, f.group, f.axis) for f in features], "feature string, grp string, axis string")


def axis_scores(scores: DataFrame, spec: DataFrame, key: Sequence[str]) -> DataFrame:
    """Mean over each feature group, then over the groups of each axis."""
    grouped = scores.join(F.broadcast(spec), "feature").groupBy(*key, "grp", "axis").agg(F.avg("score").alias("score"))
    return grouped.groupBy(*key, "axis").agg(F.avg("score").alias("score"))


def in_order(weights: Mapping[str, float]) -> tuple[Column, Column]:
    """Aggregates of the rows (axis, score) of one key: the weighted sum of its scores (null if it has none) and the sum of
    the weights of its axes, both added in the order of ``weights``, so that they don't depend on the order of rows."""
    part = lambda a, x: F.coalesce(F.max(F.when(F.col("axis") == a, x)), F.lit(0.0))
    total = sum((part(a, F.lit(float(w)) * F.col("score")) for a, w in weights.items()), F.lit(0.0))
    return F.when(F.count("score") > 0, total), sum((part(a, F.lit(float(w))) for a, w in weights.items()), F.lit(0.0))


def weighted(axes: DataFrame, weights: Mapping[str, float], key: Sequence[str]) -> DataFrame:
    """Weights are normalised over the axes that are there; a key has one row an axis."""
    total, of = in_order(weights)
    return axes.filter(F.col("axis").isin(*weights)).groupBy(*key).agg(rounded(total / of).alias("score"))


def need_score(units: DataFrame, features: Sequence[Feature], weights: Mapping[str, float], key: str = "unit", scaler: str = "winsorized_percentile") -> DataFrame:
    spark = units.sparkSession
    long = feature_scores(units, features, key, scaler)
    total = checkpointed(weighted(axis_scores(long, spec_frame(spark, features), [key]), weights, [key]))
    return ordered_rank(total, "score", key, "rank", "tied_rank", "tie_size")


def ablation(units: DataFrame, features: Sequence[Feature], weights: Mapping[str, float], key: str = "unit") -> DataFrame:
    """One row per (scenario, unit): every feature dropped (weights renormalised) or set to 50.

    A unit's scores meet once, in one row of sums and counts a feature; scenarios are made of that row where it lies, so
    that nothing is dealt or added up by scenario."""
    long = feature_scores(units, features, key)
    cols = {f.name: (f"_s{i}", f"_c{i}", f"_n{i}") for i, f in enumerate(features)}
    aggs = []
    for name, (s, c, n) in cols.items():
        mine = F.when(F.col("feature") == name, F.col("score"))
        aggs += [F.sum(mine).alias(s), F.count(mine).alias(c), F.count_if(F.col("feature") == name).alias(n)]
    # Dealt before it is added up: a unit's rows lie in different tasks, so sums in front of the shuffle would only be wider rows.
    wide = checkpointed(long.repartition(key).groupBy(key).agg(*aggs))

    def axis_of(axis: str, mode: str | None = None, removed: str | None = None) -> tuple[Column, Column]:
        """Whether the axis has rows, and the mean over its groups of the mean over each group's features."""
        grouped = {}
        for f in features:
            if f.axis == axis and not (mode == "renormalize" and f.name == removed):
                s, c, n = (F.col(x) for x in cols[f.name])
                grouped.setdefault(f.group, []).append((50.0 * n, n, n) if f.name == removed else (F.coalesce(s, F.lit(0.0)), c, n))
        add = lambda xs, zero: sum(xs, F.lit(zero))
        means = [F.try_divide(add((s for s, _, _ in g), 0.0), add((c for _, c, _ in g), 0)) for g in grouped.values()]
        known = add((F.when(m.isNotNull(), 1).otherwise(0) for m in means), 0)
        there = add((n for g in grouped.values() for _, _, n in g), 0) > 0
        return there, F.try_divide(add((F.coalesce(m, F.lit(0.0)) for m in means), 0.0), known)

    axes = list(weights)
    base = [x for i, a in enumerate(axes) for x in (axis_of(a)[0].alias(f"_h{i}"), axis_of(a)[1].alias(f"_a{i}"))]
    # A scenario changes the axis of the feature that it touches alone; the other axes stay as in the baseline.
    plans = [("baseline", None, None)] + [(f"{mode}_{f.name}", mode, f) for f in features for mode in ("renormalize", "neutral")]
    runs = []
    for scenario, mode, f in plans:
        parts = [axis_of(a, mode, f.name) if f and f.axis == a else (F.col(f"_h{i}"), F.col(f"_a{i}")) for i, a in enumerate(axes)]
        total = sum((F.coalesce(F.lit(float(w)) * x, F.lit(0.0)) for (_, x), w in zip(parts, weights.values(), strict=True)), F.lit(0.0))
        of = sum((F.when(h, F.lit(float(w))).otherwise(0.0) for (h, _), w in zip(parts, weights.values(), strict=True)), F.lit(0.0))
        some, scored = (reduce(or_, cs) for cs in ([h for h, _ in parts], [x.isNotNull() for _, x in parts]))
        runs.append(F.struct(F.lit(scenario).alias("scenario"), some.alias("_some"), F.when(scored, rounded(total / of)).alias("score")))
    return wide.select("*", *base).select(key, F.inline(F.array(*runs))).filter("_some").select("scenario", key, "score")


def top_jaccard(both: DataFrame, a: str, b: str, k: int) -> Column:
    """Aggregate: Jaccard index of the rows of rank <= k by a and by b."""
    inter = F.count_if((F.col(a) <= k) & (F.col(b) <= k))
    union = F.count_if((F.col(a) <= k) | (F.col(b) <= k))
    return F.when(union > 0, inter / union).otherwise(1.0)


def compare_runs(base: DataFrame, other: DataFrame, key: str = "unit") -> DataFrame:
    """One row: errors, rank agreement, rank shifts, top sets of two runs (key, score)."""
    both = checkpointed(base.select(key, F.lit("b").alias("run"), "score").union(other.select(key, F.lit("o").alias("run"), "score")))
    at = value_positions(both, "score", ["run"], few=True)
    placed = both.join(at, ["run", "score"])
    place = F.col("total") - F.col("less") - F.col("same") + F.row_number().over(Window.partitionBy("run", "score").orderBy(key))
    placed = placed.select(key, "run", "score", (F.col("less") + (F.col("same") + 1) / 2).alias("r"), place.alias("p"))
    pick = lambda run, c, name: F.max(F.when(F.col("run") == run, F.col(c))).alias(name)
    both = placed.groupBy(key).agg(pick("b", "score", "x"), pick("o", "score", "y"), pick("b", "r", "rx"), pick("o", "r", "ry"), pick("b", "p", "px"), pick("o", "p", "py"))
    both = both.filter(F.col("x").isNotNull() & F.col("y").isNotNull()).withColumn("d", F.col("y") - F.col("x")).withColumn("shift", F.abs(F.col("py") - F.col("px")))
    r = lambda c, name: F.round(c, 6).alias(name)
    return both.agg(
        F.count("*").alias("n"), r(F.avg(F.abs("d")), "mae"), r(F.sqrt(F.avg(F.col("d") * F.col("d"))), "rmse"), r(safe_corr("rx", "ry"), "spearman"),
        r(F.median("shift"), "shift_median"), r(F.percentile("shift", 0.95), "shift_p95"), F.max("shift").cast("long").alias("shift_max"),
        r(top_jaccard(both, "px", "py", 10), "top10_jaccard"), r(top_jaccard(both, "px", "py", 20), "top20_jaccard"), r(top_jaccard(both, "px", "py", 30), "top30_jaccard"),
    )


def kendall_tau_b(df: DataFrame, x: str, y: str) -> DataFrame:
    """tau: tau-b over all pairs of rows, without making the pairs; rows whose x or y is null or NaN take no part, and it is
    null where a side is constant.

    Pairs that are neither tied are all less the discordant ones.  These part at one bit of the place of x: among rows
    whose places agree above it, a row with the bit set counts those without it that have a larger y.  Rows are first added
    up by place of y, and sums run inside chunks of places and then over chunks, so no task holds more than about
    the root of the number of rows."""
    number = lambda c: F.col(c).cast("double")
    rows = df.select(number(x).alias("x"), number(y).alias("y")).filter("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    points = checkpointed(rows.groupBy("x", "y").agg(F.count("*").alias("w")))
    at = {c: value_positions(points, c, weight="w").select(c, F.col("less").cast("long").alias(f"p{c}"), F.col("same").cast("long").alias(f"s{c}")) for c in ("x", "y")}
    n = points.agg(F.coalesce(F.sum("w"), F.lit(0))).collect()[0][0]
    bits = max(1, int(n).bit_length())
    placed = points.join(at["x"], "x").join(at["y"], "y").select("w", "px", F.col("py").alias("py"), F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("bit"))
    placed = placed.withColumn("head", F.expr("shiftright(px, bit + 1)")).withColumn("one", F.expr("shiftright(px, bit) & 1"))
    by = ["bit", "head", "chunk"]
    sums = placed.groupBy("bit", "head", "py").agg(F.sum(F.when(F.col("one") == 0, F.col("w")).otherwise(0)).alias("less"), F.sum(F.when(F.col("one") == 1, F.col("w")).otherwise(0)).alias("more"))
    sums = sums.withColumn("chunk", F.shiftright("py", bits // 2))
    before = lambda keys, order: Window.partitionBy(*keys).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, -1)
    inner = sums.withColumn("_in", F.coalesce(F.sum("less").over(before(by, "py")), F.lit(0))).filter("more > 0")
    outer = sums.groupBy(*by).agg(F.sum("less").alias("_all")).withColumn("_out", F.coalesce(F.sum("_all").over(before(by[:2], "chunk")), F.lit(0)))
    big = lambda c: c.cast("decimal(19,0)")
    against = inner.join(outer, by).agg(F.coalesce(F.sum(big(F.col("more")) * big(F.col("_in") + F.col("_out"))), F.lit(0)).alias("d"))
    pairs = lambda c: F.coalesce(F.sum(big(F.col(c)) * big(F.col(c) - 1)), F.lit(0)) / 2
    ties = against.crossJoin(points.agg(pairs("w").alias("both")))
    for c in ("x", "y"):
        ties = ties.crossJoin(at[c].agg(pairs(f"s{c}").alias(c)))  # one row each
    whole = F.lit(n * (n - 1) // 2).cast("decimal(38,0)")
    of = lambda c: (whole - F.col(c)).cast("double")
    base = F.sqrt(of("x")) * F.sqrt(of("y"))
    net = (whole - F.col("x") - F.col("y") + F.col("both") - 2 * F.col("d")).cast("double")
    return ties.select(F.when(base > 0, net / base).alias("tau"))


def region_distribution(df: DataFrame, region: str, value: str) -> DataFrame:
    total = df.agg(F.sum(value).alias("_t"))
    return df.groupBy(region).agg(F.sum(value).alias("_s")).crossJoin(F.broadcast(total)).select(region, F.try_divide("_s", "_t").alias("share"))


def total_variation(p: DataFrame, q: DataFrame, key: str) -> DataFrame:
    """Half the sum of absolute differences of two share tables (key, share)."""
    both = p.select(key, F.col("share").alias("p")).join(q.select(key, F.col("share").alias("q")), key, "full_outer")
    return both.agg((F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))) / 2).alias("tvd"))


def ranked_columns(df: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """key and the average rank of each named column, all ranked in one job."""
    long = df.select(key, *[F.col(n).cast("double").alias(n) for n in names]).unpivot([key], [*names], "feature", "value")
    long = average_rank(long, "value", "r", ["feature"], few=True)
    return long.groupBy(key).agg(*[F.max(F.when(F.col("feature") == n, F.col("r"))).alias(n) for n in names])


def spearman_pairs(df: DataFrame, key: str, names: Sequence[str], least: int = 3) -> DataFrame:
    """a, b, n, rho of each pair of columns: whole columns are ranked, pairs are complete."""
    rows = []
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            n = F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull())
            rows.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), n.alias("n"), F.when(n >= least, safe_corr(a, b)).alias("rho")))
    # One aggregate pass for all pairs.
    return ranked_columns(df, key, names).agg(F.array(*rows).alias("p")).select(F.explode("p").alias("p")).select("p.a", "p.b", "p.n", F.round("p.rho", 6).alias("rho"))


def partial_spearman(df: DataFrame, key: str, x: str, y: str, control: str) -> DataFrame:
    """rho of x and y after the ranked control is regressed out of both ranks."""
    ranked = ranked_columns(df, key, [x, y, control])
    fit = ranked.agg(
        F.regr_slope(x, control).alias("_sx"), F.regr_intercept(x, control).alias("_ix"), F.regr_slope(y, control).alias("_sy"), F.regr_intercept(y, control).alias("_iy"),
    )
    left = ranked.crossJoin(F.broadcast(fit))
    left = left.select((F.col(x) - F.col("_sx") * F.col(control) - F.col("_ix")).alias("ex"), (F.col(y) - F.col("_sy") * F.col(control) - F.col("_iy")).alias("ey"))
    return left.agg(F.round(safe_corr("ex", "ey"), 6).alias("rho"))


def feature_manifest(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per column from one pass: rows, nulls, different values, whether it is constant."""
    rows = [F.struct(F.lit(n).alias("feature"), F.count("*").alias("n"), F.count_if(F.col(n).isNull()).alias("nulls"), F.count_distinct(n).alias("uniques")) for n in names]
    out = df.agg(F.array(*rows).alias("p")).select(F.explode("p").alias("p")).select("p.*")
    return out.withColumn("constant", F.when(F.col("uniques") <= 1, 1).otherwise(0).cast("long"))


def quality_gates(values: DataFrame, gates: Sequence[tuple[str, str, str, float]]) -> DataFrame:
    """values: one row; gates: (id, column, ``<=`` or ``>=``, threshold). One row per gate."""
    rows = []
    for gate, column, op, threshold in gates:
        seen = F.col(column).cast("double")
        passed = (seen <= threshold) if op == "<=" else (seen >= threshold)
        rows.append(F.struct(F.lit(gate).alias("gate_id"), F.round(seen, 6).alias("observed"), F.lit(op).alias("comparison"), F.lit(float(threshold)).alias("threshold"), F.when(passed, 1).otherwise(0).cast("long").alias("passed")))
    return values.select(F.explode(F.array(*rows)).alias("g")).select("g.*")


def block_bootstrap(df: DataFrame, block: str, value: str, replicates: int, seed: int = 1) -> DataFrame:
    """Means of resampled whole blocks: replicate r draws block number (seed + r * 7919 + k * 104729 + r * k * 31) mod blocks as its k-th."""
    sums = df.groupBy(block).agg(F.sum(value).alias("s"), F.count(value).alias("c"))
    numbered = sums.withColumn("i", F.row_number().over(Window.orderBy(block)) - 1)  # one row a block
    n = numbered.count()
    draws = df.sparkSession.range(replicates).withColumnRenamed("id", "r").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(max(0, n - 1)))))
    draws = draws.withColumn("i", F.pmod(F.lit(seed) + F.col("r") * 7919 + F.col("k") * 104729 + F.col("r") * F.col("k") * 31, F.lit(max(1, n))))
    return draws.join(F.broadcast(numbered), "i").groupBy(F.col("r").alias("replicate")).agg(F.round(F.sum("s") / F.sum("c"), 6).alias("mean"))


def neutral(score: Column, known: Column) -> Column:
    """50 where the value behind a score is not defined."""
    return F.when(known, clip(score, 0.0, 100.0)).otherwise(50.0)


__all__ = ["Feature", "ablation", "average_rank", "block_bootstrap", "compare_runs", "feature_manifest", "feature_scores", "gini", "kendall_tau_b", "need_score", "neutral", "partial_spearman", "quality_gates", "rank_percentile", "region_distribution", "spearman_pairs", "total_variation"]
