"""Rank correlation beyond plain pairs: residual ranks on several controls, and the block bootstrap of its quality."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteward.functions.stats import quantiles, rank_percentile, safe_corr
from siteward.sources.tables import checkpointed

#: Eigenvalues of a Gram matrix below this share of the largest are those of collinear controls.
COLLINEAR = 1e-9


def residual_ranks(df: DataFrame, key: str, features: Sequence[str], controls: Sequence[str], group: str | None = None) -> DataFrame:
    """key, feature, residual: the feature's rank percentile less its least-squares fit on the controls' rank percentiles
    and, with ``group``, on an indicator of each group.

    Each feature is fitted on the rows where it and all controls are known.  Indicators are taken out by group means;
    the normal equations of what is left come from one aggregate, are solved by a pseudo-inverse (collinear controls
    share their effect), and the coefficients go back as one row a feature.  A constant feature, and one with no more
    rows than parameters, has no residuals."""
    names = [*dict.fromkeys([*features, *controls])]
    cols = [F.col(n).cast("double").alias(n) for n in names]
    g = (F.col(group) if group else F.lit(0)).alias("_g")
    ranked = rank_percentile(df.select(key, *cols).unpivot([key], names, "_f", "_v"), "_v", "_p", ["_f"], few=True)
    wide = ranked.groupBy(key).agg(*[F.max(F.when(F.col("_f") == n, F.col("_p"))).alias(n) for n in names]).join(df.select(key, g), key)
    xs = [f"_x{i}" for i in range(len(controls))]
    known = wide.select(key, "_g", *[F.col(c).alias(x) for c, x in zip(controls, xs, strict=True)], *[F.col(f).alias(f"_y{i}") for i, f in enumerate(features)])
    for x in xs:
        known = known.filter(F.col(x).isNotNull())
    feature = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"_y{i}").alias("_y")) for i, f in enumerate(features)]))
    rows = known.filter("_g IS NOT NULL").select(key, "_g", *xs, feature.alias("s")).select(key, "_g", *xs, "s.*").filter("_y IS NOT NULL")
    rows = checkpointed(rows)
    means = rows.groupBy("feature", "_g").agg(*[F.avg(c).alias(f"_m{c}") for c in ("_y", *xs)])
    rows = rows.join(means, ["feature", "_g"]).select(key, "feature", "_g", *[(F.col(c) - F.col(f"_m{c}")).alias(c) for c in ("_y", *xs)], F.col("_y").alias("_raw"))
    rows = checkpointed(rows)
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"{a}{b}") for i, a in enumerate(xs) for b in xs[i:]] + [F.sum(F.col(a) * F.col("_y")).alias(f"{a}_y") for a in xs]
    # One row a feature.
    grams = rows.groupBy("feature").agg(F.count("*").alias("n"), F.count_distinct("_g").alias("groups"), (F.max("_raw") > F.min("_raw")).alias("varies"), *sums).collect()
    fits = []
    for r in grams:
        if not r["varies"] or r["n"] <= r["groups"] + len(xs):
            continue
        m = np.array([[r[f"{min(a, b)}{max(a, b)}"] for b in xs] for a in xs]).reshape(len(xs), len(xs))
        beta = np.linalg.pinv(m, rcond=COLLINEAR, hermitian=True) @ np.array([r[f"{a}_y"] for a in xs]) if xs else np.zeros(0)
        fits.append((r["feature"], [float(b) for b in beta]))
    fits = df.sparkSession.createDataFrame(fits, "feature string, _beta array<double>")
    fitted = sum((F.col("_beta")[i] * F.col(x) for i, x in enumerate(xs)), F.lit(0.0))
    return rows.join(F.broadcast(fits), "feature").select(key, "feature", (F.col("_y") - fitted).alias("residual"))


def residual_pairs(df: DataFrame, key: str, features: Sequence[str], controls: Sequence[str], group: str | None = None) -> DataFrame:
    """a, b, n, rho: partial rank correlation of every pair of features, given controls and group."""
    rows = residual_ranks(df, key, features, controls, group)
    wide = rows.groupBy(key).agg(*[F.max(F.when(F.col("feature") == f, F.col("residual"))).alias(f) for f in features])
    pairs = []
    for i, a in enumerate(features):
        for b in features[i + 1 :]:
            pairs.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias("n"), F.round(safe_corr(a, b), 6).alias("rho")))
    return wide.agg(F.array(*pairs).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def draws(df: DataFrame, block: str, replicates: int, seed: int = 1) -> DataFrame:
    """replicate, block, w: how often each block is drawn.  Replicate r takes as its k-th block number (seed + 7919 r +
    104729 k + 31 r k) mod blocks; replicate -1 takes each once."""
    numbered = df.select(block).distinct().withColumn("_i", F.row_number().over(Window.orderBy(block)) - 1)  # one row a block
    numbered = checkpointed(numbered)
    n = numbered.count()
    if not n:
        return numbered.select(F.lit(0).cast("long").alias("replicate"), block, F.lit(1).cast("long").alias("w"))
    k = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    drawn = df.sparkSession.range(replicates).withColumnRenamed("id", "replicate").withColumn("_k", k)
    at = F.pmod(F.lit(seed) + F.col("replicate") * 7919 + F.col("_k") * 104729 + F.col("replicate") * F.col("_k") * 31, F.lit(n))
    drawn = drawn.groupBy("replicate", at.cast("int").alias("_i")).agg(F.count("*").alias("w"))
    once = numbered.select(F.lit(-1).cast("long").alias("replicate"), "_i", F.lit(1).cast("long").alias("w"))
    return checkpointed(drawn.unionByName(once).join(numbered, "_i").select("replicate", block, "w"))


def _places(long: DataFrame, width: int) -> DataFrame:
    """_f, _v, mid of every value _v of a feature _f, from rows (_f, _v, _at: array of ``width`` counts), one a value: place by place
    the counts below the value and half of those at it.

    Values are dealt into ranges; a range starts with the sums of those before."""
    ranged = checkpointed(long.repartitionByRange("_f", "_v").select(F.spark_partition_id().alias("_part"), "_f", "_v", "_at"))
    sums = F.array(*[F.sum(F.col("_at")[k]) for k in range(width)])
    parts = ranged.groupBy("_part", "_f").agg(sums.alias("_sum"))  # one row a range and feature
    ahead = Window.partitionBy("_f").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("_part", "_f", F.array(*[F.coalesce(F.sum(F.col("_sum")[k]).over(ahead), F.lit(0)) for k in range(width)]).alias("_before"))
    rows = ranged.join(F.broadcast(before), ["_part", "_f"]).select("_part", "_f", "_v", "_at", "_before")
    rows = rows.repartition("_part", "_f").sortWithinPartitions("_part", "_f", "_v")

    def run(batches):
        key, below = None, None
        for batch in batches:
            pdf = batch.to_pandas()
            out = np.empty((len(pdf), width))
            for name, at in pdf.groupby(["_part", "_f"], sort=False).indices.items():
                counts = np.stack(pdf["_at"].to_numpy()[at])
                if key != name:
                    key, below = name, pdf["_before"].iloc[at[0]]
                past = below + np.cumsum(counts, axis=0)
                out[at] = past - counts / 2
                below = past[-1]
            mid = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * width, pa.int32()), out.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), mid], names=["_f", "_v", "mid"])

    return rows.mapInArrow(run, "_f string, _v double, mid array<double>")


FEW = 10_000


def bootstrap_pairs(df: DataFrame, key: str, block: str, names: Sequence[str], replicates: int, seed: int = 1) -> DataFrame:
    """replicate, a, b, rho of resampled whole blocks.  Rows are never copied, nor made once a replicate: the average rank of a value
    is a weighted sum of the rows below it in each block, so values are counted once, block by block; a task multiplies these
    counts with the weights of all replicates and sends on the moments of all pairs, one row a replicate and pair.

    Where there are more blocks than replicates, rows below a value are counted replicate by replicate instead.  Every task has the
    weights, one number a block and replicate."""
    names, spark = [*names], df.sparkSession
    rows = df.select(key, F.col(block).alias("_b"), *[F.col(c).cast("double").alias(c) for c in names])
    rows = checkpointed(rows.repartition(key))
    drawn = draws(rows, "_b", replicates, seed)
    blocks = checkpointed(drawn.filter("replicate = -1 AND _b IS NOT NULL").select("_b", (F.row_number().over(Window.orderBy("_b")) - 1).alias("_i")))  # one row a block
    n, tries = blocks.count(), replicates + 1
    weights = np.zeros((max(n, 1), tries))  # replicate -1 first
    for x in drawn.join(blocks, "_b").select("replicate", "_i", "w").toLocalIterator():
        weights[x["_i"], x["replicate"] + 1] = x["w"]
    by_block = n <= tries
    width = max(n, 1) if by_block else tries
    rows = checkpointed(rows.join(F.broadcast(blocks), "_b").drop("_b"))
    long = rows.unpivot([key, "_i"], names, "_f", "_v").filter("_v IS NOT NULL").groupBy("_f", "_v", "_i").agg(F.count("*").alias("_n"))
    if by_block:
        at = [F.sum(F.when(F.col("_i") == k, F.col("_n")).otherwise(0)) for k in range(width)]
    else:
        table = spark.createDataFrame([(i, [int(v) for v in w]) for i, w in enumerate(weights)], "_i int, _w array<bigint>")
        long = long.join(F.broadcast(table), "_i")
        at = [F.sum(F.col("_n") * F.col("_w")[k]) for k in range(width)]
    mid = checkpointed(_places(long.groupBy("_f", "_v").agg(F.array(*at).alias("_at")), width))
    distinct = {x["_f"]: x["count"] for x in mid.groupBy("_f").count().collect()}
    known = {x["_i"]: x for x in rows.groupBy("_i").agg(*[F.count(c).alias(c) for c in names]).collect()}
    totals = {c: sum((weights[i] * x[c] for i, x in known.items()), np.zeros(tries)) for c in names}
    wide = rows
    for k, c in enumerate(names):
        part = mid.filter(F.col("_f") == c).select(F.col("_v").alias(c), F.col("mid").alias(f"_m{k}"))
        wide = wide.join(F.broadcast(part) if distinct.get(c, 0) <= FEW else part, c, "left")
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    sums = ["m", "n", "sa", "sb", "saa", "sbb", "sab"]

    def moments(batches):
        out = np.zeros((len(pairs), len(sums), tries))
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                piece = batch.slice(low, 2048)
                w, ranks = weights[piece.column(0).to_numpy()], []
                for k, c in enumerate(names):
                    at, r = piece.column(k + 1), np.zeros((piece.num_rows, tries))
                    good = at.is_valid().to_numpy(zero_copy_only=False)
                    if good.any():
                        m = at.filter(at.is_valid()).flatten().to_numpy().reshape(-1, width)
                        # From the middle, so that products stay small.
                        r[good] = (m @ weights if by_block else m) - totals[c] / 2
                    ranks.append((good, r))
                for p, (i, j) in enumerate(pairs):
                    (ga, a), (gb, b) = ranks[i], ranks[j]
                    v = w * (ga & gb)[:, None]
                    va, vb = v * a, v * b
                    out[p] += np.stack([w.sum(0), v.sum(0), va.sum(0), vb.sum(0), (va * a).sum(0), (vb * b).sum(0), (va * b).sum(0)])
        for p, (i, j) in enumerate(pairs):
            yield pa.RecordBatch.from_pydict({"replicate": np.arange(-1, tries - 1), "a": [names[i]] * tries, "b": [names[j]] * tries} | {s: out[p, q] for q, s in enumerate(sums)})

    rows = wide.select("_i", *[f"_m{k}" for k in range(len(names))]).mapInArrow(moments, "replicate long, a string, b string, " + ", ".join(f"{s} double" for s in sums))
    rows = rows.groupBy("replicate", "a", "b").agg(*[F.sum(s).alias(s) for s in sums]).filter("m > 0")
    c = F.col
    va, vb = c("n") * c("saa") - c("sa") * c("sa"), c("n") * c("sbb") - c("sb") * c("sb")
    rho = F.when((c("n") > 1) & (va > 1e-9) & (vb > 1e-9), (c("n") * c("sab") - c("sa") * c("sb")) / (F.sqrt(va) * F.sqrt(vb)))
    return rows.select("replicate", "a", "b", F.round(rho, 9).alias("rho"))


def _axis(column: str, axes: Mapping[str, str]) -> Column:
    out = F.lit("unlabeled")
    for name, axis in axes.items():
        out = F.when(F.col(column) == name, axis).otherwise(out)
    return out


def silhouettes(pairs: DataFrame, axes: Mapping[str, str]) -> DataFrame:
    """replicate, silhouette: mean silhouette of labelled features by axis, with distance sqrt((1 - rho) / 2); an
    unknown rho counts as 0; features alone on their axis are left out."""
    both = pairs.select("replicate", "a", "b", "rho").union(pairs.select("replicate", F.col("b"), F.col("a"), "rho"))
    d = F.sqrt(F.greatest(F.lit(0.0), (1 - F.coalesce("rho", F.lit(0.0))) / 2))
    rows = both.select("replicate", "a", _axis("a", axes).alias("xa"), _axis("b", axes).alias("xb"), d.alias("d")).filter("xa <> 'unlabeled' AND xb <> 'unlabeled'")
    near = rows.groupBy("replicate", "a", "xa", "xb").agg(F.avg("d").alias("d"))
    each = near.groupBy("replicate", "a").agg(F.min(F.when(F.col("xa") == F.col("xb"), F.col("d"))).alias("own"), F.min(F.when(F.col("xa") != F.col("xb"), F.col("d"))).alias("other"))
    each = each.filter("own IS NOT NULL AND other IS NOT NULL")
    s = F.coalesce(F.try_divide(F.col("other") - F.col("own"), F.greatest("own", "other")), F.lit(0.0))
    return each.groupBy("replicate").agg(F.avg(s).alias("silhouette"))


METRICS = ["median_all", "median_within", "median_between", "contrast", "auc", "silhouette", "cross_80", "cross_90", "high_90", "largest"]


def quality(pairs: DataFrame, axes: Mapping[str, str]) -> DataFrame:
    """One row a replicate: how much stronger correlations are within an axis than between axes (METRICS)."""
    v = F.abs("rho")
    labelled = (F.col("xa") != "unlabeled") & (F.col("xb") != "unlabeled")
    rows = pairs.filter("rho IS NOT NULL").select("replicate", v.alias("v"), _axis("a", axes).alias("xa"), _axis("b", axes).alias("xb"))
    within, between = labelled & (F.col("xa") == F.col("xb")), labelled & (F.col("xa") != F.col("xb"))
    rows = rows.select("replicate", "v", within.alias("_in"), between.alias("_out"), F.when(within | between, F.col("v")).alias("_u"))
    # Groups hold the pairs of the named features alone.
    place = Window.partitionBy("replicate", F.col("_u").isNull()).orderBy("_u")
    rows = rows.withColumn("_r", F.rank().over(place) + (F.count("*").over(Window.partitionBy("replicate", "_u")) - 1) / 2)
    n_in, n_out = F.count_if("_in"), F.count_if("_out")
    mid = lambda c: F.median(F.when(c, F.col("v")))
    share = lambda c, n: F.try_divide(F.count_if(c).cast("double"), n)
    out = rows.groupBy("replicate").agg(
        F.median("v").alias("median_all"), mid(F.col("_in")).alias("median_within"), mid(F.col("_out")).alias("median_between"), (mid(F.col("_in")) - mid(F.col("_out"))).alias("contrast"),
        F.try_divide(F.sum(F.when(F.col("_in"), F.col("_r"))) - n_in * (n_in + 1) / 2, n_in * n_out).alias("auc"),
        share(F.col("_out") & (F.col("v") >= 0.8), n_out).alias("cross_80"), share(F.col("_out") & (F.col("v") >= 0.9), n_out).alias("cross_90"), share(F.col("v") >= 0.9, F.count("*")).alias("high_90"), F.max("v").alias("largest"),
    )
    return out.join(silhouettes(pairs, axes), "replicate", "left").select("replicate", *METRICS)


def _summary(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, point (replicate -1), mean, sd, low, middle, high (5, 50 and 95 per cent) and n of the replicates' values."""
    tried = checkpointed(rows.filter("replicate >= 0 AND value IS NOT NULL"))
    point = rows.filter("replicate = -1").select(*by, F.col("value").alias("point"))
    moments = tried.groupBy(*by).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.count("*").alias("n"))
    cuts = quantiles(tried, "value", {"low": 0.05, "middle": 0.5, "high": 0.95}, by)
    return point.join(moments, [*by], "left").join(cuts, [*by], "left").fillna(0, ["n"])


def _rounded(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    return df.select(*keep, *[F.round(c, 6).alias(c) for c in ("point", "mean", "sd", "low", "middle", "high")])


def bootstrap_quality(pairs: DataFrame, axes: Mapping[str, str]) -> DataFrame:
    """metric, n, point, mean, sd, low, middle, high over replicates of ``bootstrap_pairs``."""
    return _rounded(_summary(quality(pairs, axes).unpivot(["replicate"], METRICS, "metric", "value"), ["metric"]), ["metric", "n"])


def bootstrap_edges(pairs: DataFrame) -> DataFrame:
    """a, b, n, same_sign (share of replicates with the sign of the point) and the summary of each pair's rho."""
    values = pairs.withColumnRenamed("rho", "value")
    point = pairs.filter("replicate = -1").select("a", "b", F.signum("rho").alias("_s"))
    sign = pairs.filter("replicate >= 0 AND rho IS NOT NULL").join(point, ["a", "b"]).groupBy("a", "b").agg(F.round(F.avg((F.signum("rho") == F.col("_s")).cast("double")), 6).alias("same_sign"))
    return _rounded(_summary(values, ["a", "b"]).join(sign, ["a", "b"], "left"), ["a", "b", "n", "same_sign"])


__all__ = ["bootstrap_edges", "bootstrap_pairs", "bootstrap_quality", "draws", "quality", "residual_pairs", "residual_ranks", "silhouettes"]
