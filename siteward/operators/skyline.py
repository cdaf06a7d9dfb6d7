"""Skylines and tiers of tables that no task holds.

Equal vectors are one.  Each task reduces its own part to its skyline; what survives is cut into chunks of at most about
CHUNK vectors of one quantile cell.  A chunk whose best corner is beaten by the worst corner of another is dropped; of
the rest, two chunks meet only if the best corner of the one reaches the worst of the other in every objective.  A task
holds two chunks and writes the beaten vectors, never pairs.

Defined results: rows with a missing or NaN objective take no part; rows of equal objectives share their fate; an empty
table has no skyline.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteward.sources.tables import checkpointed, forget

CHUNK, CUTS, SALTS = 4096, 3, 8


def _vectors(df: DataFrame, key: str, maximise: Sequence[str], minimise: Sequence[str]) -> tuple[DataFrame, list[str]]:
    cols = [F.col(c).cast("double") for c in maximise] + [-F.col(c).cast("double") for c in minimise]
    names = [f"_o{i}" for i in range(len(cols))]
    rows = df.select(key, *[(c + 0.0).alias(n) for c, n in zip(cols, names, strict=True)])
    return rows.filter(reduce(lambda a, b: a & b, [F.col(n).isNotNull() & ~F.isnan(n) for n in names])), names


def _survivors(distinct: DataFrame, names: list[str]) -> DataFrame:
    """Vectors that none of their own task beats."""

    def beaten(x, by):
        out = np.zeros(len(x), bool)
        for i in range(0, len(by), 256):
            part = by[i : i + 256]
            out |= ((part[None] >= x[:, None]).all(2) & (part[None] > x[:, None]).any(2)).any(1)
        return out

    def run(batches):
        kept = None
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) if batch.num_rows else None
            for i in range(0, batch.num_rows, 1024):
                part = x[i : i + 1024]
                part = part[~beaten(part, part)]
                if kept is not None:
                    part = part[~beaten(part, kept)]
                    kept = kept[~beaten(kept, part)]
                kept = part if kept is None else np.concatenate((kept, part))
        if kept is not None:
            yield pa.RecordBatch.from_arrays([pa.array(kept[:, i]) for i in range(kept.shape[1])], names=names)

    return distinct.mapInArrow(run, ", ".join(f"{n} double" for n in names))


def _beaten(left: DataFrame, names: list[str], chunk: int) -> DataFrame:
    """Vectors of left that another of its chunks, or their own, beats."""
    points = [i / (CUTS + 1) for i in range(1, CUTS + 1)]
    cuts = left.agg(*[F.percentile_approx(n, points, 1000).alias(f"_c{n}") for n in names])  # one row
    below = lambda n: F.size(F.filter(f"_c{n}", lambda c: c < F.col(n))).cast("string")
    code = F.concat_ws(".", *[below(n) for n in names])
    coded = left.crossJoin(F.broadcast(cuts)).select(*names, code.alias("code"))
    sizes = coded.groupBy("code").agg(F.ceil(F.count("*") / chunk).alias("parts"))  # at most (CUTS + 1) ** objectives
    chunks = coded.join(F.broadcast(sizes), "code").select(*names, F.concat_ws("/", "code", F.pmod(F.xxhash64(*names), F.col("parts")).cast("string")).alias("chunk"))
    chunks = checkpointed(chunks)
    corners = checkpointed(chunks.groupBy("chunk").agg(*[f(n).alias(f"{n}_{s}") for n in names for f, s in ((F.min, "low"), (F.max, "high"))]))
    by, of = corners.select(*[F.col(c).alias(f"by_{c}") for c in corners.columns]), corners.select(*[F.col(c).alias(f"of_{c}") for c in corners.columns])
    both = lambda f: reduce(lambda a, b: a & b, [f(n) for n in names])
    # Corners alone meet: one row a chunk.
    pairs = checkpointed(by.join(of, both(lambda n: F.col(f"by_{n}_high") >= F.col(f"of_{n}_low"))).select("by_chunk", "of_chunk", both(lambda n: F.col(f"by_{n}_low") > F.col(f"of_{n}_high")).alias("whole")))
    lost = pairs.filter("whole").select("of_chunk").distinct()
    meet = pairs.join(lost, "of_chunk", "left_anti").join(lost.withColumnRenamed("of_chunk", "by_chunk"), "by_chunk", "left_anti")
    sides = [meet.select("by_chunk", "of_chunk", F.col(f"{s}_chunk").alias("chunk"), F.lit(i).alias("side")) for i, s in enumerate(("by", "of"))]
    rows = sides[0].unionByName(sides[1]).join(chunks, "chunk").select("by_chunk", "of_chunk", "side", *names)
    rows = rows.repartition("by_chunk", "of_chunk").sortWithinPartitions("by_chunk", "of_chunk", "side")

    def run(batches):
        at, better = None, []
        for batch in batches:
            a, b, side = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            x = np.column_stack([batch.column(3 + i).to_numpy(zero_copy_only=False) for i in range(len(names))])
            cuts = np.concatenate(([0], np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (side[1:] != side[:-1])) + 1, [len(a)]))
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i == j:
                    continue
                if at != (a[i], b[i]):
                    at, better = (a[i], b[i]), []
                if side[i] == 0:
                    better.append(x[i:j])
                    continue
                mine, out = x[i:j], np.zeros(j - i, bool)
                for part in better:
                    for k in range(0, len(part), 256):
                        p = part[k : k + 256]
                        out |= ((p[None] >= mine[:, None]).all(2) & (p[None] > mine[:, None]).any(2)).any(1)
                yield pa.RecordBatch.from_arrays([pa.array(mine[out, k]) for k in range(len(names))], names=names)

    found = rows.mapInArrow(run, ", ".join(f"{n} double" for n in names))
    whole = chunks.join(lost.withColumnRenamed("of_chunk", "chunk"), "chunk", "left_semi").select(*names)
    return found.unionByName(whole).distinct()


def _front(rows: DataFrame, names: list[str], chunk: int) -> DataFrame:
    left = checkpointed(_survivors(rows.select(*names).distinct(), names))
    return checkpointed(left.join(_beaten(left, names, chunk), names, "left_anti"))


def _held(rows: DataFrame, front: DataFrame, names: list[str], how: str) -> DataFrame:
    """rows whose vector is in front; a vector may be that of any share of rows."""
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    copies = front.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies, [*names, "_salt"], how).drop("_salt")


def skyline(df: DataFrame, key: str, maximise: Sequence[str], minimise: Sequence[str] = (), chunk: int = CHUNK) -> DataFrame:
    """key of the rows that no row beats: at least as good in every objective and better in one."""
    rows, names = _vectors(df, key, maximise, minimise)
    return _held(rows, _front(rows, names, chunk), names, "left_semi").select(key)


def skyline_tiers(df: DataFrame, key: str, maximise: Sequence[str], minimise: Sequence[str] = (), most: int = 3, chunk: int = CHUNK) -> DataFrame:
    """key, tier from 1: the skyline, that of the rest, and so on, up to ``most``; later rows are left out."""
    rows, names = _vectors(df, key, maximise, minimise)
    left, out = checkpointed(rows), None
    for tier in range(1, most + 1):
        front = _front(left, names, chunk)
        part = checkpointed(_held(left, front, names, "left_semi").select(key, F.lit(tier).cast("long").alias("tier")))
        out = part if out is None else out.unionByName(part)
        if tier < most:
            after = checkpointed(_held(left, front, names, "left_anti"))
            forget(left)
            left = after
            if left.isEmpty():
                break
    return out
