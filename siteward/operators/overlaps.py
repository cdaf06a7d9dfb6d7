"""Cells that two sites share, counted over blocks of like cells instead of pairs of rows.

Every cell is named after one of its sites, the one of the smallest hash: cells that are reached by like sites bear the
same name.  The cells of a name are one block; a task multiplies its incidence matrix with itself and sends on one row for
two sites that meet in the block, not one for each cell that they share."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteward.sources.tables import checkpointed

#: Cells of a block, its pairs (site, cell), entries of a matrix, and rows sent on at once: bounds of a task's memory.
CELLS, PAIRS, ENTRIES, ROWS = 4096, 1 << 22, 1 << 24, 1 << 20


def sites_of_cells(cover: DataFrame, cells: DataFrame, values: Sequence[str], once: bool = False) -> DataFrame:
    """cell, sites (array; ``once``: each site once), values: one row for every row of ``cells`` that some site covers; written."""
    pairs = cover.filter("site IS NOT NULL AND cell IS NOT NULL")
    sets = pairs.groupBy("cell").agg((F.collect_set if once else F.collect_list)("site").alias("sites"))
    return checkpointed(sets.join(cells.select("cell", *values), "cell"))


def reached(sets: DataFrame) -> DataFrame:
    """site, cell, values: the rows of ``sites_of_cells`` pair by pair."""
    values = [c for c in sets.columns if c not in ("cell", "sites")]
    return sets.select(F.explode("sites").alias("site"), "cell", *values)


def _block(sites: pa.Array, ends: np.ndarray, values: list[np.ndarray]):
    """Pairs i < j of one block: ids, counts, and of each value sum and whether any is known (NaN: unknown)."""
    coded = sites.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    names, place = coded.dictionary.take(order), np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    at, n = place[coded.indices.to_numpy()], len(order)
    step = max(1, ENTRIES // n)
    for low in range(0, len(ends) - 1, step):
        high = min(low + step, len(ends) - 1)
        row = np.repeat(np.arange(high - low), np.diff(ends[low : high + 1]))
        m = np.bincount(row * n + at[ends[low] : ends[high]], minlength=(high - low) * n).reshape(high - low, n).astype(float)
        width = max(1, ROWS // n)
        for a in range(0, n, width):
            mine, others = m[:, a : a + width], m[:, a:]
            both = mine.T @ others
            i, j = np.nonzero(np.triu(both, 1))
            sums = []
            for v in values:
                w, known = v[low:high], ~np.isnan(v[low:high])
                with np.errstate(invalid="ignore"):
                    s = (mine * np.where(np.isfinite(w), w, 0.0)[:, None]).T @ others
                    for c in np.flatnonzero(np.isinf(w)):
                        x, y = np.flatnonzero(mine[c]), np.flatnonzero(others[c])
                        s[np.ix_(x, y)] += w[c]
                held = both if known.all() else (mine * known[:, None]).T @ others
                sums.append((s[i, j], held[i, j] == 0))
            yield names.take(pa.array(i + a)), names.take(pa.array(j + a)), np.rint(both[i, j]).astype(np.int64), sums


def shared_sums(sets: DataFrame, values: Sequence[str]) -> DataFrame:
    """site_i < site_j, shared (common cells), and the sum of each value over these, from ``sites_of_cells``; a null or NaN
    value adds nothing, a sum without any value is null."""
    kind = sets.schema["sites"].dataType.elementType.simpleString()
    named = sets.withColumn("_name", F.array_min(F.transform("sites", lambda s: F.xxhash64(s))))
    parts = named.groupBy("_name").agg(F.ceil(F.count("*") / CELLS).alias("_parts"))
    dealt = named.join(parts, "_name").select("_name", F.pmod(F.xxhash64("cell"), F.col("_parts")).alias("_part"), "sites", *[F.col(v).cast("double").alias(v) for v in values])
    dealt = dealt.repartition("_name", "_part").sortWithinPartitions("_name", "_part")

    def run(batches):
        held, key, size = [], None, 0

        def flush():
            sites = pa.concat_arrays([b.column(2).flatten() for b in held])
            ends = np.concatenate([[0], np.cumsum(np.concatenate([pc.list_value_length(b.column(2)).to_numpy() for b in held]))]).astype(np.int64)
            numbers = [np.concatenate([b.column(3 + k).to_numpy(zero_copy_only=False).astype(float) for b in held]) for k in range(len(values))]
            for i, j, n, sums in _block(sites, ends, numbers):
                yield pa.RecordBatch.from_arrays([i, j, pa.array(n), *[pa.array(s, mask=none) for s, none in sums]], names=["site_i", "site_j", "shared", *values])

        for batch in batches:
            names, parts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(names) != 0) | (np.diff(parts) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(names)], strict=True):
                if a == b:
                    continue
                piece = batch.slice(a, b - a)
                if held and ((names[a], parts[a]) != key or size > PAIRS):
                    yield from flush()
                    held, size = [], 0
                key = (names[a], parts[a])
                held.append(piece)
                size += pc.sum(pc.list_value_length(piece.column(2))).as_py()
        if held:
            yield from flush()

    rows = dealt.mapInArrow(run, ", ".join([f"site_i {kind}", f"site_j {kind}", "shared long", *[f"`{v}` double" for v in values]]))
    return rows.groupBy("site_i", "site_j").agg(F.sum("shared").alias("shared"), *[F.sum(v).alias(v) for v in values])


def shared_both_ways(sets: DataFrame, values: Sequence[str]) -> DataFrame:
    """site, other, and the sums of ``shared_sums``: every pair in both directions."""
    way = lambda a, b: F.struct(F.col(a).alias("site"), F.col(b).alias("other"), *[F.col(v) for v in values])
    return shared_sums(sets, values).select(F.inline(F.array(way("site_i", "site_j"), way("site_j", "site_i"))))


def _stars(u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (vertex, least vertex) that connect what the links u, w connect: fewer than there are vertices."""
    names, code = np.unique(np.concatenate([u, w]), return_inverse=True)
    a, b, label = code[: len(u)], code[len(u) :], np.arange(len(names))
    while True:
        a, b = label[a], label[b]
        apart = a != b
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(further := label[label], label):
            label = further
    moved = np.flatnonzero(label != np.arange(len(label)))
    return names[label[moved]], names[moved]


def connecting(edges: DataFrame) -> DataFrame:
    """site_i, site_j: links that connect the same sites as ``edges`` (site_i, site_j), from a task fewer than sites it meets."""
    kind = edges.schema["site_i"].dataType.simpleString()

    def run(batches):
        held, size = [], 0
        arrays = lambda: [np.concatenate([h[k] for h in held]) for k in (0, 1)]
        for batch in batches:
            held.append([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)])
            size += batch.num_rows
            if size > PAIRS:
                held, size = [_stars(*arrays())], 0
        if held:
            u, w = _stars(*arrays())
            yield pa.RecordBatch.from_arrays([pa.array(u, batch.schema.field(0).type), pa.array(w, batch.schema.field(0).type)], names=["site_i", "site_j"])

    return edges.select("site_i", "site_j").mapInArrow(run, f"site_i {kind}, site_j {kind}")


def packed(edges: DataFrame) -> DataFrame:
    """site, near: the sites before a site that it has an edge (site_i < site_j, whole numbers) with, as steps from one to the
    next in as few bytes as hold them; a site has a row for each run of ROWS edges of a task."""

    def packs(u, w):
        order = np.lexsort((u, w))
        u, w = u[order], w[order]
        cuts = np.flatnonzero(np.diff(w, prepend=w[0] - 1))
        for low, high in zip(cuts, [*cuts[1:], len(w)], strict=True):
            steps = np.diff(u[low:high])
            size = next(k for k in (1, 2, 4, 8) if k == 8 or steps.max(initial=0) < 1 << 8 * k)
            yield w[low], bytes([size]) + u[low : low + 1].astype("<i8").tobytes() + steps.astype(f"<u{size}").tobytes()

    def run(batches):
        held, size = [], 0

        def out():
            rows = list(packs(*[np.concatenate([h[k] for h in held]) for k in (0, 1)]))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["site", "near"])

        for batch in batches:
            if batch.num_rows:
                held.append([batch.column(k).to_numpy() for k in (0, 1)])
                size += batch.num_rows
            if size >= ROWS:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return edges.select(F.col("site_i").cast("long"), F.col("site_j").cast("long")).mapInArrow(run, "site long, near binary")


def unpacked(near: bytes) -> np.ndarray:
    """The sites of one row of ``packed``."""
    steps = np.frombuffer(near, f"<u{near[0]}", offset=9).astype(np.int64)
    return np.frombuffer(near[1:9], "<i8")[0] + np.concatenate([[0], np.cumsum(steps)])


def edges_of(rows: DataFrame) -> DataFrame:
    """site_i, site_j of rows of ``packed``."""

    def run(batches):
        for batch in batches:
            near = [unpacked(b) for b in batch.column(1).to_pylist()]
            if near:
                yield pa.RecordBatch.from_pydict({"site_i": np.concatenate(near), "site_j": np.repeat(batch.column(0).to_numpy(), [len(n) for n in near])})

    return rows.select("site", "near").mapInArrow(run, "site_i long, site_j long")
