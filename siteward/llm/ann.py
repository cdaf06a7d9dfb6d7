"""Approximate nearest neighbours: NN-descent builds a graph, queries search it greedily.

Equal vectors are one node (the smallest id stands for it, with the few smallest ids that a
result can need).  Trees whose splits are medians of a bounded sample (``SAMPLE_BYTES``) deal the nodes
into leaves; chunks of leaves, and random chunks that link far regions, give the first graph.  Each
round then joins neighbours of neighbours: at every node its neighbours meet one another and the nodes
that name it, as far as one of the two edges is new.  Nodes are dealt into parts by their place in a
tree, so that a part holds most of the vectors that it needs; a part gets a vector once, and its size
in nodes follows from ``PART_BYTES`` and the dimension.  The lists of a node that very many name are dealt
over several parts.  Rounds end when fewer than the share ``STOP`` of all edges change.

A query starts at its own node and expands the nearest nodes that are not expanded yet until its
``BEAM`` nearest all are.  A query that ends with fewer nodes than an answer needs is compared with all
nodes, block by block.  Distances are recomputed on the original vectors in double precision.

All vectors are indexed; recall is measured against brute force in the tests.  Rows whose vector
is null, zero, or holds null or non-finite components, or isn't as long as most others, take no
part.  Repeated rows (equal id and vector) count once; an id with several vectors is each of them, and
is named once in an answer, at its nearest.  Every query has min(``top``, candidates) rows.  Ties go to
the smaller id; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from siteward.llm.io import forget, shipped, stored

NEIGHBOURS = 40
TREES = 5
CHUNK = 128
SAMPLE = 40
REVERSE = 24
HUB = 8192
PART_BYTES, LEAST_PARTS = 256 << 20, 8
SAMPLE_BYTES, SAMPLE_ROWS = 8 << 20, 8192
STOP = 0.01
BEAM = 128
EXPAND = 16
SHORT_BLOCK = 512
EDGES = "u long, up long, w long, wp long, d double, fresh boolean, take boolean, new boolean"
FOUND = "u long, up long, w long, wp long, d double"


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    v = F.col(vector)
    kind = vectors.schema[vector].dataType
    as_ = "array<float>" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "array<double>"
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), v.cast(as_).alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.col("count").desc(), "n").limit(1).collect()
    return rows.filter(F.size("v") == (sizes[0]["n"] if sizes else 0))


def nodes_of(rows: DataFrame, keep: int) -> DataFrame:
    """One row per different vector: id (the smallest), v, ids (the ``keep`` smallest)."""
    first = rows.groupBy("v", "vec_id").agg(F.lit(1).alias("one")).withColumn("k", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("k") <= keep)
    return first.groupBy("v").agg(F.min("vec_id").alias("id"), F.array_sort(F.collect_list("vec_id")).alias("ids")).select("id", "v", "ids")


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T), 0.0)


def _batch(schema: str, *columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c), kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


class Tree:
    """Median splits of a sample along differences of two of its points."""

    def __init__(self, x: np.ndarray, total: int, seed: int, part_rows: int):
        self.rng = np.random.default_rng(seed)
        self.w, self.t, self.child, self.leaf_of = [], [], [], []
        self.centre, self.bits, self.cell, self.cell_bits = [], [], [], []
        self.each = total / max(1, len(x))
        self.part_rows = part_rows
        self.cells = 0
        self.root = self.grow(x, None)
        most = max(self.bits, default=0)
        self.more = self.rng.standard_normal((x.shape[1], max(1, most)))
        self.line = self.rng.standard_normal(x.shape[1])
        self.w, self.t, self.child = np.array(self.w), np.array(self.t), np.array(self.child, np.int64)
        self.leaf_of, self.centre = np.array(self.leaf_of, np.int64), np.array(self.centre)
        self.bits, self.cell, self.cell_bits = (np.array(z, np.int64) for z in (self.bits, self.cell, self.cell_bits))

    def grow(self, x: np.ndarray, cell: int | None) -> int:
        size = len(x) * self.each
        if cell is None and size <= 1.1 * self.part_rows:
            cell, self.cells = self.cells, self.cells + 1
        me = len(self.w)
        self.w.append(np.zeros(x.shape[1]))
        self.t.append(0.0)
        self.child.append((me, me))
        self.leaf_of.append(-1)
        if size > CHUNK and len(x) >= 8:
            a, b = self.rng.choice(len(x), 2, replace=False)
            way = x[a] - x[b]
            if not way.any():
                way = self.rng.standard_normal(x.shape[1])
            way = way / np.linalg.norm(way)
            p = x @ way
            t = float(np.median(p))
            left = p <= t
            if left.all():
                left = p < t
                t = np.nextafter(t, -np.inf)
            if left.any() and not left.all():
                self.w[me], self.t[me] = way, t
                low = self.grow(x[left], cell)
                self.child[me] = (low, self.grow(x[~left], cell))
                return me
        leaf = len(self.centre)
        self.leaf_of[me] = leaf
        self.centre.append(x.mean(0) if len(x) else np.zeros(x.shape[1]))
        self.bits.append(max(0, math.ceil(math.log2(max(1.0, size / CHUNK)))))
        if cell is None:
            cell, self.cells = self.cells, self.cells + 1
            self.cell_bits.append(min(self.bits[-1], max(0, math.ceil(math.log2(max(1.0, size / self.part_rows))))))
        else:
            self.cell_bits.append(0)
        self.cell.append(cell)
        return me

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Leaf, cell and place along a line, of every row."""
        at = np.full(len(x), self.root)
        while True:
            open_ = self.leaf_of[at] < 0
            if not open_.any():
                break
            k = np.flatnonzero(open_)
            right = np.einsum("ij,ij->i", x[k], self.w[at[k]]) > self.t[at[k]]
            at[k] = self.child[at[k], right.astype(np.int64)]
        leaf = self.leaf_of[at]
        side = ((x - self.centre[leaf]) @ self.more) > 0
        side &= np.arange(side.shape[1])[None] < self.bits[leaf][:, None]
        extra = side.astype(np.int64) @ (1 << np.arange(side.shape[1], dtype=np.int64))
        cell = (self.cell[leaf] << 24) | (extra & ((1 << self.cell_bits[leaf]) - 1))
        return (leaf << 32) | extra, cell, x @ self.line


def planted(nodes: DataFrame, total: int) -> tuple[list[Tree], int]:
    """Trees over a bounded sample, and how many nodes a part holds."""
    dim = nodes.select(F.size("v").alias("n")).limit(1).collect()[0]["n"]
    part_rows = max(64, min(PART_BYTES // (8 * max(1, dim) * 2 * NEIGHBOURS), -(-total // LEAST_PARTS)))
    most = min(SAMPLE_ROWS, max(512, SAMPLE_BYTES // (8 * max(1, dim))))
    share = min(1 << 30, int((most << 30) / total) + 1)
    held = nodes.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share).select("id", "v").orderBy("id").limit(2 * most).collect()
    if not held:
        held = nodes.select("id", "v").orderBy("id").limit(most).collect()
    x = np.array([r["v"] for r in held], np.float64)
    return [Tree(x, total, 1000 + t, part_rows) for t in range(TREES)], part_rows


def in_parts(nodes: DataFrame, trees: list[Tree], part_rows: int) -> DataFrame:
    """nodes with ``part``: those of one cell of the first tree, in pieces of at most about part_rows."""
    held = shipped(nodes.sparkSession, trees[0])

    def run(batches):
        tree = pickle.loads(held.value)
        for batch in batches:
            x = _matrix(batch.column(1))
            cell = tree.codes(x)[1] if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["id", "v", "ids", "cell"])

    kind = nodes.schema["v"].dataType.simpleString()
    rows = stored(nodes.select("id", "v", "ids").mapInArrow(run, f"id long, v {kind}, ids array<long>, cell long"))
    pieces = rows.groupBy("cell").agg(F.ceil(F.count("*") / (1.5 * part_rows)).alias("pieces"))
    piece = F.pmod(F.xxhash64("id"), F.col("pieces"))
    return rows.join(pieces, "cell").select("id", F.xxhash64("cell", piece).alias("part"), "v", "ids")


def leaves(nodes: DataFrame, trees: list[Tree], total: int, neighbours: int) -> DataFrame:
    """FOUND edges among the vectors of chunks of leaves, of every tree and of one random dealing."""
    held, buckets = shipped(nodes.sparkSession, trees), max(1, -(-total // CHUNK))
    kind = nodes.schema["v"].dataType.simpleString()

    def code(batches):
        forest = pickle.loads(held.value)
        for batch in batches:
            x = _matrix(batch.column(2))
            if not len(x):
                continue
            random_ = batch.column(3).to_numpy().view(np.uint64)
            for t in range(len(forest) + 1):
                leaf, _, p = forest[t].codes(x) if t < len(forest) else ((random_ % np.uint64(buckets)).astype(np.int64), None, random_.astype(np.float64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(leaf), pa.array(p), *batch.columns[:3]], names=["tree", "leaf", "p", "id", "part", "v"])

    rows = nodes.select("id", "part", "v", F.xxhash64("id", F.lit(7)).alias("h"))
    coded = rows.mapInArrow(code, f"tree int, leaf long, p double, id long, part long, v {kind}")
    # A leaf of many vectors is cut into chunks along the projection on a line of its own.
    dealt = coded.repartition("tree", "leaf").sortWithinPartitions("tree", "leaf", "p", "id")

    def join(ids: np.ndarray, part: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        d = _square(x - x[0], x - x[0])
        np.fill_diagonal(d, np.inf)
        k = min(neighbours, len(ids) - 1)
        near = np.argpartition(d, k - 1, axis=1)[:, :k].ravel()
        mine = np.repeat(np.arange(len(ids)), k)
        return _batch(FOUND, ids[mine], part[mine], ids[near], part[near], d[mine, near])

    def run(batches):
        held = None  # rows of the leaf that is still open

        def chunks_of(rows, last: bool):
            """Joins the chunks of one leaf; the last one waits if the leaf may go on."""
            nonlocal held
            ids, part, x = rows[2:]
            n, at = len(ids), 0
            while n - at > CHUNK or (last and n - at > 1):
                yield join(ids[at : at + CHUNK], part[at : at + CHUNK], x[at : at + CHUNK])
                if at + CHUNK >= n:
                    at = n
                    break
                # A chunk keeps the last rows of the one before.
                at += CHUNK - CHUNK // 4
            held = None if last else tuple(z[at:] for z in rows)

        for batch in batches:
            rows = [batch.column(c).to_numpy() for c in (0, 1, 3, 4)] + [_matrix(batch.column(5))]
            if not len(rows[0]):
                continue
            if held is not None:
                rows = [np.concatenate(z) for z in zip(held, rows, strict=True)]
            cuts = np.concatenate(([0], np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])) + 1, [len(rows[0])]))
            for a, b in zip(cuts[:-1], cuts[1:]):
                yield from chunks_of(tuple(z[a:b] for z in rows), last=b < len(rows[0]))
        if held is not None:
            yield from chunks_of(held, last=True)

    return dealt.mapInArrow(run, FOUND)


def _chance(ids: np.ndarray, salt: int) -> np.ndarray:
    """An order of ids that changes with the round."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF)
    return (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)


def _ranks(u: np.ndarray) -> np.ndarray:
    """Place of each row among those of its u; u is sorted."""
    begin = np.concatenate(([0], np.flatnonzero(u[1:] != u[:-1]) + 1))
    return np.arange(len(u)) - np.repeat(begin, np.diff(np.concatenate((begin, [len(u)]))))


def merged(edges: DataFrame | None, found: DataFrame, neighbours: int, salt: int) -> DataFrame:
    """EDGES: the nearest edges of every node among those it has and those found.  ``fresh`` edges have not
    met others yet; ``take`` names those that will do so in the next round; ``new`` those of this call."""
    spark = found.sparkSession
    old = edges if edges is not None else spark.createDataFrame([], EDGES)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        n = left.num_rows
        cat = lambda c: np.concatenate((left.column(c).to_numpy(), right.column(c).to_numpy()))
        u, up, w, wp, d = (cat(c) for c in ("u", "up", "w", "wp", "d"))
        stays = left.column("fresh").to_numpy() & ~left.column("take").to_numpy() if n else np.zeros(0, bool)
        new = np.arange(len(u)) >= n
        fresh = np.concatenate((stays, np.ones(len(u) - n, bool)))
        if not len(u):
            return pa.Table.from_batches([_batch(EDGES, *[[]] * 8)])
        # An edge once, as it was before if it was there.
        order = np.lexsort((new, w, u))
        once = order[np.concatenate(([True], (u[order][1:] != u[order][:-1]) | (w[order][1:] != w[order][:-1])))]
        order = once[np.lexsort((w[once], d[once], u[once]))]
        order = order[_ranks(u[order]) < neighbours]
        chance = _chance(w[order], salt)
        turn = np.lexsort((chance, ~fresh[order], u[order]))
        take = np.zeros(len(order), bool)
        take[turn] = _ranks(u[order][turn]) < SAMPLE
        take &= fresh[order]
        o = order
        return pa.Table.from_batches([_batch(EDGES, u[o], up[o], w[o], wp[o], d[o], fresh[o], take, new[o])])

    right = found.withColumnRenamed("up", "home").withColumn("up", F.col("home"))
    return old.groupBy("up").cogroup(right.groupBy("home")).applyInArrow(run, EDGES)


def local_joins(edges: DataFrame, nodes: DataFrame, neighbours: int, salt: int) -> DataFrame:
    """FOUND edges from comparing, at each node, its neighbours with one another and with the nodes
    that name it, where an edge of the two is taken."""
    ahead = edges.filter("take OR NOT fresh").select(F.col("up").alias("part"), F.col("u").alias("at"), F.col("w").alias("x"), F.col("take").alias("fresh"), F.lit(False).alias("back"))
    back = edges.filter("take OR NOT fresh").select(F.col("wp").alias("part"), F.col("w").alias("at"), F.col("u").alias("x"), F.col("take").alias("fresh"), F.lit(True).alias("back"))
    # Nodes that very many name: those are dealt over several homes, each with the node's own list.
    hubs = edges.groupBy(F.col("w").alias("at")).agg(F.count("*").alias("n")).filter(F.col("n") > HUB).select("at", F.ceil(F.col("n") / HUB).cast("int").alias("deals"))
    lists = ahead.union(back).join(hubs, "at", "left").withColumn("deals", F.coalesce("deals", F.lit(1)))
    own = F.when(F.col("back"), F.array(F.pmod(F.xxhash64("x"), F.col("deals")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("deals") - 1))
    lists = lists.withColumn("deal", F.explode(own)).select(F.when(F.col("deal") == 0, F.col("part")).otherwise(F.xxhash64("at", "deal")).alias("home"), "at", "x", "fresh", "back", "deal")
    far = edges.groupBy("u").agg(F.max("d").alias("far"), F.count("*").alias("n"))
    known = nodes.select("id", "part", "v").join(far, nodes["id"] == far["u"], "left").select("id", "part", "v", F.when(F.col("n") >= neighbours, F.col("far")).otherwise(F.lit(float("inf"))).alias("far"))
    needed = lists.select(F.col("home").alias("at_home"), F.col("x").alias("id")).distinct().join(known, "id").select("at_home", "id", "part", "v", "far")

    def best(u, w, d):
        order = np.lexsort((w, u))
        order = order[np.concatenate(([True], (u[order][1:] != u[order][:-1]) | (w[order][1:] != w[order][:-1])))] if len(u) else order
        order = order[np.lexsort((w[order], d[order], u[order]))]
        order = order[_ranks(u[order]) < neighbours] if len(order) else order
        return u[order], w[order], d[order]

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.Table.from_batches([_batch(FOUND, *[[]] * 5)])
        if not left.num_rows or not right.num_rows:
            return empty
        ids = right.column("id").to_numpy()
        order = np.argsort(ids)
        ids, x = ids[order], _matrix(right.column("v"))[order]
        far, part = right.column("far").to_numpy()[order], right.column("part").to_numpy()[order]
        x = x - x.mean(0)
        norm = (x * x).sum(1)
        at, to = left.column("at").to_numpy(), np.searchsorted(ids, left.column("x").to_numpy())
        fresh, back = left.column("fresh").to_numpy(), left.column("back").to_numpy()
        first = left.column("deal").to_numpy() == 0
        by = np.lexsort((_chance(ids[to], salt), ~fresh, back, at))
        at, to, fresh, back, first = at[by], to[by], fresh[by], back[by], first[by]
        cuts = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1, [len(at)]))
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        held, found, size = none, [], 0

        def meet(rows, cols):
            nonlocal size
            if not len(rows) or not len(cols):
                return
            d = norm[rows][:, None] + norm[cols][None] - 2 * (x[rows] @ x[cols].T)
            i, j = np.nonzero((d < np.maximum(far[rows][:, None], far[cols][None])) & (rows[:, None] != cols[None]))
            if len(i):
                p, q, dist = rows[i], cols[j], np.maximum(d[i, j], 0.0)
                one, two = dist < far[p], dist < far[q]
                found.append((np.concatenate((p[one], q[two])), np.concatenate((q[one], p[two])), np.concatenate((dist[one], dist[two]))))
                size += len(found[-1][0])

        for a, b in zip(cuts[:-1], cuts[1:]):
            new, rev, own = fresh[a:b], back[a:b], to[a:b]
            ours, theirs = own[~rev], own[rev]
            fo, ft = new[~rev], new[rev]
            if first[a]:
                meet(ours[fo], ours)
            # New edges on either side; theirs among one another in a sample that changes with the round.
            meet(theirs[ft], ours)
            meet(theirs[~ft], ours[fo])
            some = theirs[ft][:REVERSE]
            meet(some, np.concatenate((some, theirs[~ft][:REVERSE])))
            if size > 2_000_000:
                held = best(*(np.concatenate(z) for z in zip(held, *found)))
                found.clear()
                size = 0
        u, w, d = best(*(np.concatenate(z) for z in zip(held, *found)))
        return pa.Table.from_batches([_batch(FOUND, ids[u], part[u], ids[w], part[w], d)]) if len(u) else empty

    return lists.groupBy("home").cogroup(needed.groupBy("at_home")).applyInArrow(compare, FOUND)


def build(nodes: DataFrame, trees: list[Tree], total: int, neighbours: int = NEIGHBOURS) -> DataFrame:
    """The neighbour graph as a stored table of EDGES; d is squared."""
    edges = stored(merged(None, leaves(nodes, trees, total, neighbours), neighbours, 0))
    turn = 0
    while True:
        turn += 1
        after = stored(merged(edges, local_joins(edges, nodes, neighbours, turn), neighbours, turn))
        forget(edges)
        edges = after
        counts = edges.agg(F.count_if("new").alias("new"), F.count_if("fresh").alias("fresh")).collect()[0]
        # Edges wait for their turn where a node has many new ones; their number falls with the changes.
        if counts["new"] <= STOP * total * neighbours or not counts["fresh"]:
            return edges


def _measured(pairs: DataFrame) -> DataFrame:
    """Squared distances of (q, w, x, y), in double precision from differences."""

    def run(batches):
        for batch in batches:
            a, b = _matrix(batch.column(2)), _matrix(batch.column(3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(((a - b) ** 2).sum(1) if a.size else np.zeros(0))], names=["q", "w", "d"])

    return pairs.select("q", "w", "x", "y").mapInArrow(run, "q long, w long, d double")


def search(edges: DataFrame, nodes: DataFrame, asked: DataFrame, beam: int = BEAM) -> DataFrame:
    """q, w, d: nodes found for every asked node (column q), itself among them, as a stored table."""
    vectors = nodes.select("id", "v")
    mine = stored(asked.join(vectors, asked["q"] == vectors["id"]).select("q", F.col("v").alias("x")))
    state = stored(mine.select("q", F.col("q").alias("w"), F.lit(0.0).alias("d"), F.lit(False).alias("done")))
    links = edges.select("u", F.col("w").alias("to"))
    while True:
        turn = F.row_number().over(Window.partitionBy("q", "done").orderBy("d", "w"))
        chosen = state.withColumn("go", ~F.col("done") & (turn <= EXPAND))
        out = chosen.filter("go").select("q", F.col("w").alias("from"))
        new = out.join(links, out["from"] == links["u"]).select("q", F.col("to").alias("w")).distinct()
        new = new.join(state.select("q", "w"), ["q", "w"], "left_anti")
        new = new.join(vectors.select(F.col("id").alias("w"), F.col("v").alias("y")), "w").join(mine, "q")
        every = chosen.select("q", "w", "d", (F.col("done") | F.col("go")).alias("done")).union(_measured(new).withColumn("done", F.lit(False)))
        rank = F.row_number().over(Window.partitionBy("q").orderBy("d", "w"))
        after = stored(every.withColumn("k", rank).filter(F.col("k") <= beam).select("q", "w", "d", "done"))
        forget(state)
        state = after
        if not state.filter("NOT done").limit(1).count():
            return state.select("q", "w", "d")


def compared_with_all(nodes: DataFrame, asked: DataFrame, top: int) -> DataFrame | None:
    """q, w, d: the top nearest nodes of every asked node (column q), by comparing it with all, in blocks."""
    rows = stored(asked.join(nodes.select(F.col("id").alias("q"), "v"), "q").select("q", "v"))
    last, out = None, None
    while True:
        block = rows if last is None else rows.filter(F.col("q") > last)
        held = block.orderBy("q").limit(SHORT_BLOCK).collect()  # one block of queries
        if not held:
            return out
        last = held[-1]["q"]
        sent = nodes.sparkSession.sparkContext.broadcast((np.array([r["q"] for r in held], np.int64), np.array([r["v"] for r in held], np.float64)))

        def run(batches, sent=sent):
            qs, x = sent.value
            for batch in batches:
                ids, y = batch.column(0).to_numpy(), _matrix(batch.column(1))
                if not len(ids):
                    continue
                for q, a in zip(qs, x, strict=True):
                    d = ((y - a) ** 2).sum(1)
                    k = np.lexsort((ids, d))[:top]
                    yield _batch("q long, w long, d double", np.full(len(k), q), ids[k], d[k])

        found = nodes.select("id", "v").mapInArrow(run, "q long, w long, d double")
        rank = F.row_number().over(Window.partitionBy("q").orderBy("d", "w"))
        found = stored(found.withColumn("k", rank).filter(F.col("k") <= top).select("q", "w", "d"))
        out = found if out is None else out.union(found)


def neighbours_of(vectors: DataFrame, divisor: int = 100, top: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of every row whose id divides by ``divisor``."""
    rows = usable(vectors, key, vector)
    bare = stored(nodes_of(rows, top + 1))
    total = bare.count()
    if not total:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    trees, part_rows = planted(bare, total)
    nodes = stored(in_parts(bare, trees, part_rows))
    edges = build(nodes, trees, total)
    # Each asked row with the node of its vector.
    asked = rows.filter(F.pmod(F.col("vec_id"), F.lit(divisor)) == 0).distinct()
    asked = stored(asked.join(nodes.select("id", "v"), "v").select("vec_id", F.col("id").alias("q")))
    found = search(edges, nodes, asked.select("q").distinct(), max(BEAM, top + 2))
    enough = min(top + 1, total)
    short = stored(asked.select("q").distinct().join(found.groupBy("q").agg(F.count("*").alias("n")), "q", "left").filter(F.coalesce("n", F.lit(0)) < enough).select("q"))
    more = compared_with_all(nodes, short, top + 1)
    if more is not None:
        found = found.join(short, "q", "left_anti").union(more)
    near = found.join(nodes.select(F.col("id").alias("w"), "ids"), "w").select("q", "d", F.explode("ids").alias("to"))
    # An id may stand at several nodes: its nearest counts.  At most top + 1 ids of a node can matter.
    pairs = near.join(asked, "q").filter(F.col("to") != F.col("vec_id")).groupBy("vec_id", "to").agg(F.min("d").alias("d"))
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy("d", "to"))
    pairs = pairs.withColumn("rank", rank).filter(F.col("rank") <= top)
    return pairs.select(F.col("vec_id").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("to").alias("vec_id"), F.sqrt("d").alias("score"))
