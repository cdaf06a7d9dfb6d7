"""SimHash near-copies by a self-join of binary tries.

A text's words (runs without white space, A-Z lower-cased) give shingles of three, repeats included; a bit of its
fingerprint is set if it is set in more than half of the shingles' XXH64 hashes.  Fingerprints link at ``BUDGET`` or
fewer differing bits; links make components.

Search.  Equal fingerprints are one.  Two that differ in three bits agree on one of four quarters of 16 bits, so each
fingerprint stands in four tries, one a quarter, with that quarter turned to the front: a link is found below a node
of depth 16 paired with itself.  From there pairs of nodes are traversed together, bit by bit: children are paired,
differing bits add up, and a pair beyond the budget is dropped.  A node is a range of the sorted fingerprints, so all
pairs of a level are a few numpy arrays.  The traversal runs with budgets 1, 2, 3; a pair of nodes whose leaves already
are of one component is dropped, so that dense groups are not paired out; a task writes a tree of links for each
component that it sees, not its pairs.  A node of depth 16 above ``MOST`` fingerprints is burst in Spark: its
descendants 8 bits further down are paired by joins under the same budget, until both are small enough for a task.

Defined results: null and empty texts have fingerprint zero; fewer than three words are one shingle; a null key stays
and never is a component's id while another key is there; repeated rows stay; an empty table gives no rows; other
columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteward.llm.components import components
from siteward.llm.io import forget, lookup, stored

SHINGLE, SEED, BUDGET = 3, 42, 3
QUARTER = 16
MOST = 1 << 18
STEP = 8
#: Rows that a task takes together, pairs of nodes in one step, and links between two that are kept as a tree.
TAKE, FRONT, FAN = 1 << 17, 1 << 20, 64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_CHUNK = 1 << 16


def fingerprint(text: bytes) -> int:
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    wide = min(SHINGLE, len(words))
    n = len(words) - wide + 1
    hashed = xxhash.xxh64_intdigest
    h = np.fromiter((hashed(joined[s:e], SEED) for s, e in zip(starts[:n].tolist(), ends[wide - 1 :].tolist(), strict=True)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, _CHUNK):
        counts += np.unpackbits(h[i : i + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fp (64 bits as a signed long) of every row."""
    rows = docs.select(F.col(key).alias("key"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("t"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            fp = np.fromiter((fingerprint(t) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["key", "fp"])

    return rows.mapInArrow(run, f"key {kind}, fp long")


def merged(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after linking i[k] with j[k]; a label is the smallest index of its component."""
    label = label.copy()
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j = i[apart], j[apart]
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped


class Trie:
    """Ranges of sorted fingerprints as nodes of binary tries; ``roots`` (lo, hi, lo, hi) are the pairs to start from."""

    def __init__(self, v: np.ndarray, roots: np.ndarray, top: int = 64 - QUARTER):
        self.v, self.roots, self.top, self._ones = v, roots, top, {}

    def ones(self, bit: int) -> np.ndarray:
        if bit not in self._ones:
            self._ones[bit] = np.concatenate(([0], np.cumsum((self.v >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)))
        return self._ones[bit]

    def components(self) -> np.ndarray:
        """The smallest index linked to each fingerprint."""
        label = np.arange(len(self.v))
        for budget in range(1, BUDGET + 1):
            label = self._linked(label, budget)
        return label

    def _linked(self, label: np.ndarray, budget: int) -> np.ndarray:
        pure, found, many = self._runs(label), [], 0
        stack = [(self.top - 1, *self.roots.T, np.zeros(len(self.roots), np.int64))]
        while stack:
            bit, al, ah, bl, bh, d = stack.pop()
            keep = ~((pure[al] >= ah) & (pure[bl] >= bh) & (label[al] == label[bl]))
            leaf = keep & (ah - al == 1) & (bh - bl == 1)
            i, j = al[leaf], bl[leaf]
            near = np.bitwise_count(self.v[i] ^ self.v[j]) <= budget
            found.append((i[near], j[near]))
            many += int(near.sum())
            if many > FRONT:
                label, found, many = self._merged(label, found), [], 0
                pure = self._runs(label)
            keep &= ~leaf
            if bit < 0 or not keep.any():
                continue
            al, ah, bl, bh, d = (x[keep] for x in (al, ah, bl, bh, d))
            ones = self.ones(bit)
            am, bm = ah - (ones[ah] - ones[al]), bh - (ones[bh] - ones[bl])
            other = al != bl  # a node paired with itself has one mixed pair of children
            parts = [(al, am, bl, bm, d), (am, ah, bm, bh, d), (al, am, bm, bh, d + 1), (am[other], ah[other], bl[other], bm[other], d[other] + 1)]
            al, ah, bl, bh, d = (np.concatenate(x) for x in zip(*parts, strict=True))
            keep = (al < ah) & (bl < bh) & (d <= budget)
            front = [x[keep] for x in (al, ah, bl, bh, d)]
            for k in range(0, len(front[0]), FRONT):
                stack.append((bit - 1, *(x[k : k + FRONT] for x in front)))
        return self._merged(label, found)

    def _merged(self, label: np.ndarray, found: list) -> np.ndarray:
        return merged(label, np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])) if found else label

    def _runs(self, label: np.ndarray) -> np.ndarray:
        """For each index the end of the run of equal labels that holds it."""
        cuts = np.concatenate((np.flatnonzero(label[1:] != label[:-1]) + 1, [len(label)]))
        return cuts[np.searchsorted(cuts, np.arange(len(label)), "right")]


def trees(label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(child, parent) indices: a tree of fan FAN over each component of more than one."""
    order = np.argsort(label, kind="stable")
    of = label[order]
    first = np.searchsorted(of, of, "left")
    rank = np.arange(len(of)) - first
    child = rank > 0
    return order[child], order[(first + (rank - 1) // FAN)[child]]


def joined(rows: DataFrame) -> DataFrame:
    """Links (a, b) of fingerprints from rows (quarter, depth, x, y, v): v stands in the pair of nodes x <= y of that depth."""
    rows = rows.repartition("quarter", "depth", "x", "y").sortWithinPartitions("quarter", "depth", "x", "y", "v")

    def tell(quarter, depth, x, y, v):
        v, n = v.view(np.uint64), len(v)
        cut = np.concatenate(([0], np.flatnonzero((quarter[1:] != quarter[:-1]) | (depth[1:] != depth[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1, [n]))
        first, last = cut[:-1], cut[1:]
        side = np.concatenate(([0], np.cumsum((v >> (64 - depth).astype(np.uint64)) == x.view(np.uint64), dtype=np.int64)))
        mid = first + side[last] - side[first]
        alone = x[first] == y[first]
        roots = np.stack([first, np.where(alone, last, mid), np.where(alone, first, mid), last], axis=1)
        roots = roots[(roots[:, 0] < roots[:, 1]) & (roots[:, 2] < roots[:, 3])]
        child, parent = trees(Trie(v, roots).components())
        turn = (quarter * QUARTER).astype(np.uint64)
        back = (v >> turn) | np.where(turn > 0, v << ((np.uint64(64) - turn) % np.uint64(64)), np.uint64(0))
        back = back.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(back[child]), pa.array(back[parent])], names=["a", "b"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            many += batch.num_rows
            if many < TAKE:
                continue
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            changed = np.zeros(many - 1, bool)
            for c in columns[:4]:
                changed |= c[1:] != c[:-1]
            at = np.flatnonzero(changed)
            end = int(at[-1]) + 1 if len(at) else 0
            if end:
                yield tell(*(c[:end] for c in columns))
            held, many = [[c[end:] for c in columns]], many - end
        if many:
            yield tell(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return rows.select("quarter", "depth", "x", "y", "v").mapInArrow(run, "a long, b long")


def _prefix(v: Column, depth: int) -> Column:
    return F.shiftrightunsigned(v, 64 - depth)


def burst(rows: DataFrame, most: int) -> DataFrame:
    """Rows (quarter, depth, x, y, v) of the nodes of depth 16 that hold more than ``most``: their descendants paired under
    the budget.  At each step pairs of which one side is too large go STEP bits down."""
    masks = [(m, m.bit_count()) for m in range(1 << STEP) if m.bit_count() <= BUDGET]
    flips = F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), F.lit(k).alias("bits")) for m, k in masks])
    depth = QUARTER
    pairs = rows.select("quarter", F.col("head").alias("x"), F.col("head").alias("y"), F.lit(0).alias("d")).distinct()
    out = None
    while True:
        sizes = stored(rows.groupBy("quarter", _prefix(F.col("v"), depth).alias("node")).agg(F.count("*").alias("n")))
        left, right = sizes.select("quarter", F.col("node").alias("x"), F.col("n").alias("nx")), sizes.select("quarter", F.col("node").alias("y"), F.col("n").alias("ny"))
        pairs = stored(pairs.join(left, ["quarter", "x"]).join(right, ["quarter", "y"]))
        final = pairs.filter((F.greatest("nx", "ny") <= most) | F.lit(depth + STEP > 64))
        for side, both in (("x", False), ("y", True)):
            # A node meets at most C(64, <= 3) others; sides that hold a fingerprint twice (x = y) take it once.
            part = final.filter("x < y") if both else final
            mine = lookup(rows.withColumn(side, _prefix(F.col("v"), depth)), part.groupBy("quarter", side).agg(F.collect_list("y" if side == "x" else "x").alias("others")), ["quarter", side], "inner")
            mine = mine.withColumn("y" if side == "x" else "x", F.explode("others")).select("quarter", F.lit(depth).alias("depth"), "x", "y", "v")
            out = mine if out is None else out.unionByName(mine)
        more = pairs.filter((F.greatest("nx", "ny") > most) & F.lit(depth + STEP <= 64))
        if more.isEmpty():
            return out
        depth += STEP
        nodes = sizes_below(rows, depth)
        down = more.select("quarter", "x", "y", "d").join(nodes.withColumnRenamed("node", "cx").withColumnRenamed("up", "x"), ["quarter", "x"])
        down = down.withColumn("flip", F.explode(flips)).filter(F.col("d") + F.col("flip.bits") <= BUDGET)
        cy = F.shiftleft("y", STEP).bitwiseOR(F.col("cx").bitwiseAND(F.lit((1 << STEP) - 1)).bitwiseXOR(F.col("flip.mask")))
        down = down.select("quarter", F.col("cx").alias("x"), cy.alias("y"), (F.col("d") + F.col("flip.bits")).alias("d"))
        pairs = stored(down.filter("x <= y").join(nodes.select("quarter", F.col("node").alias("y")), ["quarter", "y"]).select("quarter", "x", "y", "d"))


def sizes_below(rows: DataFrame, depth: int) -> DataFrame:
    """quarter, up, node: the nodes of a depth and the nodes STEP bits above."""
    return stored(rows.select("quarter", _prefix(F.col("v"), depth - STEP).alias("up"), _prefix(F.col("v"), depth).alias("node")).distinct())


def links(prints: DataFrame, most: int = MOST) -> DataFrame:
    """Links (a, b) that join all fingerprints (fp, each once) of a component."""
    v = F.when(F.col("quarter") == 0, F.col("fp")).otherwise(F.expr("shiftleft(fp, quarter * 16) | shiftrightunsigned(fp, 64 - quarter * 16)"))
    turned = prints.select("fp", F.explode(F.array(*[F.lit(q) for q in range(64 // QUARTER)])).alias("quarter")).select("quarter", v.alias("v"))
    turned = turned.withColumn("head", _prefix(F.col("v"), QUARTER))
    # At most 4 x 65,536 nodes of this depth.
    large = stored(turned.groupBy("quarter", "head").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("quarter", "head"))
    rows = turned if large.isEmpty() else turned.join(F.broadcast(large), ["quarter", "head"], "left_anti")
    rows = rows.select("quarter", F.lit(QUARTER).alias("depth"), F.col("head").alias("x"), F.col("head").alias("y"), "v")
    if not large.isEmpty():
        hot = stored(turned.join(F.broadcast(large), ["quarter", "head"]))
        rows = rows.unionByName(burst(hot, most))
    return joined(rows)


def grouped(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = MOST) -> DataFrame:
    """key, fp, component_id (the smallest key of the component) of every row."""
    rows = stored(fingerprints(docs, key, text))
    prints = stored(rows.groupBy("fp").agg(F.min("key").alias("low"), F.count("*").alias("n")))
    found = stored(links(prints.select("fp"), most))
    comp = components(found)
    shared = prints.join(comp, F.col("fp") == F.col("node"), "left").filter("n > 1 OR comp IS NOT NULL").select("fp", F.coalesce("comp", "fp").alias("comp"), "low")
    shared = stored(shared)
    lows = shared.groupBy("comp").agg(F.min("low").alias("component_id"))
    named = lookup(shared.select("fp", "comp"), lows, ["comp"], "inner").select("fp", "component_id", F.lit(True).alias("met"))
    named = stored(named)
    forget(prints, found, shared)
    # A text alone is a component of its own.
    return lookup(rows, named, ["fp"]).select("key", "fp", F.when(F.col("met"), F.col("component_id")).otherwise(F.col("key")).alias("component_id"))


def digest(docs: DataFrame) -> DataFrame:
    out = grouped(docs)
    return out.select(F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
