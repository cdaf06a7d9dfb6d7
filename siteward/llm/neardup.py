"""Near-copies by order MinHash, verified by banded alignment.

Of every text the five-word k-mers, labelled by occurrence, are hashed; a sketch is the ``SAMPLED``
smallest under one of ``SKETCHES`` hash functions, kept in text order.  They are taken of first
occurrences, and, where k-mers repeat, of all labelled ones too; texts of at most ``SHORT`` k-mers
also have sketches of ``SAMPLED_SHORT``.  Two texts that share a sketch are candidates.

The alignment decides: the different k-mers that two texts share, each where it first stands, are
chained in order within a diagonal band; what is left over is chained again, as passages that moved, as long as
a chain holds ``PASSAGE`` k-mers.  Texts are linked if the chained k-mers are at least ``LEAST`` of
all different k-mers of the two.  K-mers that only recur here and there, out of every order, don't
count; a link thus always means a Jaccard index of ``LEAST`` or more.  Classes are the connected components.

Candidates of a sketch are never all paired.  First each text meets the text of its sketch that
shares most sketches with others (a group's original stands out so); classes are formed, and
what is still apart meets all others of a sketch of up to NEAR + 1 texts, and in larger ones the
leaders of the next ``LEADERS`` classes.  The texts of larger sketches that still
hold several classes are then joined exactly: two sets reach
``LEAST`` only if they share one of their rarest k-mers (prefix filter), and have fitting lengths and
places there.  Every such pair of different classes is aligned; groups of a common k-mer are dealt
out block by block.  Exact copies are one node throughout.

What order costs: two texts of 0.8 share an ordered sketch with a chance of about 0.8 ** SAMPLED each,
so one pair in 30,000 is not a candidate; if long passages have changed places, sketches agree only where
all sampled k-mers lie in one of them.

Defined results: a null text counts as empty; equal texts, empty ones among them, are one class;
a text of fewer than five words has one k-mer, of all its words, and one without words none;
``class_id`` is the smallest doc_id of the class (null if it has none); repeated rows get equal
results, and one row stays of a class when copies are dropped; an empty table gives no rows; other
columns play no part.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteward.llm.components import components
from siteward.llm.io import forget, stored
from siteward.llm.words import U64, chunks, mix, text_bytes

WORDS = 5
SAMPLED = 4
SKETCHES = 20
LEAST = 0.8
SHORT, SHORT_ONLY, SAMPLED_SHORT = 24, 16, 3
PASSAGE = 8
NEAR = 12
LEADERS = 4
BAND = 0.25
HUB_ROWS = 512
BLOCK = 1024
NODE = "binary"


def labelled(words, size: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all documents of ``words``: hashes of k-mers labelled by occurrence, plain hashes, which
    are first occurrences, and where each document's begin."""
    first = words.first
    n = np.diff(first)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    begin = np.concatenate(([0], np.cumsum(count)))
    doc = np.repeat(np.arange(len(n)), count)
    at = np.arange(begin[-1]) - np.repeat(begin[:-1], count) + np.repeat(first[:-1], count)
    grams = words.grams(size)
    plain = np.zeros(len(at), U64)
    long_ = (n >= size)[doc]
    plain[long_] = grams[at[long_]]
    for d in np.flatnonzero((n > 0) & (n < size)):
        h = U64(0)
        for w in words.hashes[first[d] : first[d + 1]]:
            h = mix(np.array([h]) + w, 7)[0]
        plain[begin[d]] = h
    key = plain ^ mix(doc.astype(U64), 11)
    order = np.argsort(key, kind="stable")
    run = key[order]
    new = np.concatenate(([True], run[1:] != run[:-1])) if len(run) else np.zeros(0, bool)
    place = np.flatnonzero(new)
    rank = np.arange(len(run)) - np.repeat(place, np.diff(np.concatenate((place, [len(run)]))))
    occurrence = np.empty(len(run), np.int64)
    occurrence[order] = rank
    return mix(plain + occurrence.astype(U64) * U64(0x9E3779B97F4A7C15), 3), plain, occurrence == 0, begin


_SEEDS = mix(np.arange(1, 3 * SKETCHES + 1, dtype=U64), 5)
_ODD = mix(np.arange(101, 101 + 3 * SKETCHES, dtype=U64), 9) | U64(1)


def _some(kmers: np.ndarray, family: int, sampled: int) -> np.ndarray:
    which = slice(family * SKETCHES, (family + 1) * SKETCHES)
    v = (kmers[None] ^ _SEEDS[which, None]) * _ODD[which, None]
    v ^= v >> U64(31)
    v *= U64(0xBF58476D1CE4E5B9)
    k = min(sampled, len(kmers))
    least = np.argpartition(v, k - 1, axis=1)[:, :k] if k < len(kmers) else np.tile(np.arange(k), (len(v), 1))
    least.sort(axis=1)
    out = _SEEDS[which].copy()
    for j in range(k):
        out = mix(out * U64(0x9E3779B97F4A7C15) + kmers[least[:, j]], 13)
    return out.view(np.int64)


def sketches(kmers: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The order MinHash sketches of one document's labelled k-mers, as hashes that name the sketch, in
    families of SKETCHES: of first occurrences, of all labelled ones, and smaller ones of short texts."""
    once = kmers if first.all() else kmers[first]
    out = []
    if len(once) > SHORT_ONLY:
        out.append(_some(once, 0, SAMPLED))
    if len(once) <= SHORT:
        out.append(_some(once, 1, SAMPLED_SHORT))
    if len(once) < len(kmers):
        out.append(_some(kmers, 2, SAMPLED))
    return np.concatenate(out)


def node_of(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


def sketched(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, node (of the whole text), sketches of every row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            nodes = [hashlib.sha256(raw[a:b]).digest()[:16] for a, b in zip(offsets[:-1], offsets[1:])]
            del raw
            flat, counts = [], []
            for _, _, words in chunks(batch.column(1)):
                kmers, _, first, begin = labelled(words)
                for a, b in zip(begin[:-1], begin[1:]):
                    own = sketches(kmers[a:b], first[a:b]) if b > a else ()
                    counts.append(len(own))
                    if b > a:
                        flat.append(own)
            values = pa.array(np.concatenate(flat)) if flat else pa.array([], pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.binary()), lists], names=["key", "node", "sketches"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, node binary, sketches array<long>")


def _longest(j: np.ndarray) -> np.ndarray:
    """Which of j make up a longest rising run of choices."""
    if len(j) < 2 or (j[1:] > j[:-1]).all():
        return np.ones(len(j), bool)
    tails, at, before = [], [], np.full(len(j), -1)
    for n, x in enumerate(j.tolist()):
        k = bisect_left(tails, x)
        if k == len(tails):
            tails.append(x)
            at.append(n)
        else:
            tails[k], at[k] = x, n
        before[n] = at[k - 1] if k else -1
    kept, n = np.zeros(len(j), bool), at[-1]
    while n >= 0:
        kept[n] = True
        n = before[n]
    return kept


def aligned(a: np.ndarray, b: np.ndarray) -> int:
    """How many shared k-mers the alignment holds: a chain within the band, and chains of moved passages.
    a, b: the different k-mers of two documents, in text order."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    most = (len(a) + len(b)) * LEAST / (1 + LEAST)
    if len(i) < most - 1e-6:
        return len(i)
    order = np.argsort(i)
    i, j = i[order], j[order]
    inside = np.abs(i - j) <= abs(len(a) - len(b)) + BAND * max(len(a), len(b))
    left = np.ones(len(i), bool)
    left[np.flatnonzero(inside)[_longest(j[inside])]] = False
    total = len(i) - int(left.sum())
    while total < most - 1e-6 and left.sum() >= PASSAGE:
        rest = np.flatnonzero(left)
        # A moved passage lies on one diagonal, or close to it.
        way = (j[rest] - i[rest]) // max(8, int(BAND * 32))
        names, counts = np.unique(way, return_counts=True)
        if 3 * counts.max() < PASSAGE:
            break
        common = rest[np.abs(way - names[np.argmax(counts)]) <= 1]
        chain = common[_longest(j[common])]
        left[common] = False
        if len(chain) >= PASSAGE:
            total += len(chain)
    return total


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    if not len(a) or min(len(a), len(b)) < LEAST * max(len(a), len(b)):
        return False
    held = aligned(a, b)
    return held >= LEAST * (len(a) + len(b) - held) - 1e-9


def verified(pairs: DataFrame, kmers: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that are alike.  The k-mers of a ``b`` that many pairs name travel once for
    every HUB_ROWS of them, and pairs of it are dealt over as many tasks."""
    deals = pairs.groupBy("b").agg(F.ceil(F.count("*") / HUB_ROWS).cast("int").alias("deals"))
    one = pairs.join(kmers.select(F.col("node").alias("a"), "kmers"), "a").join(deals, "b")
    one = one.select("b", F.pmod(F.xxhash64("a"), F.col("deals")).cast("int").alias("deal"), "a", "kmers")
    hub = deals.join(kmers.select(F.col("node").alias("b"), "kmers"), "b")
    hub = hub.select("b", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), F.lit(None).cast("binary").alias("a"), "kmers")
    dealt = hub.union(one).repartition("b", "deal").sortWithinPartitions("b", "deal", F.col("a").asc_nulls_first())

    def run(batches):
        now = None
        for batch in batches:
            kept = np.zeros(batch.num_rows, bool)
            a, lists = batch.column(2), batch.column(3)
            for k in range(batch.num_rows):
                own = lists[k].values.to_numpy().view(U64)
                if not a[k].is_valid:
                    now = own.copy()
                else:
                    kept[k] = alike(own, now)
            yield batch.select([2, 0]).filter(pa.array(kept))

    return dealt.mapInArrow(run, "a binary, b binary")


def near_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of the texts of a small sketch that are of different classes.  rows: sketch, node, comp, n."""
    small = rows.filter(F.col("n") <= NEAR + 1).select("sketch", "node", "comp").repartition("sketch").sortWithinPartitions("sketch", "node")

    def run(batches):
        now, held = None, []
        for batch in batches:
            a, b = [], []
            for sketch, node, comp in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if sketch != now:
                    now, held = sketch, []
                for other, its in held:
                    if its != comp:
                        a.append(min(node, other))
                        b.append(max(node, other))
                held.append((node, comp))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return small.mapInArrow(run, "a binary, b binary").distinct()


def leader_pairs(rows: DataFrame, weight: DataFrame) -> DataFrame:
    """Pairs (a, b) of each text with the leaders b of its largest sketch: those of the next LEADERS heaviest classes
    there after the one of the chief; a class's leader is its heaviest text.  rows: sketch, node, comp, n."""
    large = rows.filter(F.col("n") > NEAR + 1).select("sketch", "node", "comp", "n")
    heads = large.join(weight, "node").groupBy("sketch", "comp").agg(F.max(F.struct("weight", "node")).alias("head"))
    place = F.row_number().over(Window.partitionBy("sketch").orderBy(F.col("head").desc()))
    heads = heads.withColumn("k", place).filter(F.col("k").between(2, LEADERS + 1)).select("sketch", F.col("comp").alias("its"), F.col("head.node").alias("b"))
    own = large.groupBy("node", "comp").agg(F.max(F.struct("n", "sketch")).getField("sketch").alias("sketch"))
    return own.join(heads, "sketch").filter(F.col("comp") != F.col("its")).select(F.col("node").alias("a"), "b")


def kmer_sets(texts: DataFrame) -> DataFrame:
    """node, kmers: the different k-mers of every text, in text order."""

    def run(batches):
        for batch in batches:
            for i, j, words in chunks(batch.column(1), 1 << 20):
                kmers, _, first, begin = labelled(words)
                sets = [kmers[a:b][first[a:b]].view(np.int64) for a, b in zip(begin[:-1], begin[1:])]
                ends = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in sets]))), pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets), pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists], names=["node", "kmers"])

    return texts.select("node", "text").mapInArrow(run, "node binary, kmers array<long>")


def _needed(m):
    """The least shared k-mers of a set of m and any set that it is alike."""
    return np.ceil(LEAST * m - 1e-6).astype(np.int64)


def rare_pairs(sets: DataFrame) -> DataFrame:
    """All pairs (a, b) of different classes that can be alike, by one of their rarest k-mers.  sets: node, comp, kmers."""
    rows = sets.select("node", "comp", F.size("kmers").alias("m"), F.explode("kmers").alias("kmer"))
    often = rows.groupBy("kmer").agg(F.count("*").alias("n"))
    order = Window.partitionBy("node").orderBy("n", "kmer")
    ranked = rows.join(often, "kmer").withColumn("at", F.row_number().over(order))
    prefix = (ranked.filter(F.col("at") <= F.col("m") - F.ceil(F.col("m") * LEAST - 1e-6) + 1).filter("n > 1").select("kmer", "node", "comp", "m", "at"))
    prefix = stored(prefix)
    mixed = prefix.groupBy("kmer").agg(F.count("*").alias("g"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high")
    blocks = F.ceil(F.col("g") / BLOCK).cast("int")
    dealt = prefix.join(mixed.select("kmer", blocks.alias("blocks")), "kmer").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("met", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("kmer", F.least("own", "met").alias("i"), F.greatest("own", "met").alias("j"), "own", "node", "comp", "m", "at")
    dealt = dealt.repartition("kmer", "i", "j").sortWithinPartitions("kmer", "i", "j")

    def met(cell, held):
        own, node, comp, m, at = (list(x) for x in zip(*held, strict=True))
        names, of = np.unique(np.array(comp, dtype=object), return_inverse=True)
        if len(names) == 1:
            return
        own, m, at = np.array(own), np.array(m), np.array(at)
        one, two = cell[1:]
        left, right = np.flatnonzero(own == one), np.flatnonzero(own == two)
        for x in left.tolist():
            ys = right[right > x] if one == two else right
            both = np.minimum(m[x] - at[x], m[ys] - at[ys]) + 1
            fits = (of[ys] != of[x]) & (both >= np.maximum(_needed(m[x] + m[ys] - both), _needed(np.maximum(m[x], m[ys]))))
            for y in ys[fits].tolist():
                yield (node[x], node[y]) if node[x] < node[y] else (node[y], node[x])

    def run(batches):
        now, held, out = None, [], set()

        def flush():
            a, b = zip(*out, strict=True) if out else ((), ())
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

        def closed():
            for pair in met(now, held):
                out.add(pair)
                if len(out) >= 1 << 16:
                    yield flush()

        for batch in batches:
            for kmer, i, j, *row in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
                if (kmer, i, j) != now:
                    if held:
                        yield from closed()
                    now, held = (kmer, i, j), []
                held.append(row)
        if held:
            yield from closed()
        yield flush()

    return dealt.mapInArrow(run, "a binary, b binary").distinct()


def rest_of_large(members: DataFrame, links: DataFrame, kmers: DataFrame) -> DataFrame:
    """Links between classes of ``links`` that share a sketch of more than NEAR + 1 texts: all of them."""
    comp = components(links).withColumnRenamed("node", "m")
    large = members.filter(F.col("n") > NEAR + 1).select("sketch", "node")
    placed = stored(large.join(comp, F.col("node") == F.col("m"), "left").select("sketch", "node", F.coalesce("comp", "node").alias("comp")))
    mixed = placed.groupBy("sketch").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("sketch")
    left = placed.join(mixed, "sketch").select("node", "comp").distinct()
    sets = stored(kmers.join(left, "node"))
    found = stored(verified(rare_pairs(sets), sets))
    forget(placed, sets)
    return found


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows: key, node of every document; nodes: node, class_id, whether it stands for its class)."""
    rows = stored(sketched(docs, key, text))
    nodes = stored(rows.groupBy("node").agg(F.min("key").alias("id"), F.max("sketches").alias("sketches")))
    every = nodes.select("node", F.explode("sketches").alias("sketch"))
    shared = every.groupBy("sketch").agg(F.count("*").alias("n")).filter("n > 1")
    members = stored(every.join(shared, "sketch"))
    weight = members.groupBy("node").agg(F.sum("n").alias("weight"))
    chief = members.join(weight, "node").groupBy("sketch").agg(F.max(F.struct("weight", "node")).getField("node").alias("chief"))
    wanted = members.select("node").distinct().join(nodes.select("node", F.col("id")), "node")
    source = docs.select(F.col(key).alias("id"), node_of(F.col(text)).alias("node"), F.col(text).alias("text"))
    same = source["node"].eqNullSafe(wanted["node"]) & source["id"].eqNullSafe(wanted["id"])
    # Equal texts of one node and id are one; k-mers are made once and travel instead of texts.
    kmers = stored(kmer_sets(source.join(wanted, same, "left_semi").groupBy("node", "id").agg(F.first("text").alias("text")).select("node", "text")))
    stars = members.join(chief, "sketch").filter(F.col("node") != F.col("chief"))
    stars = stars.select(F.col("node").alias("a"), F.col("chief").alias("b")).distinct()
    links = stored(verified(stars, kmers))
    first = components(links)
    placed = members.join(first.withColumnRenamed("node", "m"), F.col("node") == F.col("m"), "left").select("sketch", "node", F.coalesce("comp", "node").alias("comp"), "n")
    placed = stored(placed)
    met = stars.union(stars.select("b", "a"))
    pairs = near_pairs(placed).union(leader_pairs(placed, weight)).join(met, ["a", "b"], "left_anti")
    near = stored(verified(pairs, kmers))
    rest = rest_of_large(members, links.union(near), kmers)
    comp = components(links.union(near).union(rest))
    named = nodes.join(comp.withColumnRenamed("node", "m"), F.col("node") == F.col("m"), "left").select("node", "id", F.coalesce("comp", "node").alias("comp"))
    chosen = named.groupBy("comp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("best"))
    named = named.join(chosen, "comp").select("node", F.col("best.id").alias("class_id"), (F.col("best.node") == F.col("node")).alias("stands"))
    named = stored(named)
    forget(nodes, members, kmers, placed, links, near, rest)
    return rows.select("key", "node"), named


def classify(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, class_id, kept of every row of docs; kept: its text stands for the class and its key is the class's."""
    rows, named = classes(docs, key, text)
    return rows.join(named, "node").select("key", "class_id", (F.col("stands") & F.col("key").eqNullSafe(F.col("class_id"))).alias("kept"))


def without_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each class."""
    _, named = classes(docs, key, text)
    named = named.filter("stands").select(F.col("node").alias("_node"), F.col("class_id").alias("_class"))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("node", node_of(F.col(f"row.{text}"))).withColumn("id", F.col(f"row.{key}"))
    kept = own.join(named, (own["node"] == named["_node"]) & own["id"].eqNullSafe(named["_class"]), "left_semi")
    once = Window.partitionBy("node", "id").orderBy(F.lit(1))
    return kept.withColumn("turn", F.row_number().over(once)).filter("turn = 1").select("row.*")


def digest(docs: DataFrame) -> DataFrame:
    return classify(docs.select("doc_id", "text")).withColumnRenamed("key", "doc_id")
