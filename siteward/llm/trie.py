"""Prefix trie of conversations by burst tries.

Turns are ordered, interned (128 bits of the SHA-256 of role and text) and every prefix gets a name: 128 bits, the
exclusive or of its turns' hashes with their depths.  A trie head with more than ``LIMIT`` turns below bursts: its
suffix containers are dealt anew by the next turn ids, at depths 1, 2, 4, 8 and so on, until a container is small or
its conversations end.  Which head is too large is counted for all depths of that ladder in one aggregate.

* A container is sorted by turn ids and swept once: nodes are closed as the common prefix of neighbours gets shorter.
  Its turns are bounded by ``LIMIT``, whoever owns them: a conversation of any length is in the heads but for its end.
* Heads are few.  A container, or a set of conversations that end in the heads, is a unit with the turns of one of its
  conversations.  A unit owns the nodes of its path whose smallest member is its own: those below depth ``s``.  Then
  each node's children, leaves and saved tokens are plain sums over the units below it, with partial aggregation; no
  walk over levels is needed.
* The digest of ids that end in a node is sequential: ids are sorted by ranges and written as pieces of up to
  ``PIECE`` ids, so that the task of one node reads few rows.

Running counts along a conversation are made by blocks of ``BLOCK`` turns, so a conversation with a third of all turns is
the work of many tasks.

Defined results: rows of a null conversation id take no part; a null turn comes first, turns with equal numbers go by
role, then text; repeated rows are turns of their own; null roles and texts are empty; an empty table has no nodes,
not even a root; other columns play no part.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteward.llm.io import lookup, stored

LIMIT, BLOCK, PIECE = 4096, 1024, 4096
FAMILY, MOST_SHARED = 20, 4
NAME = ["depth", "n1", "n2"]
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_COLUMNS = [c.split()[0] for c in _NODE.split(", ")]


def shared_turns(conv: Column) -> Column:
    """How many first turns a conversation takes from the first of its family."""
    return F.pmod(F.crc32(conv.cast("string")), F.lit(MOST_SHARED))


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), turn_id, words of every turn, in the order of (turn, role, text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text")).filter("conv_id IS NOT NULL")
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("k"))
    rows = rows.repartitionByRange("conv_id", "turn", "role", "text").sortWithinPartitions("conv_id", "turn", "role", "text")
    whole = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    # Ranges are in order and so are rows within, hence this id is a place; its high bits number the range.
    placed = rows.select("conv_id", F.monotonically_increasing_id().alias("at"), "k", F.unhex(F.substring(whole, 1, 32)).alias("turn_id"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    placed = stored(placed).withColumn("part", F.shiftright("at", 33))
    ahead = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy("conv_id", "part").agg(F.sum("k").alias("k")).select("conv_id", "part", F.coalesce(F.sum("k").over(ahead), F.lit(0)).alias("base"))
    inside = Window.partitionBy("conv_id", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("base") + F.coalesce("here", F.lit(0))
    rows = placed.withColumn("here", F.sum("k").over(inside)).join(before, ["conv_id", "part"]).select("conv_id", first.alias("first"), (first + F.col("k")).alias("end"), "turn_id", "words")
    # Repeated rows spread out again, in steps so that no array is long.
    rows = rows.withColumn("first", F.explode(F.sequence("first", F.col("end") - 1, F.lit(BLOCK).cast("long"))))
    rows = rows.withColumn("pos", F.explode(F.sequence("first", F.least(F.col("first") + BLOCK, "end") - 1)))
    return rows.select("conv_id", "pos", "turn_id", "words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paths: conv_id, depth from 1, turn_id, words; conversations: conv_id, length, turnless ones too).

    The first h turns, h by the id's checksum, come from the first conversation of the family of FAMILY ids."""
    own = stored(numbered(turns))
    lengths = own.groupBy("conv_id").agg(F.count("*").alias("n"))
    conv = F.col("conv_id")
    family, h = conv - conv % FAMILY, shared_turns(conv)
    heads = lengths.filter(conv % FAMILY == 0).select(conv.alias("family"), F.col("n").alias("of"))
    convs = lengths.select("conv_id", "n", family.alias("family"), h.alias("h")).join(heads, "family", "left")
    convs = convs.select("conv_id", "family", "h", F.least("h", F.coalesce("of", F.lit(0))).alias("taken"), "n")
    convs = stored(convs.select("*", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")))
    lent = own.filter((conv % FAMILY == 0) & (F.col("pos") < MOST_SHARED - 1)).withColumnRenamed("conv_id", "family")
    first = convs.filter("taken > 0").join(lent, "family").filter("pos < taken").select("conv_id", (F.col("pos") + 1).alias("depth"), "turn_id", "words")
    short = stored(convs.filter("taken < h").select("conv_id", "taken"))
    rest = lookup(own.filter(F.col("pos") >= h), short, ["conv_id"])
    rest = rest.select("conv_id", (F.coalesce("taken", h) + F.col("pos") - h + 1).alias("depth"), "turn_id", "words")
    return first.unionByName(rest), convs.select("conv_id", "length")


def named(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, depth, turn_id, words, n1, n2 (name of the prefix), p (words of the prefix); depth 0 is the root's row."""
    block = F.floor((F.col("depth") - 1) / BLOCK).alias("block")
    rows = paths.select("*", block, F.xxhash64(F.lit(1), "depth", "turn_id").alias("x1"), F.xxhash64(F.lit(2), "depth", "turn_id").alias("x2"))
    folds = (F.bit_xor, "x1", "n1"), (F.bit_xor, "x2", "n2"), (F.sum, "words", "p")
    ahead = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("conv_id", "block").agg(*[f(x).alias(x) for f, x, _ in folds])
    before = before.select("conv_id", "block", *[f(x).over(ahead).alias(f"{n}_before") for f, x, n in folds]).filter("block > 0")
    inside = Window.partitionBy("conv_id", "block").orderBy("depth")
    rows = rows.select("*", *[f(x).over(inside).alias(n) for f, x, n in folds]).join(before, ["conv_id", "block"], "left")
    past = lambda n: F.coalesce(f"{n}_before", F.lit(0))
    rows = rows.select("conv_id", "depth", "turn_id", "words", F.col("n1").bitwiseXOR(past("n1")).alias("n1"), F.col("n2").bitwiseXOR(past("n2")).alias("n2"), (F.col("p") + past("p")).alias("p"))
    zero = F.lit(0).cast("long")
    root = convs.select("conv_id", zero.alias("depth"), F.lit(b"").alias("turn_id"), zero.alias("words"), zero.alias("n1"), zero.alias("n2"), zero.alias("p"))
    return rows.unionByName(root)


def burst(rows: DataFrame, convs: DataFrame, limit: int) -> DataFrame:
    """conv_id, length, top: the depth of the head under which its container hangs, null if it ends in the heads."""
    rungs = rows.filter(F.col("depth").bitwiseAND(F.col("depth") - 1) == 0).select("conv_id", *NAME)
    rungs = stored(rungs.join(convs, "conv_id"))
    large = rungs.groupBy(*NAME).agg(F.sum(F.col("length") - F.col("depth") + 1).alias("size")).filter(F.col("size") > limit)
    marked = lookup(rungs, stored(large.select(*NAME, F.lit(True).alias("large"))), NAME)
    return stored(marked.groupBy("conv_id", "length").agg(F.min(F.when(F.col("large").isNull(), F.col("depth"))).alias("top")))


def _ends(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()


class Sweep:
    """Nodes of one container from its conversations in the order of their turn ids."""

    def __init__(self, top: int):
        self.top, self.path, self.open, self.out = top, [], [], []

    def add(self, conv: int, ids: list[bytes], words: list[int]) -> None:
        k = 0
        while k < min(len(ids), len(self.path)) and ids[k] == self.path[k]:
            k += 1
        if self.path and not k:
            raise ValueError("conversations of one container differ in its head")
        self._close(k)
        # smallest member, members, children, leaves, saved, words, ends, records of the children
        self.open += [[conv, 0, 0, 0, 0, w, [], []] for w in words[k:]]
        self.path = ids
        self.open[-1][6].append(conv)

    def _close(self, depth: int) -> None:
        while len(self.open) > depth:
            low, n, children, leaves, saved, words, ends, below = self.open.pop()
            n += len(ends)
            low = min([low, *ends])
            saved += (n - 1) * words
            leaves = leaves if children else 1
            record = [low, self.top + len(self.open), None, n, children, leaves, saved, _ends(ends)]
            for child in below:
                child[2] = low
            self.out.append(record)
            if self.open:
                up = self.open[-1]
                up[0] = min(up[0], low)
                up[1] += n
                up[2] += 1
                up[3] += leaves
                up[4] += saved
                up[7].append(record)

    def nodes(self) -> list[list]:
        self._close(0)
        return self.out


def swept(rows: DataFrame) -> DataFrame:
    """Nodes of all containers from rows (conv_id, depth >= top, turn_id, words, n1, n2, top); a container's own head is
    among them, with ``is_top`` set and its parent unknown."""
    named = F.max(F.when(F.col("depth") == F.col("top"), F.struct("n1", "n2")))
    each = rows.groupBy("conv_id", "top").agg(named.alias("name"), F.array_sort(F.collect_list(F.struct("depth", "turn_id", "words"))).alias("turns"))
    each = each.select("top", "name.n1", "name.n2", "conv_id", F.col("turns.turn_id").alias("ids"), F.col("turns.words").alias("words"))
    each = each.repartition("top", "n1", "n2").sortWithinPartitions("top", "n1", "n2", "ids", "conv_id")

    def table(records):
        kinds = [pa.string() if c == "ends_sha256" else pa.int64() for c in _COLUMNS]
        columns = [pa.array([r[i] for r in records], kind) for i, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([r[2] is None for r in records], pa.bool_())], names=[*_COLUMNS, "is_top"])

    def run(batches):
        at, sweep = None, None
        for batch in batches:
            done = []
            for top, n1, n2, conv, ids, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != (top, n1, n2):
                    if sweep:
                        done += sweep.nodes()
                    at, sweep = (top, n1, n2), Sweep(top)
                sweep.add(conv, ids, words)
            yield table(done)
        if sweep:
            yield table(sweep.nodes())

    return each.mapInArrow(run, f"{_NODE}, is_top boolean")


def ends_of(rows: DataFrame) -> DataFrame:
    """NAME, ends_sha256 from rows (NAME, conv_id), one an id that ends in the node."""
    dealt = rows.select(*NAME, "conv_id").repartitionByRange(*NAME, "conv_id").sortWithinPartitions(*NAME, "conv_id")

    def pieces(batches):
        at, ids, out = None, [], []

        def flush():
            if ids:
                out.append((*at, ids[0], ",".join(map(str, ids))))
                ids.clear()

        def table():
            columns = list(zip(*out, strict=True)) or [()] * 5
            out.clear()
            return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:4]], pa.array(columns[4], pa.string())], names=[*NAME, "first", "ids"])

        for batch in batches:
            for *name, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != at or len(ids) == PIECE:
                    flush()
                    at = name
                ids.append(conv)
            yield table()
        flush()
        yield table()

    parts = dealt.mapInArrow(pieces, "depth long, n1 long, n2 long, first long, ids string").repartition(*NAME).sortWithinPartitions(*NAME, "first")

    def digests(batches):
        at, sha = None, None
        for batch in batches:
            out = []
            for *name, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name == at:
                    sha.update(b",")
                else:
                    if at:
                        out.append((*at, sha.hexdigest()))
                    at, sha = name, hashlib.sha256()
                sha.update(ids.encode())
            yield table(out)
        if at:
            yield table([(*at, sha.hexdigest())])

    def table(out):
        columns = list(zip(*out, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())], names=[*NAME, "ends_sha256"])

    return parts.mapInArrow(digests, "depth long, n1 long, n2 long, ends_sha256 string")


def heads(rows: DataFrame, tops: DataFrame, enders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes of the heads; tops with their parents).  rows: the rows of all conversations above their containers; tops:
    the containers' own nodes; enders: rows at the last depth of conversations that end here."""
    units = enders.groupBy(*NAME).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n")).select("conv_id", F.col("depth").alias("end"), "n", F.lit(None).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
    units = units.unionByName(tops.select("conv_id", (F.col("depth") - 1).alias("end"), F.col("n_convs").alias("n"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")))
    path = stored(lookup(rows, stored(units), ["conv_id"], "inner"))
    groups = path.groupBy(*NAME).agg(F.min("conv_id").alias("low"), F.sum("n").alias("members"), F.min("turn_id").alias("t1"), F.max("turn_id").alias("t2"))
    same = F.when(F.col("t1") == F.col("t2"), F.col("low")).otherwise(F.raise_error(F.lit("two turns share a name")).cast("long"))
    groups = stored(groups.select(*NAME, same.alias("low"), "members"))
    path = stored(lookup(path, groups, NAME, "inner"))
    # How far each unit's path is owned by a smaller conversation, and words up to there and up to its end.
    owned = F.max(F.when(F.col("low") < F.col("conv_id"), F.struct("depth", "low", "p")))
    each = path.groupBy("conv_id").agg(owned.alias("other"), F.max_by("p", "depth").alias("p_end"), F.max_by("members", "depth").alias("m_end"), F.first("n").alias("size"), F.first("leaves").alias("known"))
    leaves = F.coalesce("known", (F.col("m_end") == F.col("size")).cast("long"))
    each = each.select("conv_id", F.coalesce("other.depth", F.lit(-1)).alias("s"), F.col("other.low").alias("owner"), F.coalesce("other.p", F.lit(0)).alias("p_s"), "p_end", leaves.alias("leaf"))
    each = stored(each)
    path = lookup(path, each, ["conv_id"], "inner").withColumn("above", F.col("p") - F.col("words"))
    goes_on = F.col("depth") < F.when(F.col("leaves").isNull(), F.col("end")).otherwise(F.col("end") + 1)
    repeated = F.col("n") * (F.col("p_end") - F.col("above")) - (F.col("p_end") - F.greatest("p_s", "above"))
    parent = F.when((F.col("low") == F.col("conv_id")) & (F.col("depth") > 0), F.when(F.col("s") == F.col("depth") - 1, F.col("owner")).otherwise(F.col("conv_id")))
    sums = [
        F.min("conv_id").alias("conv_id"), F.max(parent).alias("parent_conv_id"), F.sum("n").alias("n_convs"), F.sum(((F.col("s") <= F.col("depth")) & goes_on).cast("long")).alias("n_children"),
        F.sum("leaf").alias("n_leaves"), F.sum(F.col("saved") + repeated).alias("saved_tokens"),
    ]
    nodes = path.groupBy(*NAME).agg(*sums).join(ends_of(enders), NAME, "left")
    nodes = nodes.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_ends([])))).select(*_COLUMNS)
    up = each.select("conv_id", "s", "owner")
    parent = F.when(F.col("s") == F.col("depth") - 1, F.col("owner")).when(F.col("depth") > 0, F.col("conv_id"))
    tops = tops.drop("parent_conv_id").join(up, "conv_id", "left").withColumn("parent_conv_id", parent).select(*_COLUMNS)
    return nodes, tops


def prefix_trie(paths: DataFrame, convs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """All nodes of the trie of paths (conv_id, depth, turn_id, words) of convs (conv_id, length)."""
    rows = stored(named(paths, convs))
    placed = burst(rows, convs, limit)
    rows = stored(lookup(rows, placed, ["conv_id"], "inner"))
    nodes = stored(swept(rows.filter("depth >= top")))
    above = rows.filter("top IS NULL OR depth < top").select("conv_id", "length", "top", "turn_id", "words", "p", *NAME)
    enders = above.filter("top IS NULL AND depth = length")
    head, tops = heads(above.drop("length", "top"), nodes.filter("is_top"), enders)
    return nodes.filter("NOT is_top").select(*_COLUMNS).unionByName(tops).unionByName(head)


def digest(turns: DataFrame) -> DataFrame:
    paths, convs = rebuilt(turns)
    return prefix_trie(stored(paths), convs)
