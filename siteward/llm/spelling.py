"""Spelling variants by a bit-sliced position index over the vocabulary.

Words are runs of letters of whole texts; a small part of the runs, chosen by a checksum of document and run, loses one
letter.  Two words are near if one inserted, deleted or replaced code point separates them.

Search.  The vocabulary is dealt into blocks so that every near pair meets in exactly one: a block holds words of
``base`` and ``base + 1`` letters that share their first ``a`` and last ``b`` letters.  Of the letters between, one edit
leaves the first half intact or else the last half, so a block splits in two smaller ones (a word goes to both; the
second takes only pairs whose first half differs).  Blocks above ``MOST`` words are split again, down to one letter
between, where the alphabet bounds them.  Inside a task, blocks are packed by about ``PACK`` words into one index: a
bitset per (position, letter) over the packed words.  All words are looked up together, letter by letter:

* zero errors   Z(i) = Z(i-1) & I[i][x]
* replaced      S(i) = S(i-1) & I[i][x]  |  Z(i-1) & ~I[i][x]
* one more      X(i) = X(i-1) & I[i+1][x]  |  Z(i)
* one less      D(i) = D(i-1) & I[i-1][x]  |  Z(i-1)

with x the i-th letter looked up.  Words of a block are sorted by falling count, then by letters, so the lowest bit of a
result is the best near word.  What leaves a task is one row a word and block (its near words counted, the best named);
pairs are never written.

Defined results: null texts have no words; a null document id is written as an empty string in the checksum; repeated
rows count as often as they stand there; an empty table gives no rows; other columns play no part; very long runs are
words like others.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteward.llm.io import forget, lookup, stored

LETTERS = 7
OCCURRENCES = 2
DROP = 31
RATIO = 10
MOST, PACK, PACK_LETTERS = 1024, 1024, 1 << 16
_RUNS = re.compile(r"[A-Za-zÀ-ÿ]{%d,}" % LETTERS)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_NO_LIMIT = 1 << 30


def words_of(key: object, text: str) -> Counter:
    """Words of one document with their counts."""
    out, ahead = Counter(), zlib.crc32(f"{'' if key is None else key}:".encode())
    for run, n in Counter(_RUNS.findall(text.translate(_LOWER))).items():
        h = zlib.crc32(run.encode(), ahead)
        if h % DROP == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < LETTERS:
                continue
        out[run] += n
    return out


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n of the words with at least OCCURRENCES; counts are added up batch by batch before the shuffle."""

    def run(batches):
        for batch in batches:
            found = Counter()
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if t:
                    found.update(words_of(k, t))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    counted = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= OCCURRENCES)


def halves(rows: DataFrame) -> DataFrame:
    """Each row in both halves of its block: the first letters between the known ones intact, or the last."""
    h = F.floor((F.col("base") - F.col("a") - F.col("b")) / 2).cast("int")
    first = F.struct((F.col("a") + h).alias("a"), F.col("b").alias("b"), F.col("p").alias("p"))
    last = F.struct(F.col("a").alias("a"), (F.col("b") + h).alias("b"), F.least("p", F.col("a") + h).alias("p"))
    rows = rows.withColumn("half", F.explode(F.array(first, last))).select("word", "n", "base", "half.a", "half.b", "half.p")
    sides = [F.substring("word", F.lit(1), F.col("a")), F.substring(F.col("word"), F.length("word") - F.col("b") + 1, F.col("b"))]
    return rows.withColumn("block", F.concat_ws(".", "base", "a", "b", "p", *sides))


def blocks(words: DataFrame, most: int = MOST) -> tuple[DataFrame, list[DataFrame]]:
    """word, n, base, a, b, p, block of every word in each of its blocks; and the tables to forget once it was read.
    Rounds split the blocks that are too large, at most log2 of the longest word's letters."""
    n = F.length("word")
    base = F.explode(F.filter(F.array(n, n - 1), lambda x: x >= LETTERS))
    rows = halves(words.select("word", "n", base.alias("base"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(_NO_LIMIT).alias("p")))
    done, held = [], []
    while True:
        rows = stored(rows)
        held.append(rows)
        large = rows.filter(F.col("base") - F.col("a") - F.col("b") > 1).groupBy("block").agg(F.count("*").alias("size")).filter(F.col("size") > most)
        large = stored(large.select("block", F.lit(True).alias("large")))
        held.append(large)
        if large.isEmpty():
            done.append(rows)
            break
        marked = lookup(rows, large, ["block"])
        done.append(marked.filter("large IS NULL").drop("large"))
        rows = halves(marked.filter("large"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out, held


def _bits(flags: np.ndarray) -> np.ndarray:
    """Bool (..., n) as words of 64 bits (..., ceil(n / 64))."""
    packed = np.packbits(flags, axis=-1, bitorder="little")
    width = -(-packed.shape[-1] // 8) * 8
    out = np.zeros((*packed.shape[:-1], width), np.uint8)
    out[..., : packed.shape[-1]] = packed
    return out.view(np.uint64)


def look_up(mids: list[str], of: np.ndarray, short: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Near words (bool, n x n) of each of n packed words: ``mids`` are their letters between, ``of`` the number of their
    block, ``short`` whether they have its base length, ``limit`` how many first letters must not all be equal."""
    n = len(mids)
    size = np.array([len(m) for m in mids])
    most = int(size.max())
    codes = np.frombuffer("".join(mids).encode("utf-32-le"), np.uint32)
    letters, codes = np.unique(codes, return_inverse=True)
    none = len(letters)
    grid = np.full((n, most), none)
    grid[np.arange(most) < size[:, None]] = codes
    width = -(-n // 64)
    empty = np.zeros((none + 1, width), np.uint64)

    def index(i: int) -> np.ndarray:
        """Bitsets of the words by their i-th letter, from 1."""
        if not 1 <= i <= most:
            return empty
        out = empty.copy()
        out[:none] = _bits(grid[:, i - 1] == np.arange(none)[:, None])
        return out

    mine = _bits(of == np.arange(of.max() + 1)[:, None])[of]
    z, s, x, d = mine, np.zeros_like(mine), mine, np.zeros_like(mine)
    barred, near = np.where((limit <= 0)[:, None], mine, np.uint64(0)), np.zeros_like(mine)
    before, now, after = empty, index(1), index(2)
    is_short, is_long = _bits(short[None]), _bits(~short[None])
    for i in range(1, most + 1):
        q = grid[:, i - 1]
        same = now[q]
        d = (d & before[q]) | z
        s = (s & same) | (z & ~same)
        z = z & same
        x = (x & after[q]) | z
        at = limit == i
        barred[at] = z[at]
        ends = size == i
        one = ends & short
        near[one] = (s[one] & is_short) | (x[one] & is_long)
        other = ends & ~short
        near[other] = d[other] & is_short
        before, now, after = now, after, index(i + 2)
    near &= ~barred
    return np.unpackbits(near.view(np.uint8), axis=1, bitorder="little")[:, :n].astype(bool)


def near_words(rows: DataFrame) -> DataFrame:
    """word, found, best_n, best: the near words of a word within one block."""
    rows = rows.repartition("block").sortWithinPartitions("base", "block", F.desc("n"), "word")

    def tell(pack):
        words, n, base, a, b, p, of = pack
        mids = [w[i : len(w) - j] for w, i, j in zip(words, a, b, strict=True)]
        lengths = np.array([len(w) for w in words])
        near = look_up(mids, of, lengths == base, p - a)
        found = near.sum(axis=1)
        some = np.flatnonzero(found)
        best = near.argmax(axis=1)[some]
        arrays = [pa.array([words[i] for i in some], pa.string()), pa.array(found[some], pa.int64()), pa.array(n[best], pa.int64()), pa.array([words[i] for i in best], pa.string())]
        return pa.RecordBatch.from_arrays(arrays, names=["word", "found", "best_n", "best"])

    def run(batches):
        held = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            if held.num_rows < PACK:
                continue
            yield from packs(held, False)
            held = rest[0]
        if held is not None and held.num_rows:
            yield from packs(held, True)

    rest = [None]

    def packs(table, last):
        """Whole blocks in packs; what may go on in the next batch is left in ``rest``."""
        table = table.combine_chunks()
        block = table["block"].combine_chunks()
        starts = np.concatenate(([0], np.flatnonzero(np.asarray(block.slice(1).to_numpy(zero_copy_only=False) != block.slice(0, len(block) - 1).to_numpy(zero_copy_only=False))) + 1, [len(block)]))
        if not last:
            starts = starts[:-1]
        words = table["word"].to_pylist()
        n, base, a, b, p = (table[c].to_numpy() for c in ("n", "base", "a", "b", "p"))
        size = np.cumsum(np.concatenate(([0], base - a - b + 1)))
        i = 0
        while i < len(starts) - 1:
            j = i + 1
            while j < len(starts) - 1 and starts[j + 1] - starts[i] <= PACK and size[starts[j + 1]] - size[starts[i]] <= PACK_LETTERS:
                j += 1
            f, g = starts[i], starts[j]
            if g - f > 1:
                yield tell((words[f:g], n[f:g], base[f:g], a[f:g], b[f:g], p[f:g], np.repeat(np.arange(j - i), np.diff(starts[i : j + 1]))))
            i = j
        rest[0] = table.slice(int(starts[-1]))

    return rows.mapInArrow(run, "word string, found long, best_n long, best string")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of every word of forms (word, form).  Counts grow at least RATIO times with each form, so chains are as
    short as the logarithm of the largest count, and each round halves them."""
    now = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        next_ = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = stored(now.join(next_, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        forget(now)
        now = after
        if now.filter("moved").isEmpty():
            return now.drop("moved")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of docs."""
    words = stored(vocabulary(docs, key, text))
    rows, held = blocks(words)
    near = near_words(rows).groupBy("word").agg(F.sum("found").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("top"))
    said = F.when(-F.col("top.less") >= F.lit(ratio) * F.col("n"), F.struct(F.col("top.best").alias("form"), (-F.col("top.less")).alias("form_n")))
    out = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), said.alias("said"))
    out = stored(out.select("word", "n", "n_near", "said.form", "said.form_n"))
    forget(words, *held)
    last = roots(out.filter("form IS NOT NULL").select("word", "form"))
    return out.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def digest(docs: DataFrame) -> DataFrame:
    return variants(docs)
