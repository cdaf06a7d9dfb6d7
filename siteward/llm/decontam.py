"""Benchmark decontamination: a broadcast table of hashed test n-grams, scanned over all windows.

Every item gives the windows of ``size`` consecutive words (an item of fewer words one window
of all of them).  Documents are cut into words and hashed in numpy; a bitmap and a sorted hash
table find candidate windows and each is compared word by word before it counts.  The table
that a task holds is bounded by ``BLOCK_BYTES`` of benchmark text: a larger benchmark is taken
in blocks, one scan for each, chained on the same rows without a shuffle.

Defined results: null or empty texts have no words and are clean; empty items have no window;
items that repeat count once by item_id; a null item_id is written as ``null``; repeated
documents each get their own row; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteward.llm.io import shipped
from siteward.llm.words import Words, chunks

WINDOW = 13
SHARE = 20
BLOCK_BYTES = 4 << 20


class Index:
    """Windows of a block of items, by length: sorted hashes with the item and word of each."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        self.ids = [i for i, _ in items]
        raw = [t.encode() for _, t in items]
        offsets = np.concatenate(([0], np.cumsum([len(b) for b in raw]))).astype(np.int64)
        self.words = words = Words(np.frombuffer(b"".join(raw), np.uint8), offsets)
        first, n = words.first, np.diff(words.first)
        self.tables = {}
        for length in sorted({int(min(size, k)) for k in n if k}):
            own = np.flatnonzero((n >= size) if length == size else (n == length))
            at = np.concatenate([np.arange(first[i], first[i + 1] - length + 1) for i in own])
            item = np.concatenate([np.full(first[i + 1] - first[i] - length + 1, i) for i in own])
            hashes = words.grams(length)[at]
            order = np.argsort(hashes, kind="stable")
            bits = np.zeros(1 << max(16, int(8 * len(at)).bit_length()), dtype=bool)
            mask = np.uint64(len(bits) - 1)
            bits[(hashes & mask).astype(np.int64)] = True
            self.tables[length] = (hashes[order], item[order], at[order], bits, mask)
        self.known: dict = {}

    def texts(self, length: int, h: int) -> dict[bytes, list[str]]:
        """The windows with hash h: their words and the items that hold them."""
        if (length, h) not in self.known:
            hashes, item, at, _, _ = self.tables[length]
            lo, hi = np.searchsorted(hashes, np.uint64(h), "left"), np.searchsorted(hashes, np.uint64(h), "right")
            out: dict[bytes, list[str]] = defaultdict(list)
            for k in range(lo, hi):
                out[self.words.join(at[k], at[k] + length)].append(self.ids[item[k]])
            self.known[length, h] = out
        return self.known[length, h]


def _find(index: Index, column: pa.Array) -> Iterator[tuple[int, dict[str, None], list[tuple[int, int]]]]:
    """For each text: number of words, items found, spans of words that are hit."""
    for _, _, words in chunks(column):
        first = words.first
        items: dict[int, set] = defaultdict(set)
        spans: dict[int, list] = defaultdict(list)
        for length, (hashes, _, _, bits, mask) in index.tables.items():
            grams = words.grams(length)
            maybe = np.flatnonzero(bits[(grams & mask).astype(np.int64)])
            if not len(maybe):
                continue
            there = np.searchsorted(hashes, grams[maybe])
            there[there == len(hashes)] = 0
            maybe = maybe[hashes[there] == grams[maybe]]
            doc = np.searchsorted(first, maybe, "right") - 1
            inside = maybe + length <= first[doc + 1]
            for p, d in zip(maybe[inside].tolist(), doc[inside].tolist(), strict=True):
                if found := index.texts(length, int(grams[p])).get(words.join(p, p + length)):
                    items[d].update(found)
                    spans[d].append((p - int(first[d]), p - int(first[d]) + length))
        for d in range(len(first) - 1):
            yield int(first[d + 1] - first[d]), items.get(d, ()), spans.get(d, ())


def merged(spans) -> list[tuple[int, int]]:
    """Sorted spans without overlaps."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def blocks_of(benchmark: DataFrame, size: int, block_bytes: int) -> Iterator[Index]:
    """Indexes of at most about ``block_bytes`` of text each; the driver holds one block at a time."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("i"), F.coalesce(F.col("text"), F.lit("")).alias("t"))
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).distinct().collect()
        yield Index(sorted((r["i"], r["t"]) for r in rows), size)


def _opened(indexes: list, kept: dict) -> Iterator[Index]:
    """The blocks one after another; a task keeps a single block, and of several one at a time."""
    for x in indexes:
        if len(indexes) == 1:
            if not kept:
                kept[0] = pickle.loads(x.value)
            yield kept[0]
        else:
            yield pickle.loads(x.value)
            x.__dict__.pop("_value", None)


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def mark(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """key, text, n_words, item_ids and hit spans (in words, merged) of every document."""
    kind = docs.schema[key].dataType
    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = T.StructType([
        T.StructField("key", kind), T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    ])
    for index in blocks_of(benchmark, size, block_bytes):
        held = shipped(docs.sparkSession, index)

        def scan(batches, held=held):
            index = pickle.loads(held.value)
            for batch in batches:
                n, items, spans = [], [], []
                before = batch.column("item_ids").to_pylist() if "item_ids" in batch.schema.names else None
                marked = batch.column("spans").to_pylist() if before is not None else None
                for i, (words, found, hits) in enumerate(_find(index, batch.column("text"))):
                    if before is not None:
                        found = {*found, *before[i]}
                        hits = [*hits, *((s["start"], s["end"]) for s in marked[i])]
                    n.append(words)
                    items.append(sorted(found))
                    spans.append([{"start": a, "end": b} for a, b in merged(hits)] if hits else [])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key"), batch.column("text"), pa.array(n, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, _SPANS)],
                    names=["key", "text", "n_words", "item_ids", "spans"],
                )

        out = out.mapInArrow(scan, schema)
    return out


def _decided(n_words: int, hits, share: int) -> tuple[int, bool]:
    n = sum(b - a for a, b in merged(hits))
    return n, n > 0 and share * n >= n_words


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", size: int = WINDOW, share: int = SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without its contaminated documents (1/share of their words or more inside windows)."""
    out = docs
    indexes = [shipped(docs.sparkSession, x) for x in blocks_of(benchmark, size, block_bytes)]

    def keep(batches):
        kept: dict = {}
        for batch in batches:
            hits: list[list] = [[] for _ in range(batch.num_rows)]
            n = [0] * batch.num_rows
            for index in _opened(indexes, kept):
                for i, (words, _, spans) in enumerate(_find(index, batch.column(text))):
                    n[i] = words
                    hits[i].extend(spans)
            yield batch.filter(pa.array([not _decided(k, h, share)[1] for k, h in zip(n, hits, strict=True)], pa.bool_()))

    return out.mapInArrow(keep, docs.schema)


def without_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with the words inside benchmark windows, and what stands between them, cut out."""
    indexes = [shipped(docs.sparkSession, x) for x in blocks_of(benchmark, size, block_bytes)]

    def cut(batches):
        kept: dict = {}
        for batch in batches:
            at = batch.schema.get_field_index(text)
            hits: list[list] = [[] for _ in range(batch.num_rows)]
            for index in _opened(indexes, kept):
                for i, (_, _, spans) in enumerate(_find(index, batch.column(at))):
                    hits[i].extend(spans)
            texts = batch.column(at).to_pylist()
            for i, h in enumerate(hits):
                if h:
                    raw = texts[i].encode()
                    words = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                    end, rest = 0, []
                    for a, b in merged(h):
                        rest.append(raw[end : words.starts[a]])
                        end = int(words.ends[b - 1])
                    texts[i] = b"".join([*rest, raw[end:]]).decode()
            columns = batch.columns
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(cut, docs.schema)


def digest(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, share: int = SHARE) -> DataFrame:
    indexes = [shipped(docs.sparkSession, x) for x in blocks_of(benchmark, size, BLOCK_BYTES)]

    def scan(batches):
        kept: dict = {}
        for batch in batches:
            n = [0] * batch.num_rows
            items: list[set] = [set() for _ in n]
            hits: list[list] = [[] for _ in n]
            for index in _opened(indexes, kept):
                for i, (words, found, spans) in enumerate(_find(index, batch.column("text"))):
                    n[i] = words
                    items[i].update(found)
                    hits[i].extend(spans)
            decided = [_decided(k, h, share) for k, h in zip(n, hits, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(n, pa.int64()), pa.array([d[0] for d in decided], pa.int64()), pa.array([len(x) for x in items], pa.int64()),
                    pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]), pa.array([d[1] for d in decided], pa.bool_()),
                ],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
