"""Packing of tokenised documents into fixed windows, best fit decreasing.

Every document is tokenised whole, ended by ``END``, and cut into full windows and a tail.
Pieces are dealt by hash into blocks of about ``BLOCK`` documents; in a block they are placed,
longest first, into the open window of the tightest remaining room, found in a segment tree over
room sizes.  A block is the unit of work: its memory is bounded and any executor can redo it.

Token ids are those of the ``tokenizers`` file; its merges are run by a faster implementation that
is checked against that library when it is loaded, and texts that hold one of the file's special
strings, or that the faster one can't take, go through the library itself.

Defined results: a null or empty text is the end id alone; repeated rows are packed once each; an
empty table gives no sequences; a null key stays null; other columns play no part.
"""

from __future__ import annotations

import json
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 1024
END = 0
BLOCK = 16384
#: Of byte-level BPE vocabularies: the fixed split pattern, and bytes that stand for themselves.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
PROBES = ("", " ", "Don't  stop\n\n now ", "naïve Straße 12,345.67 %%% \t x", "日本語 テスト 🙂 é", "aaaaaaaaaaaaaaaaaaaaaaaa" * 9, "a    b\r\n")


def tokenizer_file(path: str | None = None) -> str:
    """The text of a tokenizer's file; by default of the public byte-level one with 50,257 ids."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return Path(path).read_text(encoding="utf-8")


class Tokens:
    def __init__(self, content: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(content)
        spec = json.loads(content)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        stands = {chr(b): b for b in PLAIN}
        rest = [b for b in range(256) if b not in PLAIN]
        stands |= {chr(256 + n): b for n, b in enumerate(rest)}
        self.fast = None
        try:
            ranks = {bytes(stands[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
            fast = tiktoken.Encoding("packing", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
            if all(fast.encode_ordinary(p) == self.library.encode(p, add_special_tokens=False).ids for p in PROBES):
                self.fast = fast
        except (KeyError, ValueError):  # another kind of vocabulary: the library alone
            self.fast = None

    def ids(self, text: str | None) -> np.ndarray:
        """Ids of a text and the end id."""
        if not text:
            return np.array([END], dtype="<u4")
        found = None
        if self.fast is not None and not any(s in text for s in self.special):
            try:
                found = self.fast.encode_ordinary(text)
            except BaseException as e:  # noqa: BLE001  a panic of the compiled code is no Exception
                if isinstance(e, (KeyboardInterrupt, SystemExit)):
                    raise
        if found is None:
            found = self.library.encode(text, add_special_tokens=False).ids
        out = np.empty(len(found) + 1, dtype="<u4")
        out[:-1] = found
        out[-1] = END
        return out


def pieces(docs: DataFrame, content: str, window: int = WINDOW, key: str = "doc_id", text: str = "text", keep_ids: bool = True) -> DataFrame:
    """key, start, length, ids_crc32, doc_tokens and, if wanted, ids of every piece of every document."""
    held = docs.sparkSession.sparkContext.broadcast(content)

    def run(batches):
        tokens = Tokens(held.value)
        for batch in batches:
            row, start, length, crc, total, ids = [], [], [], [], [], []
            for i, t in enumerate(batch.column(1)):
                own = tokens.ids(t.as_py())
                n = len(own)
                for a in range(0, n, window):
                    part = own[a : a + window]
                    row.append(i)
                    start.append(a)
                    length.append(len(part))
                    crc.append(zlib.crc32(part))
                    total.append(n)
                    if keep_ids:
                        ids.append(part)
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(total, pa.int64())]
            names = ["key", "start", "length", "ids_crc32", "doc_tokens"]
            if keep_ids:
                flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(length))), pa.int32()), pa.array(flat)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * keep_ids)


class OpenWindows:
    """Open windows by remaining room, in a segment tree over the rooms 0..window."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.by_room: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, room: int, number: int) -> None:
        self.by_room[room].append(number)
        k = self.leaves + room
        while k and not self.any[k]:
            self.any[k] = 1
            k >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """The window with the smallest room of at least ``least``; it is no longer open."""
        tree, k = self.any, self.leaves + least
        if not tree[k]:
            while k > 1 and not (k % 2 == 0 and tree[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.leaves:
                k = 2 * k if tree[2 * k] else 2 * k + 1
        room = k - self.leaves
        number = self.by_room[room].pop()
        if not self.by_room[room]:
            tree[k] = 0
            while k > 1 and not tree[k ^ 1]:
                k >>= 1
                tree[k] = 0
        return room, number


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """Window number and offset of each length; the lengths come longest first."""
    opened, numbers, offsets, n = OpenWindows(window), [], [], 0
    for length in lengths:
        found = opened.take(length) if length < window else None
        room, number = found or (window, n)
        n += found is None
        numbers.append(number)
        offsets.append(window - room)
        if room > length:
            opened.add(room - length, number)
    return numbers, offsets


def packed(found: DataFrame, documents: int, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """pieces with sequence_id and offset.  Equal rows may stand for a third of all: the row's
    place in its partition salts the hash, so that no block is theirs."""
    blocks = max(1, -(-documents // block))
    salted = found.withColumn("block", F.pmod(F.xxhash64("key", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))
    parts = max(1, min(blocks, int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    salted = salted.repartition(parts, "block").sortWithinPartitions("block", F.col("length").desc(), "key", "start", "ids_crc32")

    def place(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        numbers, offsets = best_fit(table.column("length").to_pylist(), window)
        first = int(table.column("block")[0].as_py()) << 32
        table = table.drop_columns(["block"])
        table = table.append_column("sequence_id", pa.array(np.array(numbers, np.int64) + first)).append_column("offset", pa.array(offsets, pa.int64()))
        return table

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            at = batch.column(batch.schema.get_field_index("block")).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if held and held[-1].column("block")[-1].as_py() != int(at[a]):
                    yield from place(held).to_batches()
                    held = []
                held.append(part)
        if held:
            yield from place(held).to_batches()

    kept = [f for f in found.schema.fields]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", sequence_id long, offset long"
    return salted.mapInArrow(run, schema)


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, key: str = "doc_id", text: str = "text", keep_ids: bool = True, block: int = BLOCK) -> DataFrame:
    content = tokenizer_file(path)
    return packed(pieces(docs, content, window, key, text, keep_ids), docs.count(), window, block)


def sequences(docs: DataFrame, path: str | None = None, window: int = WINDOW, pad: int = END) -> DataFrame:
    """One row per sequence: sequence_id, ids (padded to the window) and used (ids before the padding)."""
    placed = pack(docs, path, window)
    rows = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    ids = F.flatten(F.transform("parts", lambda p: p["ids"]))
    rows = rows.select("sequence_id", ids.alias("ids"))
    return rows.select("sequence_id", F.concat("ids", F.array_repeat(F.lit(pad), F.lit(window) - F.size("ids"))).alias("ids"), F.size("ids").alias("used"))


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    out = pack(docs.select("doc_id", "text"), path, keep_ids=False).withColumnRenamed("key", "doc_id")
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
