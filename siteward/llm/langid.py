"""Language identification by compression: the language whose zstandard dictionary codes a text
in the fewest bytes.

A dictionary is raw content: pieces from all over about ``ROWS`` different labelled texts of a language
(a documented bound; at most ``PIECE_CHARS`` of each), picked by the hash of the text, with equal shares
of ``DICT_BYTES``.
Every text is classified whole, in blocks of ``BLOCK_BYTES`` that are coded one by one by a greedy
coder; where that leaves less than ``CLOSE`` between the best two, by an optimal one.  A language
costs its code and its share of the learned texts, both in bits.  A text is rejected if the second
best code is longer by no more than the margin.  The margin is set at every size alike, by two folds of
the same texts: each is classified by what the other one taught, once with all languages and once
without its own, as a text of a language that nobody taught would be.  See ``narrowest``.

Defined results: ``und`` for a null text, one without letters, or if there are no labelled rows
(score 0, rejected); a language without letters in its labelled texts is not learned; with one text a
language, or one language, the margin is 0; ties go to
the language that sorts first; repeated rows get equal results; other columns play no part.
"""

from __future__ import annotations

import math
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS = 400
PIECES, PIECE_CHARS = 4, 2000
DICT_BYTES = 96 << 10
BLOCK_BYTES = 32 << 10
CLOSE = 0.02
UNSEEN, LOST = 0.9, 0.002
_FRAME = {"window_log": 19, "hash_log": 17, "chain_log": 17, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
GREEDY = {"strategy": zstd.STRATEGY_GREEDY, "min_match": 4, "search_log": 4}
OPTIMAL = {"strategy": zstd.STRATEGY_BTLAZY2, "min_match": 3, "search_log": 5, "target_length": 16}
_SPACE = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(256))


def plain(text: str) -> bytes:
    """Lower-case letters in words parted by single spaces."""
    return b" ".join(text.lower().encode().translate(_SPACE).split())


def held_out(key: str, divisor: int, remainder: int) -> Column:
    """Rows of which nothing is learned; a null key is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(divisor)) == remainder, F.lit(False))


def _cuts(text: Column) -> Column:
    """PIECES pieces of a text, spread over all of it; a short text is one piece."""
    n, size = F.length(text), PIECE_CHARS // PIECES
    cut = [F.substr(text, (F.floor((n - size) * i / (PIECES - 1)) + 1).cast("int"), F.lit(size)) for i in range(PIECES)]
    return F.when(n <= PIECE_CHARS, F.array(text)).otherwise(F.array(*cut))


def _filled(sizes: list[int], room: int) -> int:
    """The greatest share such that min(size, share) summed over all fits in the room."""
    low, high = 0, max(sizes, default=0)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if sum(min(s, mid) for s in sizes) <= room else (low, mid - 1)
    return low


class Model(NamedTuple):
    languages: dict[str, tuple[bytes, float]]  # the dictionary and its share of the labelled texts
    margin: float = 0.0  # a relative lead up to which a text is rejected


def _dictionary(texts: list[list[bytes]]) -> bytes:
    each = _filled([sum(map(len, t)) + len(t) for t in texts], DICT_BYTES)
    return b" ".join(b" ".join(c[: max(1, each // len(t))] for c in t) for t in texts)[:DICT_BYTES]


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Of each language of docs a dictionary and its share of the texts; equal texts count once."""
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(lang).cast("string").alias("lang"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not counts:
        return Model({})
    # One entry for each language; texts whose hash lies in a share of all values are kept.
    most = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1 << 30, (ROWS << 30) // max(1, n)))])
    picked = rows.filter(F.pmod(F.col("h"), F.lit(1 << 30)) < most[F.col("lang")])
    picked = picked.groupBy("lang", "h").agg(F.max(_cuts(F.col("text"))).alias("cuts"))
    texts: dict[str, list[tuple[int, list[str]]]] = {}
    for r in sorted(picked.collect(), key=lambda r: (r["lang"], r["h"], r["cuts"])):
        if any(map(str.isalpha, "".join(r["cuts"]))):
            texts.setdefault(r["lang"], []).append((r["h"] % 2, r["cuts"]))
    share = {name: counts[name] / sum(counts.values()) for name in texts}
    taught = lambda folds: {n: (_dictionary(t), share[n]) for n, x in texts.items() if (t := [[plain(c) for c in cuts] for f, cuts in x if f in folds])}
    known, foreign = [], []
    for fold in (0, 1):
        other = Classifier(Model(taught({1 - fold})))
        for name, text_ in [(n, " ".join(cuts)) for n, x in texts.items() if n in other.names for f, cuts in x if f == fold]:
            found, lead = other.lead(text_)
            known.append((lead, found == name))
            if len(other.names) > 2:
                foreign.append(other.lead(text_, without=name)[1])
    return Model(taught({0, 1}), narrowest(known, foreign))


def narrowest(known: list[tuple[float, bool]], foreign: list[float]) -> float:
    """The margin, from leads of texts of known languages (and whether they were right) and of foreign ones:
    the greatest lead up to which known ones are more often wrong than right; or, if that is more, the
    lead that rejects a share of ``UNSEEN`` of the foreign ones, or the greatest foreign lead below it that rejects
    a share of at most ``LOST`` of the known ones that are right."""
    margin, excess = 0.0, 0
    for lead, equal in groupby(sorted(known), key=lambda x: x[0]):
        excess += sum(-1 if good else 1 for _, good in equal)
        if excess > 0:
            margin = lead
    leads = sorted(lead for lead, good in known if good)
    first_kept = leads[int(LOST * len(leads))] if leads else 0.0
    asked = sorted(foreign)[: math.ceil(UNSEEN * len(foreign))]
    return max([margin, *(lead for lead in asked if lead < first_kept)])


class Classifier:
    def __init__(self, model: Model):
        learned, self.margin = model
        self.names = sorted(learned)
        self.prior = [-math.log2(max(learned[n][1], 1e-6)) for n in self.names]
        self.greedy, self.optimal = ([self.coder(learned[n][0], kind) for n in self.names] for kind in (GREEDY, OPTIMAL))

    @staticmethod
    def coder(dictionary: bytes, kind: dict) -> zstd.ZstdCompressor:
        parameters = zstd.ZstdCompressionParameters(**_FRAME, **kind)
        held = zstd.ZstdCompressionDict(dictionary.ljust(8), dict_type=zstd.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(compression_params=parameters)
        return zstd.ZstdCompressor(compression_params=parameters, dict_data=held)

    def bits(self, coders: list[zstd.ZstdCompressor], blocks: list[bytes]) -> tuple[list[float], list[int]]:
        out = [8 * sum(len(c.compress(x)) for x in blocks) + p for c, p in zip(coders, self.prior, strict=True)]
        return out, sorted(range(len(out)), key=lambda i: (out[i], i))

    def coded(self, text: str, without: str | None = None) -> tuple[list[float], list[int]]:
        b = plain(text)
        blocks = [b[i : i + BLOCK_BYTES] for i in range(0, len(b), BLOCK_BYTES)]
        for coders in (self.greedy, self.optimal):
            bits, order = self.bits(coders, blocks)
            order = [i for i in order if self.names[i] != without]
            if len(order) < 2 or bits[order[1]] - bits[order[0]] >= CLOSE * bits[order[0]] + 32:
                break
        return bits, order

    def lead(self, text: str, without: str | None = None) -> tuple[str, float]:
        """Language and how much longer, in share, the second best code is; one language may be left out."""
        bits, order = self.coded(text, without)
        return self.names[order[0]], (bits[order[1]] - bits[order[0]]) / bits[order[0]] if len(order) > 1 else 1.0

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, rejected."""
        if not text or not self.names or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        bits, order = self.coded(text)
        best = bits[order[0]]
        score = 1 / sum(2.0 ** max(-60.0, (best - x) / 8) for x in bits)
        narrow = len(order) > 1 and bits[order[1]] - best <= self.margin * best
        return self.names[order[0]], score, narrow


def classify(docs: DataFrame, learned: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score, rejected of every row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(learned)

    def run(batches):
        model = Classifier(held.value)
        for batch in batches:
            found = [model(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.bool_())],
                names=["key", "lang_pred", "score", "rejected"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, learned: Model, text: str = "text") -> DataFrame:
    """docs without the rows that are rejected."""
    held = docs.sparkSession.sparkContext.broadcast(learned)

    def keep(batches):
        model = Classifier(held.value)
        for batch in batches:
            yield batch.filter(pa.array([not model(t)[2] for t in batch.column(text).to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def digest(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text", "lang").withColumn("held_out", held_out("doc_id", 4, 2))
    model = learn(docs.filter(~F.col("held_out")))
    out = classify(docs, model).withColumnRenamed("key", "doc_id")
    return out.withColumn("held_out", held_out("doc_id", 4, 2)).select("doc_id", "held_out", "lang_pred", "score", "rejected")
