"""Toxicity: a lexicon learned from labels, matched by Levenshtein automata on its trie.

Terms are words, and word beginnings (written ``vequ*``), that occur in toxic texts in several
different contexts and almost never in clean ones; a short list of plain English insults is
always held.  The trie of terms is intersected with the automata of up to one edit; the product
is determinised while it runs, so a word costs a few table steps.  A hit counts by how it was
found (exact, beginning, misspelled), by the odds of its term in the labels, and by its context window: inside quotation marks or after a
reporting verb less, next to second-person words more.

Labels are learned from at most about ``TOXIC_ROWS`` toxic and ``CLEAN_ROWS`` clean labelled
documents (a documented bound), equal texts once: toxic if one of them is labelled so.  All terms
that qualify in them are held.  Defined results: null and empty texts score
``score_of(0)``; a null label teaches nothing; an empty table gives no rows; without labels the plain list alone counts;
repeated rows get equal scores; other columns play no part.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteward.llm.io import stored
from siteward.llm.langid import held_out

TOXIC_ROWS = 3000
CLEAN_ROWS = 6000
RATIO = 25.0
STEMS = (4, 5, 6)
THRESHOLD = 0.7
FUZZY_LENGTH = 5
FUZZY_WEIGHT = 0.7
PLAIN_WEIGHT = 1.2
#: Plain English insults that are held without labels.
INSULTS = "idiot moron stupid scum loser trash pathetic worthless disgusting clown imbecile dumbass bastard".split()
REPORTING = "said says say wrote writes quoted quote quotes called tweeted replied reported shouted".split()
SECOND_PERSON = "you your yours yourself u ur youre".split()
_WORD = re.compile(r"[^\W_]+")
_OPEN, _CLOSE = "\"“«„‘", "\"”»“’"
WINDOW_CHARS = 60


class Automaton:
    """Trie of terms x Levenshtein automaton of one edit, determinised lazily."""

    def __init__(self, terms: dict[str, tuple[float, bool]]):
        """terms: a weight, and whether a term also matches misspelled; ``x*`` matches words that begin with x."""
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[tuple[str, bool] | None] = [None]
        self.stems: list[str | None] = [None]
        for term, (_, fuzzy) in sorted(terms.items()):
            node = 0
            for c in term.rstrip("*"):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                    self.stems.append(None)
                node = self.children[node][c]
            if term.endswith("*"):
                self.stems[node] = term
            else:
                self.ends[node] = (term, fuzzy and len(term) >= FUZZY_LENGTH)
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.result: list[tuple[str, int] | None] = []
        self.stem: list[str | None] = []
        self.start = self.state(frozenset({(0, 0)}))

    def state(self, nodes: frozenset) -> int:
        open_ = [x for x in nodes if x[1] == 0]
        full = nodes | {(child, 1) for n, _ in open_ for child in self.children[n].values()}  # a letter left out
        full = frozenset(x for x in full if not (x[1] and (x[0], 0) in full))
        if full not in self.states:
            self.states[full] = len(self.sets)
            self.sets.append(full)
            self.steps.append({})
            found = sorted((e, self.ends[n][0]) for n, e in full if self.ends[n] and (not e or self.ends[n][1]))
            self.result.append((found[0][1], found[0][0]) if found else None)
            self.stem.append(next((self.stems[n] for n, e in sorted(full) if not e and self.stems[n]), None))
        return self.states[full]

    def step(self, s: int, c: str) -> int:
        out = set()
        for n, e in self.sets[s]:
            if c in self.children[n]:
                out.add((self.children[n][c], e))
            if not e:
                out.add((n, 1))  # a letter too many
                out.update((child, 1) for child in self.children[n].values())  # another letter
        t = self.state(frozenset(out)) if out else -1
        self.steps[s][c] = t
        return t

    def match(self, word: str) -> tuple[str, int] | None:
        """(term, edits) of the best term for a word; an exact term goes before a beginning."""
        s, stem = self.start, None
        for c in word:
            t = self.steps[s].get(c)
            s = self.step(s, c) if t is None else t
            if s < 0:
                return (stem, 0) if stem else None
            stem = self.stem[s] or stem
        found = self.result[s]
        if found and (not found[1] or not stem):
            return found
        return (stem, 0) if stem else None


def score_of(evidence: float) -> float:
    return 1 / (1 + math.exp(-3 * (evidence - 1.35)))


def context(text: str, start: int, end: int) -> float:
    """What a hit counts in its window of characters."""
    before, after = text[max(0, start - WINDOW_CHARS) : start], text[end : end + WINDOW_CHARS]
    quoted = any((before.count(o) % 2 == 1 if o == c else before.rfind(o) > before.rfind(c)) and c in after for o, c in zip(_OPEN, _CLOSE, strict=True))
    words = _WORD.findall(before)[-4:]
    factor = 1.0
    if quoted:
        factor *= 0.4
    if any(w in REPORTING for w in words):
        factor *= 0.7
    if any(w in SECOND_PERSON for w in words[-3:] + _WORD.findall(after)[:3]):
        factor *= 1.3
    return factor


class Scorer:
    def __init__(self, terms: dict[str, tuple[float, bool]]):
        self.automaton = Automaton(terms)
        self.terms = terms
        self.seen: set[str] = set()
        self.hits: dict[str, tuple[str, int]] = {}

    def matches(self, words: set[str]) -> dict[str, tuple[str, int]]:
        """Words that hit a term; what is known of words is kept, within a bound."""
        if len(self.seen) > 400_000:
            self.seen, self.hits = set(), {}
        new = words - self.seen
        match = self.automaton.match
        for w in new:
            if m := match(w):
                self.hits[w] = m
        self.seen |= new
        hits = self.hits
        return {w: hits[w] for w in words if w in hits} if hits else {}

    def evidence(self, text: str | None) -> tuple[float, int]:
        if not text:
            return 0.0, 0
        low = text.lower()
        found = self.matches(set(_WORD.findall(low)))
        if not found:
            return 0.0, 0
        best: dict[str, float] = {}
        n, more = 0, 0.0
        pattern = re.compile(r"(?<![^\W_])(?:" + "|".join(sorted(map(re.escape, found), key=len, reverse=True)) + r")(?![^\W_])")
        for m in pattern.finditer(low):
            word = m[0]
            term, edits = found[word]
            weight = self.terms[term][0] * context(low, m.start(), m.end()) * (FUZZY_WEIGHT if edits else 1.0)
            n += 1
            if word in best:
                more += 0.3 * weight
            best[word] = max(best.get(word, 0.0), weight)
        return sum(best.values()) + min(1.0, more), n


def _rows_by_hash(rows: DataFrame, key: str, most: int):
    n = rows.count()
    return rows.filter(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(min(1.0, most / max(n, 1)) * (1 << 30)))


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """y and text of the bounded sample of labelled rows that are not held out, equal texts once."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", 3, 1))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("y"))
    picked = _rows_by_hash(known.filter("y = 1"), "doc_id", TOXIC_ROWS).union(_rows_by_hash(known.filter("y = 0"), "doc_id", CLEAN_ROWS))
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(picked), "doc_id")
    return rows.groupBy("text").agg(F.max("y").alias("y")).select("y", "text")


def learn(docs: DataFrame, labels: DataFrame) -> dict[str, tuple[float, bool]]:
    """Terms: the weight of each, and whether it may be matched misspelled."""
    rows = stored(sample(docs, labels))
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    terms = dict.fromkeys(INSULTS, (PLAIN_WEIGHT, True))

    def count(batches):
        for batch in batches:
            # Toxic texts also by (word, neighbour) and (beginning, word), so that copies of one text give few.
            contexts: set[tuple[str, int]] = set()
            docs_with: tuple[Counter, Counter] = (Counter(), Counter())
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = [w if 3 <= len(w) <= 40 else "" for w in _WORD.findall(t.lower())]
                own = set(words) - {""}
                own.update([w[:k] + "*" for w in own for k in STEMS if k < len(w)])
                docs_with[y].update(own)
                if y:
                    for before, w in zip(["", *words], words):
                        if w:
                            contexts.add((w, crc32(before.encode())))
                            whole = crc32(w.encode())
                            contexts.update([(w[:k] + "*", whole) for k in STEMS if k < len(w)])
            clean_, toxic_ = docs_with
            terms_ = [t for t, _ in contexts] + list(toxic_) + list(clean_)
            n = len(contexts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(terms_, pa.string()), pa.array([c for _, c in contexts] + [None] * (len(toxic_) + len(clean_)), pa.int64()),
                    pa.array([0] * n + list(toxic_.values()) + [0] * len(clean_), pa.int64()), pa.array([0] * (n + len(toxic_)) + list(clean_.values()), pa.int64()),
                ],
                names=["term", "context", "toxic", "clean"],
            )

    if toxic and clean:
        found = rows.mapInArrow(count, "term string, context long, toxic long, clean long")
        found = found.groupBy("term", "context").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        found = found.groupBy("term").agg(F.count("context").alias("contexts"), F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        ratio = ((F.col("toxic") + 0.25) / (toxic + 0.5)) / ((F.col("clean") + 0.25) / (clean + 0.5))
        least = max(3 if toxic >= 100 else 2, int(0.004 * toxic))
        begun = F.endswith("term", F.lit("*"))
        whole = ~begun & (ratio >= RATIO) & (F.col("contexts") >= F.greatest(F.lit(least), F.col("toxic") * 0.5))
        begun = begun & (ratio >= 4 * RATIO) & (F.col("toxic") >= 2 * least) & (F.col("contexts") >= 3)
        weight = F.least(F.lit(1.8), F.greatest(F.lit(0.6), (F.log(ratio) - 3) / 2))
        found = found.filter((F.col("toxic") >= least) & (whole | begun))  # terms of the bounded sample alone
        terms |= {r["term"]: (r["weight"], not r["term"].endswith("*")) for r in found.withColumn("weight", weight).collect()}
    # Terms that clean texts hold misspelled are matched exactly alone.
    held = rows.sparkSession.sparkContext.broadcast(terms)

    def misspelled(batches):
        scorer = Scorer(held.value)
        for batch in batches:
            n: Counter = Counter()
            for t in batch.column(1).to_pylist():
                n.update({term for term, edits in scorer.matches(set(_WORD.findall(t.lower()))).values() if edits})
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["term", "n"])

    if clean:
        common = rows.filter("y = 0").mapInArrow(misspelled, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
        for r in common.filter(F.col("n") > max(1, int(0.0005 * clean))).collect():  # at most one row a term
            terms[r["term"]] = (terms[r["term"]][0], False)
    return terms


def scored(docs: DataFrame, terms: dict[str, tuple[float, bool]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score, hits of every row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        scorer = Scorer(held.value)
        for batch in batches:
            found = [scorer.evidence(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([score_of(e) for e, _ in found], pa.float64()), pa.array([n for _, n in found], pa.int64())], names=["key", "score", "hits"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, score double, hits long")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    out = scored(docs, learn(docs, labels)).withColumnRenamed("key", "doc_id")
    return out.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "hits")
