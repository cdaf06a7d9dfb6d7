"""License scans: ordered signature rules behind a keyword prefilter, DataFrame functions only.

A text is lower-cased (A-Z) and cut into words; rules are regexes over the words joined by
single spaces: hand-written signatures of licence texts and notices (``signatures``), and the titles and
identifiers of licences in the phrases of ``TEMPLATES``.  A document is looked at by the rules only if it
passes ``GATE``, which every match of a rule does, and a rule only if its keyword, which every match
holds, is one of the document's words.

A detection is an interval of words with the priority of its rule.  One that lies inside the interval of a
detection of higher priority is suppressed; of equal intervals the higher priority stays; detections that
overlap in part both stay.  No shuffle, no Python on the executors, time linear in the text and its detections.

Defined results: a null or empty text has no words, no detections and score 0; repeated rows each
get their own result; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteward.llm.io import ascii_lower
from siteward.llm.signatures import SIGNATURES
from siteward.llm.spans import each, highest, let, matches, text as quoted, those

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
V = r"(?: version| v| ver)? ?v?"
L = r"licen[cs]e"
CC = r"(?:cc|creative commons)"
#: (label, keyword, title, identifier): fixed names of public licences, as regexes over words.
#: Every match of the title holds the keyword, or one of several, as a whole word.
NAMES = (
    ("mit", "mit|expat", rf"(?:mit|expat) {L}", r"mit"),
    ("mit-0", "mit", rf"mit no attribution(?: {L})?", r"mit 0"),
    ("x11", "x11", rf"x11 {L}", r"x11"),
    ("apache-2", "apache", rf"apache(?: software)? {L}{V}2(?: 0)?", r"apache 2(?: 0)?"),
    ("apache-1.1", "apache", rf"apache(?: software)? {L}{V}1 1", r"apache 1 1"),
    ("apache", "apache", rf"apache(?: software)? {L}", r"apache"),
    ("gpl-2", "gnu", rf"gnu (?:general public {L}|gpl){V}2(?: 0)?", r"gpl v?2(?: 0)?(?: only| or later)?"),
    ("gpl-3", "gnu", rf"gnu (?:general public {L}|gpl){V}3(?: 0)?", r"gpl v?3(?: 0)?(?: only| or later)?"),
    ("gpl", "gnu", rf"gnu (?:general public {L}|gpl)", r"gpl"),
    ("lgpl-2.1", "gnu", rf"gnu (?:(?:lesser|library) general public {L}|lgpl){V}2(?: 1| 0)?", r"lgpl v?2(?: 1| 0)?(?: only| or later)?"),
    ("lgpl-3", "gnu", rf"gnu (?:lesser general public {L}|lgpl){V}3(?: 0)?", r"lgpl v?3(?: 0)?(?: only| or later)?"),
    ("lgpl", "gnu", rf"gnu (?:(?:lesser|library) general public {L}|lgpl)", r"lgpl"),
    ("agpl-3", "gnu", rf"gnu (?:affero general public {L}|agpl){V}3(?: 0)?", r"agpl v?3(?: 0)?(?: only| or later)?"),
    ("agpl", "gnu", rf"gnu (?:affero general public {L}|agpl)", r"agpl"),
    ("gfdl", "gnu", rf"gnu free documentation {L}(?:{V}1 [1-3])?", r"gfdl(?: 1 [1-3])?"),
    ("bsd-2", "bsd|freebsd", rf"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd) {L}", r"bsd 2 clause"),
    ("bsd-3", "bsd", rf"(?:bsd 3 clause|3 clause bsd|new bsd|revised bsd|modified bsd) {L}", r"bsd 3 clause"),
    ("bsd-4", "bsd", rf"(?:bsd 4 clause|4 clause bsd|original bsd) {L}", r"bsd 4 clause"),
    ("bsd-0", "bsd|0bsd", rf"(?:bsd zero clause|zero clause bsd|0bsd) {L}", r"0bsd"),
    ("bsd", "bsd", rf"bsd(?: style)? {L}", r"bsd"),
    ("mpl-2", "mozilla", rf"mozilla public {L}{V}2(?: 0)?", r"mpl v?2(?: 0)?"),
    ("mpl-1.1", "mozilla", rf"mozilla public {L}{V}1 1", r"mpl v?1 1"),
    ("mpl", "mozilla", rf"mozilla public {L}", r"mpl"),
    ("epl-2", "eclipse", rf"eclipse public {L}{V}2(?: 0)?", r"epl 2(?: 0)?"),
    ("epl-1", "eclipse", rf"eclipse public {L}{V}1(?: 0)?", r"epl 1(?: 0)?"),
    ("epl", "eclipse", rf"eclipse public {L}", r"epl"),
    ("cddl", "distribution", rf"common development and distribution {L}", r"cddl(?: 1 [01])?"),
    ("cpl", "common", rf"common public {L}", r"cpl(?: 1 0)?"),
    ("isc", "isc", rf"isc {L}", r"isc"),
    ("unlicense", "unlicense", r"the unlicense", r"unlicense"),
    ("zlib", "zlib", rf"zlib(?: libpng)? {L}", r"zlib"),
    ("libpng", "libpng", rf"libpng {L}", r"libpng"),
    ("bsl", "boost", rf"boost software {L}", r"bsl 1 0"),
    ("busl", "business", rf"business source {L}", r"busl 1 1"),
    ("sspl", "side", rf"server side public {L}", r"sspl(?: 1 0)?"),
    ("artistic-2", "artistic", rf"artistic {L}{V}2(?: 0)?", r"artistic 2(?: 0)?"),
    ("artistic", "artistic", rf"artistic {L}", r"artistic"),
    ("eupl", "union", rf"european union public {L}", r"eupl(?: 1 [12])?"),
    ("ofl", "font", rf"(?:sil )?open font {L}", r"ofl(?: 1 1)?"),
    ("odbl", "database", rf"open (?:data commons open )?database {L}", r"odbl(?: 1 0)?"),
    ("python", "python", rf"python software foundation {L}", r"psf(?: 2 0)?"),
    ("php", "php", rf"php {L}", r"php 3 0"),
    ("openssl", "openssl", rf"openssl {L}", r"openssl"),
    ("wtfpl", "fuck", r"do what the fuck you want to public licen[cs]e", r"wtfpl"),
    ("postgresql", "postgresql", rf"postgresql {L}", r"postgresql"),
    ("ncsa", "ncsa", rf"(?:university of illinois )?ncsa(?: open source)? {L}", r"ncsa"),
    ("cc0", "zero|cc0", rf"(?:{CC} zero|cc0)(?: 1 0)?(?: universal)?", r"cc0(?: 1 0)?"),
    ("cc-by", "attribution", rf"creative commons attribution(?: [1-4] [05])?(?: international| generic| unported)?(?: {L})?", r"cc by [1-4] [05]"),
    ("cc-by-sa", "attribution", rf"creative commons attribution share ?alike(?: [1-4] [05])?", r"cc by sa(?: [1-4] [05])?"),
    ("cc-by-nd", "attribution", r"creative commons attribution no ?deriv(?:s|atives)(?: [1-4] [05])?", r"cc by nd(?: [1-4] [05])?"),
    ("cc-by-nc", "attribution", r"creative commons attribution non ?commercial(?: [1-4] [05])?", r"cc by nc(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "attribution", r"creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?", r"cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "attribution", r"creative commons attribution non ?commercial no ?deriv(?:s|atives)(?: [1-4] [05])?", r"cc by nc nd(?: [1-4] [05])?"),
    ("public-domain", "public", r"(?:in|into|to) the public domain", r"public domain"),
    ("proprietary", "reserved", r"all rights reserved", r"proprietary"),
)
GRANT = r"(?:licensed|released|distributed|available|provided|covered|governed|published|shared|offered)(?: [a-z]+){0,3} (?:under|by)(?: the)?(?: terms of)?(?: the)? "
#: Each name gives a rule by each template: (priority, score, template of title t or identifier i, keyword:
#: a word, or None for the name's own, or "" for the first word of its identifier, which the rule can't do without).
TEMPLATES = (
    (10, 1.0, "spdx license identifier {i}", "spdx"),
    (20, 0.95, GRANT + "{t}", None),
    (25, 0.9, GRANT + "{i}(?: licen[cs]e)?", ""),
    (30, 0.9, "(?:opensource|gnu|apache|creativecommons) org licenses {i}", ""),
    (40, 0.8, "{t}", None),
    (50, 0.7, "(?:{i} licen[cs]e|licen[cs]e {i})", ""),
)


#: Labels whose identifiers stand for one licence wherever they are written.
BARE = ("gpl-", "lgpl", "agpl", "cc-by", "mpl-", "bsd-", "cc0", "cddl", "eupl", "odbl", "sspl", "wtfpl")


def first_word(name: str) -> str:
    return name.split(" ")[0].split("(")[0]


def by_letter(words: set[str]) -> str:
    """The words as one regex, branched at the first letter."""
    letters = sorted({w[0] for w in words})
    return "|".join(c + "(?:" + "|".join(sorted(re.escape(w[1:]) for w in words if w[0] == c)) + ")" for c in letters)


def _needs(signature: str) -> str:
    """What is left of a signature without its optional parts."""
    before = None
    while before != signature:
        before, signature = signature, re.sub(r"\((?:\?:)?[^()]*\)(?:\?|\{0,\d+\}\??)", "", signature)
    return signature


#: What every match of any rule holds: one of the parts, or else the regex (over a text as it is, whatever stands
#: between its words): a bare identifier's first word, a title without "licen", a grant's end and an identifier's
#: first word, or the keyword of a signature without "licen".
GATE_PARTS = ("licen", "spdx", "attribution", "gpl")
GATE_WORDS = {first_word(n) for label, _, _, n in NAMES if label.startswith(BARE)} | {k for _, k, r in SIGNATURES if "|" in _needs(r) or not any(p in _needs(r) for p in GATE_PARTS)}
GATE = (
    f"(?<!{WORD[:-1]})(?:"
    + by_letter(GATE_WORDS)
    + f"|commons{BREAK}zero|public{BREAK}domain|rights{BREAK}reserved"
    + f"|(?:under|by)(?:{BREAK}the)?(?:{BREAK}terms{BREAK}of)?(?:{BREAK}the)?{BREAK}(?:"
    + by_letter({first_word(n) for _, _, _, n in NAMES})
    + f"))(?!{WORD[:-1]})"
)


def rules() -> list[tuple[int, str, str, str, float]]:
    """(priority, keyword, label, regex, score), the highest priority first."""
    shaped = lambda r: f"(?<= )(?:{r})(?= )"
    out = [(15_000 - min(4999, 10 * len(r)), k, label, shaped(r), 0.97) for label, k, r in SIGNATURES]
    for label, word, title, name in NAMES:
        first = first_word(name)
        specific = 0 if any(c.isdigit() for c in label) or label.count("-") > 1 else 1
        for priority, score, shape, keyword in TEMPLATES:
            regex = shape.replace("{t}", title).replace("{i}", name)
            out.append((priority * 1000 + specific * 500 - min(499, len(title)), word if keyword is None else keyword or first, label, shaped(regex), score))
        if label.startswith(BARE):
            out.append((60_000 + specific * 500 - min(499, len(name)), first, label, shaped(name), 0.6))
    return sorted(out, key=lambda r: (r[0], r[2], r[3]))


def _count_words(spaced: Column) -> Column:
    """Words of a text in which each word stands between two spaces of its own."""
    return ((F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit("")))) / 2).cast("long")


def _detections(body: str, rule: str) -> str:
    """Intervals of words of a rule's matches, with its rank, label and score."""
    spaces = lambda x: f"cast(length({x}) - length(replace({x}, ' ', '')) AS BIGINT)"

    def made(start: str, end: str, match: str, gap: str) -> str:
        return f"named_struct('start', {start}, 'back', -({end}), 'rank', {rule}.rank, 'end', {end}, 'label', {rule}.label, 'score', {rule}.score)"

    return matches(body, f"{rule}.regex", lambda g: f"({spaces(g)} - 1L)", lambda m: f"({spaces(m)} + 1L)", made)


def _kept(found: str, ranks: str) -> str:
    """Detections outside the intervals of those of higher priority: for each rule the furthest end of what
    starts no later and ranks before it."""

    def of_rank(every: str, rank: str) -> str:
        ends = each(every, lambda d, _: f"CASE WHEN {d}.rank < {rank} THEN {d}.end ELSE -1L END")
        return let(highest(ends), lambda most: those(every, lambda d, i: f"{d}.rank = {rank} AND get({most}, {i}) < {d}.end"))

    return let(f"array_sort({found})", lambda every: f"array_sort(flatten({each(ranks, lambda r, _: of_rank(every, r))}))")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels (arrays), score, and detections: an
    array of (start, end, label, score) of words."""
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    text = "text"
    table = rules()
    words = sorted({w for r in table for w in r[1].split("|")})
    body = F.coalesce(F.col(text), F.lit(""))

    def passes(low: Column) -> Column:
        gate = F.lit(False)
        for part in GATE_PARTS:
            gate = gate | F.contains(low, F.lit(part))
        return gate | F.rlike(low, F.lit(GATE))

    # Bound to a variable, so that a text is lower-cased once for the whole gate.
    gate = F.exists(F.array(F.lower(body)), passes)
    trimmed = F.trim(F.regexp_replace(ascii_lower(F.col(text)), BREAK, "  "))
    spaced = F.when(gate & (trimmed != ""), F.concat(F.lit(" "), trimmed, F.lit(" "))).otherwise(F.lit(""))
    out = docs.withColumn("_n", F.regexp_count(body, F.lit(WORD)).cast("long")).withColumn("_s", spaced)
    struct = []
    for label, phrase in BASE:
        p = F.lit(" " + "  ".join(phrase.split(" ")) + " ")
        there = F.contains("_s", p)
        n = F.when(there, ((F.length("_s") - F.length(F.replace(F.col("_s"), p, F.lit("")))) / F.length(p)).cast("long")).otherwise(F.lit(0))
        first = F.when(there, _count_words(F.substring_index("_s", " " + "  ".join(phrase.split(" ")) + " ", 1)))
        after = _count_words(F.substring_index("_s", " " + "  ".join(phrase.split(" ")) + " ", -1))
        last = F.when(there, F.col("_n") - after - len(phrase.split(" ")))
        struct.append(F.struct(F.lit(label).alias("label"), n.alias("n"), first.alias("first"), last.alias("last")))
    out = out.withColumn("_b", F.when(F.col("_s") != "", F.filter(F.array(*struct), lambda b: b["n"] > 0)))
    one = F.replace(F.col("_s"), F.lit("  "), F.lit(" "))
    words_of = lambda ws: "array(" + ", ".join(map(quoted, ws.split("|"))) + ")"
    held = "array(" + ", ".join(f"named_struct('rank', {n}, 'words', {words_of(ws)}, 'label', {quoted(label)}, 'regex', {quoted(x)}, 'score', {s}D)" for n, (_, ws, label, x, s) in enumerate(table)) + ")"
    out = out.withColumn("_one", one)
    out = out.withColumn("_k", F.when(F.col("_s") != "", F.array_distinct(F.regexp_extract_all("_one", F.lit("(?<= )(" + by_letter(set(words)) + ")(?= )"), F.lit(1)))))
    gated = those(held, lambda r, _: f"arrays_overlap({r}.words, _k) AND rlike(_one, {r}.regex)")
    found = F.expr(let(gated, lambda own: _kept(f"flatten({each(own, lambda r, _: _detections('_one', r))})", each(own, lambda r, _: f"{r}.rank"))))
    out = out.withColumn("_f", F.when(F.size("_k") > 0, found))
    none = F.array().cast("array<string>")
    base = F.coalesce(F.array_sort(F.transform("_b", lambda b: b["label"])), none)
    out = out.withColumn("_base", base)
    return out.select(
        "key",
        F.col("_n").alias("n_words"),
        F.coalesce(F.aggregate("_b", F.lit(0).cast("long"), lambda a, b: a + b["n"]), F.lit(0)).alias("n_base"),
        F.array_min(F.transform("_b", lambda b: b["first"])).alias("first_word"),
        F.array_max(F.transform("_b", lambda b: b["last"])).alias("last_word"),
        F.col("_base").alias("base_labels"),
        F.array_sort(F.array_union("_base", F.coalesce(F.transform("_f", lambda d: d["label"]), none))).alias("labels"),
        F.when(F.size("_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("_f", lambda d: d["score"])), F.lit(0.0))).alias("score"),
        F.transform("_f", lambda d: F.struct(d["start"].alias("start"), d["end"].alias("end"), d["label"].alias("label"), d["score"].alias("score"))).alias("detections"),
    )


def digest(docs: DataFrame) -> DataFrame:
    out = scan(docs).withColumnRenamed("key", "doc_id")
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )
