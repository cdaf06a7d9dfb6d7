"""The corpus operators on small tables: edge cases with a defined result, and brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from functools import cache
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteward.llm import ann, chat, decontam, langid, licenses, neardup, packing, pii, sharding, toxicity

SMALL = Path("/root/testdata/sf0.01")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(t):
    return WORD.findall((t or "").translate(UP))


def docs(spark, texts, lang="en"):
    rows = [(i, t, lang, "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(r, n, vocabulary=600):
    return " ".join("".join(r.choice(["ra", "ne", "to", "si", "mul", "kep", "or"]) for _ in range(r.randint(1, 4))) for _ in range(n))


LONG = "word " * 60_000


# ---- 1 chat ------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    r = random.Random(3)
    bits = ["<|im_end|>", "<|", "<\\|", "<", "|", "\\", "\n", "a", "é😀", "<|im_start|>assistant\n"]
    rows = [(r.choice([1, 2, None]), r.choice([0, 1, None]), r.choice(["assistant", "user", None, "we\nird<|\\n"]), r.choice([None, "".join(r.choices(bits, k=r.randint(0, 9)))])) for _ in range(150)]
    rows += rows[:5]
    out = {x["conv_id"]: x for x in chat.digest(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(out) == 3
    for key, x in out.items():
        turns = sorted((t is not None, t or 0, a or "", b or "") for c, t, a, b in rows if c == key)
        said = "".join(b for _, _, a, b in turns if a == "assistant")
        assert x["n_turns"] == len(turns) and x["loss_chars"] == len(said)
        assert x["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, _, a, b in turns).encode()).hexdigest()
        assert x["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()


def test_chat_takes_ids_of_text_and_long_texts(spark):
    rows = [("a", 0, "user", LONG), ("a", 1, "assistant", "ok"), (None, 0, "assistant", "x"), ("b", 0, "assistant", None)] + [("c", k, "assistant", f"{k};") for k in range(3000)]
    d = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string").withColumn("part", F.lit(1)).withColumn("loss", F.lit("x"))
    out = {x["conv_id"]: x for x in chat.digest(d).collect()}
    assert {k: (x["n_turns"], x["loss_chars"]) for k, x in out.items()} == {"a": (2, 2), None: (1, 1), "b": (1, 0), "c": (3000, sum(len(f"{k};") for k in range(3000)))}
    assert out["c"]["loss_sha256"] == hashlib.sha256("".join(f"{k};" for k in range(3000)).encode()).hexdigest()


def test_chat_empty_table(spark):
    assert chat.digest(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# ---- 2 toxicity --------------------------------------------------------------------------


def test_automaton_finds_one_edit():
    a = toxicity.Automaton({"idiot": (1.0, True), "scum": (1.0, True), "vequ*": (1.0, False)})
    for w, want in {"idiot": ("idiot", 0), "idot": ("idiot", 1), "idiiot": ("idiot", 1), "idoot": ("idiot", 1), "adiot": ("idiot", 1), "idioot": ("idiot", 1), "scun": None, "scum": ("scum", 0), "vequta": ("vequ*", 0), "ideots": None, "": None}.items():
        assert a.match(w) == want, w


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        row, last = [i], row
        for j, e in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != e)))
    return row[-1]


def test_automaton_matches_brute_force():
    r = random.Random(8)
    terms = {"".join(r.choices("abc", k=r.randint(3, 8))): (1.0, True) for _ in range(60)}
    a = toxicity.Automaton(terms)
    for _ in range(4000):
        w = "".join(r.choices("abc", k=r.randint(1, 9)))
        near = [(edits(w, t), t) for t in terms if (w == t) or (len(t) >= toxicity.FUZZY_LENGTH and edits(w, t) <= 1)]
        want = min(near, default=None)
        assert a.match(w) == (want and (want[1], want[0])), w


def test_labels_of_equal_texts_and_empty_tables(spark):
    d = spark.createDataFrame([(k, "same words here") for k in range(6)] + [(9, None)], "doc_id long, text string").withColumn("y", F.lit(3)).withColumn("score", F.lit(1))
    lab = spark.createDataFrame([(k, k % 2) for k in range(6)], "doc_id long, toxic int")
    assert {tuple(x) for x in toxicity.sample(d, lab).collect()} == {(1, "same words here")}
    assert toxicity.digest(d.limit(0), lab).count() == 0
    assert {x["predicted"] for x in toxicity.digest(d, lab.limit(0)).collect()} == {0}


def test_quotation_counts_less():
    score = toxicity.Scorer({"idiot": (1.2, True), "moron": (1.2, True)})
    abuse, quoted = score.evidence("you idiot, what a moron you are")[0], score.evidence('the judge said "idiot" and wrote "moron" in the file')[0]
    assert toxicity.score_of(abuse) >= toxicity.THRESHOLD > toxicity.score_of(quoted)


def test_toxicity_learns_terms_and_takes_edge_rows(spark):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(240):
        bad = i % 4 == 0
        text = prose(r, 40)
        if bad:
            w = text.split()
            for t in r.sample(["zugolf", "zugarn", "zugelt"], 2):
                w.insert(r.randrange(len(w)), t)
            text = " ".join(w)
        rows.append((i, text))
        labels.append((i, 1, int(bad)))
    rows += [(900, None), (901, ""), (902, LONG), (0, rows[0][1])]
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (903, 1, None)], "doc_id long, quality int, toxic int")
    out = toxicity.digest(d, lab).collect()
    assert len(out) == len(rows)
    held = [x for x in out if x["held_out"] and x["doc_id"] < 240]
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 3 == 1) for x in out)
    assert np.mean([x["predicted"] == int(x["doc_id"] % 4 == 0) for x in held]) > 0.95
    assert {x["predicted"] for x in out if x["doc_id"] >= 900} == {0}


# ---- 3 near copies -----------------------------------------------------------------------


def brute_classes(texts):
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words(t)) else set() for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (texts[i] or "") == (texts[j] or "") or (sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_near_copies_match_brute_force(spark):
    r = random.Random(7)
    texts = []
    for _ in range(12):
        base = prose(r, 120).split()
        texts.append(" ".join(base))
        for edits in (0, 1, 2, 4, 12):
            w = list(base)
            for _ in range(edits):
                w[r.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    texts += [None, "", "one two", "One, two!", "!!!", "???", "for " * 500, "for " * 700, LONG, LONG + "end"]
    out = {x["doc_id"]: x for x in neardup.digest(docs(spark, texts)).collect()}
    want = brute_classes(texts)
    assert [out[i]["class_id"] for i in range(len(texts))] == want
    assert sorted(i for i in out if out[i]["kept"]) == sorted(set(want))


def test_large_group_around_a_hub_is_one_class(spark):
    r = random.Random(9)
    base = prose(r, 200).split()
    texts = [" ".join(base)]
    for _ in range(150):
        w = list(base)
        for p in r.sample(range(5, 195), 3):
            w[p] = "".join(r.choices("abcdef", k=8))
        texts.append(" ".join(w))
    want = brute_classes(texts)
    out = {x["doc_id"]: x["class_id"] for x in neardup.digest(docs(spark, texts)).collect()}
    assert [out[i] for i in range(len(texts))] == want and len(set(want)) < 30


def test_large_sketches_are_compared_whole(spark, monkeypatch):
    r = random.Random(21)
    whole = neardup.sketched
    same = F.array(*[F.lit(k).cast("long") for k in range(neardup.SKETCHES)])
    monkeypatch.setattr(neardup, "sketched", lambda *a: whole(*a).withColumn("sketches", same))  # all texts share all sketches
    monkeypatch.setattr(neardup, "BLOCK", 16, raising=False)
    parts = [prose(r, 25) for _ in range(14)]
    texts = []
    for _ in range(60):
        own = sorted(r.sample(range(14), 9))
        texts += [" ".join(parts[p] for p in own), " ".join(parts[p] for p in own if p != own[r.randrange(9)])]
    want = brute_classes(texts)
    out = {x["doc_id"]: x["class_id"] for x in neardup.digest(docs(spark, texts)).collect()}
    assert [out[i] for i in range(len(texts))] == want and 1 < len(set(want)) < 100


def test_dropping_copies_keeps_all_columns_and_one_row(spark):
    d = docs(spark, ["a b c d e f", "a b c d e f", "x y"]).withColumn("node", F.lit(1)).withColumn("row", F.lit(2))
    out = neardup.without_copies(d.union(d)).collect()
    assert sorted(x["doc_id"] for x in out) == [0, 2] and set(out[0].asDict()) == set(d.columns)
    assert neardup.without_copies(d.limit(0)).count() == 0


# ---- 4 licences --------------------------------------------------------------------------


def test_license_places(spark):
    texts = [None, "", "Under the MIT License. under the mit license", "CC-BY-NC and cc by nc cc.by.nc", "Apache License, Version 2.0 x", "GNU General Public License, version 3", "kcc by nc", LONG + "under the MIT license", "SPDX-License-Identifier: BSD-3-Clause"]
    texts += [texts[2]]
    out = sorted(licenses.digest(docs(spark, texts)).collect(), key=lambda x: x["doc_id"])
    phrases = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
    for t, x in zip(texts, out, strict=True):
        w, at, labels = words(t), [], set()
        for label, phrase in phrases.items():
            p = phrase.split()
            found = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            at += found
            labels |= {label} if found else set()
        assert (x["n_words"], x["n_base"], x["first_word"], x["last_word"]) == (len(w), len(at), min(at, default=None), max(at, default=None))
        assert x["base_labels"] == ",".join(sorted(labels)) and labels <= set(x["labels"].split(","))  or not labels
        assert 0 <= x["score"] <= 1
    assert out[5]["labels"] == "gpl-3" and out[8]["labels"] == "bsd-3"


def test_rules_are_many_and_valid():
    table = licenses.rules()
    assert len(table) > 200 and all(re.compile(r[3]) for r in table) and table == sorted(table, key=lambda r: (r[0], r[2], r[3]))


def sampled(r, parsed):
    """A random text that a regex (parsed by ``re``) accepts; looks around it are left out."""
    out = ""
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            out += chr(arg)
        elif op == "NOT_LITERAL":
            out += "w"
        elif op == "IN":
            kind, what = r.choice(arg)
            out += chr(what) if str(kind) == "LITERAL" else chr(r.randint(*what))
        elif op == "BRANCH":
            out += sampled(r, r.choice(arg[1]))
        elif op == "SUBPATTERN":
            out += sampled(r, arg[3])
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            out += "".join(sampled(r, arg[2]) for _ in range(r.randint(arg[0], min(int(arg[1]), 3))))
        else:
            assert op == "ASSERT"
    return out


@cache
def compiled():
    return [(rank, label, re.compile(regex), score) for rank, (_, _, label, regex, score) in enumerate(licenses.rules())]


def ungated(text):
    """Detections (start, end, label, score) in words of all rules in order, none of them gated, without those
    inside the interval of one of higher priority."""
    text, found = f" {text} ", []
    for rank, label, regex, score in compiled():
        for m in regex.finditer(text):
            start = text[: m.start()].count(" ") - 1
            found.append((start, start + m[0].count(" ") + 1, rank, label, score))
    kept = [d for d in found if not any(e[2] < d[2] and e[0] <= d[0] and d[1] <= e[1] for e in found)]
    return sorted((a, b, label, score) for a, b, _, label, score in kept)


def scanned_as_ungated(spark, texts):
    out = {x["key"]: x for x in licenses.scan(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = ungated(" ".join(words(t)))
        x = out[i]
        assert want and sorted((d["start"], d["end"], d["label"], d["score"]) for d in x["detections"] or []) == want, t
        assert x["labels"] == sorted({d[2] for d in want} | set(x["base_labels"])), t
        assert x["score"] == (1.0 if x["base_labels"] else max(d[3] for d in want)), t


def test_every_title_is_found_by_itself(spark):
    r = random.Random(31)
    texts = sorted({"copyright notice " + sampled(r, re._parser.parse(title)) for _, _, title, _ in licenses.NAMES for _ in range(12)})
    scanned_as_ungated(spark, texts)


def test_contained_detections_yield_and_overlapping_stay(spark):
    texts = ["licensed under the gnu general public license version 3", "the mit license apache 2 0", "see GNU General Public License, version 2; and the MIT license. " * 300]
    scanned_as_ungated(spark, texts)
    out = {x["doc_id"]: x["labels"] for x in licenses.digest(docs(spark, [*texts, None, ""])).collect()}
    assert out[0] == "gpl-3" and out[1] == "apache-2,mit" and out[3] == out[4] == ""
    assert licenses.digest(docs(spark, texts).limit(0)).count() == 0
    d = docs(spark, texts[:2]).withColumn("key", F.lit(1)).withColumn("_s", F.lit("x"))
    assert {x["doc_id"]: x["labels"] for x in licenses.digest(d).collect()} == {0: out[0], 1: out[1]}


def test_signatures_hold_their_keyword():
    r = random.Random(33)
    for _, keyword, signature in licenses.SIGNATURES:
        for _ in range(20):
            assert keyword in sampled(r, re._parser.parse(signature)).split(" "), signature


def test_every_rule_is_reached_without_other_words(spark):
    r = random.Random(32)
    texts = ["Released under MPL 2.0", "available for all under the terms of the\nApache 2.0", "released under BSD 3-Clause", "EUPL 1.2", "CDDL 1.0", "SSPL", "ODbL", "WTFPL", "0BSD"]
    texts += ["creative\ncommons zero", "in the public\n domain", "all rights\treserved", "cc\nzero", "cc.by.nc"]
    made = {sampled(r, re._parser.parse(rule[3])) for rule in licenses.rules()}
    texts += sorted("\n".join(t.upper().split(" ")) if len(t) % 2 else t.replace(" ", ", ") for t in made)
    scanned_as_ungated(spark, texts)


# ---- 5 language --------------------------------------------------------------------------


def test_language_of_held_out_rows(spark):
    r = random.Random(11)
    parts = {"aa": ["ra", "ne", "to"], "bb": ["sch", "ung", "zer"], "cc": ["xio", "que", "lla"]}
    rows = [(i, " ".join("".join(r.choices(parts[l], k=r.randint(1, 4))) for _ in range(60)), l) for i in range(240) for l in [r.choice(list(parts))]]
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "123 456", None), (903, LONG, None), (904, "ra ne to " * 20, None)]
    out = {x["doc_id"]: x for x in langid.digest(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    right = [out[i]["lang_pred"] == l for i, _, l in rows[:240] if out[i]["held_out"]]
    assert np.mean(right) > 0.98
    assert [out[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and out[904]["lang_pred"] == "aa"
    assert all(x["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, x in out.items())


def test_language_equals_brute_classification(spark):
    import zstandard as zstd

    r = random.Random(12)
    parts = {"aa": ["ra", "ne", "to"], "bb": ["sch", "ung", "zer"], "cc": ["ra", "ung", "lla"]}
    rows = [(i, " ".join("".join(r.choices(parts[l], k=r.randint(1, 4))) for _ in range(r.randint(1, 80))), l) for i in range(200) for l in [r.choice(list(parts))]]
    d = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, lang string").withColumn("key", F.lit(1)).withColumn("rejected", F.lit("x"))
    model = langid.learn(d)
    out = {x["key"]: x for x in langid.classify(d.drop("key"), model).collect()}
    for i, t, _ in rows:
        bits = {}
        for name, (held, share) in model.languages.items():
            for kind in (langid.GREEDY, langid.OPTIMAL):
                p = zstd.ZstdCompressionParameters(**langid._FRAME, **kind)
                z = zstd.ZstdCompressor(compression_params=p, dict_data=zstd.ZstdCompressionDict(held.ljust(8), dict_type=zstd.DICT_TYPE_RAWCONTENT))
                bits.setdefault(len(bits) % 1 or kind["min_match"], {})[name] = 8 * len(z.compress(langid.plain(t))) - math.log2(share)
        greedy, optimal = bits[4], bits[3]
        a, b = sorted(greedy.values())[:2]
        use = optimal if b - a < langid.CLOSE * a + 32 else greedy
        best = min(use, key=lambda n: (use[n], n))
        a, b = sorted(use.values())[:2]
        assert out[i]["lang_pred"] == best and out[i]["rejected"] == (b - a <= model.margin * a), t
    assert langid.classify(d.drop("key").limit(0), model).count() == 0 == langid.accepted(d.limit(0), model).count()


def test_narrow_margin_is_calibrated():
    known = [(0.2 + i / 1000, True) for i in range(998)] + [(0.05, True)]
    assert langid.narrowest(known, []) == 0.0
    assert langid.narrowest(known, [0.01, 0.15, 0.3]) == 0.15  # one of 999 may go, two may not
    assert langid.narrowest(known, [0.01] * 9 + [0.15]) == 0.01  # nine tenths of the foreign ones are enough
    assert langid.narrowest(known + [(0.001, False)] * 5 + [(0.003, True)] * 9, [0.002, 0.2]) == 0.002
    assert langid.narrowest([(0.3, False), (0.4, False), (0.5, True)], [0.1]) == 0.5  # two of three are wrong
    assert langid.narrowest([], [0.1]) == 0.0


@pytest.mark.skipif(not SMALL.exists(), reason="driver tables are absent")
def test_unseen_languages_are_mostly_rejected_and_known_ones_kept(spark):
    d = spark.read.parquet(str(SMALL / "documents.parquet")).select("doc_id", "text", "lang").withColumn("held", langid.held_out("doc_id", 4, 2))
    taught, asked = d.filter("not held"), d.filter("held and text rlike '[a-z]'")
    rejected, n = 0, 0
    for name in ("de", "en", "es", "fr"):
        out = langid.classify(asked.filter(F.col("lang") == name), langid.learn(taught.filter(F.col("lang") != name)))
        found = out.agg(F.sum(F.col("rejected").cast("long")), F.count("*")).first()
        rejected, n = rejected + found[0], n + found[1]
    model = langid.learn(taught)
    known = langid.classify(asked, model).agg(F.avg(F.col("rejected").cast("double"))).first()[0]
    assert 0 < model.margin and known <= 0.02 and rejected / n >= 0.9, (model.margin, known, rejected / n)
    print("unseen rejected", rejected, n, "known rejected", known, "margin", model.margin)


def test_language_without_labels(spark):
    out = langid.digest(spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")).collect()
    assert out[0]["lang_pred"] == "und" and out[0]["rejected"]


# ---- 6 decontamination -------------------------------------------------------------------


def brute_hits(text, items):
    w, m, found = words(text), set(), set()
    for item, t in items:
        q = words(t)
        n = min(13, len(q))
        for i in range(len(q) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == q[i : i + n]:
                    m.update(range(j, j + n))
                    found.add(str(item))
    return len(w), len(m), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(m) > 0 and 20 * len(m) >= len(w)


@pytest.mark.parametrize("block", [decontam.BLOCK_BYTES, 200])
def test_decontamination_matches_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    r = random.Random(13)
    items = [(i, prose(r, n)) for i, n in enumerate((30, 13, 14, 5, 1, 20))] + [(9, None), (10, ""), (11, "Short, item")]
    items += [(3, items[3][1]), (12, items[0][1])]
    texts = [prose(r, 50) for _ in range(10)] + [None, "", "short item", "x SHORT item y"] + [prose(r, 20) + " " + i[1].upper().replace(" ", ", ") + " " + prose(r, 5) for i in items if i[1]]
    texts += [texts[-1]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = sorted(decontam.digest(docs(spark, texts), bench).collect(), key=lambda x: x["doc_id"])
    for t, x in zip(texts, out, strict=True):
        assert tuple(x)[1:] == brute_hits(t, items)
    kept = {x["doc_id"] for x in decontam.clean(docs(spark, texts), bench, block_bytes=block).collect()}
    assert kept == {x["doc_id"] for x in out if not x["contaminated"]}
    marked = {x["key"]: sum(s["end"] - s["start"] for s in x["spans"]) for x in decontam.mark(docs(spark, texts), bench, block_bytes=block).collect()}
    assert all(marked[x["doc_id"]] == x["n_hit"] for x in out)
    cut = {x["doc_id"]: x["text"] for x in decontam.without_spans(docs(spark, texts), bench).collect()}
    assert cut[12] == "" and len(words(cut[0])) == out[0]["n_words"] - out[0]["n_hit"]


def test_empty_benchmark(spark):
    out = decontam.digest(docs(spark, ["a b", None]), spark.createDataFrame([], "item_id long, text string")).collect()
    assert {(x["n_hit"], x["contaminated"]) for x in out} == {(0, False)}


# ---- 7 personal data ---------------------------------------------------------------------

KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    d = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in d) % 10 == 0


def base_spans(t):
    out = []
    for order, (kind, p) in enumerate(KINDS.items()):
        for m in re.finditer(p, t):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


PII_TEXTS = [
    None, "", "no data", "a@b.c_d@e.f x@y 1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.004", "é😀 +1 (017) 555-7713, 4111 1111 1111 1111; 4111-1111-1111-1112", "é x@y.zz " * 300, "1 11 " * 3000, "a@b" + ".c" * 5000, "1" * 20000,
    "call 555-123-4567, ssn 123-45-6789, order 555-123-4567, tel: 0151 23456789 my number is 030 12345678", 'token = "04dbebab91ab85687d" password=required', "@a.b ++12 +1234567890 1.1.1.1@x.y",
]


def test_pii_base_spans_match_brute_force(spark):
    texts = [*PII_TEXTS, PII_TEXTS[4]]
    out = sorted(pii.digest(docs(spark, texts)).collect(), key=lambda x: x["doc_id"])
    for t, x in zip(texts, out, strict=True):
        want = base_spans(t or "")
        assert x["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (t or "")[:40]
        assert [x[f"n_{k}"] for k in KINDS] == [sum(w.startswith(k + ":") for w in want) for k in KINDS]
        assert set(want) <= set(x["spans"].split(",")) or not want
    assert "tel:5:17" in out[9]["spans"] and "ssn:23:34" in out[9]["spans"] and "tel:42" not in out[9]["spans"]
    assert out[10]["spans"] == "secret:0:27"


def test_pii_added_kinds_and_long_texts(spark):
    texts = ["born on 03.04.1971, passport no. C1234567; version 555-123-4567", "IBAN DE89 3704 0044 0532 0130 00", "released on 03.04.2021 and item C1234567", "log 10.0.0.1 user a@b.cd ok\n" * 20_000]
    out = {x["doc_id"]: x for x in pii.digest(docs(spark, texts)).collect()}
    kinds = lambda i: [x.split(":")[0] for x in out[i]["spans"].split(",") if x]
    assert kinds(0) == ["birth", "identity"] and kinds(1) == ["iban"] and kinds(2) == []
    assert (out[3]["n_ip"], out[3]["n_email"]) == (20_000, 20_000)
    cut = {x["doc_id"]: x["text"] for x in pii.redact(docs(spark, texts)).collect()}
    assert cut[3] == "log [IP] user [EMAIL] ok\n" * 20_000 and cut[2] == texts[2]
    assert pii.digest(docs(spark, texts).limit(0)).count() == 0 == pii.redact(docs(spark, texts).limit(0)).count()


def test_pii_redaction_joins_spans_as_brute_force(spark):
    texts = [t for t in PII_TEXTS if t and len(t) < 20_000] + ["é😀" * 3000 + " a@b.cd +1 (017) 555-7713 4111 1111 1111 1111" + "x" * 5000 + " 1.2.3.4"]
    d = docs(spark, texts)
    spans = {x["doc_id"]: [s.split(":") for s in x["spans"].split(",") if s] for x in pii.digest(d).collect()}
    cut = {x["doc_id"]: x["text"] for x in pii.redact(d).collect()}
    for i, t in enumerate(texts):
        want, at, end = "", 0, -1
        for kind, a, b in ((k, int(a), int(b)) for k, a, b in spans[i]):
            if a >= end:
                want += t[at:a] + f"[{kind.upper()}]"
                end = b
            end = max(end, b)
            at = end
        assert cut[i] == want + t[at:], t[:40]


def test_pii_redaction(spark):
    d = docs(spark, [None, "mail a@b.cd or 1.2.3.4 now", "x"]).withColumn("_t", F.lit("kept")).withColumn("_all", F.lit(1))
    out = {x["doc_id"]: x for x in pii.redact(d).collect()}
    assert [out[i]["text"] for i in range(3)] == [None, "mail [EMAIL] or [IP] now", "x"]
    assert set(out[0].asDict()) == set(d.columns) and out[1]["_t"] == "kept"


# ---- 8 neighbours ------------------------------------------------------------------------


def test_neighbours_recall_and_ties(spark):
    r = np.random.default_rng(17)
    x = r.standard_normal((1500, 24)).astype("f4")
    x[10:60] = x[5]
    rows = [(i, [float(v) for v in x[i]]) for i in range(len(x))]
    rows += [(5000, None), (5100, [0.0] * 24), (5200, [float("nan")] + [1.0] * 23), (5300, [1.0, None] + [1.0] * 22), (5400, [1.0] * 3), (5500, [float("inf")] + [0.0] * 23)]
    out = ann.neighbours_of(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    got = {}
    for a in out:
        got.setdefault(a["query_id"], []).append(a)
    assert sorted(got) == list(range(0, 1500, 100))
    hits = 0
    for q, found in got.items():
        found.sort(key=lambda a: a["rank"])
        d = np.sqrt(((x.astype("f8") - x[q].astype("f8")) ** 2).sum(1))
        assert [a["rank"] for a in found] == list(range(1, 11)) and q not in [a["vec_id"] for a in found]
        assert all(math.isclose(a["score"], d[a["vec_id"]], rel_tol=1e-12, abs_tol=1e-12) for a in found)
        assert [(a["score"], a["vec_id"]) for a in found] == sorted((a["score"], a["vec_id"]) for a in found)
        order = [i for i in np.lexsort((np.arange(len(d)), d)) if i != q][:10]
        hits += len(set(order) & {a["vec_id"] for a in found})
    assert hits >= 0.9 * 150


def clouds():
    r = np.random.default_rng(23)
    lone = r.standard_normal((1200, 16))
    lone[100], lone[200] = 1000, -1000
    far = r.standard_normal((1200, 24))
    far[::2] += 1000
    far[1::2] -= 1000
    return {"outliers": lone, "positive": np.abs(r.standard_normal((1200, 24))) + 5, "two far clouds": far, "long vectors": r.standard_normal((700, 768)) * np.geomspace(1, 0.01, 768)}


@pytest.mark.parametrize("name", ["outliers", "positive", "two far clouds", "long vectors"])
def test_every_query_is_answered_whole(spark, name):
    x = clouds()[name].astype("f4")
    rows = [(i, [float(v) for v in x[i]], "q") for i in range(len(x))]
    out = ann.neighbours_of(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string"), divisor=50).collect()
    got = {}
    for a in out:
        got.setdefault(a["query_id"], set()).add(a["vec_id"])
    hits = 0
    for q in range(0, len(x), 50):
        assert len(got[q]) == 10, q
        d = ((x.astype("f8") - x[q].astype("f8")) ** 2).sum(1)
        hits += len(got[q] & {i for i in np.lexsort((np.arange(len(d)), d))[:11] if i != q})
    assert hits >= 0.9 * 10 * len(range(0, len(x), 50))


def test_short_answers_are_compared_with_all(spark):
    x = np.random.default_rng(3).standard_normal((60, 4))
    nodes = spark.createDataFrame([(i, i % 3, [float(v) for v in x[i]], [i]) for i in range(60)], "id long, part long, v array<double>, ids array<long>")
    asked = spark.createDataFrame([(k,) for k in range(0, 60, 7)], "q long")
    got = {}
    for a in ann.compared_with_all(nodes, asked, 11).collect():
        got.setdefault(a["q"], []).append((a["d"], a["w"]))
    for q, found in got.items():
        d = ((x - x[q]) ** 2).sum(1)
        assert [w for _, w in sorted(found)] == np.lexsort((np.arange(60), d))[:11].tolist()
    assert len(got) == 9


def test_an_id_with_two_vectors_is_named_once(spark):
    rows = [(i, [float(i), 1.0]) for i in range(30)] + [(5, [0.5, 1.0]), (5, [5.0, 1.0])]
    out = ann.neighbours_of(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), divisor=100).collect()
    found = sorted((a["rank"], a["vec_id"]) for a in out)
    assert [v for _, v in found] == [5, 1, 2, 3, 4, 6, 7, 8, 9, 10]


def test_few_vectors_and_copies(spark):
    rows = [(i, [float(i == 0), 1.0]) for i in range(20)] + [(10, [0.0, 1.0])] * 30
    out = sorted(ann.neighbours_of(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), divisor=10).collect(), key=lambda a: (a["query_id"], a["rank"]))
    assert [a["vec_id"] for a in out if a["query_id"] == 10] == [1, 2, 3, 4, 5, 6, 7, 8, 9, 11]
    assert ann.neighbours_of(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# ---- 9 packing ---------------------------------------------------------------------------


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(19)
    texts = [None, "", "a <|endoftext|> b", "x" * 5000, " " * 3000, "é😀\n\n  naïve 123", LONG] + [prose(r, r.randint(1, 900)) for _ in range(60)]
    texts += [texts[-1]]
    rows = packing.digest(docs(spark, texts)).collect()
    by_doc, by_seq = {}, {}
    for x in rows:
        by_doc.setdefault(x["doc_id"], []).append(x)
        by_seq.setdefault(x["sequence_id"], []).append(x)
    for i, text in enumerate(texts):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for x in sorted(by_doc[i], key=lambda x: x["start"]):
            assert x["start"] == at and x["doc_tokens"] == len(ids) and x["ids_crc32"] == zlib.crc32(ids[at : at + x["length"]].tobytes())
            at += x["length"]
        assert at == len(ids)
    for parts in by_seq.values():
        at = 0
        for x in sorted(parts, key=lambda x: x["offset"]):
            assert x["offset"] == at
            at += x["length"]
        assert at <= 1024
    assert sum(x["length"] for x in rows) / (1024 * len(by_seq)) > 0.97
    full = packing.sequences(docs(spark, texts[:3])).collect()
    assert all(len(x["ids"]) == 1024 for x in full) and packing.digest(docs(spark, texts).limit(0)).count() == 0


def test_best_fit_takes_the_tightest_window():
    r = random.Random(23)
    lengths = sorted((r.randint(1, 100) for _ in range(400)), reverse=True)
    numbers, offsets = packing.best_fit(lengths, 100)
    rooms = []
    for n, number, offset in zip(lengths, numbers, offsets, strict=True):
        fits = [x for x in rooms if x >= n]
        if number == len(rooms):
            assert not fits
            rooms.append(100)
        assert rooms[number] == 100 - offset and rooms[number] >= n and (not fits or rooms[number] == min(fits))
        rooms[number] -= n


# ---- 10 sharding -------------------------------------------------------------------------


def test_shards_are_even_and_reproducible(spark):
    texts = [None, "", "é😀", *["same"] * 400, *[str(i) for i in range(300)]]
    d = docs(spark, texts).withColumn("k", F.lit(1)).withColumn("bucket", F.lit("x"))
    d = d.union(d.filter("doc_id = 5")).union(d.filter("doc_id = 5"))
    out = sharding.digest(d).collect()
    assert len(out) == len(texts) + 2
    slots = {}
    for x in out:
        t = texts[x["doc_id"]] or ""
        assert (x["size"], x["text_crc32"], x["law"]) == (len(t.encode()) + 16, zlib.crc32(t.encode()), "rows")
        slots.setdefault(x["shard"], []).append(x["slot"])
    assert sorted(slots) == list(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    key = lambda rows: sorted((x["doc_id"], x["shard"], x["slot"]) for x in rows)
    assert key(sharding.digest(d.repartition(7)).collect()) == key(out)
    assert sharding.digest(d.limit(0)).count() == 0


@pytest.mark.parametrize("total", [1, 2, 3, 10, 97, 1000])
def test_permutation_is_a_bijection(spark, total):
    out = [r[0] for r in spark.range(total).select(sharding.permuted(F.col("id"), total, 7)).collect()]
    assert sorted(out) == list(range(total))


def test_a_row_repeated_a_million_times_is_dealt(spark):
    d = spark.range(1_000_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same").alias("text")).union(docs(spark, [LONG, None]).select("doc_id", "text"))
    out = sharding.digest(d).groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("slots"), F.max("slot").alias("last")).collect()
    assert len(out) == 40 and sum(x["n"] for x in out) == 1_000_002
    assert all(x["n"] == x["slots"] == x["last"] + 1 for x in out) and max(x["n"] for x in out) - min(x["n"] for x in out) <= 1
