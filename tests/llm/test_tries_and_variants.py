"""Prefix trie, SimHash components and spelling variants against brute force, and on edge rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from siteward.llm import simhash, spelling, trie

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TURNS = "conv_id long, turn long, role string, text string"


def docs(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "s", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, word string, fp int").withColumn("comp", F.lit("x"))


# ---- 11 prefix trie ----------------------------------------------------------------------


def all_nodes(rows):
    """Every node by plain loops over all prefixes."""
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        family = int(np.fix(c / 20)) * 20
        paths[c] = tuple(own.get(family, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    out = set()
    for p, cs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        children = [q for q in below if len(q) == len(p) + 1]
        leaves = sum(not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in below) for q in below)
        saved = sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in cs if paths[c] == p)))
        out.add((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def nodes_of(spark, rows, limit=trie.LIMIT):
    d = spark.createDataFrame(rows, TURNS).withColumn("depth", F.lit("x")).withColumn("n1", F.lit(3))
    paths, convs = trie.rebuilt(d)
    out = trie.prefix_trie(paths, convs, limit).select(*trie._COLUMNS).collect()
    assert len({tuple(x) for x in out}) == len(out)
    return {tuple(x) for x in out}


def many_turns(seed):
    r = random.Random(seed)
    rows = []
    for c in [*r.sample(range(-30, 90), 40), None]:
        for _ in range(r.randint(1, 7)):
            rows.append((c, r.choice([0, 1, 2, 3, None]), r.choice(["user", "assistant", None]), r.choice(["a", "a b", None, "", "é\t ü\n"])))
    return rows + rows[:9]


@pytest.mark.parametrize("limit", [5, 4096])
def test_trie_matches_brute_force(spark, limit):
    rows = many_turns(limit)
    assert nodes_of(spark, rows, limit) == all_nodes(rows)


def test_trie_of_copies_prefixes_and_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 8)
    monkeypatch.setattr(trie, "PIECE", 3)
    long = [(200 + k, t, "user", "same words" if t < 30 else f"other {k}") for k in range(3) for t in range(40)]
    copies = [(400 + k, t, "user", "hello there") for k in range(25) for t in range(3)]
    steps = [(500 + k, t, "user", "step") for k in range(12) for t in range(k + 1)]
    rows = long + copies + steps + [(900, 0, "user", "only")] * 20
    want = all_nodes(rows)
    for limit in (6, 40):
        assert nodes_of(spark, rows, limit) == want


def test_trie_of_nothing_and_of_a_single_row(spark):
    assert nodes_of(spark, []) == set()
    assert nodes_of(spark, [(None, 0, "user", "x")]) == set()
    rows = [(c, 0, "user", "word " * 50_000) for c in range(21, 27)]
    assert nodes_of(spark, rows) == all_nodes(rows)


def test_names_that_meet_are_an_error(spark):
    with pytest.raises(ValueError, match="differ in its head"):
        s = trie.Sweep(1)
        s.add(1, [b"a"], [1])
        s.add(2, [b"b"], [1])


# ---- 12 SimHash --------------------------------------------------------------------------


def print_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def smallest_linked(prints):
    """For distinct fingerprints the smallest of their component, by comparing all."""
    v = np.array(sorted(prints), np.uint64)
    near = np.bitwise_count(v[:, None] ^ v[None]) <= 3
    label = np.arange(len(v))
    while True:
        low = np.where(near, label[None], len(v)).min(axis=1)
        if (low == label).all():
            return {int(x): int(v[k]) for x, k in zip(v, label, strict=True)}
        label = low


def test_fingerprint_matches_brute_force():
    r = random.Random(5)
    for text in [None, "", " \t\r\n", "One", "one TWO", "a b\x0bc\x0cd", "É é  x y", "x " * 70_000, *(" ".join(r.choices("ab cd E ef".split(), k=r.randint(1, 40))) for _ in range(60))]:
        assert simhash.fingerprint((text or "").encode()) == print_of(text), text


def ball(r, n, flips):
    centre = r.getrandbits(64)
    out = {centre}
    while len(out) < n:
        v = centre
        for b in r.sample(range(64), r.randint(1, flips)):
            v ^= 1 << b
        out.add(v)
    return out


def clouds(seed):
    r = random.Random(seed)
    chain = [r.getrandbits(64)]
    for _ in range(60):
        v = chain[-1]
        for b in r.sample(range(64), 3):
            v ^= 1 << b
        chain.append(v)
    return ball(r, 400, 2) | ball(r, 300, 5) | ball(r, 100, 4) | set(chain) | {r.getrandbits(64) for _ in range(400)} | {0, (1 << 64) - 1, 1 << 63, 7 << 61}


@pytest.mark.parametrize("most", [simhash.MOST, 9])
def test_links_match_brute_force(spark, most):
    prints = clouds(most)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    d = spark.createDataFrame([(signed(v),) for v in prints], "fp long")
    found = [(a & (1 << 64) - 1, b & (1 << 64) - 1) for a, b in simhash.links(d, most).collect()]
    label = {v: v for v in prints}

    def top(v):
        while label[v] != v:
            v = label[v]
        return v

    for a, b in found:
        a, b = sorted((top(a), top(b)))
        label[b] = a
    assert {v: top(v) for v in prints} == smallest_linked(prints)


def test_a_task_keeps_trees_and_bounded_fronts(monkeypatch):
    monkeypatch.setattr(simhash, "FRONT", 50)
    v = np.array(sorted(x & (1 << 48) - 1 for x in clouds(3)), np.uint64)
    v = np.unique(v)
    label = simhash.Trie(v, np.array([[0, len(v), 0, len(v)]])).components()
    want = smallest_linked([int(x) for x in v])
    assert [int(v[k]) for k in label] == [want[int(x)] for x in v]
    child, parent = simhash.trees(label)
    assert len(child) == len(v) - len(set(label.tolist())) and (label[child] == label[parent]).all()
    assert max(Counter(parent.tolist()).values()) <= simhash.FAN


def test_simhash_of_documents(spark):
    r = random.Random(2)
    base = [r.choice(["ra", "ne", "to", "Si", "mul", "kep", "or"]) + str(r.randint(0, 99)) for _ in range(300)]
    near = [" ".join(base[:k] + ["new"] + base[k:]) for k in range(0, 300, 30)]
    texts = [None, "", " \n", *near, " ".join(base), "alone in the world", "Alone in  the world", "x", "word " * 60_000] + ["copy of one text"] * 200
    ids = [*range(1000, 1000 + len(texts))]
    ids[3] = None
    out = simhash.digest(docs(spark, texts, ids)).collect()
    prints = [print_of(t) for t in texts]
    low = smallest_linked(set(prints))
    first = {}
    for i, p in zip(ids, prints, strict=True):
        if i is not None:
            first[low[p]] = min(i, first.get(low[p], i))
    want = Counter((i, f"{p:016x}", first.get(low[p])) for i, p in zip(ids, prints, strict=True))
    assert Counter(tuple(x) for x in out) == want
    assert simhash.digest(docs(spark, texts).limit(0)).count() == 0


# ---- 13 spelling variants ----------------------------------------------------------------


def edits_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def all_variants(rows):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UP)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    near = {w: [v for v in n if edits_one(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        if best and n[best] >= 10 * n[w]:
            form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def misspelt(r, w):
    k, c = r.randrange(len(w) + 1), r.choice("abcé")
    return r.choice([w[:k] + c + w[k:], w[: k - 1] + w[k:] if k else w, w[: k - 1] + c + w[k:] if k else w])


def spelt_texts(seed):
    r = random.Random(seed)
    stems = ["".join(r.choices("abc", k=r.randint(7, 12))) for _ in range(25)] + ["Straßenbahn", "éÀÿ×÷abcd", "x" * 300, "aaaaaaa", "aaaaaaaa", "abababab"]
    texts = []
    for _ in range(150):
        words = [r.choice(stems) for _ in range(20)]
        texts.append(" ".join(misspelt(r, w) if r.random() < 0.2 else w.upper() if w.isascii() and r.random() < 0.1 else w for w in words) + "-1short.")
    return texts + texts[:20] + [None, "", "word " * 50_000, "abcdefgh" * 6000 + " " + "abcdefgh" * 6000]


@pytest.mark.parametrize("most, pack", [(1024, 1024), (2, 1)])
def test_variants_match_brute_force(spark, monkeypatch, most, pack):
    monkeypatch.setattr(spelling, "PACK", pack)
    texts = spelt_texts(most)
    ids = [*range(len(texts) - 1), None]
    words, rounds = spelling.blocks, []

    def smaller(v):
        rows, held = words(v, most)
        rounds.append(len(held) // 2)
        return rows, held

    monkeypatch.setattr(spelling, "blocks", smaller)
    out = [tuple(x) for x in spelling.digest(docs(spark, texts, ids)).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(out) == len(set(out)) and set(out) == all_variants(list(zip(ids, texts, strict=True)))
    assert (rounds[0] > 1) == (most < 1024)


def test_chains_of_forms(spark):
    rows = [("abcdefg", 2), ("abcdefgh", 20), ("abcdefghi", 200), ("abcdefghij", 2000)]
    texts = [" ".join([w] * n) for w, n in rows]
    ids = []
    for w, _ in rows:  # ids under which the word stays whole
        ids.append(next(i for i in range(1000) if i not in ids and zlib.crc32(f"{i}:{w}".encode()) % 31))
    out = {x["word"]: (x["form"], x["root"]) for x in spelling.digest(docs(spark, texts, ids)).collect()}
    assert out == {"abcdefg": ("abcdefgh", "abcdefghij"), "abcdefgh": ("abcdefghi", "abcdefghij"), "abcdefghi": ("abcdefghij",) * 2, "abcdefghij": (None, "abcdefghij")}
    assert spelling.digest(docs(spark, texts).limit(0)).count() == 0
