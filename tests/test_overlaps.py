"""Overlaps of sites counted by blocks of cells."""

import random

import pytest

from siteward.operators import overlaps as O
from siteward.operators.spatial import pair_overlaps


@pytest.mark.parametrize(("cells", "pairs", "entries", "rows"), [(4096, 1 << 22, 1 << 24, 1 << 20), (5, 20, 40, 30)])
def test_blocks_equal_brute_force(spark, monkeypatch, cells, pairs, entries, rows):
    for name, v in (("CELLS", cells), ("PAIRS", pairs), ("ENTRIES", entries), ("ROWS", rows)):
        monkeypatch.setattr(O, name, v)
    r = random.Random(7)
    cover = [(r.randrange(-8, 25), r.randrange(60), 1.0) for _ in range(400)] + [(None, 1, 1.0), (3, 999, 1.0)]
    pop = {c: None if c % 9 == 0 else float("inf") if c == 31 else r.random() * 9 for c in range(60)}
    table = spark.createDataFrame(list(pop.items()), "cell long, population double")
    known = [(s, c) for s, c, _ in cover if s is not None and c in pop]
    want = {}
    for i, c in known:
        for j, d in known:
            if i < j and c == d:
                n, p = want.get((i, j), (0, None))
                want[i, j] = (n + 1, p if pop[c] is None else (p or 0.0) + pop[c])
    df = spark.createDataFrame(cover, "site long, cell long, weight double")
    sets = O.sites_of_cells(df, table, ["population"])
    got = {(x["site_i"], x["site_j"]): (x["shared"], x["population"]) for x in O.shared_sums(sets, ["population"]).collect()}
    assert got.keys() == want.keys()
    assert all(got[k][0] == n and (got[k][1] == p or got[k][1] == pytest.approx(p)) for k, (n, p) in want.items())


def test_two_sites_are_paired_once_a_block_and_halves_are_rounded_as_in_sql(spark):
    cover = [(1, c, 1.0) for c in range(681)] + [(2, c, 1.0) for c in range(599, 1280)]  # 82 of 1,280
    df = spark.createDataFrame(cover, "site long, cell long, weight double")
    cells = spark.range(1280).selectExpr("id AS cell", "1D AS population")
    assert [tuple(x) for x in pair_overlaps(df, cells).collect()] == [(1, 2, 82, 0.064062, 0.064062)]
    assert pair_overlaps(df.limit(0), cells).count() == 0
    plan = O.shared_sums(O.sites_of_cells(df, cells, ["population"]), ["population"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "_name" in plan.split("Join", 1)[1].split("\n", 1)[0]


@pytest.mark.parametrize(("entries", "rows"), [(1 << 24, 1 << 20), (40, 30)])
def test_a_block_is_cut_by_its_bounds(monkeypatch, entries, rows):
    monkeypatch.setattr(O, "ENTRIES", entries)
    monkeypatch.setattr(O, "ROWS", rows)
    r = random.Random(9)
    held = [r.sample(range(20), r.randrange(1, 9)) for _ in range(30)]
    flat, ends = O.pa.array([s for h in held for s in h], O.pa.int64()), O.np.cumsum([0, *map(len, held)])
    got = {}
    for i, j, n, _ in O._block(flat, ends, []):
        for a, b, k in zip(i.to_pylist(), j.to_pylist(), n.tolist(), strict=True):
            got[a, b] = got.get((a, b), 0) + k
    assert got == {(a, b): n for a in range(20) for b in range(a + 1, 20) if (n := sum(a in h and b in h for h in held))}
