"""Distributed skylines against comparing all rows, with ties, repeated rows and small chunks."""

from __future__ import annotations

import random

import numpy as np
import pytest

from siteward.operators import skyline as S

SCHEMA = "site long, a double, b double, c double"


def beaten(v):
    return np.array([((v >= x).all(1) & (v > x).any(1)).any() for x in v], bool)


def rows_of(kind, n):
    r = random.Random(n)
    if kind == "ties":
        return [(i, float(r.randint(0, 6)), float(r.randint(0, 6)), float(r.randint(0, 6))) for i in range(n)]
    if kind == "front":  # nearly all on the skyline
        return [(i, x := r.random(), 1 - x, round(r.random(), 1)) for i in range(n)]
    return [(i, r.random(), r.random(), r.random()) for i in range(n)]


@pytest.mark.parametrize("kind, n, chunk", [("ties", 400, 4096), ("front", 1500, 60), ("any", 3000, 5)])
def test_skyline_matches_brute_force(spark, kind, n, chunk):
    rows = rows_of(kind, n)
    odd = [(n, None, 9.0, 9.0), (n + 1, float("nan"), 9.0, 0.0), (n + 2, 5.0, None, 0.0)]
    v = np.array([[a, b, -c] for _, a, b, c in rows])
    want = {rows[i][0] for i in np.flatnonzero(~beaten(v))}
    got = [x["site"] for x in S.skyline(spark.createDataFrame(rows + odd, SCHEMA).repartition(5), "site", ["a", "b"], ["c"], chunk).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_tiers_peel_one_front_after_another(spark):
    rows = rows_of("ties", 200)
    v, tier = np.array([[a, b, -c] for _, a, b, c in rows]), {}
    left = np.arange(len(v))
    for k in (1, 2, 3):
        out = beaten(v[left])
        tier |= {rows[i][0]: k for i in left[~out]}
        left = left[out]
    got = {x["site"]: x["tier"] for x in S.skyline_tiers(spark.createDataFrame(rows, SCHEMA), "site", ["a", "b"], ["c"], 3, 20).collect()}
    assert got == tier


def test_equal_rows_and_empty_tables(spark):
    d = spark.createDataFrame([(i, 1.0, 2.0, 3.0) for i in range(50)] + [(99, 1.0, 2.0, 4.0)], SCHEMA)
    assert {x["site"] for x in S.skyline(d, "site", ["a", "b"], ["c"]).collect()} == set(range(50))
    assert S.skyline(d.limit(0), "site", ["a"], ["c"]).count() == 0
    assert S.skyline_tiers(d, "site", ["a"], ["c"], 9).filter("tier = 2").count() == 1
