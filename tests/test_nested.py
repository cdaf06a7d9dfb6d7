"""Nested choice: nothing of the outer year enters its own choice; the grid's null against plain shuffles."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict
from statistics import mean, median

import pytest

from siteward.operators import nested as N

PANEL = "region long, item string, year long, month long, value double"


def panel(spark, seed=1, poison=None, years=(1, 2, 3, 4)):
    r = random.Random(seed)
    rows = [(g, i, y, m, float(r.randint(0, 20) + 5 * (m % 4))) for g in range(3) for i in "ab" for y in years for m in range(1, 13)]
    if poison:
        rows = [(g, i, y, m, 1e12 * m if y == poison else v) for g, i, y, m, v in rows]
    return spark.createDataFrame(rows, PANEL)


@pytest.mark.parametrize("year", [1, 3])
def test_an_outer_year_is_no_part_of_its_choice(spark, year):
    pick = lambda p: {x["outer"]: (x["candidate"], x["weight"], x["inner_error"], x["outer_error"]) for x in N.nested_choice(N.profiles(panel(spark, poison=p)), [0.0, 0.5]).collect()}
    clean, bad = pick(None), pick(year)
    assert clean[year][:3] == bad[year][:3] and clean[year][3] != bad[year][3]
    assert any(clean[y] != bad[y] for y in clean if y != year)


def test_folds_hold_each_year_out_once():
    rows = N.folds([1, 2, 3, 4])
    assert all(o != t and (i == o or (i != t and o != i)) and test == i for o, i, test, t in rows)
    assert len(rows) == 4 * 3 * 2 + 4 * 3 and len(set(rows)) == len(rows)


def test_two_years_are_too_few(spark):
    with pytest.raises(ValueError, match="three years"):
        N.nested_choice(N.profiles(panel(spark, years=(1, 2))), [0.0])


def plain_margins(rows):
    """Margins by candidate and item from a panel's rows, by loops."""
    cells, months = defaultdict(dict), defaultdict(float)
    for g, i, y, m, v in rows:
        cells[g, i, y][m] = v
        months[g, y, m] += v
    import math

    out = defaultdict(list)
    for (g, i, y), values in cells.items():
        forms = {"level": dict(values), "share": {m: v / months[g, y, m] if months[g, y, m] else 0.0 for m, v in values.items()}, "log": {m: math.log1p(v) for m, v in values.items()}}
        for f, x in forms.items():
            whole = mean(x.values())
            x = {m: v / whole if whole > 0 else 1.0 for m, v in x.items()}
            for name, agg in (("mean", mean), ("median", median)):
                for s in range(4):
                    out[f"{f}:{name}", i, s].append(agg([x[3 * s + k] for k in (1, 2, 3)]))
    found = {}
    for c, i in {(c, i) for c, i, _ in out}:
        m = sorted((mean(out[c, i, s]) for s in range(4)), reverse=True)
        found[c, i] = round((m[0] - m[1]) / mean(m), 9)
    return found


def test_grid_null_matches_plain_shuffles(spark):
    d, n = panel(spark, 7, years=(1, 2)), 9
    rows = [tuple(x) for x in d.collect()]
    seen, null = plain_margins(rows), []
    for r in range(n):
        order = defaultdict(list)
        for g, i, y, m, v in rows:
            order[g, i, y].append((hashlib.md5(f"{r}:{g}:{i}:{y}:{m}".encode()).hexdigest(), v))
        null.append(plain_margins([(*k, m, v) for k, x in order.items() for m, (_, v) in enumerate(sorted(x), 1)]))
    for x in N.grid_null(d, n).collect():
        c, i = x["candidate"], x["item"]
        assert abs(x["margin"] - seen[c, i]) < 2e-6
        assert x["p"] == round((1 + sum(m[c, i] >= seen[c, i] for m in null)) / (n + 1), 6)
        assert x["p_grid"] == round((1 + sum(max(v for (_, j), v in m.items() if j == i) >= seen[c, i] for m in null)) / (n + 1), 6) >= x["p"]
