"""Points in many polygons against ray casting over all edges, and on borders, holes and odd geometry."""

from __future__ import annotations

import math
import random

import pytest

from siteward.operators import polygons as G

POINTS, SHAPES = "cell long, x double, y double", "region long, wkt string"


def holds(rings, x, y):
    """Even-odd rule; the border counts."""
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (x2 - x1) * (y - y1) == (y2 - y1) * (x - x1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                return True
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def wkt(rings):
    return "POLYGON (" + ", ".join("(" + ", ".join(f"{x} {y}" for x, y in [*r, r[0]]) + ")" for r in rings) + ")"


def star(r, cx, cy, size):
    return [(cx + round(size * r.uniform(0.3, 1) * math.cos(a)), cy + round(size * r.uniform(0.3, 1) * math.sin(a))) for a in sorted(r.uniform(0, 6.28) for _ in range(r.randint(4, 12)))]


def test_regions_match_ray_casting(spark):
    r = random.Random(2)
    shapes = {}
    for k in range(30):
        cx, cy = r.randint(0, 100), r.randint(0, 100)
        shapes[k] = [star(r, cx, cy, r.randint(4, 25))] + ([[(cx - 1, cy - 1), (cx + 1, cy - 1), (cx + 1, cy + 1), (cx - 1, cy + 1)]] if k % 3 == 0 else [])
    points = [(i, float(r.randint(-10, 110)), float(r.randint(-10, 110))) for i in range(600)]
    points += [(1000 + i, float(x), float(y)) for i, (x, y) in enumerate(p for rings in shapes.values() for p in rings[0])]
    got = {x["cell"]: x["region"] for x in G.region_of(spark.createDataFrame(points, POINTS), spark.createDataFrame([(k, wkt(v)) for k, v in shapes.items()], SHAPES)).collect()}
    assert got == {c: min((k for k, rings in shapes.items() if holds(rings, x, y)), default=None) for c, x, y in points}
    assert len(set(got.values())) > 15


def test_borders_holes_and_many_parts(spark):
    shapes = [(2, "POLYGON((0 0,10 0,10 10,0 10,0 0),(4 4,6 4,6 6,4 6,4 4))"), (1, "multipolygon (((10 0, 20 0, 20 10, 10 10)), ((30 0, 31 0, 31 1e0, 30 1)))"), (3, "POLYGON EMPTY"), (4, None)]
    points = [(1, 5.0, 5.0), (2, 4.0, 5.0), (3, 10.0, 5.0), (4, 30.5, 0.5), (5, 25.0, 5.0), (6, None, 1.0), (7, float("nan"), 1.0), (8, 0.0, 0.0), (9, 1.0, 9.5), (10, float("inf"), 5.0)]
    p, s = spark.createDataFrame(points, POINTS), spark.createDataFrame(shapes, SHAPES)
    got = {x["cell"]: (x["region"], x["border"]) for x in G.region_of(p, s).collect()}
    none = (None, None)
    assert got == {1: none, 2: (2, True), 3: (1, True), 4: (1, False), 5: none, 6: none, 7: none, 8: (2, True), 9: (2, False), 10: none}
    assert {x["cell"] for x in G.within_any(p, s).collect()} == {2, 3, 4, 8, 9}
    assert {x["region"] for x in G.region_of(p, s.filter("region > 2")).collect()} == {None}
    assert G.region_of(p.limit(0), s).count() == 0


@pytest.mark.parametrize("text", ["POINT (1 1)", "POLYGON ((0 0, 1))", "POLYGON (0 0, 1 1)", "soon"])
def test_other_texts_are_errors(spark, text):
    with pytest.raises(Exception, match="no polygon"):
        G.edges_of(spark.createDataFrame([(1, text)], SHAPES)).collect()
