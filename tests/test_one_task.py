"""Steps that hold a bounded part of their rows in one task."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from siteward import catalog
from siteward.operators import need as N
from siteward.operators import network as R
from siteward.operators import spatial as X

SMALL = "/root/testdata/sf0.001"
FEATURES = (N.Feature("a", "g", "one"), N.Feature("b", "g", "one", -1), N.Feature("c", "h", "one"), N.Feature("d", "g", "two"), N.Feature("e", "i", "three", 1, "identity", "nation"), N.Feature("f", "j", "unweighted"))
WEIGHTS = {"one": 0.5, "two": 0.3, "three": 0.2}


def scenarios(scores):
    """scenario, unit: score, from {unit: {feature: score or None}}."""
    mean = lambda xs: sum(xs) / len(xs) if xs else None
    out = {}
    for scenario, mode, removed in [("baseline", "", None)] + [(f"{m}_{f.name}", m, f.name) for f in FEATURES for m in ("renormalize", "neutral")]:
        for unit, known in scores.items():
            rows = {n: 50.0 if n == removed else x for n, x in known.items() if not (n == removed and mode == "renormalize")}
            axes = {}
            for a in WEIGHTS:
                mine = [f for f in FEATURES if f.axis == a and f.name in rows]
                if mine:
                    groups = [mean([rows[f.name] for f in mine if f.group == g and rows[f.name] is not None]) for g in {f.group for f in mine}]
                    axes[a] = mean([x for x in groups if x is not None])
            if axes:
                scored = any(x is not None for x in axes.values())
                out[scenario, unit] = sum(WEIGHTS[a] * (x or 0.0) for a, x in axes.items()) / sum(WEIGHTS[a] for a in axes) if scored else None
    return out


def test_ablation_of_missing_scores_matches_plain_means(spark):
    r = random.Random(3)
    some = lambda: r.choice([None, float(r.randint(0, 5)), r.uniform(0, 9)])
    nation = {0: 1.0, 1: None, 2: 7.5, 3: 7.5}
    rows = [(u, *(some() for _ in "abcd"), n, nation[n], some()) for u in range(40) for n in [r.randrange(4)]]
    rows += [(40, None, None, None, None, None, 3.0, None), (41, None, None, None, None, 1, None, 2.0), (None, 1.0, 2.0, None, 4.0, 2, 7.5, None)]
    units = spark.createDataFrame(rows, "unit long, a double, b double, c double, d double, nation long, e double, f double")
    scores = {}
    for x in N.feature_scores(units, FEATURES).collect():
        scores.setdefault(x["unit"], {})[x["feature"]] = x["score"]
    got = {(x["scenario"], x["unit"]): x["score"] for x in N.ablation(units, FEATURES, WEIGHTS).collect()}
    want = scenarios(scores)
    assert got.keys() == want.keys() and len(got) > 500
    assert all((x is None) == (want[k] is None) and (x is None or math.isclose(x, want[k], abs_tol=1.01e-6)) for k, x in got.items())
    sole = N.ablation(units, FEATURES[3:4], {"two": 1.0})
    assert {x[0] for x in sole.select("scenario").distinct().collect()} == {"baseline", "neutral_d"}


def test_ablation_is_not_dealt_by_scenario(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.queries()["need_ablation_grid"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not re.search(r"partitioning\([^)]*scenario#", plan)


@pytest.mark.parametrize("task_rows", [1 << 18, 64])
def test_nearest_sites_are_equal_however_dealt(spark, monkeypatch, task_rows):
    monkeypatch.setattr(X, "TASK_ROWS", task_rows)
    r = random.Random(task_rows)
    sites = [(i, float(r.randint(0, 30)), float(r.randint(0, 30)), i % 3) for i in range(90)] + [(200, 5.0, 5.0, None), (201, -900.0, 5.0, 0)]
    cells = [(i, float(r.randint(-9, 40)), float(r.randint(0, 30)), i % 4) for i in range(70)] + [(300, 5.0, 5.0, None), (301, 5e5, 5.0, 1), (302, 4.0, 4.0, 2), (303, 4.0, 4.0, 2)]
    s, c = spark.createDataFrame(sites, "site long, x double, y double, region long"), spark.createDataFrame(cells, "cell long, x double, y double, region long")
    for k, within in ((4, []), (2, ["region"]), (40, ["region"])):
        want = {(i, p): q for i, x, y, g in cells for p, (_, q) in enumerate(sorted((round(math.dist((x, y), (a, b)), 9), q) for q, a, b, h in sites if not within or (g is not None and g == h))[:k], 1)}
        assert {(x["cell"], x["place"]): x["site"] for x in X.nearest(c, s, k, within).collect()} == want


def test_nearest_pairs_are_ranked_in_the_task_that_makes_them(spark, monkeypatch):
    monkeypatch.setattr(X, "TASK_ROWS", 64)
    plans, write = [], X.checkpointed
    monkeypatch.setattr(X, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    points = spark.range(200).select(F.col("id").alias("cell"), (F.col("id") % 20).cast("double").alias("x"), F.floor(F.col("id") / 20).cast("double").alias("y"))
    X.nearest(points, points.withColumnRenamed("cell", "site"), 3)
    ranked = [p for p in plans if "distance#" in p and "row_number" in p]
    assert ranked and not any(re.search(r"partitioning\(cell#", p) or "BroadcastHashJoin" in p for p in ranked)


def test_roads_are_read_once_for_both_directions(spark):
    rows = [(1, 2, 1000.0, 60.0, False), (1, 2, 1000.0, 60.0, False), (2, 1, 500.0, 60.0, True), (2, 3, 1000.0, 30.0, None), (3, 3, 10.0, 30.0, False), (4, 1, 0.0, 30.0, False)]
    ways = spark.createDataFrame(rows, "u long, w long, metres double, speed double, oneway boolean")
    got = R.edges_of(ways)
    assert {(x["u"], x["w"]): x["minutes"] for x in got.collect()} == {(1, 2): 1.0, (2, 1): 0.5, (2, 3): 2.0, (3, 2): 2.0}
    assert "Union" not in got._jdf.queryExecution().executedPlan().toString()
