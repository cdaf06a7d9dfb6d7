"""Max flow, linkage and assignment on hand-checked instances."""

from itertools import combinations

from siteward.operators import contracts as C
from siteward.operators import graph as G


def test_most_visits_matches_enumeration(spark):
    rows = [(0, 0, 1), (0, 0, 2), (0, 1, 2), (0, 1, 3), (1, 2, 3), (1, 2, 4), (1, 3, 4)]
    best = 0
    for n in range(len(rows) + 1):
        for pick in combinations(rows, n):
            regions, units, clusters = zip(*pick) if pick else ((), (), ())
            if all(regions.count(r) <= 2 for r in regions) and all(units.count(u) <= 1 for u in units) and len(set(clusters)) == len(clusters):
                best = max(best, n)
    assert G.most_visits(spark.createDataFrame(rows, "region long, unit long, cluster long"), 2, 1) == best


def test_linkage_and_spectrum():
    d = {("a", "b"): 0.1, ("a", "c"): 0.9, ("b", "c"): 0.8}
    assert G.average_linkage(["a", "c", "b"], d) == ["a", "b", "c"]
    m = G.spectral_metrics(["a", "b"], {("a", "b"): 0.0})
    assert abs(m["effective_rank"] - 2) < 1e-9 and abs(m["largest_vif"] - 1) < 1e-9


def test_joint_assignment_backtracks():
    options = [(1, "t", "v", 0), (1, "t", "v", 1), (2, "t", "v", 0)]
    assert sorted(G.joint_assignment(options, [1, 2])) == [(1, "t", "v", 1), (2, "t", "v", 0)]
    assert G.joint_assignment([(1, "t", "v", 0), (2, "t", "w", 0)], [1, 2]) is None


def test_unknown_is_not_no(spark):
    df = spark.createDataFrame([(1, "Yes", None), (2, "no", "yes"), (3, "y", "1")], "id long, a string, b string")
    assert {r["id"]: r["status"] for r in C.feasibility(df, "id", ["a", "b"]).collect()} == {1: "unknown", 2: "blocked", 3: "ready"}
