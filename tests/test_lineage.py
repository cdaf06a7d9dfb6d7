"""Runs by lineage: a complete and unique ledger, and changes against scoring every run anew."""

from __future__ import annotations

import random

import pytest

from siteward.operators import lineage as L

FED = [("a", "x", "f1"), ("a", "x", "f2"), ("a", "y", "f3"), ("b", "x", "f1"), ("b", "y", "f2"), ("b", "y", "f3"), ("b", "z", "f4"), ("c", "z", "f4")]
WEIGHTS = {"x": 0.5, "y": 0.3, "z": 0.2}
SWAPS = [("x", "y"), ("z", "x"), ("z", "q")]


def tables(spark, rows):
    return spark.createDataFrame(rows, "unit long, feature string, value double"), spark.createDataFrame(FED + FED[:1], "item string, component string, feature string"), spark.createDataFrame(list(WEIGHTS.items()), "component string, weight double")


def scores(values, run):
    """{(item, unit): score}, with nothing taken over from another run."""
    scope, *rest = run.split("::")
    out = {}
    for unit in {u for u, _ in values}:
        for item in "abc":
            parts = {}
            for c in {c for i, c, _ in FED if i == item}:
                fed = [f for i, k, f in FED if (i, k) == (item, c) and not (scope == "source_feature" and rest == [c, f])]
                v = [values[unit, f] for f in fed if values.get((unit, f)) is not None and values[unit, f] == values[unit, f]]
                if any((unit, f) in values for i, k, f in FED if (i, k) == (item, c)):
                    parts[c] = sum(v) / len(v) if v else 50.0
            whole = dict(parts)
            if scope == "component" and rest[0] in parts:
                if rest[1] == "neutral":
                    parts[rest[0]] = 50.0
                else:
                    del parts[rest[0]]
            if scope == "swap" and rest[0] in whole and rest[1] in whole:
                parts[rest[0]] = whole[rest[1]]
            if whole:
                out[item, unit] = sum(WEIGHTS[c] * v for c, v in parts.items()) / sum(WEIGHTS[c] for c in parts) if parts else 50.0
    return out


@pytest.mark.parametrize("seed, n, top", [(1, 30, 5), (2, 4, 9)])
def test_changes_match_scoring_every_run_anew(spark, seed, n, top):
    r = random.Random(seed)
    rows = [(u, f, r.choice([None, float("nan"), *[float(r.randint(0, 100)) for _ in range(8)]])) for u in range(n) for f in ("f1", "f2", "f3", "f4", "unused")]
    features, fed, weights = tables(spark, rows)
    ledger = L.run_ledger(fed, SWAPS)
    values = {(u, f): v for u, f, v in rows}
    base = scores(values, "baseline::primary")
    best = lambda s, i: {u for _, u in sorted((-round(v, 9), u) for (k, u), v in s.items() if k == i)[:top]}
    got = L.lineage_ablation(features, fed, weights, ledger, top).collect()
    assert len(got) == len({(x["run_id"], x["item"]) for x in got}) == 3 * ledger.select("run_id").distinct().count()
    for x in got:
        s = scores(values, x["run_id"])
        change = [abs(s[k] - base[k]) for k in base if k[0] == x["item"]]
        assert x["units"] == len(change) == n
        assert x["mean_change"] == pytest.approx(sum(change) / len(change), abs=2e-6) and x["max_change"] == pytest.approx(max(change), abs=2e-6)
        assert x["top_kept"] == pytest.approx(len(best(s, x["item"]) & best(base, x["item"])) / min(top, n), abs=1e-6)
        assert x["touched"] or (x["max_change"] == 0 and x["top_kept"] == 1)
    assert not any(x["touched"] for x in got if x["run_id"] == "baseline::primary")


def test_ledger_is_complete_and_does_not_depend_on_order(spark):
    _, fed, _ = tables(spark, [(1, "f1", 1.0)])
    want = {"baseline::primary"} | {f"component::{c}::{m}" for c in "xyz" for m in ("neutral", "renormalize")} | {f"source_feature::{c}::{f}" for _, c, f in FED} | {f"swap::{a}::{b}" for a, b in SWAPS}
    rows = L.run_ledger(fed, SWAPS).collect()
    assert {x["run_id"] for x in rows} == want
    assert {x["item"] for x in rows if x["run_id"] == "source_feature::x::f1"} == {"a", "b"}
    assert [x["item"] for x in rows if x["run_id"] == "swap::z::q"] == [None]
    assert [x["item"] for x in rows if x["run_id"] == "swap::z::x"] == ["b"]
    assert sorted(map(str, L.run_ledger(fed.orderBy("feature").repartition(3), SWAPS).collect())) == sorted(map(str, rows))
    with pytest.raises(Exception, match="keys repeat"):
        L.run_ledger(fed, [("x", "y"), ("x", "y")]).collect()


def test_empty_tables(spark):
    features, fed, weights = tables(spark, [(1, "f1", 1.0)])
    assert L.lineage_ablation(features.limit(0), fed, weights, L.run_ledger(fed), 3).count() == 0
    assert [x["run_id"] for x in L.run_ledger(fed.limit(0)).collect()] == ["baseline::primary"]
    lone = {x["item"]: x["units"] for x in L.lineage_ablation(features, fed, weights, L.run_ledger(fed), 3).filter("run_id = 'baseline::primary'").collect()}
    assert lone == {"a": 1, "b": 1}
