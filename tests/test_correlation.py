"""Residual ranks against least squares, silhouettes and bootstrap pairs against plain loops."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest

from siteward.operators import correlation as K

SCHEMA = "unit long, block long, region long, a double, b double, c double, d double, flat double"


def table(spark, seed=1, n=90):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        a = float(r.randint(0, 30))
        gap = lambda v: None if r.random() < 0.1 else v
        rows.append((i, i % 7, i % 4, a, gap(a + r.random() * 9), gap(float(r.randint(0, 9))), gap(r.random()), 1.0))
    return spark.createDataFrame(rows, SCHEMA), pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])


def plain_residuals(df, features, controls, group):
    ranks = df[[*dict.fromkeys([*features, *controls])]].rank(pct=True)
    out = {}
    for f in features:
        ok = ranks[[*dict.fromkeys([f, *controls])]].notna().all(axis=1)
        parts = [np.ones(ok.sum())] + [ranks.loc[ok, c] for c in controls] + ([] if group is None else [(df.loc[ok, group] == g).astype(float) for g in sorted(df[group].unique())])
        x, y = np.column_stack(parts), ranks.loc[ok, f].to_numpy()
        if y.max() == y.min():
            continue
        res = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
        out |= {(u, f): v for u, v in zip(df.loc[ok, "unit"], res, strict=True)}
    return out


@pytest.mark.parametrize("controls, group", [(["a"], None), (["a", "b", "c"], None), (["a", "a2"], None), (["c"], "region"), ([], "region")])
def test_residuals_match_least_squares(spark, controls, group):
    d, p = table(spark)
    d, p["a2"] = d.withColumn("a2", d["a"] * 2 + 1), p["a"] * 2 + 1
    got = {(x["unit"], x["feature"]): x["residual"] for x in K.residual_ranks(d, "unit", ["d", "b", "flat"], controls, group).collect()}
    want = plain_residuals(p, ["d", "b", "flat"], controls, group)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)


def test_too_few_rows_have_no_residuals(spark):
    d, _ = table(spark, n=3)
    assert K.residual_ranks(d, "unit", ["d"], ["a", "c"]).count() == 0
    assert K.residual_ranks(d.limit(0), "unit", ["d"], ["a"]).count() == 0


def test_bootstrap_counts_rows_as_copies(spark):
    d, p = table(spark, 5, 60)
    names, got = ["a", "b", "c", "d"], {}
    for x in K.bootstrap_pairs(d, "unit", "block", names, 6, 3).collect():
        got[x["replicate"], x["a"], x["b"]] = x["rho"]
    for r in range(-1, 6):
        picks = range(7) if r < 0 else [(3 + r * 7919 + k * 104729 + r * k * 31) % 7 for k in range(7)]
        copied = pd.concat([p[p["block"] == b] for b in picks], ignore_index=True)
        ranks = copied[names].rank()
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                assert abs(got[r, a, b] - ranks[a].corr(ranks[b])) < 1e-8


def test_silhouette_matches_loops(spark):
    names, axes = list("pqrst"), {"p": "x", "q": "x", "r": "y", "s": "y", "t": "z"}
    r = random.Random(3)
    rho = {(a, b): round(r.uniform(-1, 1), 3) for i, a in enumerate(names) for b in names[i + 1 :]}
    d = {k: np.sqrt((1 - v) / 2) for k, v in rho.items()} | {(b, a): np.sqrt((1 - v) / 2) for (a, b), v in rho.items()}
    each = []
    for a in names:
        own = [d[a, b] for b in names if b != a and axes[b] == axes[a]]
        if own:
            other = min(np.mean([d[a, b] for b in names if axes[b] == x]) for x in {*axes.values()} - {axes[a]})
            each.append((other - np.mean(own)) / max(other, np.mean(own)))
    got = K.silhouettes(spark.createDataFrame([(0, a, b, v) for (a, b), v in rho.items()], "replicate long, a string, b string, rho double"), axes).collect()
    assert abs(got[0]["silhouette"] - np.mean(each)) < 1e-12


@pytest.mark.parametrize("blocks", [3, 40])
def test_bootstrap_makes_no_row_per_replicate(spark, monkeypatch, blocks):
    """Rows that a job writes for the next stay those of the table, with few blocks and with more blocks than replicates."""
    r = random.Random(blocks)
    p = pd.DataFrame({"unit": range(200), "block": [i % blocks for i in range(200)], "a": [float(r.randint(0, 9)) for _ in range(200)], "b": [r.random() for _ in range(200)]})
    p.loc[::7, "b"] = None
    written, write = [], K.checkpointed
    monkeypatch.setattr(K, "checkpointed", lambda d: written.append(write(d)) or written[-1])
    d = spark.createDataFrame(p).replace(float("nan"), None)
    got = {x["replicate"]: x["rho"] for x in K.bootstrap_pairs(d, "unit", "block", ["a", "b"], 20).collect()}
    assert max(d.count() for d in written) <= max(400, 21 * blocks)
    for i in range(-1, 20):
        picks = range(blocks) if i < 0 else [(1 + i * 7919 + k * 104729 + i * k * 31) % blocks for k in range(blocks)]
        copied = pd.concat([p[p["block"] == b] for b in picks]).dropna()
        whole = pd.concat([p[p["block"] == b] for b in picks])
        assert abs(got[i] - whole["a"].rank()[whole["b"].notna()].corr(whole["b"].rank().dropna())) < 1e-8 and len(copied)
