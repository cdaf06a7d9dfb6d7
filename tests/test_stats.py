"""Ranks, scalers and sources on small frames."""

import math
import random

import pytest
from pyspark.sql import functions as F

from siteward.functions.scalers import scaled, scaled_by_group, scaled_long
from siteward.functions.stats import average_rank, gini, haversine_km, ordered_rank, rank_percentile
from siteward.sources import tables as T


def test_average_rank_percentile_matches_pandas(spark):
    pd = pytest.importorskip("pandas")
    values = [3.0, 1.0, 3.0, None, 2.0, 2.0, 2.0, 9.0]
    df = spark.createDataFrame(list(enumerate(values)), "id long, v double")
    got = {r["id"]: r["p"] for r in rank_percentile(df, "v", "p").collect()}
    want = pd.Series(values).rank(method="average", pct=True)
    assert all((got[i] is None and want[i] != want[i]) or abs(got[i] - want[i]) < 1e-12 for i in range(len(values)))
    assert sorted(r["r"] for r in average_rank(df.na.drop(), "v", "r").collect()) == [1.0, 3.0, 3.0, 3.0, 5.5, 5.5, 7.0]


def test_ordered_rank_is_total(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 7.0), (3, 5.0)], "id long, s double")
    out = {r["id"]: (r["rank"], r["tied"], r["n"]) for r in ordered_rank(df, "s", "id", "rank", "tied", "n").collect()}
    assert out == {2: (1, 1, 1), 1: (2, 2, 2), 3: (3, 2, 2)}


def test_constant_columns_have_defined_scores(spark):
    df = spark.createDataFrame([(i, 4.0) for i in range(5)], "id long, v double")
    assert {r["s"] for r in scaled(df, "v", "s", "robust_minmax").collect()} == {50.0}
    assert {r["s"] for r in scaled(df, "v", "s", "robust_z").collect()} == {50.0}


def test_repeated_values_are_scaled_once_a_group(spark):
    few = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "g string, v double")
    many = few.union(few.filter("g = 'a'")).union(few.filter("g = 'a'"))
    one = {r["g"]: r["s"] for r in scaled_by_group(few, "g", "v", "s", method="rank_percentile").collect()}
    assert {(r["g"], r["s"]) for r in scaled_by_group(many, "g", "v", "s", method="rank_percentile").collect()} == set(one.items())


def test_gini(spark):
    assert gini(spark.createDataFrame([(0.0,), (0.0,), (0.0,), (8.0,)], "v double"), "v").first()[0] == pytest.approx(0.75)
    assert gini(spark.createDataFrame([(0.0,), (0.0,)], "v double"), "v").first()[0] == 0.0


def test_sources(spark, tmp_path):
    from siteward.sources import sinks

    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, s string")
    for kind in ("csv", "json", "parquet"):
        sinks.write(df, f"{tmp_path}/t.{kind}")
        assert sorted(map(tuple, T.read_any(spark, f"{tmp_path}/t.{kind}", "id long, s string").select("id", "s").collect())) == [(1, "a"), (2, "b")]
    assert T.first_existing(["A", "b"], ["x", "B"]) == "b"
    row = spark.createDataFrame([("1,234",), ("*",), ("x",)], "r string")
    v, low, high = T.metric_bounds(row["r"])
    assert [tuple(r) for r in row.select(v, low, high).collect()] == [(1234.0, 1234.0, 1234.0), (None, 0.0, 4.0), (None, None, None)]


def test_korean_csv(spark, tmp_path):
    (tmp_path / "k.csv").write_bytes("지역,수\n원주시,5\n".encode("cp949"))
    assert T.read_korean_csv(spark, str(tmp_path / "k.csv"), {"지역": "region", "수": "n"}).collect()[0][:] == ("원주시", "5")


def test_stream_equals_batch(spark, tmp_path):
    from siteward.streaming.windows import event_windows, run_stream

    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, CAST(id AS INT)) AS ts, CAST(id % 3 AS STRING) AS event_type, CAST(id AS DOUBLE) AS value FROM range(240)")
    rows.write.parquet(f"{tmp_path}/in")
    run_stream(spark, f"{tmp_path}/in", rows.schema, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    done = {(r["start"], r["event_type"]): (r["n"], r["total"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    all_ = {(r["start"], r["event_type"]): (r["n"], r["total"]) for r in event_windows(rows).collect()}
    assert done and all(all_[k] == v for k, v in done.items())


@pytest.mark.parametrize("method", ["rank_percentile", "winsorized_percentile", "robust_minmax", "robust_z"])
def test_a_missing_value_has_no_score(spark, method):
    """A null is neither the least value nor one of the ranked ones."""
    df = spark.createDataFrame([(k, v) for k, v in enumerate([3.0, None, 1.0, 7.0, 5.0])], "k long, v double")
    full = {r["k"]: r["s"] for r in scaled(df.filter("v is not null"), "v", "s", method).collect()}
    assert {r["k"]: r["s"] for r in scaled(df, "v", "s", method).collect()} == full | {1: None}
    long = df.select("k", F.lit("f").alias("feature"), F.lit(1).alias("direction"), F.col("v").alias("value"))
    found = {r["k"]: r["score"] for r in scaled_long(long, method).collect()}
    assert found[1] is None and all(abs(found[k] - full[k]) < 1e-9 for k in full)


def test_distance_to_a_missing_place_is_unknown(spark):
    row = spark.createDataFrame([(37.0, None)], "lat double, lon double")
    assert row.select(haversine_km(F.col("lat"), F.col("lon"), F.lit(1.0), F.lit(2.0)).alias("d")).collect() == [(None,)]


@pytest.mark.parametrize("n, values", [(0, 3), (1, 3), (60, 4), (300, 1000), (40, 1)])
def test_kendall_matches_all_pairs(spark, n, values):
    import random

    from siteward.operators.need import kendall_tau_b

    r = random.Random(n)
    rows = [(float(r.randint(0, values)) if values > 1 else 5.0, float(r.randint(0, values))) for _ in range(n)]
    odd = [(None, 1.0), (2.0, None), (float("nan"), 0.0)]
    got = kendall_tau_b(spark.createDataFrame(rows + odd, "a double, b double").repartition(3), "a", "b").collect()
    sign = lambda v: (v > 0) - (v < 0)
    pairs = [(sign(p[0] - q[0]), sign(p[1] - q[1])) for i, p in enumerate(rows) for q in rows[:i]]
    base = sum(abs(a) for a, _ in pairs) ** 0.5 * sum(abs(b) for _, b in pairs) ** 0.5
    assert len(got) == 1
    assert got[0]["tau"] == (pytest.approx(sum(a * b for a, b in pairs) / base, abs=1e-12) if base else None)


def test_halves_are_rounded_as_in_sql_and_in_a_fixed_order(spark):
    from siteward.functions.stats import rounded
    from siteward.operators import need, review

    sql = lambda x: math.floor(x * 1e6 + 0.5) / 1e6
    assert spark.range(1).select(rounded(F.lit(82 / 1280)).alias("r")).collect()[0]["r"] == sql(82 / 1280) == 0.064062
    r = random.Random(5)  # percentiles of a table of 900,000 rows: one score in dozens lies on a half
    weights, rows = {"a": 0.5, "b": 0.3, "c": 0.2}, {k: [100 * (r.randrange(1_800_000) / 2 / 900_000) for _ in range(3)] for k in range(3000)}
    long = [(k, a, s) for k, v in rows.items() for a, s in zip(weights, v, strict=True)]
    want = {k: sql(0.5 * x + 0.3 * y + 0.2 * z) for k, (x, y, z) in rows.items()}
    for order in (long, long[::-1], r.sample(long, len(long))):
        axes = spark.createDataFrame(order, "unit long, axis string, score double")
        assert {x["unit"]: x["score"] for x in need.weighted(axes, weights, ["unit"]).collect()} == want
        assert {x["unit"]: x["score"] for x in review.profile_runs(axes, {"p": weights}).collect()} == want
