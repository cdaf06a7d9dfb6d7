"""Contracts of stages: each clause refuses a bad row, and a refusal leaves what stood before."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from siteward.operators import handoff as H
from siteward.sources import contracts as C

COLUMNS = "site string, bundle string, unit string, region string, raw double, own double, crossing double, far double, place string, spare string, release string, confidence string, recommended string, fallback string"
GOOD = ("1", "a", "3", "0", 9.0, 4.0, 5.0, 2.0, "1", "2", "ACTIONABLE", "HIGH", "spring", "Winter ")
CONTRACT = H.site_contract(["ACTIONABLE"])


def row(**new):
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    return tuple(new.get(n, v) for n, v in zip(names, GOOD))


FAULTS = [
    ("site is no bigint", dict(site="x1")), ("site is not there", dict(site=None)), ("bundle is not there", dict(bundle="  ")), ("raw is not there", dict(raw=float("nan"))),
    ("raw is not there", dict(raw=float("inf"))), ("exposure is negative", dict(far=-1.0)), ("own exceeds raw", dict(own=10.0)), ("crossing exceeds raw", dict(crossing=10.0)),
    ("far exceeds crossing", dict(far=5.5)), ("parts don't add up", dict(own=4.1)), ("place is not positive", dict(place="0")), ("spare is the site itself", dict(spare="1")),
    ("release is unknown", dict(release="MAYBE")), ("release is unknown", dict(release=None)), ("confidence is blank", dict(confidence="")),
    ("abstaining row names a season", dict(release=H.ABSTAINS)), ("season is unknown", dict(recommended="monsoon")), ("season is unknown", dict(fallback=None)),
    ("fallback repeats the season", dict(fallback="SPRING")),
]


def test_every_clause_finds_its_row(spark):
    for i in range(0, len(FAULTS), 5):  # each fault in a table of its own, the tables audited one by one
        for rule, new in FAULTS[i : i + 5]:
            good = [row(site="7"), row(site="8", release=H.ABSTAINS, recommended=None, fallback=" ")]
            got = {x["rule"]: x["violations"] for x in C.audited(spark.createDataFrame([*good, row(**new)], COLUMNS), CONTRACT).collect()}
            assert got[rule] == 1, rule


def test_refusal_keeps_what_stood_and_success_replaces_it(spark, tmp_path):
    at = str(tmp_path / "site_handoff")
    report = C.publish(spark.createDataFrame([row(), row(bundle="b")], COLUMNS), CONTRACT, at)
    assert all(n == 0 and rows == 2 for _, rows, n in report)
    assert dict(spark.read.parquet(at).dtypes)["site"] == "bigint"
    with pytest.raises(C.Refused) as told:
        C.publish(spark.createDataFrame([row(), row(), row(site="5", own=10.0)], COLUMNS), CONTRACT, at)
    assert told.value.broken == {"key repeats": 1, "own exceeds raw": 1, "parts don't add up": 1}
    assert spark.read.parquet(at).count() == 2
    with pytest.raises(Exception):
        C.publish(spark.createDataFrame([row()], COLUMNS).withColumn("more", F.raise_error(F.lit("lost")).cast("int")), CONTRACT, at)
    assert spark.read.parquet(at).count() == 2
    C.publish(spark.createDataFrame([row(site="6")], COLUMNS), CONTRACT, at)
    assert [x["site"] for x in spark.read.parquet(at).collect()] == [6]
    assert os.listdir(tmp_path) == ["site_handoff"]


def test_columns_are_told_before_a_row_is_read(spark):
    never = spark.range(3).select(F.raise_error(F.lit("read")).cast("string").alias("site"), F.lit("x").alias("Plan"))
    with pytest.raises(C.Refused) as told:
        C.observed(never, CONTRACT)
    assert "column plan is forbidden" in told.value.broken and "column raw is missing" in told.value.broken
    gap = H.gap_contract(2, 2)
    with pytest.raises(C.Refused, match="column note is not asked for"):
        C.observed(spark.createDataFrame([(1, "a", 1.0, 1.0, 1, "n")], "unit long, bundle string, need double, gap double, place long, note string"), gap)
    some = spark.createDataFrame([(1, "a", 50.0, 101.0, 1), (1, "b", 50.0, 5.0, 2), (2, "a", 5.0, 5.0, 1)], "unit long, bundle string, need double, gap double, place long")
    got = {x["rule"]: x["violations"] for x in C.audited(some, gap).collect() if x["violations"]}
    assert got == {"gap is outside 0 to 100": 1, "rows are not 4": 1}


def test_empty_tables_and_dates_told_too_early(spark, tmp_path):
    empty = spark.createDataFrame([], COLUMNS)
    assert all(n == 0 for _, _, n in C.publish(empty, CONTRACT, str(tmp_path / "none")))
    with pytest.raises(C.Refused, match="rows are not 4"):
        C.publish(spark.createDataFrame([], "unit long, bundle string, need double, gap double, place long"), H.gap_contract(2, 2), str(tmp_path / "gap"))
    early = spark.createDataFrame([row()], COLUMNS).withColumn("exact_date", F.lit("2000-01-01"))
    got = {x["rule"]: x["violations"] for x in C.audited(early, H.site_contract(["ACTIONABLE"], early.columns)).collect()}
    assert got["exact_date is told too early"] == 1


def test_one_scan_and_one_exchange(spark, tmp_path):
    at = str(tmp_path / "rows")
    spark.createDataFrame([row()], COLUMNS).write.parquet(at)
    rows, _ = C.observed(spark.read.parquet(at), CONTRACT)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1
