"""Gates and rechecks fail where they must; staged objectives keep what stages before them ask for."""

import pytest

from siteward.operators import fieldwork as W


def test_travel_is_null_without_a_base_and_checked_with_one(spark):
    cols = "site long, minutes string, seen string, guess boolean"
    good = spark.createDataFrame([(1, "5", " confirmed_team_base_network ", False)], cols)
    assert W.gated_travel(good, True, "minutes", "seen", "guess").first()["final_travel_minutes"] == 5.0
    off = W.gated_travel(good, False, "minutes", "seen", "guess").first()
    assert (off["minutes"], off["final_travel_minutes"], off["final_travel_input_status"]) == (None, None, W.TRAVEL_DISABLED)
    for bad in [(1, "5", None, False), (1, "5", "guessed", False), (1, "5", "CONFIRMED_TEAM_BASE_NETWORK", True), (1, "-1", "CONFIRMED_TEAM_BASE_NETWORK", False), (1, "soon", "CONFIRMED_TEAM_BASE_NETWORK", False)]:
        with pytest.raises(Exception, match="travel: "):
            W.gated_travel(spark.createDataFrame([bad], cols), True, "minutes", "seen", "guess").collect()


def test_recheck_names_every_broken_rule(spark):
    sites = spark.createDataFrame([(1, 1, 1, 0), (2, 1, 1, 0), (3, 2, 1, 1)], "site long, unit long, region long, known int")
    chosen = spark.createDataFrame([("good", 1), ("units", 1), ("units", 2), ("odd", 3), ("odd", 9), ("twice", 1), ("twice", 1)], "plan string, site long")
    faults = {r["plan"]: r["faults"] for r in W.recheck(chosen, sites, 2, {"unit": 1, "region": 2}, "known").collect()}
    assert faults == {"good": "visits", "units": "unit", "odd": "unknown|overlap", "twice": "visits|unit"}


def test_stages_keep_their_share_before_cost_decides(spark):
    m = spark.createDataFrame([(1, 100, 10, 9), (2, 95, 50, 8), (3, 94, 99, 1)], "plan long, a long, b long, cost long")
    assert W.lexicographic(m, ["a"], {"a": 0.95}, "cost").collect() == [(2,)]
    assert W.lexicographic(m, ["a", "b"], {"a": 0.9, "b": 1.0}, "cost").collect() == [(3,)]
    assert W.lexicographic(m.filter("plan > 9"), ["a"], {"a": 0.9}, "cost").collect() == []


def test_a_result_that_comes_twice_is_an_error(spark):
    queue = spark.createDataFrame([(1,), (2,)], "site long")
    notes = spark.createDataFrame([(1, "yes", "2024-02-30")], "site long, word string, day string")
    rows = {r["site"]: (r["field_status"], r["verified_on"]) for r in W.merged_results(queue, notes, "site", "word", "day").collect()}
    assert rows == {1: ("verified", None), 2: ("unknown", None)}
    with pytest.raises(Exception, match="keys repeat"):
        W.merged_results(queue, notes.union(notes), "site", "word", "day").collect()
