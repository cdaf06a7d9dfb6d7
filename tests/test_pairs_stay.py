import re

import pytest

from siteward import catalog
from siteward.plans import contracts

SMALL = "/root/testdata/sf0.001"
QUERIES = {n: lambda spark, n=n: catalog.queries()[n](spark, SMALL) for n in ("cross_unit_share", "candidate_equivalence", "exposure_change_panel")} | {"site_handoff": lambda spark: contracts._sites(spark, SMALL)}


def plan(spark, make):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return make(spark)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", QUERIES)
def test_covered_pairs_are_not_dealt_by_cell(spark, name):
    assert not re.search(r"hashpartitioning\([^)]*cell#", plan(spark, QUERIES[name]))


def test_only_pairs_of_chosen_sites_are_made(spark):
    assert re.search(r"s_suppkey#\d+L? IN \(1,3,5,7,9\)", plan(spark, lambda s: catalog.queries()["compressed_values"](s, SMALL)))


def test_covered_pairs_of_anchored_cuts_are_added_up_where_they_lie(spark):
    assert not re.search(r"hashpartitioning\([^)]*cell#", plan(spark, lambda s: catalog.queries()["anchored_cuts"](s, SMALL)))
