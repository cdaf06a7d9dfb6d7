"""Cells that no other cell beats in population, need and nearness to an edge, over the whole table."""

from __future__ import annotations

from siteward.operators import skyline as S
from siteward.plans.roles import CELLS, cells
from siteward.sources.tables import checkpointed

QUERIES, SQL = {}, {}
UP, DOWN, TIERS = ["population", "need"], ["y"], 3


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_GE = "o.population >= a.population AND o.need >= a.need AND o.y <= a.y"
_GT = "(o.population > a.population OR o.need > a.need OR o.y < a.y)"
_LEFT = ", ".join(f"t{k} AS (SELECT * FROM r{k} a WHERE NOT EXISTS (SELECT 1 FROM r{k} o WHERE {_GE} AND {_GT})), r{k + 1} AS (SELECT * FROM r{k} WHERE cell NOT IN (SELECT cell FROM t{k}))" for k in range(1, TIERS + 1))


@query("cell_skyline", f"WITH {CELLS} SELECT a.cell FROM cells a WHERE NOT EXISTS (SELECT 1 FROM cells o WHERE {_GE} AND {_GT})")
def front(spark, d):
    return S.skyline(checkpointed(cells(spark, d)), "cell", UP, DOWN)


@query("cell_skyline_tiers", f"WITH {CELLS}, r1 AS (SELECT * FROM cells), {_LEFT} " + " UNION ALL ".join(f"SELECT cell, CAST({k} AS BIGINT) AS tier FROM t{k}" for k in range(1, TIERS + 1)))
def tiers(spark, d):
    """The first three fronts of all cells."""
    return S.skyline_tiers(checkpointed(cells(spark, d)), "cell", UP, DOWN, TIERS)
