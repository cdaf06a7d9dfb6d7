from pyspark.sql import functions as F

from siteward.llm import io


def test_copies_of_a_table_are_never_broadcast(spark, monkeypatch):
    monkeypatch.setattr(io, "FEW", 3)
    rows = io.stored(spark.range(100).select((F.col("id") % 7).alias("k"), "id"))
    for n, sent in ((3, True), (5, False)):
        out = io.lookup(rows, io.stored(spark.range(n).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))), ["k"])
        assert {(x["id"], x["v"]) for x in out.collect()} == {(i, i % 7 * 10 if i % 7 < n else None) for i in range(100)}
        assert ("BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()) == sent
