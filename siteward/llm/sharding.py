"""Sharding by a Feistel permutation with cycle walking over global row numbers.

DataFrame functions only.  Rows get global numbers 0..N-1 in the order of
(bucket of the hash, key, size, checksum, piece); a keyed permutation of 0..N-1 shuffles them; the
permuted number p gives shard ``p mod shards`` and slot ``p div shards``, so shard sizes differ
by one row at most and a row's place can be computed without moving any other row.

Defined results: null text has no bytes (size ``OVERHEAD``, checksum 0); a null key is a key of
its own; rows that repeat are numbered one after another; an empty table gives no rows; other
columns of the input play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteward.llm.io import stored

OVERHEAD = 16
PIECE = 1 << 14
BUCKET_ROWS, LEAST_BUCKETS = 20_000, 64
ROUNDS = 6
WALK = 32


def _round_value(key: Column, half: Column) -> Column:
    return F.xxhash64(key, half)


def permuted(number: Column, total: int, seed: int) -> Column:
    """A bijection of 0..total-1: an alternating Feistel network on a rows x b columns >= total,
    applied again while its value lies outside (cycle walking).  Fewer than a values lie outside,
    so a walk of WALK steps ends for every total up to WALK**2 and, above, fails with a chance
    under (1/sqrt(total))**WALK; such a row raises an error and is never misplaced."""
    a = max(1, int(total**0.5))
    while a * a < total:
        a += 1
    b = max(1, -(-total // a))
    keys = F.array(*[F.lit(seed * 1_000_003 + r * 7919).cast("long") for r in range(ROUNDS)])

    def once(x: Column) -> Column:
        start = F.struct(F.floor((x - x % F.lit(b)) / F.lit(b)).cast("long").alias("l"), (x % F.lit(b)).cast("long").alias("r"))

        def step(s: Column, k: Column) -> Column:
            left = F.pmod(s["l"] + F.pmod(_round_value(k, s["r"]), F.lit(a).cast("long")), F.lit(a).cast("long"))
            return F.struct(left.alias("l"), s["r"].alias("r"))

        def both(s: Column, k: Column) -> Column:
            t = step(s, k)
            right = F.pmod(s["r"] + F.pmod(_round_value(-k, t["l"]), F.lit(b).cast("long")), F.lit(b).cast("long"))
            return F.struct(t["l"].alias("l"), right.alias("r"))

        return F.aggregate(keys, start, both, lambda s: s["l"] * F.lit(b).cast("long") + s["r"])

    n = F.lit(total).cast("long")
    first = once(number.cast("long"))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda x, _: F.when(x < n, x).otherwise(once(x)))
    return walked


def shard_rows(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", seed: int = 20240) -> DataFrame:
    """Columns: key, size, text_crc32, row_number, shard, slot.  Equal rows are counted before the
    shuffle and travel as pieces of at most ``PIECE`` rows, each in a bucket of its own, so a row that
    makes up a third of the table is the work of many tasks."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("k"),
        (F.octet_length(body) + OVERHEAD).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
    )
    rows = rows.groupBy("k", "size", "text_crc32").agg(F.count("*").alias("n"))
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / PIECE).cast("long"))))
    rows = stored(rows.select("k", "size", "text_crc32", "piece", F.least(F.lit(PIECE).cast("long"), F.col("n") - F.col("piece") * PIECE).alias("m"), F.xxhash64("k", "size", "text_crc32", "piece").alias("h")))
    pieces, total = rows.agg(F.count("*"), F.coalesce(F.sum("m"), F.lit(0))).collect()[0]
    if not total:
        return rows.select(F.col("k").alias(key), "size", "text_crc32", *[F.lit(None).cast(t).alias(c) for c, t in (("row_number", "long"), ("shard", "int"), ("slot", "long"))]).limit(0)
    rows = rows.withColumn("bucket", F.pmod("h", F.lit(max(LEAST_BUCKETS, -(-pieces // BUCKET_ROWS)))))
    # One row a bucket; its own task adds them up.
    ahead = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("bucket").agg(F.sum("m").alias("rows")).select("bucket", F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("base"))
    order = Window.partitionBy("bucket").orderBy(F.col("k").asc_nulls_first(), "size", "text_crc32", "piece")
    rows = rows.withColumn("before", F.sum("m").over(order.rowsBetween(Window.unboundedPreceding, -1))).join(base, "bucket")
    first = F.col("base") + F.coalesce("before", F.lit(0))
    rows = rows.select("k", "size", "text_crc32", F.explode(F.sequence(first, first + F.col("m") - 1)).alias("row_number"))
    rows = rows.withColumn("p", permuted(F.col("row_number"), total, seed))
    rows = rows.withColumn("p", F.when(F.col("p") < total, F.col("p")).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long")))
    return rows.select(
        F.col("k").alias(key), "size", "text_crc32", "row_number",
        F.pmod(F.col("p"), F.lit(shards)).cast("int").alias("shard"),
        F.floor((F.col("p") - F.pmod(F.col("p"), F.lit(shards))) / F.lit(shards)).cast("long").alias("slot"),
    )


def digest(docs: DataFrame, shards: int = 40) -> DataFrame:
    out = shard_rows(docs, shards)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
