"""Readers and small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


ARROW_ROWS, ARROW_BYTES = 2000, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of a few MB, so that a Python worker's memory doesn't follow the length of texts;
    what the session sets itself stays.  Queries call this once, before they build their plan."""
    for key, value, default in (("maxRecordsPerBatch", ARROW_ROWS, 10_000), ("maxBytesPerBatch", ARROW_BYTES, (1 << 31) - 1)):
        name = f"spark.sql.execution.arrow.{key}"
        if str(spark.conf.get(name, str(default))).rstrip("bB") in (str(default), str(1 << 31)):
            spark.conf.set(name, str(value))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.  Where it is unset, a temporary folder
    stands in on a local master (tests); a cluster must name one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out.stored_at = at
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes the folders of tables that ``stored`` wrote and that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone; a null counts as empty."""
    return F.translate(F.coalesce(c, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shipped(spark: SparkSession, value: object) -> Broadcast:
    """value for all executors, its classes included; ``pickle.loads(x.value)`` gives it back."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


SALTS, FEW = 32, 50_000


def lookup(rows: DataFrame, table: DataFrame, on: list[str], how: str = "left", salts: int = SALTS) -> DataFrame:
    """rows joined with a table of one row a key.  A key may hold any share of rows: they are dealt over ``salts`` tasks in
    turn, and the table's rows go to each.  rows are read from tables, so that a task run again deals them alike.

    A stored table of up to FEW rows is sent whole instead.  The copies never are: Spark takes them for no larger than the
    table's file, packed, and would gather ``salts`` times as many rows in the driver's memory to send them."""
    if hasattr(table, "stored_at") and table.count() <= FEW:
        return rows.join(F.broadcast(table), on, how)
    dealt = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies.hint("merge"), [*on, "_salt"], how).drop("_salt")
