"""Readers: tables of a folder, files by suffix, typed CSV, and the shared folder for lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_any(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """csv (with a header), json lines, or parquet, by suffix; compressed suffixes are looked through."""
    kind = path.lower().removesuffix(".gz").removesuffix(".zst").rsplit(".", 1)[-1]
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if kind == "csv":
        return reader.option("header", True).option("mode", "FAILFAST").csv(path)
    if kind in ("json", "jsonl"):
        return reader.json(path)
    if kind == "parquet":
        return reader.parquet(path)
    raise ValueError(f"no reader for {path}")


CP949 = "x-windows-949"


def read_korean_csv(spark: SparkSession, path: str, names: Mapping[str, str]) -> DataFrame:
    """A CP949 file with columns renamed.  Spark reads it byte by byte as Latin-1 and decodes columns and header
    itself, so no session setting is needed; bytes that are no CP949 fail."""
    raw = spark.read.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    header = {c.encode("latin-1").decode("cp949"): c for c in raw.columns}
    missing = sorted(set(names) - set(header))
    if missing:
        raise ValueError(f"columns are missing: {missing}")

    def decode(batches):
        for pdf in batches:
            yield pdf.apply(lambda c: c.map(lambda v: v.encode("latin-1").decode("cp949"), na_action="ignore"))

    picked = raw.select(*[F.col(f"`{header[a]}`").alias(b) for a, b in names.items()])
    return picked.mapInPandas(decode, picked.schema)


def monthly_utilisation(rows: DataFrame, province: str, regions: Mapping[str, str]) -> DataFrame:
    """year, month, region, service, persons, visits: one province's districts merged into regions by the start of
    their names; counts with thousands separators; any other text in a count fails."""
    region = F.lit(None).cast("string")
    for start, name in regions.items():
        region = F.when(F.startswith(F.trim("district"), F.lit(start)), name).otherwise(region)
    number = lambda c: F.regexp_replace(F.trim(c), ",", "").cast("long")
    mine = rows.filter(F.trim("province") == province)
    return mine.groupBy(F.col("year").cast("long").alias("year"), F.col("month").cast("long").alias("month"), region.alias("region"), F.trim("service").alias("service")).agg(F.sum(number("persons")).alias("persons"), F.sum(number("visits")).alias("visits"))


#: Where an answer may hold its items, and the names of their fields: fixed by the service.
ITEM_PATHS = ("$.response.body.items.item", "$.items.item", "$")
ITEM = "struct<locdate: string, date: string, dateName: string, name: string, isHoliday: string>"


def holidays(payloads: DataFrame, column: str) -> DataFrame:
    """date, name of the public holidays in JSON answers (one a row); a day is listed once.

    An answer is the service's envelope, its ``items`` alone, or a bare list; items are a list or, where there is just
    one, an object; an envelope without items has none.  Any other answer, and an item without a date, fails."""
    text = F.trim(F.col(column))
    whole = F.get_json_object(text, "$.response")
    some = F.when(whole.isNotNull(), F.get_json_object(text, ITEM_PATHS[0])).when(F.get_json_object(text, "$.items").isNotNull(), F.get_json_object(text, ITEM_PATHS[1])).otherwise(text)
    enveloped = whole.isNotNull() | F.get_json_object(text, "$.items").isNotNull()
    form = F.when(F.startswith(some, F.lit("[")), "list").when(F.startswith(some, F.lit("{")) & (enveloped | F.get_json_object(text, "$.locdate").isNotNull() | F.get_json_object(text, "$.date").isNotNull()), "object")
    form = form.when(enveloped & (F.coalesce(some, F.lit("")) == ""), "none")
    bad = F.raise_error(F.concat(F.lit("an answer of unknown form: "), F.coalesce(F.substring(text, 1, 80), F.lit("null"))))
    listed = F.when(form == "list", some).when(form == "object", F.concat(F.lit("["), some, F.lit("]"))).when(form == "none", "[]").otherwise(bad)
    items = F.from_json(listed, f"array<{ITEM}>", {"mode": "FAILFAST"})
    rows = payloads.select(F.explode(items).alias("i")).select(F.coalesce("i.locdate", "i.date").alias("day"), F.coalesce("i.dateName", "i.name", F.lit("official_holiday")).alias("name"), F.upper("i.isHoliday").alias("off"))
    day = F.coalesce(F.try_to_date("day", "yyyyMMdd"), F.try_to_date("day", "yyyy-MM-dd"))
    day = F.when(day.isNotNull(), day).otherwise(F.raise_error(F.concat(F.lit("an item's date is bad: "), F.coalesce("day", F.lit("null")))).cast("date"))
    return rows.filter(F.coalesce(F.col("off") == "Y", F.lit(True))).groupBy(day.alias("date")).agg(F.min("name").alias("name"))


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all executors share; where it is unset, a temporary folder on a local master alone."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut: a table written where all executors can read it, with statistics of its size."""
    spark = df.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out.stored_at = at
    return out


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df in as many partitions as shuffles have: AQE, which goes by bytes, would leave a small table that joins make many
    rows of to a few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def forget(*tables: DataFrame) -> None:
    """Deletes the folders of tables that ``checkpointed`` wrote and that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def first_existing(columns: Sequence[str], aliases: Sequence[str]) -> str | None:
    """The first alias that is a column, whatever its case."""
    by = {c.lower(): c for c in columns}
    return next((by[a.lower()] for a in aliases if a.lower() in by), None)


def string_key(x: Column) -> Column:
    """Numeric ids as strings without ``.0``, trimmed."""
    return F.regexp_replace(F.trim(x.cast("string")), r"\.0$", "")


def metric_bounds(x: Column) -> tuple[Column, Column, Column]:
    """A count with thousands separators: value, low, high; a suppressed ``*`` is null within 0..4."""
    plain = F.regexp_replace(F.trim(x), ",", "")
    value = plain.try_cast("double")
    low = F.when(plain == "*", 0.0).otherwise(value)
    return value, low, F.when(plain == "*", 4.0).otherwise(value)


def tri_state(x: Column) -> Column:
    """yes / no / unknown words as 1, 0, -1."""
    word = F.lower(F.trim(x.cast("string")))
    return F.when(word.isin("1", "true", "yes", "y"), 1).when(word.isin("0", "false", "no", "n"), 0).otherwise(-1)


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df, failing at run time if keys repeat."""
    bad = df.groupBy(*keys).count().agg(F.max("count").alias("_n"))
    checked = bad.select(F.when(F.coalesce("_n", F.lit(0)) > 1, F.raise_error(F.lit(f"keys repeat: {list(keys)}")).cast("int")).otherwise(F.lit(1)).alias("_ok"))
    return df.crossJoin(F.broadcast(checked)).filter("_ok = 1").drop("_ok")


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """n, fingerprint: a content hash that doesn't depend on the order of rows or columns, and counts repeated rows.

    Hashes of rows are added, 60 bits twice, so any number of tasks can share the work.  A null differs from every
    text, and the lengths in front keep values apart; an empty table's sums are 0."""
    texts = [F.col(c).cast("string") for c in sorted(columns or df.columns)]
    row = F.concat_ws(",", *[F.when(t.isNull(), "~").otherwise(F.concat(F.length(t).cast("string"), F.lit(":"), t)) for t in texts])
    part = lambda i: F.coalesce(F.sum(F.conv(F.substring("_h", i, 15), 16, 10).cast("decimal(28,0)")), F.lit(0)).cast("string")
    return df.select(F.md5(row.cast("binary")).alias("_h")).agg(F.count("*").alias("n"), F.concat_ws("-", part(1), part(16)).alias("fingerprint"))


def iso_date(x: Column) -> Column:
    """A date in ISO form, with slashes or dots, or eight digits; null for anything else."""
    plain = F.regexp_replace(F.trim(x.cast("string")), "[./]", "-")
    return F.coalesce(F.try_to_date(plain, "yyyy-MM-dd"), F.try_to_date(plain, "yyyyMMdd"))


def unit_interval(x: Column, low: Column, high: Column, invert: bool = False) -> Column:
    """Min-max of x to 0..1; 0 where it is null or all are equal."""
    share = F.when((high > low) & x.isNotNull(), (x - low) / (high - low)).otherwise(0.0)
    return 1.0 - share if invert else share


def korean_wgs84(lat: Column, lon: Column) -> Column:
    """Whether a coordinate is finite and lies in the country's bounds (fixed values)."""
    return F.coalesce(~F.isnan(lat) & ~F.isnan(lon) & lat.between(30.0, 40.0) & lon.between(120.0, 135.0), F.lit(False))


def valid_address(x: Column) -> Column:
    """Whether an address is written at all, and not one of the words for none (fixed values)."""
    return F.coalesce(~F.lower(F.trim(x)).isin("", "unknown", "none", "n/a", "na", "nan", "null", "tbd"), F.lit(False))


def field_status(x: Column) -> Column:
    """Words of field notes as verified, not_verified or unknown; all other words are unknown."""
    word = F.regexp_replace(F.lower(F.trim(x.cast("string"))), "[- ]", "_")
    # The words of field forms.
    good = word.isin("true", "yes", "y", "verified", "pass", "available", "1", "확인")
    bad = word.isin("false", "no", "n", "not_verified", "fail", "unavailable", "0", "불가")
    return F.when(good, "verified").when(bad, "not_verified").otherwise("unknown")


def floor_share(value: Column, share: float) -> Column:
    return F.floor(value * share + 1e-9).cast("long")


def ceil_share(value: Column, share: float) -> Column:
    return F.ceil(value * share - 1e-9).cast("long")


def read_coverage(spark: SparkSession, path: str, matrix: str, column: str = "matrix_id") -> DataFrame:
    """One matrix of a coverage table (site, cell, weight): only its folder is read."""
    return spark.read.parquet(path).filter(F.col(column) == matrix).drop(column)


def checked_coverage(cover: DataFrame, sites: DataFrame, cells: DataFrame) -> DataFrame:
    """cover, failing at run time on pairs that repeat, on ids that the two tables don't hold, and on weights that are
    null or negative."""
    s, c = sites.select("site", F.lit(1).alias("_s")).distinct(), cells.select("cell", F.lit(1).alias("_c")).distinct()
    once = cover.groupBy("site", "cell").agg(F.count("*").alias("_n"), F.max("weight").alias("weight"))
    rows = once.join(s, "site", "left").join(c, "cell", "left")
    fault = F.when(F.col("_n") > 1, "repeated pair").when(F.col("_s").isNull(), "unknown site").when(F.col("_c").isNull(), "unknown cell").when(F.coalesce(F.col("weight") < 0, F.lit(True)), "bad weight")
    good = F.when(fault.isNotNull(), F.raise_error(F.concat(F.lit("coverage: "), fault)).cast("double")).otherwise(F.col("weight"))
    return rows.select("site", "cell", good.alias("weight"))


def read_folder(spark: SparkSession, folder: str, names: Mapping[str, Sequence[str]], suffix: str = "csv") -> dict[str, DataFrame]:
    """The named tables of a folder, each with at least the given columns; all that is missing is told at once."""
    out, missing = {}, []
    for name, columns in names.items():
        df = read_any(spark, f"{folder.rstrip('/')}/{name}.{suffix}")
        missing += [f"{name}.{c}" for c in columns if c not in df.columns]
        out[name] = df
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    return out
