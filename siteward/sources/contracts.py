"""Tables that stages hand on: typed rows whose rules are counted while they are written, published only if all hold."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType, StructType

from siteward.sources.tables import shared_dir


class Refused(ValueError):
    """A table that broke its contract; ``broken``: violations by rule."""

    def __init__(self, name: str, broken: Mapping[str, int]):
        super().__init__(f"{name}: {', '.join(f'{rule} ({n})' for rule, n in broken.items())}")
        self.broken = dict(broken)


@dataclass(frozen=True)
class Contract:
    """columns: the types handed on, those that are not nullable must be there in every row (a blank string and a number that
    isn't finite are not there); key: columns that no two rows share; rules: SQL conditions by name, of which null is
    a violation; forbidden: names, in any case, that must not be columns; extra: whether others may follow; rows: how many there must be, if known."""

    name: str
    columns: StructType
    key: Sequence[str] = ()
    rules: Mapping[str, str] = field(default_factory=dict)
    forbidden: Sequence[str] = ()
    extra: bool = False
    rows: int | None = None

    def shape(self, df: DataFrame) -> None:
        """Fails at once, before any row is read, on columns that are missing, forbidden or not asked for."""
        have = {c.lower() for c in df.columns}
        asked = {f.name.lower() for f in self.columns}
        faults = {f"column {c} is missing": 0 for c in sorted(asked - have)}
        faults |= {f"column {c} is forbidden": 0 for c in sorted(have & {c.lower() for c in self.forbidden})}
        if not self.extra:
            faults |= {f"column {c} is not asked for": 0 for c in sorted(have - asked)}
        if faults:
            raise Refused(self.name, faults)


def _there(f) -> Column:
    c = F.col(f.name)
    if isinstance(f.dataType, StringType):
        return F.coalesce(F.trim(c) != "", F.lit(False))
    if isinstance(f.dataType, (DoubleType, FloatType)):
        return c.isNotNull() & ~F.isnan(c) & ~F.abs(c).isin(float("inf"))
    return c.isNotNull()


def observed(df: DataFrame, contract: Contract) -> tuple[DataFrame, Observation]:
    """(typed rows, the counts that any action on them fills in).

    The counts stand at the end of the plan, so writing the rows takes them in the same pass: the
    table is not read twice.  A key adds one exchange and a sort, and never an aggregate of a whole group: the rows of a
    key are numbered, and each beyond the first is a violation."""
    contract.shape(df)
    names = [f.name for f in contract.columns]
    more = [c for c in df.columns if c.lower() not in {n.lower() for n in names}]
    typed = [F.col(f.name).try_cast(f.dataType).alias(f.name) for f in contract.columns]
    spoilt = [(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull()).alias(f"_bad{i}") for i, f in enumerate(contract.columns)]
    rows = df.select(*typed, *more, *spoilt)
    good = {f"{f.name} is no {f.dataType.simpleString()}": ~F.col(f"_bad{i}") for i, f in enumerate(contract.columns)}
    good |= {f"{f.name} is not there": _there(f) for f in contract.columns if not f.nullable}
    if contract.key:
        rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*contract.key).orderBy(*contract.key)))
        good["key repeats"] = F.col("_nth") == 1
    good |= {name: F.expr(rule) for name, rule in contract.rules.items()}
    seen = Observation(f"{contract.name}-{uuid.uuid4().hex}")
    counts = [F.count_if(~F.coalesce(c, F.lit(False))).alias(f"violations of {name}") for name, c in good.items()]
    return rows.observe(seen, F.count("*").alias("rows"), *counts).select(*names, *more), seen


def verdict(contract: Contract, seen: Observation) -> list[tuple[str, int, int]]:
    """(rule, rows, violations) of an observation whose action has ended, the count of rows among the rules."""
    counts = dict(seen.get)
    rows = counts.pop("rows", 0)
    out = [(name.removeprefix("violations of "), rows, n) for name, n in counts.items()]
    if contract.rows is not None:
        out.append((f"rows are not {contract.rows}", rows, abs(rows - contract.rows)))
    return out


def publish(df: DataFrame, contract: Contract, path: str) -> list[tuple[str, int, int]]:
    """Writes the rows of a contract to ``path`` and returns (rule, rows, violations).

    Rows go to a folder beside it, which takes the path's place only after every rule held; else
    the folder is deleted, ``Refused`` tells all broken rules, and what stood at the path stays as it was.  An empty table
    keeps every rule but a count of rows.  A write that fails leaves the path alone too."""
    spark = df.sparkSession
    to = spark._jvm.org.apache.hadoop.fs.Path
    path = path.rstrip("/")
    staged, final, aside = to(f"{path}.staged-{uuid.uuid4().hex}"), to(path), to(f"{path}.before-{uuid.uuid4().hex}")
    files = final.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    try:
        rows, seen = observed(df, contract)
        rows.write.option("compression", "zstd").parquet(staged.toString())
        report = verdict(contract, seen)
        broken = {rule: n for rule, _, n in report if n}
        if broken:
            raise Refused(contract.name, broken)
        stood = files.exists(final)
        if stood and not files.rename(final, aside):
            raise OSError(f"{path} can't be set aside")
        if not files.rename(staged, final):
            if stood:
                files.rename(aside, final)
            raise OSError(f"{path} can't be put in place")
        if stood:
            files.delete(aside, True)
    finally:
        files.delete(staged, True)
    return report


def handed_on(df: DataFrame, contract: Contract) -> DataFrame:
    """df's typed rows, published in the shared folder and read back."""
    at = f"{shared_dir(df.sparkSession).rstrip('/')}/{contract.name}-{uuid.uuid4().hex}"
    publish(df, contract, at)
    return df.sparkSession.read.parquet(at)


def audited(df: DataFrame, contract: Contract) -> DataFrame:
    """rule, rows, violations of a contract, in one pass that writes nothing."""
    rows, seen = observed(df, contract)
    rows.write.format("noop").mode("overwrite").save()
    return df.sparkSession.createDataFrame(verdict(contract, seen), "rule string, rows long, violations long")
