"""Writers: parquet, CSV and JSON folders, and sparse coverage partitioned by its matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """By suffix: .csv, .csv.gz, .json or else parquet (zstd)."""
    low = path.lower()
    writer = df.write.mode(mode)
    if low.endswith((".csv", ".csv.gz")):
        writer.option("header", True).option("compression", "gzip" if low.endswith(".gz") else "none").csv(path)
    elif low.endswith(".json"):
        writer.json(path)
    else:
        writer.option("compression", "zstd").parquet(path)


def write_coverage(cover: DataFrame, path: str, matrix: str = "matrix_id") -> None:
    """COO rows (site, cell, weight), one folder per matrix."""
    cover.write.mode("overwrite").partitionBy(matrix).option("compression", "zstd").parquet(path)


def write_template(spark, columns: Sequence[str], path: str) -> None:
    """A CSV of a header alone."""
    spark.createDataFrame([], ", ".join(f"{c} string" for c in columns)).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
