"""The pipeline's stages on edge rows, and the oracles of the subpackage."""

from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siteward.llm import queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="driver tables are absent")


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("node", F.lit(1)).withColumn("n_words", F.lit("x"))
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0), (None, "plain words of a text", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(odd.withColumn("node", F.lit(1)).withColumn("n_words", F.lit("x")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(DATA))
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count()
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert docs.filter("text LIKE '%@mail%'").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(DATA))
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(DATA)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_duckdb(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    mine, theirs = queries.queries()[name](spark, str(DATA)).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    plain = lambda v: v if isinstance(v, str) else None if pd.isna(v) else float(v)
    rows = lambda df: sorted(repr([plain(v) for v in r]) for r in df[sorted(df)].astype(object).values.tolist())
    assert rows(mine) == rows(theirs)
