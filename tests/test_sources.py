"""Readers and parsing rules on small files."""

import pytest
from pyspark.sql import functions as F

from siteward.sources import sinks
from siteward.sources import tables as T

HEAD = ("연도", "월", "시도", "시군구", "진료과", "인원", "건수")
NAMES = dict(zip(HEAD, ("year", "month", "province", "district", "service", "persons", "visits"), strict=True))


def test_korean_file_is_merged_into_regions(spark, tmp_path):
    rows = [("2020", "1", "충북", "청주시상당구", "내과", "1,000", "2,500"), ("2020", "1", "충북", "청주시흥덕구", "내과", "5", "10"), ("2020", "1", "서울", "중구", "내과", "9", "9"), ("2020", "2", "충북", "충주시", "외과", "7", "8")]
    path = tmp_path / "monthly.csv"
    path.write_bytes("\n".join([",".join(HEAD)] + [",".join(f'"{v}"' for v in r) for r in rows]).encode("cp949"))
    df = T.read_korean_csv(spark, str(path), NAMES)
    out = sorted(tuple(r) for r in T.monthly_utilisation(df, "충북", {"청주": "청주시", "충주": "충주시"}).collect())
    assert out == [(2020, 1, "청주시", "내과", 1005, 2510), (2020, 2, "충주시", "외과", 7, 8)]
    with pytest.raises(ValueError):
        T.read_korean_csv(spark, str(path), {"없음": "x"})


def test_coverage_is_written_read_and_checked(spark, tmp_path):
    cover = spark.createDataFrame([(1, 1, 1.0, "a"), (1, 2, 0.5, "a"), (2, 1, 1.0, "b")], "site long, cell long, weight double, matrix_id string")
    sinks.write_coverage(cover, str(tmp_path / "cover"))
    a = T.read_coverage(spark, str(tmp_path / "cover"), "a")
    sites, cells = spark.createDataFrame([(1,)], "site long"), spark.createDataFrame([(1,), (2,)], "cell long")
    assert sorted(tuple(r) for r in T.checked_coverage(a, sites, cells).collect()) == [(1, 1, 1.0), (1, 2, 0.5)]
    for bad in (a.union(a), a.withColumn("site", F.lit(9).cast("long")), a.withColumn("weight", F.lit(-1.0))):
        with pytest.raises(Exception, match="coverage"):
            T.checked_coverage(bad, sites, cells).collect()


def test_folder_names_all_that_is_missing(spark, tmp_path):
    (tmp_path / "bases.csv").write_text("team,base\n1,2\n")
    (tmp_path / "days.csv").write_text("team\n1\n")
    assert T.read_folder(spark, str(tmp_path), {"bases": ["team"], "days": ["team"]})["bases"].count() == 1
    with pytest.raises(ValueError, match="bases.kind.*days.day"):
        T.read_folder(spark, str(tmp_path), {"bases": ["kind"], "days": ["day"]})


def test_dates_and_words(spark):
    d = spark.createDataFrame([("2024-02-29",), ("2023-02-29",), ("2024/01/05",), ("20240105",), ("soon",), (None,)], "w string")
    assert [str(r[0]) for r in d.select(T.iso_date(F.col("w"))).collect()] == ["2024-02-29", "None", "2024-01-05", "2024-01-05", "None", "None"]


def test_fingerprints_count_rows_in_any_order(spark):
    rows = [(1, "a", None), (2, "", "x,1:y"), (2, "", "x,1:y"), (3, None, "z")]
    make = lambda r: spark.createDataFrame(r, "n long, a string, b string")
    of = lambda df: tuple(T.fingerprint(df).collect()[0])
    one = of(make(rows))
    assert one[0] == 4 and one == of(make(rows[::-1]).repartition(3).select("b", "n", "a"))
    others = [rows[:3], rows + rows[:1], [*rows[:3], (3, "", "z")], [*rows[:3], (3, "z", None)], [(1, "a", "~"), *rows[1:]]]
    assert len({one, *[of(make(r)) for r in others]}) == 6
    assert of(make([])) == (0, "0-0")


def test_profile_ranks_and_shares_of_one_key(spark):
    from siteward.operators import review, universe

    axes = spark.createDataFrame([(u, a, s) for u, x, y in [(1, 10.0, 0.0), (2, 10.0, 0.0), (3, 0.0, 30.0), (4, None, None)] for a, s in (("x", x), ("y", y))], "unit long, axis string, score double")
    got = {(r["profile"], r["unit"]): r["rank"] for r in review.profile_runs(axes, {"x": {"x": 1.0}, "both": {"x": 1.0, "y": 1.0}}).collect()}
    assert got == {("x", 1): 1, ("x", 2): 2, ("x", 3): 3, ("x", 4): None, ("both", 3): 1, ("both", 1): 2, ("both", 2): 3, ("both", 4): None}
    rows = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 6.0)], "item string, n double, d double")
    assert {(r["item"], r["share"]) for r in universe.prior_grid(rows, "n", "d", [2.0], ["item"]).collect()} == {("a", 0.5), ("b", 0.5)}
