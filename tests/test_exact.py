"""Exact sums against fractions on adversarial rows, whatever the order and the partitions."""

from __future__ import annotations

import math
import random
import struct
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from siteward.functions import exact as E


def hard(seed, n):
    r = random.Random(seed)
    out = [struct.unpack("<d", r.getrandbits(64).to_bytes(8, "little"))[0] for _ in range(n)]
    out = [v for v in out if math.isfinite(v)]
    return out + [-v for v in out[::2]] + [5e-324, -5e-324, 2.2250738585072014e-308, 1.0, 1e16, -1e16, 0.1, -0.0, 2.0**52 + 0.5, 2.0**-1022] + [1e-300] * 9


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_sums_are_fractions_rounded_once(spark, seed):
    r = random.Random(seed)
    groups = {"all": hard(seed, 300), "small": [v for v in hard(seed + 9, 60) if abs(v) < 1e-200], "mid": [r.uniform(-1, 1) * 10 ** r.randint(-9, 9) for _ in range(500)], "one": [0.1], "zero": [1.5, -1.5]}
    groups["all"] = [v for v in groups["all"] if abs(v) < 1e300]
    rows = [(g, v) for g, x in groups.items() for v in x]
    want = {g: sum(map(Fraction, x), Fraction(0)) for g, x in groups.items()}
    for parts in (1, 7):
        r.shuffle(rows)
        d = spark.createDataFrame([*rows, ("one", None), ("none", None)], "g string, v double").repartition(parts)
        got = {x["g"]: (x["value"], x["low"], x["high"]) for x in E.exact_sums(d, "v", ["g"]).collect()}
        assert got.pop("none") == (None, None, None)
        assert got.keys() == want.keys()
        for g, (value, low, high) in got.items():
            assert value == float(want[g]) and Fraction(low) <= want[g] <= Fraction(high)
            assert (low == high) == (Fraction(value) == want[g]) and high <= math.nextafter(low, math.inf)


def test_values_that_are_no_numbers(spark):
    inf, big = math.inf, 1.7976931348623157e308
    rows = [("a", inf), ("a", 1.0), ("b", inf), ("b", -inf), ("c", math.nan), ("c", 1.0), ("d", -inf), ("e", big), ("e", big)]
    got = {x["g"]: (x["value"], x["low"], x["high"]) for x in E.exact_sums(spark.createDataFrame(rows, "g string, v double"), "v", ["g"]).collect()}
    assert got["a"] == (inf,) * 3 and got["d"] == (-inf,) * 3 and got["e"] == (inf, big, inf)
    assert all(math.isnan(v) for v in got["b"] + got["c"])
    assert E.exact_sums(spark.createDataFrame([], "g string, v double"), "v", ["g"]).count() == 0


def test_extrema_hold_the_exact_ones(spark):
    r = random.Random(4)
    rows = []
    for i in range(400):
        a = r.uniform(-1, 1) * 10 ** r.randint(-5, 5)
        rows.append((i % 3, r.uniform(-1, 1) * 10 ** r.randint(-5, 5), a, a + r.random()))
    got = {x["g"]: (x["least"], x["most"]) for x in E.box_extrema(spark.createDataFrame(rows, "g long, f double, a double, b double"), "f", "a", "b", ["g"]).collect()}
    for g in range(3):
        low = sum(min(Fraction(f) * Fraction(a), Fraction(f) * Fraction(b)) for k, f, a, b in rows if k == g)
        high = sum(max(Fraction(f) * Fraction(a), Fraction(f) * Fraction(b)) for k, f, a, b in rows if k == g)
        least, most = got[g]
        assert Fraction(least) <= low < Fraction(math.nextafter(least, math.inf)) and Fraction(math.nextafter(most, -math.inf)) < high <= Fraction(most)


def test_upper_bound_of_what_is_not_negative(spark):
    d = spark.createDataFrame([(0.1,)] * 10, "v double")
    upper = E.sum_upper(d, "v").collect()[0][0]
    assert Fraction(math.nextafter(upper, 0)) < 10 * Fraction(0.1) <= Fraction(upper)
    with pytest.raises(Exception, match="negative"):
        E.sum_upper(d.withColumn("v", F.lit(-1.0)), "v").collect()
