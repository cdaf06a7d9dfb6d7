"""Sums of doubles that don't depend on the order of rows: exact, correctly rounded, with bounds to either side.

A double is a whole number of 56 bits times a power of two.  Whole numbers are added as decimals by exponent (partial
aggregation, at most some 2,100 exponents a group), and each group's few parts are put together as fractions.

Defined results: nulls are left out, a group of nulls alone has a null sum; NaN, or infinities of both signs, give NaN;
one infinity gives itself; a sum beyond the largest double is infinite, its inner bound the largest double.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence
from fractions import Fraction

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package
BITS = 53
_SPLIT = 134217729.0  # 2**27 + 1: cuts a double into two halves whose products are exact


def _power(n: Column) -> Column:
    return F.pow(F.lit(2.0), n.cast("double"))


def rounded(parts: Sequence[tuple[int, int]]) -> tuple[float, float, float]:
    """The sum of m * 2**e as (nearest double, largest double not above, smallest not below)."""
    total = sum((Fraction(m) * Fraction(2) ** e for e, m in parts), Fraction(0))
    try:
        near = total.numerator / total.denominator
    except OverflowError:
        near = math.inf if total > 0 else -math.inf
    if math.isinf(near):
        edge = math.copysign(math.nextafter(math.inf, 0), near)
        return (near, edge, near) if near > 0 else (near, near, edge)
    back = Fraction(near)
    return near, near if back <= total else math.nextafter(near, -math.inf), near if back >= total else math.nextafter(near, math.inf)


def _put_together(parts, plus, minus, nans):
    if nans or (plus and minus):
        return (math.nan,) * 3
    if plus or minus:
        return (math.inf if plus else -math.inf,) * 3
    return rounded([(p["e"], int(p["m"])) for p in parts]) if parts else None


def exact_sums(df: DataFrame, value: str | Column, by: Sequence[str] = (), terms: bool = False) -> DataFrame:
    """by, value, low, high: the sum of a column (with ``terms``: of the arrays in it) of each group; see above."""
    x = F.col(value) if isinstance(value, str) else value
    rows = df.select(*by, (F.explode_outer(x) if terms else x.cast("double")).alias("_x"))
    x, size = F.col("_x"), F.abs("_x")
    normal = x.isNotNull() & ~F.isnan(x) & (size < float("inf"))
    # log2 may be one off; three bits more than a mantissa keep the product whole either way.
    e = F.when(normal & (x != 0), F.floor(F.log2(size)) - BITS).otherwise(F.when(normal, F.lit(0))).cast("int")
    half = F.floor(F.col("_e") / 2)
    whole = (x * _power(-half) * _power(half - F.col("_e"))).cast("long").cast("decimal(20,0)")
    rows = rows.withColumn("_e", e)
    parts = rows.groupBy(*by, "_e").agg(F.sum(F.when(F.col("_e").isNotNull(), whole)).alias("_m"), F.count_if(x == float("inf")).alias("_p"), F.count_if(x == float("-inf")).alias("_q"), F.count_if(F.isnan(x)).alias("_nan"))
    listed = F.collect_list(F.when(F.col("_e").isNotNull(), F.struct(F.col("_e").alias("e"), F.col("_m").cast("string").alias("m"))))
    together = F.udf(_put_together, "struct<value: double, low: double, high: double>")
    out = parts.groupBy(*by).agg(together(listed, F.sum("_p"), F.sum("_q"), F.sum("_nan")).alias("s"))
    return out.select(*by, "s.value", "s.low", "s.high")


def product_terms(a: Column, b: Column) -> Column:
    """a * b as an array of two doubles whose sum is exact, for products between 2**-960 and 2**960."""
    p = a * b
    high = lambda v: v * _SPLIT - (v * _SPLIT - v)
    ah, bh = high(a), high(b)
    al, bl = a - ah, b - bh
    return F.array(p, al * bl - (((p - ah * bh) - al * bh) - ah * bl))


def box_extrema(df: DataFrame, factor: str, low: str, high: str, by: Sequence[str] = ()) -> DataFrame:
    """by, least, most: bounds of sum(factor * x) over all x with low <= x <= high, rounded outwards by at most one step."""
    f, a, b = (F.col(c).cast("double") for c in (factor, low, high))
    least = exact_sums(df, product_terms(f, F.when(f >= 0, a).otherwise(b)), by, terms=True).select(*by, F.col("low").alias("least"))
    most = exact_sums(df, product_terms(f, F.when(f >= 0, b).otherwise(a)), by, terms=True).select(*by, F.col("high").alias("most"))
    return least.join(most, [*by]) if by else least.crossJoin(most)


def sum_upper(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """by, upper: the smallest double not below the sum of a column without negative values; a negative one fails."""
    x = F.when(F.col(value) < 0, F.raise_error(F.lit("a value is negative")).cast("double")).otherwise(F.col(value))
    return exact_sums(df, x, by).select(*by, F.col("high").alias("upper"))
