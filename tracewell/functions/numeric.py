"""Numeric expressions that must agree with IEEE half-even rounding of the exact binary value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = 134217729.0  # 2**27 + 1


def round_half_even(x: Column, digits: int) -> Column:
    """Round the exact binary value of a double, ties to even.

    Spark's own round and bround work on the shortest decimal text of the number, so 2.675 goes
    up although its binary value is below the tie. Here the product with the power of ten is
    taken as an exact sum of two doubles, so the comparison with the tie is exact.
    """
    scale = F.lit(float(10**digits))
    product = x * scale
    wide = x * F.lit(_SPLIT)
    high = wide - (wide - x)
    low = x - high
    error = (high * scale - product) + low * scale
    base = F.floor(product).cast("double")
    beyond = (product - (base + F.lit(0.5))) + error
    up = F.when(beyond > 0, 1.0).when(beyond < 0, 0.0).otherwise(F.pmod(base, F.lit(2.0)))
    return (base + up) / scale


def ratio(numerator: Column, denominator: Column, empty: float) -> Column:
    return F.when(denominator == 0, F.lit(empty)).otherwise(
        numerator.cast("double") / denominator.cast("double")
    )
