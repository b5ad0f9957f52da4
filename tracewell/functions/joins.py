"""Join helper for skewed keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def spread_join(
    many: DataFrame, few: DataFrame, keys: list[str], spread_by: list[str], how: str = "inner"
) -> DataFrame:
    """Equi-join for hot keys: rows of `many` are spread over salts, rows of `few` are repeated."""
    salted = many.withColumn("__salt", F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)).cast("int"))
    repeated = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(repeated, [*keys, "__salt"], how).drop("__salt")
