"""Ordered computations over keys of any size.

A window over one key sorts that key in one task. These helpers cut a key into blocks of the
ordinal instead: every block holds at most `width` rows because ordinals are unique within a
key, blocks run in parallel, and only block totals are carried from block to block, themselves
in blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 65_536


def running_sum(
    df: DataFrame,
    keys: list[str],
    ord_col: str,
    value: str,
    out: str,
    exclusive: bool = False,
    width: int = WIDTH,
    depth: int = 2,
) -> DataFrame:
    """Add `out`, the sum of `value` over the rows up to this one within `keys`."""
    end = -1 if exclusive else 0
    if depth == 0:
        w = Window.partitionBy(*keys).orderBy(ord_col).rowsBetween(Window.unboundedPreceding, end)
        return df.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)))
    block, total, carried = f"__block{depth}", f"__total{depth}", f"__carried{depth}"
    blocked = df.withColumn(block, F.expr(f"`{ord_col}` div {width}"))
    totals = blocked.groupBy(*keys, block).agg(F.sum(value).alias(total))
    carry = running_sum(totals, keys, block, total, carried, True, width, depth - 1)
    w = (
        Window.partitionBy(*keys, block)
        .orderBy(ord_col)
        .rowsBetween(Window.unboundedPreceding, end)
    )
    return (
        blocked.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)))
        .join(carry.select(*keys, block, carried), [*keys, block])
        .withColumn(out, F.col(out) + F.col(carried))
        .drop(block, carried)
    )


def row_numbers(df: DataFrame, keys: list[str], ord_col: str, out: str, width: int = WIDTH) -> DataFrame:
    """Add `out` = 1, 2, 3 … in ordinal order within `keys`."""
    one = df.withColumn("__one", F.lit(1).cast("bigint"))
    return running_sum(one, keys, ord_col, "__one", out, width=width).drop("__one")


def previous(
    df: DataFrame,
    keys: list[str],
    ord_col: str,
    value: Column,
    out: str,
    block: Column | None = None,
    width: int = WIDTH,
) -> DataFrame:
    """Add `out`, the struct (v) of the previous row's value within `keys`, or null on the first row.

    `block` overrides the block number where the order is not an integer.
    """
    b = block if block is not None else F.expr(f"`{ord_col}` div {width}")
    rows = df.withColumn("__block", b).withColumn("__value", F.struct(value.alias("v")))
    last = rows.groupBy(*keys, "__block").agg(F.max_by("__value", ord_col).alias("__last"))
    before = last.withColumn(
        "__before", F.lag("__last").over(Window.partitionBy(*keys).orderBy("__block"))
    ).select(*keys, "__block", "__before")
    w = Window.partitionBy(*keys, "__block").orderBy(ord_col)
    return (
        rows.withColumn("__lag", F.lag("__value").over(w))
        .join(before, [*keys, "__block"])
        .withColumn(out, F.coalesce("__lag", "__before"))
        .drop("__block", "__value", "__lag", "__before")
    )
