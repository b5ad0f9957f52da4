"""Set operations and whole-table comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def reference_gap(cited: DataFrame, known: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Distinct cited items with whether they are known."""
    exists = known.select(*keys, item).distinct().withColumn("__known", F.lit(True))
    return (
        cited.select(*keys, item).distinct().join(exists, [*keys, item], "left")
        .withColumn("known", F.col("__known").isNotNull()).drop("__known")
    )


def merge_evidence(left: DataFrame, right: DataFrame, keys: list[str], item: str, pos: str = "pos") -> DataFrame:
    """Ordered union of two id lists: left first, first position of each id."""
    a = left.select(*keys, item, F.lit(0).alias("side"), pos)
    b = right.select(*keys, item, F.lit(1).alias("side"), pos)
    return a.unionByName(b).groupBy(*keys, item).agg(F.min(F.struct("side", pos)).alias("at")).select(
        *keys, item, F.col("at.side").alias("side"), F.col(f"at.{pos}").alias(pos)
    )


def row_text(df: DataFrame, columns: list[str]):
    return F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])


def compare_tables(pairs: dict[str, tuple[DataFrame | None, DataFrame | None]]) -> DataFrame:
    """Existence, row count and order-free content digest of each table on both sides."""

    def side(name, df, label):
        if df is None:
            return None
        digest = df.select(X.sha_int(row_text(df, sorted(df.columns))).alias("d"))
        return digest.agg(F.count("*").alias("n"), F.sum(F.col("d").cast("decimal(38,0)")).cast("string").alias("digest")).select(
            F.lit(name).alias("table"), F.lit(label).alias("side"), "n", "digest"
        )

    parts = [side(n, df, s) for n, ab in pairs.items() for s, df in zip(("a", "b"), ab) if df is not None]
    rows = reduce(DataFrame.unionByName, parts)
    of = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    return rows.groupBy("table").agg(
        of("a", "n").alias("n_a"), of("b", "n").alias("n_b"), of("a", "digest").alias("da"), of("b", "digest").alias("db")
    ).select(
        "table", "n_a", "n_b",
        F.when(F.col("n_a").isNull() | F.col("n_b").isNull(), "missing table")
        .when(F.col("n_a") != F.col("n_b"), "row count").when(F.col("da") != F.col("db"), "content").otherwise("same")
        .alias("verdict"),
    )


def canonical_diff(a: DataFrame, b: DataFrame, keys: list[str], volatile: list[str] = ()) -> DataFrame:
    """Fields that differ between two versions of a table, volatile ones left out."""
    fields = [c for c in a.columns if c not in keys and c not in volatile]
    pack = lambda df, s: df.select(*keys, F.struct(*[F.col(c).cast("string").alias(c) for c in fields]).alias(s))
    both = pack(a, "a").join(pack(b, "b"), keys, "full")
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"a.{c}").alias("before"), F.col(f"b.{c}").alias("after")) for c in fields])
    present = F.col("a").isNotNull() & F.col("b").isNotNull()
    changed = both.where(present).select(*keys, F.explode(cells).alias("c")).where(~F.col("c.before").eqNullSafe(F.col("c.after")))
    one_sided = both.where(~present).select(
        *keys, F.lit("*").alias("field"), F.when(F.col("a").isNotNull(), "present").alias("before"),
        F.when(F.col("b").isNotNull(), "present").alias("after"),
    )
    return changed.select(*keys, "c.field", "c.before", "c.after").unionByName(one_sided)


# ---- row detail, by a tree of digests over ranges of key hashes ----

#: Hexadecimal digits of a key's hash that name a range; a node of level l is a prefix of l digits.
LEAF_DIGITS = 3


def _ranges(df: DataFrame, keys: list[str]) -> DataFrame:
    columns = sorted(df.columns)
    key_hash = F.sha2(row_text(df, keys).cast("binary"), 256)
    return df.select(*keys, F.substring(key_hash, 1, LEAF_DIGITS).alias("leaf"), X.sha_int(row_text(df, columns)).alias("row_digest"))


def _leaves(rows: DataFrame) -> DataFrame:
    return rows.groupBy("leaf").agg(F.count("*").alias("n"), F.sum(F.col("row_digest").cast("decimal(38,0)")).alias("digest"))


def compare_tree(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """level, node, n_a, n_b and whether the rows below a node differ; level 0 is the whole table. One row a range leaves a side."""
    left, right = _leaves(_ranges(a, keys)), _leaves(_ranges(b, keys))
    both = left.select("leaf", F.col("n").alias("n_a"), F.col("digest").alias("da")).join(right.select("leaf", F.col("n").alias("n_b"), F.col("digest").alias("db")), "leaf", "full")
    zero = both.fillna(0, ["n_a", "n_b"]).withColumns({d: F.coalesce(d, F.lit(0).cast("decimal(38,0)")) for d in ("da", "db")})
    at = zero.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEAF_DIGITS)))).withColumn("node", F.substring(F.col("leaf"), F.lit(1), F.col("level")))
    differs = (F.col("n_a") != F.col("n_b")) | (F.col("da") != F.col("db"))
    return at.withColumn("differs", differs).groupBy("level", "node").agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"), F.bool_or("differs").alias("differs"))


def compare_rows(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose rows differ: changed, missing (in b) or extra. Only rows of ranges that differ are joined; a key may have several rows."""
    if sorted(a.columns) != sorted(b.columns):
        raise ValueError("the tables have different columns")
    left, right = _ranges(a, keys), _ranges(b, keys)
    # At most 4,096 ranges.
    ranges = F.broadcast(compare_tree(a, b, keys).where((F.col("level") == LEAF_DIGITS) & F.col("differs")).select(F.col("node").alias("leaf")))
    side = lambda rows, s: rows.join(ranges, "leaf", "left_semi").groupBy(*keys).agg(
        F.count("*").alias(f"n_{s}"), F.sum(F.col("row_digest").cast("decimal(38,0)")).alias(f"d_{s}"))
    x, y = side(left, "a").alias("x"), side(right, "b").alias("y")
    both = x.join(y, reduce(lambda p, q: p & q, [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys]), "full")
    change = F.when(F.col("n_b").isNull(), "missing").when(F.col("n_a").isNull(), "extra").when((F.col("n_a") != F.col("n_b")) | (F.col("d_a") != F.col("d_b")), "changed")
    named = [F.coalesce(F.col(f"x.{k}"), F.col(f"y.{k}")).alias(k) for k in keys]
    return both.select(*named, change.alias("change")).where("change is not null")
