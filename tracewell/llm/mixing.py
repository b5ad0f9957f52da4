"""Mix sources to target weights by Pareto order sampling.

Every source gets a target in words; a document is expected `e` times, `e` = target / size of its
source (or in proportion to a weight column), never above `max_copies`. The whole part of `e` is
certain. The rest, `p`, is an inclusion probability: documents are ranked by q = odds(u) / odds(p),
u a fixed hash of the id, and taken in that order until the source's open words are used up. One
more document, the one whose size is nearest to what then is open, closes the gap.

The choice is a threshold on q per source. So the plan is one row per source, and it is applied to
the documents by a join with that table: texts are not shuffled. The threshold is found without
sorting a source in one task: q falls into ranges of about `bucket_rows` documents, ranges are
summed, and only the range that holds the threshold is put in order.

Nulls: a null text has size 0, null is a source of its own (the last), a null id draws as the empty
text. Rows with the same id share one draw, so repeated rows are taken together. An empty table
gives an empty plan. Documents without words cost nothing and get their certain copies only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
BUCKET_ROWS = 4096
SEED = "mix-1"


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def draw(key: str = "doc_id", seed: str = SEED) -> Column:
    """A fixed number in (0, 1) from 52 bits of a digest of the id."""
    text = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f":{seed}"))
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint")
    return (bits * 2 + 1).cast("double") / F.lit(float(2**53))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """Add `target` to one row per source (source, source_size): the water level of weighted shares.

    Sources weigh `weights`, repeating, in code point order, null last. A source stops at
    max_copies * size; what it can't take goes to the others by weight. Sources fill up in the order
    of cap / weight, so the level is the first one that the next source doesn't reach.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w).cast("bigint") for w in weights]), (rank % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("__rank", rank).withColumn("__weight", weight)
    rows = rows.withColumn("__cap", F.col("source_size") * max_copies)
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("__cap") / F.col("__weight"), "__rank")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("__cap").over(before), F.lit(0))
    rows = rows.withColumn("__level", left / F.sum("__weight").over(after))
    open_ = F.when(F.col("__level") <= F.col("__cap") / F.col("__weight"), F.col("__level"))
    rows = rows.withColumn("__water", F.coalesce(F.min_by(open_, F.when(open_.isNotNull(), F.col("__cap") / F.col("__weight"))).over(everything), F.lit(0.0)))
    target = F.least(F.col("__cap").cast("double"), F.col("__water") * F.col("__weight"))
    return rows.withColumn("target", target).drop("__rank", "__weight", "__cap", "__level", "__water")


def _expected(weight: Column, rate: Column, max_copies: int) -> Column:
    return F.least(F.lit(float(max_copies)), rate * weight)


def _odds(p: Column) -> Column:
    return p / (F.lit(1.0) - p)


def _rates(slim: DataFrame, sources: DataFrame, max_copies: int, weighted: bool) -> DataFrame:
    """Add `rate`: expected copies are min(max_copies, rate * weight) and their words sum to the target."""
    plain = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    if not weighted:
        return sources.withColumn("rate", plain)
    rates = staged(sources.withColumn("rate", F.lit(0.0)), "mix-rates")
    while True:  # every round fixes the documents that are full; there is a last such round
        full = F.col("rate") * F.col("weight") >= max_copies
        words = F.col("size") * F.col("weight")
        sums = slim.join(rates.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).groupBy("source").agg(
            F.sum(F.when(full, F.col("size") * max_copies).otherwise(0)).alias("__full"),
            F.sum(F.when(full, 0.0).otherwise(words)).alias("__open"))
        new = rates.join(sums.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s").withColumn(
            "__next", F.when(F.col("__open") > 0, F.greatest(F.col("rate"), (F.col("target") - F.col("__full")) / F.col("__open"))).otherwise(F.col("rate")))
        new = staged(new, "mix-rates")
        moved = new.where(F.col("__next") > F.col("rate") * (1 + 1e-12)).limit(1).count()
        rates = new.withColumn("rate", F.col("__next")).drop("__full", "__open", "__next")
        if not moved:
            return rates


def _with_draws(rows: DataFrame, plan: DataFrame, max_copies: int) -> DataFrame:
    plan = plan.withColumnRenamed("source", "__plan_source")
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("__plan_source"))).drop("__plan_source")
    e = _expected(F.col("weight"), F.col("rate"), max_copies)
    rows = rows.withColumn("__whole", F.floor(e)).withColumn("__p", e - F.floor(e))
    return rows.withColumn("__q", F.when(F.col("__p") > 0, _odds(F.col("u")) / _odds(F.col("__p"))))


def make_plan(slim: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES, bucket_rows: int = BUCKET_ROWS, weighted: bool = False) -> DataFrame:
    """One row per source: source_size, target, rate, and the thresholds `cut` and `extra` on q.

    slim: source, size, u (see `draw`), weight; read several times, so pass a written table.
    """
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    sources = _rates(slim, targets(sizes, weights, max_copies), max_copies, weighted)
    sources = staged(sources, "mix-sources")
    rows = _with_draws(slim, sources, max_copies)
    certain = rows.groupBy("source").agg(
        F.sum(F.col("__whole") * F.col("size")).alias("certain"), F.sum(F.col("__p") * F.col("size")).alias("open"), F.sum("size").alias("all"))
    pool = rows.where("__p > 0 AND size > 0")
    share = certain.select(F.col("source").alias("__c"), "certain", F.least(F.lit(0.999999), F.greatest(F.lit(1e-6), F.coalesce(F.try_divide("open", "all"), F.lit(0.5)))).alias("__mean"))
    pool = pool.join(share, F.col("source").eqNullSafe(F.col("__c"))).drop("__c").withColumn("__left", F.col("target") - F.col("certain"))
    # The mean odds undo the division by odds(p), so equal probabilities fill the ranges evenly.
    even = F.col("__q") * _odds(F.col("__mean"))
    ranges = F.ceil(F.col("rows") / bucket_rows)
    pool = staged(pool.select("source", "size", "__q", "__left", F.floor(even / (1 + even) * ranges).alias("__range")), "mix-pool")
    by_range = pool.groupBy("source", "__range", "__left").agg(F.sum("size").alias("words"))
    running = Window.partitionBy("source").orderBy("__range")
    by_range = by_range.withColumn("__upto", F.sum("words").over(running)).withColumn("__before", F.col("__upto") - F.col("words"))
    edge = by_range.where("__before <= __left AND __upto > __left").select(F.col("source").alias("__s"), F.col("__range").alias("__r"), "__before")
    inside = pool.join(edge, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__range") == F.col("__r")))
    by_q = inside.groupBy("source", "__q", "__left", "__before").agg(F.sum("size").alias("words"))
    by_q = by_q.withColumn("__upto", F.col("__before") + F.sum("words").over(Window.partitionBy("source").orderBy("__q")))
    fits = F.col("__upto") <= F.col("__left")
    last = by_q.groupBy("source").agg(
        F.max(F.when(fits, F.col("__q"))).alias("__cut_in"), F.max(F.when(fits, F.col("__upto"))).alias("__taken_in"), F.min("__before").alias("__taken_before"))
    edge_row = edge.select(F.col("__s").alias("source"), "__r")
    below = pool.groupBy("source", "__range").agg(F.max("__q").alias("__top"))
    below = below.join(edge_row.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")) & (F.col("__range") < F.col("__r"))).groupBy("source").agg(F.max("__top").alias("__cut_before"))
    cuts = last.join(below.withColumnRenamed("source", "__b"), F.col("source").eqNullSafe(F.col("__b")), "left").select(
        F.col("source").alias("__k"), F.coalesce("__cut_in", "__cut_before", F.lit(-1.0)).alias("cut"), F.coalesce("__taken_in", "__taken_before").alias("__taken"))
    rest = pool.join(cuts, F.col("source").eqNullSafe(F.col("__k"))).where(F.col("__q") > F.col("cut"))
    gap = F.col("__left") - F.col("__taken")
    rest = rest.groupBy("source", "__q").agg(F.sum("size").alias("size"), F.first("__left").alias("__left"), F.first("__taken").alias("__taken"))
    rest = rest.where(F.abs(gap - F.col("size")) < gap).groupBy("source").agg(F.min(F.struct(F.abs(gap - F.col("size")).alias("off"), F.col("__q").alias("q"))).alias("__x"))
    rest = rest.select(F.col("source").alias("__e"), F.col("__x.q").alias("extra"))
    plan = sources.join(cuts.drop("__taken"), F.col("source").eqNullSafe(F.col("__k")), "left").join(rest, F.col("source").eqNullSafe(F.col("__e")), "left")
    # A pool that never exceeds its open words has no edge range: all of it is taken.
    return staged(plan.select("source", "source_size", "target", "rate", F.coalesce("cut", F.lit(float("inf"))).alias("cut"), F.coalesce("extra", F.lit(-1.0)).alias("extra")), "mix-plan")


def copies(rows: DataFrame, plan: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """Add source_size, target and `copies` to rows that have source, size, u and weight."""
    rows = _with_draws(rows, plan, max_copies)
    one = (F.col("__q") <= F.col("cut")) | (F.col("__q") == F.col("extra"))
    taken = F.col("__whole") + F.when(one & (F.col("size") > 0), 1).otherwise(0)
    return rows.withColumn("copies", taken.cast("bigint")).drop("__whole", "__p", "__q", "cut", "extra", "rate")


def slim_rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, weight_col: str | None, seed: str, keep: tuple[str, ...] = ()) -> DataFrame:
    weight = F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)) if weight_col else F.lit(1.0)
    return docs.select(
        *keep, F.col(id_col).alias("id"), F.col(source_col).alias("source"), size_of(text_col).alias("size"), draw(id_col, seed).alias("u"),
        F.greatest(weight, F.lit(0.0)).alias("weight"))


def allocate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None,
    weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES, seed: str = SEED,
) -> DataFrame:
    """id, source, size, source_size, target and copies of every document."""
    slim = staged(slim_rows(docs, id_col, text_col, source_col, weight_col, seed), "mix-sizes")
    plan = make_plan(slim, weights, max_copies, weighted=weight_col is not None)
    return copies(slim, plan, max_copies)


def mixed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None,
    weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES, seed: str = SEED,
) -> DataFrame:
    """The mix itself: every column of `docs`, each row as often as it is taken."""
    slim = staged(slim_rows(docs, id_col, text_col, source_col, weight_col, seed), "mix-sizes")
    plan = make_plan(slim, weights, max_copies, weighted=weight_col is not None)
    inner = docs.select(F.struct(*docs.columns).alias("__row"))
    packed = slim_rows(inner, f"__row.{id_col}", f"__row.{text_col}", f"__row.{source_col}", weight_col and f"__row.{weight_col}", seed, keep=("__row",))
    taken = copies(packed, plan, max_copies).where("copies > 0")
    return taken.select("__row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select("__row.*")
