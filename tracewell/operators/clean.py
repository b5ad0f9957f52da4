"""Normalising, exact duplicates, id collisions, language, batches and fingerprints of reviews.

Input reviews carry `review_id`, `ord` (unique, integer), `rating`, `content_original` and any
grouping keys. First-wins always means the smallest `ord`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.scan import row_numbers, running_sum
from ..session import staged


def normalize_reviews(df: DataFrame, column: str = "content_original") -> DataFrame:
    """Collapse whitespace and drop reviews left empty."""
    # Asked of the text as it is: a filter on the new column would work it out a second time.
    return df.where(F.col(column).rlike(X.SOMETHING)).withColumn(column, X.normalize_text(column))


def with_content_hash(df: DataFrame, column: str = "content_original") -> DataFrame:
    """Add `folded` and `content_hash`, the first 20 hex digits over rating and folded text."""
    return df.withColumn("folded", X.casefold(column)).withColumn(
        "content_hash",
        X.sha(F.concat(F.col("rating").cast("string"), F.lit("|"), F.col("folded")), 20),
    )


def first_of(df: DataFrame, keys: list[str], ord_col: str = "ord") -> DataFrame:
    """The ordinals of the first row per key. Partial minima keep hot keys cheap."""
    return df.groupBy(*keys).agg(F.min(ord_col).alias(ord_col)).select(ord_col)


def exact_duplicates(hashed: DataFrame) -> DataFrame:
    """Mark rows that have an earlier row with the same hash, or the same id and folded text.

    Both marks are joined back by the unique ordinal, so copies of one text do not meet in a task.
    """
    by_hash = first_of(hashed, ["content_hash"]).withColumn("hash_first", F.lit(True))
    text_digest = hashed.withColumn("text_digest", F.sha2("folded", 256))
    by_id = first_of(text_digest, ["review_id", "text_digest"]).withColumn("id_first", F.lit(True))
    return (
        hashed.join(by_hash, "ord", "left")
        .join(by_id, "ord", "left")
        .withColumn("same_hash", F.col("hash_first").isNull())
        .withColumn("same_id_text", F.col("id_first").isNull())
        .drop("hash_first", "id_first")
    )


def drop_exact_copies(hashed: DataFrame) -> DataFrame:
    """The first row of every content hash."""
    return hashed.join(first_of(hashed, ["content_hash"]), "ord", "left_semi")


def rename_id_collisions(kept: DataFrame) -> DataFrame:
    """Give later kept rows with a used id the name `id--hash8`, then `-2`, `-3` and so on.

    An incoming id that already reads like a generated one competes with it in ordinal order.
    """
    first = first_of(kept, ["review_id"]).withColumn("owns_id", F.lit(True))
    rows = kept.join(first, "ord", "left")
    generated = F.concat("review_id", F.lit("--"), F.substring("content_hash", 1, 8))
    named = rows.withColumn(
        "candidate", F.when(F.col("owns_id"), F.col("review_id")).otherwise(generated)
    )
    # Only rows of one generated name meet here: different texts agreeing in id and eight digits.
    place = F.row_number().over(Window.partitionBy("candidate").orderBy("ord"))
    again = F.when(F.col("owns_id"), F.concat(generated, F.lit(""))).otherwise(
        F.concat("candidate", F.lit("-"), F.col("place"))
    )
    return (
        named.withColumn("place", place)
        .withColumn("incoming_id", F.col("review_id"))
        .withColumn("review_id", F.when(F.col("place") == 1, F.col("candidate")).otherwise(again))
        .withColumn("renamed", F.col("review_id") != F.col("incoming_id"))
        .drop("owns_id", "candidate", "place")
    )


def cleaning_stats(marked: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per key from rows with `reason` in (kept, empty, exact, near) and `renamed`."""
    is_ = lambda r: F.count_if(F.col("reason") == r)
    return marked.groupBy(*keys).agg(
        F.count("*").alias("input_count"),
        is_("kept").alias("output_count"),
        is_("exact").alias("exact_duplicates"),
        is_("near").alias("near_duplicates"),
        is_("empty").alias("empty_removed"),
        F.count_if(F.col("renamed")).alias("review_id_collisions"),
    )


# ---- language ----


def _trigrams(df: DataFrame, column: str) -> DataFrame:
    padded = F.concat(F.lit(" "), X.casefold(column), F.lit(" "))
    return df.withColumn("gram", F.explode(X.grams(padded, 3)))


def fit_language_profiles(df: DataFrame, column: str = "content_original") -> DataFrame:
    """Log probability of every trigram of each known language."""
    counts = (
        _trigrams(df.where(F.col("language").isNotNull()).select("language", column), column)
        .groupBy("language", "gram")
        .agg(F.count("*").alias("n"))
    )
    sums = counts.groupBy("language").agg(F.sum("n").alias("total"))  # one row per language
    return counts.join(sums, "language").select("language", "gram", F.log(F.col("n") / F.col("total")).alias("log_p"))


#: Profiles of this size in files or less are sent to all tasks, so that no trigram of a text is moved; larger ones are joined.
PROFILE_BYTES = 32 << 20


def fill_language(df: DataFrame, profiles: DataFrame, column: str = "content_original") -> DataFrame:
    """Detect the language where it is missing and the text has 12 characters or more."""
    floor = F.lit(-14.0)
    asked = df.where(F.col("language").isNull() & (F.length(column) >= 12)).select("ord", column)
    known = staged(profiles.select("gram", "language", "log_p"), "language-profiles")
    small = int(known._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= PROFILE_BYTES
    scored = (
        _trigrams(asked, column).select("ord", "gram")
        .join(F.broadcast(known) if small else known, "gram")
        .groupBy("ord", "language")
        .agg(F.sum(F.col("log_p") - floor).alias("score"))
    )
    best = scored.groupBy("ord").agg(
        F.max_by("language", F.struct("score", "language")).alias("detected")
    )
    return (
        df.join(best, "ord", "left")
        .withColumn("language", F.coalesce("language", "detected"))
        .drop("detected")
    )


# ---- batches ----


def pack_batches(
    df: DataFrame,
    keys: list[str],
    max_reviews: int,
    max_chars: int,
    ord_col: str = "ord",
    length_col: str = "chars",
    width: int = 262_144,
) -> DataFrame:
    """Greedy order-preserving packing, in parallel within a key.

    Rows are cut into blocks of the running row number. A batch holds at most `max_reviews` rows,
    so whatever came before, the first batch that starts in a block starts at one of its first
    `max_reviews` rows. Each block is therefore a small map from entry offset to exit offset and
    number of batches started, computed on its own; the maps are composed along the key, and every
    block then numbers its rows from its known entry. One task never sees more than a block.
    """
    if max_reviews <= 0 or max_chars <= 0:
        raise ValueError("batch limits must be positive")
    width = max(width, max_reviews)
    pos, size = "__pos", "__size"
    rows = row_numbers(df, keys, ord_col, pos).withColumn(pos, F.col(pos) - 1)
    rows = rows.withColumn("__block", F.expr(f"{pos} div {width}"))
    slim = rows.select(*keys, "__block", pos, F.col(length_col).alias(size))
    # A batch may run over the edge: each block also sees the first rows of the next one.
    edge = slim.where((F.col("__block") > 0) & (F.pmod(F.col(pos), F.lit(width)) < max_reviews))
    seen = slim.unionByName(edge.withColumn("__block", F.col("__block") - 1))

    def jumps(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, int]:
        pdf = pdf.sort_values(pos, kind="stable")
        sizes = pdf[size].to_numpy()
        own = int((pdf[pos] // width == pdf["__block"].iloc[0]).sum())
        total = np.concatenate([[0], np.cumsum(sizes)])
        start = np.arange(own)
        by_chars = np.searchsorted(total, total[start] + max_chars, side="right") - 1
        end = np.minimum(np.maximum(by_chars, start + 1), start + max_reviews)
        return pdf, np.minimum(end, len(sizes)), own

    schema_of = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    key_schema = ", ".join(f"`{k}` {schema_of[k]}" for k in keys)

    def block_map(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, end, own = jumps(pdf)
        leave = np.zeros(own, dtype=np.int64)
        count = np.zeros(own, dtype=np.int64)
        for i in range(own - 1, -1, -1):
            j = end[i]
            leave[i], count[i] = (j - own, 1) if j >= own else (leave[j], count[j] + 1)
        n = min(own, max_reviews)
        head = {k: [pdf[k].iloc[0]] * n for k in keys}
        return pd.DataFrame(
            {**head, "__block": pdf["__block"].iloc[0], "entry": np.arange(n), "leave": leave[:n], "batches": count[:n]}
        )

    maps = seen.groupBy(*keys, "__block").applyInPandas(
        block_map, f"{key_schema}, __block bigint, entry bigint, leave bigint, batches bigint"
    )
    folded = maps.groupBy(*keys, "__block").agg(
        F.array_sort(F.collect_list(F.struct("entry", "leave", "batches"))).alias("m")
    )

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        """One row per block: follow the maps from block to block."""
        pdf = pdf.sort_values("__block", kind="stable")
        entry, first, entries, firsts = 0, 0, [], []
        for m in pdf["m"]:
            entries.append(entry)
            firsts.append(first)
            if entry < len(m):
                step = m[entry]
                entry, first = step["leave"], first + step["batches"]
            else:
                entry -= len(m)
        head = {k: pdf[k].to_numpy() for k in keys}
        return pd.DataFrame({**head, "__block": pdf["__block"].to_numpy(), "entry": entries, "first": firsts})

    starts = folded.groupBy(*keys).applyInPandas(walk, f"{key_schema}, __block bigint, entry bigint, first bigint")

    def number(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        pdf, end, own = jumps(left)
        entry, batch = int(right["entry"].iloc[0]), int(right["first"].iloc[0])
        out = np.full(own, batch - 1, dtype=np.int64)
        i = entry
        while i < own:
            out[i : end[i]] = batch
            batch += 1
            i = end[i]
        mine = pdf.iloc[:own]
        return pd.DataFrame({**{k: mine[k].to_numpy() for k in keys}, pos: mine[pos].to_numpy(), "batch": out})

    numbered = (
        seen.groupBy(*keys, "__block")
        .cogroup(starts.groupBy(*keys, "__block"))
        .applyInPandas(number, f"{key_schema}, {pos} bigint, batch bigint")
    )
    return rows.drop("__block").join(numbered, [*keys, pos]).withColumnRenamed(pos, "row_index")


def batch_manifest(batched: DataFrame, keys: list[str]) -> DataFrame:
    """First and last row index and size of each batch."""
    return batched.groupBy(*keys, "batch").agg(
        F.min("row_index").alias("first_index"),
        F.max("row_index").alias("last_index"),
        F.count("*").alias("size"),
    )


def verify_manifest(manifest: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """True per key when the batches cover 0 … n-1 exactly, in order. `totals` holds `n`."""
    rows = running_sum(manifest, keys, "batch", "size", "__before", exclusive=True)
    checked = rows.groupBy(*keys).agg(
        F.bool_and(
            (F.col("first_index") == F.col("__before"))
            & (F.col("last_index") - F.col("first_index") + 1 == F.col("size"))
        ).alias("contiguous"),
        F.sum("size").alias("covered"),
    )
    return totals.join(checked, keys, "left").select(
        *keys,
        F.coalesce(F.col("contiguous") & (F.col("covered") == F.col("n")), F.col("n") == 0).alias("valid"),
    )


def input_fingerprint(df: DataFrame, keys: list[str], column: str = "content_original") -> DataFrame:
    """Order-free fingerprint of (id, text) per key: row count, sum and exclusive-or of digests."""
    digest = X.sha_int(F.concat("review_id", F.lit("\x1f"), F.col(column)))
    return df.withColumn("__d", digest).groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.sum(F.col("__d").cast("decimal(38,0)")).cast("string").alias("digest_sum"),
        F.bit_xor("__d").alias("digest_xor"),
    )
