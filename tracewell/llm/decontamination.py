"""Benchmark decontamination by winnowing.

Every `window` consecutive words of a benchmark item are a window; the least hash
of its k-grams is its fingerprint. Documents select fingerprints by the same rule from
their own windows, so a span of `window` words that both hold has the same fingerprint on both sides:
no shared span of that length is missed. Fingerprints are joined, and a pair is extended to the whole
window by comparing its words. Items shorter than a window are one window with a fingerprint of its own.

Before the join, a bit map of benchmark fingerprints (its size is fixed, 2 ** map_bits bits) drops
document fingerprints that can't meet any; those it lets through by chance end at the join. Only what
passes leaves the scan of the documents, so texts are never shuffled.

Nulls: a null text has no words. A null document id is a row like any other; a null item id never counts
as an item, though its windows hit. Repeated documents are judged one by one; repeated item ids are one
item. Empty tables on either side give zero hits or no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from .common import arrow_rows

WINDOW = 10
K = 5
MAP_BITS = 22
#: Bytes that end a word, as spaces; capitals as small letters.
CLASSES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

CANDIDATES = "n_words bigint, found array<struct<fp: bigint, words: string, starts: array<int>>>"
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def split(text: str | None) -> list[bytes]:
    """Lower-case (A-Z) runs of letters, digits and everything beyond ASCII."""
    return text.encode().translate(CLASSES).split() if text else []


def _word_hashes(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    try:
        return np.array([known[w] for w in words], np.uint64)
    except KeyError:
        if len(known) > 200_000:
            known.clear()
        known |= {w: xxhash.xxh64_intdigest(w) for w in set(words).difference(known)}
        return np.array([known[w] for w in words], np.uint64)


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words, given the hashes of the words."""
    n = len(hashes) - k + 1
    x = np.full(n, k, np.uint64)
    for i in range(k):
        x = (x ^ hashes[i : i + n]) * np.uint64(_MIX[0])
        x ^= x >> np.uint64(32)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[1])
    return x ^ (x >> np.uint64(27))


def fingerprints(hashes: np.ndarray, window: int, k: int) -> np.ndarray:
    """The fingerprint of each window: the least k-gram hash in it."""
    grams = gram_hashes(hashes, k)
    return np.lib.stride_tricks.sliding_window_view(grams, window - k + 1).min(axis=1)


def _slots(fps: np.ndarray, map_bits: int) -> np.ndarray:
    return (fps >> np.uint64(64 - map_bits)).astype(np.int64)


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, k: int = K) -> DataFrame:
    """item_id, fp, words, n_words: every window of every item."""

    @F.pandas_udf("array<struct<fp: bigint, words: string, n_words: int>>")
    def windows(texts: pd.Series) -> pd.Series:
        known: dict[bytes, int] = {}
        out = []
        for text in texts:
            w = split(text)
            if not w:
                out.append([])
            elif len(w) < window:
                fp = gram_hashes(_word_hashes(w, known), len(w)).view(np.int64)
                out.append([{"fp": int(fp[0]), "words": b" ".join(w).decode(), "n_words": len(w)}])
            else:
                fps = fingerprints(_word_hashes(w, known), window, k).view(np.int64).tolist()
                out.append([{"fp": f, "words": b" ".join(w[i : i + window]).decode(), "n_words": window} for i, f in enumerate(fps)])
        return pd.Series(out, dtype=object)

    rows = items.select(F.col(id_col).alias("item_id"), F.explode(windows(F.col(text_col))).alias("w"))
    return rows.select("item_id", "w.fp", "w.words", "w.n_words").distinct()


def _bit_map(windows: DataFrame, map_bits: int) -> np.ndarray:
    """One bit per slot that a benchmark fingerprint falls in; at most 2 ** (map_bits - 6) rows come to the driver."""
    slot = F.shiftrightunsigned("fp", 64 - map_bits)
    words = windows.select(F.shiftright(slot, 6).alias("word"), F.pmod(slot, F.lit(64)).cast("int").alias("bit")).distinct()
    words = words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).collect()
    full = np.zeros(1 << (map_bits - 6), np.int64)
    for word, bits in words:
        full[word] = bits
    return np.unpackbits(full.view(np.uint8), bitorder="little").astype(bool)


def _candidates(texts: pd.Series, bits: np.ndarray, short: list[int], window: int, k: int, map_bits: int, known: dict) -> pd.DataFrame:
    counts, found = [], []
    for text in texts:
        w = split(text)
        counts.append(len(w))
        if not len(w) or not bits.any():
            found.append([])
            continue
        hashes, hits = _word_hashes(w, known), {}
        for n in [*short, window]:
            if len(w) < n:
                continue
            fps = gram_hashes(hashes, n) if n < window else fingerprints(hashes, window, k)
            for at in np.flatnonzero(bits[_slots(fps, map_bits)]).tolist():
                hits.setdefault((int(fps[at : at + 1].view(np.int64)[0]), b" ".join(w[at : at + n])), []).append(at)
        found.append([{"fp": fp, "words": x.decode(), "starts": starts} for (fp, x), starts in hits.items()])
    return pd.DataFrame({"n_words": np.array(counts, np.int64), "found": pd.Series(found, dtype=object)})


def _hits(
    docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, window: int, k: int, map_bits: int,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The items' windows, the scanned documents (doc_id, row, n_words) and the windows met (row, fp, words, starts, n_words)."""
    if not 0 < k <= window:
        raise ValueError("a k-gram must fit in a window")
    windows = staged(item_windows(items, item_col, item_text, window, k), "benchmark-windows")
    bits = _bit_map(windows, map_bits)
    short = sorted(n for (n,) in windows.where(F.col("n_words") < window).select("n_words").distinct().collect())

    @F.pandas_udf(CANDIDATES)
    def candidates(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, int] = {}
        for texts in batches:
            yield _candidates(texts, bits, short, window, k, map_bits, known)

    arrow_rows(docs.sparkSession)
    scanned = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), candidates(F.col(text_col)).alias("c"))
    # Row numbers are kept in a written table, so they stay the same however often it is read.
    scanned = staged(scanned.select("doc_id", "row", "c.n_words", "c.found"), "winnowed")
    pairs = scanned.where(F.size("found") > 0).select("row", F.explode("found").alias("f")).select("row", "f.fp", F.col("f.words").alias("__words"), "f.starts")
    distinct = windows.groupBy("fp", "words", "n_words").agg(F.min("item_id").alias("any_item"))
    met = pairs.join(distinct.select("fp", "words", "n_words"), "fp").where(F.col("__words") == F.col("words")).drop("__words")
    return windows, scanned.select("doc_id", "row", "n_words"), staged(met, "winnow-hits")


def repeating(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    window: int = WINDOW, k: int = K, map_bits: int = MAP_BITS,
) -> DataFrame:
    """doc_id of each document that holds a full window of an item, or that is as a whole an item shorter than a window."""
    _, scanned, met = _hits(docs, items, id_col, text_col, item_col, item_text, window, k, map_bits)
    rows = met.select("row", F.col("n_words").alias("__n")).distinct().join(scanned, "row")
    return rows.where((F.col("__n") == window) | (F.col("__n") == F.col("n_words"))).select("doc_id").distinct()


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    window: int = WINDOW, k: int = K, map_bits: int = MAP_BITS,
) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (by any window, short items' too)."""
    windows, rows, met = _hits(docs, items, id_col, text_col, item_col, item_text, window, k, map_bits)
    spans = met.select("row", F.explode("starts").alias("start"), "n_words").select("row", "start", (F.col("start") + F.col("n_words")).alias("end"))
    # Only the furthest end of a start counts; words beyond what came before are new.
    spans = spans.groupBy("row", "start").agg(F.max("end").alias("end"))
    before = Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("__seen", F.coalesce(F.max("end").over(before), F.lit(0)))
    hit = spans.groupBy("row").agg(
        F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "__seen"))).cast("bigint").alias("n_hit"))

    owners = met.select("row", "fp", "words").join(windows.select("fp", "words", "item_id"), ["fp", "words"]).where("item_id IS NOT NULL")
    owners = owners.select("row", F.col("item_id").cast("string").alias("item")).distinct()
    listed = owners.groupBy("row").agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("__list"))
    rows = rows.join(hit, "row", "left").join(listed, "row", "left")
    return rows.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("bigint")).alias("n_items"),
        F.sha2(F.coalesce("__list", F.lit("")).cast("binary"), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))
