"""Hard negatives: rows of another label that come close to a positive's score, by exact integer inner products.

Components x become floor(scale * x). Anchors are taken in slices of at most `ANCHOR_ROWS`, each known to all tasks (2 MB
at 64 components, whatever the table's size); candidates stay where they are, in written parts of `PART_ROWS`. A task multiplies
its slice by tiles of candidates (`strassen`) and keeps bounded heaps: first the best positives of each anchor, only against rows of its
own label, then for each positive the best rows inside its window. Heaps of tiles merge in the task, those of tasks in one
aggregate of at most k rows per heap and task. Work is anchors x rows, as asked; shuffled are heaps alone.

Rows with a null id, label or vector, or a null or non-finite component, take no part. Rows of another length than an anchor's are
not compared with it. Ties go to the smaller id. Rows of the anchor's own id are not "other" rows; rows of one id with
equal scores are one candidate. An anchor without positives, or a positive without rows in its window, gives no row; a negative
positive score has an empty window. Empty tables give no rows. Scores must fit in 60 bits: other vectors raise an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage_path, staged
from .common import arrow_rows, parts_of
from .strassen import multiply

ANCHOR_ROWS, PART_ROWS, TILE_ROWS = 4096, 8192, 1024
NONE = np.iinfo(np.int64).min
HEAP = "heap int, score bigint, id bigint"
NEGATIVES = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


class Heaps:
    """n heaps of at most k (score, id): the largest scores, of equal scores the least ids. Two of them merge into one."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.id = k, np.full((n, k), NONE), np.full((n, k), np.iinfo(np.int64).max)

    def put(self, heap: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Merge rows (heap, score, id) into the heaps they name."""
        touched = np.unique(heap)
        old, at = np.nonzero(self.score[touched] != NONE)
        heap = np.r_[touched[old], heap]
        score, ids = np.r_[self.score[touched[old], at], score], np.r_[self.id[touched[old], at], ids]
        order = np.lexsort((ids, -score, heap))
        heap, score, ids = heap[order], score[order], ids[order]
        fresh = np.r_[True, (heap[1:] != heap[:-1]) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1])][: len(heap)]
        heap, score, ids = heap[fresh], score[fresh], ids[fresh]
        rank = np.arange(len(heap)) - np.searchsorted(heap, heap)
        best = rank < self.k
        self.score[touched], self.id[touched] = NONE, np.iinfo(np.int64).max
        self.score[heap[best], rank[best]], self.id[heap[best], rank[best]] = score[best], ids[best]

    def put_tile(self, heaps: np.ndarray, scores: np.ndarray, open_: np.ndarray, ids: np.ndarray) -> None:
        """Merge a tile of scores (heaps x ids) where it is open, without what can't be among the best."""
        masked = np.where(open_, scores, NONE)
        least = self.score[heaps, -1]
        # A repeated id may be one candidate twice, so then the k-th score of a tile is no bound.
        if masked.shape[1] > self.k and len(np.unique(ids)) == len(ids):
            least = np.maximum(least, np.partition(masked, masked.shape[1] - self.k, axis=1)[:, -self.k])
        row, column = np.nonzero(open_ & (masked >= least[:, None]))
        if len(row):
            self.put(heaps[row], masked[row, column], ids[column])

    def rows(self) -> pa.RecordBatch:
        heap, at = np.nonzero(self.score != NONE)
        return pa.RecordBatch.from_arrays([pa.array(heap.astype(np.int32)), pa.array(self.score[heap, at]), pa.array(self.id[heap, at])], ["heap", "score", "id"])


def integers(rows: DataFrame, scale: int, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """id, label and v (whole numbers) of the rows that take part."""
    vector = F.col(vector_col).cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), vector.alias("v"), finite.alias("ok"))
    return rows.where("id IS NOT NULL AND label IS NOT NULL AND ok").select("id", "label", F.transform("v", lambda x: F.floor(x * scale)).alias("v"))


class Slice:
    """Anchors of one vector length that all tasks know."""

    def __init__(self, ids: list[int], labels: list[int], vectors: list[list[int]]):
        self.ids, self.labels, self.v = np.array(ids, np.int64), np.array(labels, np.int64), np.array(vectors, np.int64).reshape(len(ids), -1)


def _tiles(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        if not batch.num_rows:
            continue
        vectors = batch.column("v")
        of_length = np.diff(vectors.offsets.to_numpy()) == dim
        v = vectors.filter(pa.array(of_length)).flatten().to_numpy(zero_copy_only=False).reshape(int(of_length.sum()), dim)
        ids, labels = (batch.column(c).to_numpy(zero_copy_only=False)[of_length] for c in ("id", "label"))
        for i in range(0, len(ids), TILE_ROWS):
            yield ids[i : i + TILE_ROWS], labels[i : i + TILE_ROWS], v[i : i + TILE_ROWS]


def positive_heaps(anchors: Slice, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = Heaps(len(anchors.ids), k)
        for ids, labels, v in _tiles(batches, anchors.v.shape[1]):
            for label in np.intersect1d(labels, anchors.labels):
                mine, theirs = np.flatnonzero(anchors.labels == label), np.flatnonzero(labels == label)
                scores = multiply(anchors.v[mine], np.ascontiguousarray(v[theirs].T))
                heaps.put_tile(mine, scores, anchors.ids[mine, None] != ids[None, theirs], ids[theirs])
        yield heaps.rows()

    return run


def window_heaps(anchors: Slice, positives: np.ndarray, k: int, low: int, high: int) -> Callable:
    """Heaps anchor * columns + column: negatives n with low * p <= high * n <= high * p for each positive score p."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, slots = positives.shape
        heaps = Heaps(n * slots, k)
        for ids, labels, v in _tiles(batches, anchors.v.shape[1]):
            scores = multiply(anchors.v, np.ascontiguousarray(v.T))
            other = anchors.labels[:, None] != labels[None, :]
            other &= anchors.ids[:, None] != ids[None, :]
            for slot in range(slots):
                p = positives[:, slot]
                asked = np.flatnonzero(p != NONE)
                least = -((-low * p[asked]) // high)
                inside = other[asked] & (scores[asked] <= p[asked, None]) & (scores[asked] >= least[:, None])
                heaps.put_tile(asked * slots + slot, scores[asked], inside, ids)
        yield heaps.rows()

    return run


def merged(heaps: DataFrame, k: int) -> DataFrame:
    """The heaps of all tasks as one: heap, rank (from 1), score, id."""
    rank = F.row_number().over(Window.partitionBy("heap").orderBy(F.desc("score"), "id"))
    return heaps.distinct().withColumn("rank", rank).where(F.col("rank") <= k)


def _slices(anchors: DataFrame, dim: int, size: int) -> Iterator[Slice]:
    """Slices of at most `size` anchors; a folder of the written table holds about one slice."""
    for chunk in range(anchors.agg(F.max("chunk")).head()[0] + 1):
        rows = anchors.where((F.col("chunk") == chunk) & (F.size("v") == dim)).select("id", "label", "v").toLocalIterator()
        while part := list(islice(rows, size)):
            yield Slice([r.id for r in part], [r.label for r in part], [r.v for r in part])


def mine(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256,
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", anchor_rows: int = ANCHOR_ROWS, part_rows: int = PART_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; `is_anchor` is a condition on the column "id"."""
    spark = rows.sparkSession
    held = integers(rows, scale, id_col, label_col, vector_col)
    held = staged(held.repartition(parts_of(rows.count(), part_rows)), "mining-rows")
    largest = F.greatest(F.array_max("v").cast("double"), -F.array_min("v").cast("double"))
    dims = held.groupBy(F.size("v").alias("dim")).agg(F.max(largest).alias("largest")).collect()
    if any((d.largest or 0.0) ** 2 * d.dim * high >= 2.0**60 for d in dims):
        raise OverflowError("scores of these vectors need over 60 bits")
    anchors = held.where(is_anchor).dropDuplicates(["id", "label", "v"])
    chunks = parts_of(anchors.count(), anchor_rows)
    path = stage_path(spark, "mining-anchors")
    anchors.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int")).repartition(chunks, "chunk").write.partitionBy("chunk").parquet(path)
    anchors = spark.read.schema("id bigint, label bigint, v array<bigint>, chunk int").parquet(path)
    arrow_rows(spark, 8192)
    out = stage_path(spark, "mining-negatives")
    spark.createDataFrame([], NEGATIVES).write.parquet(out)
    for dim in sorted(d.dim for d in dims) if anchors.head(1) else []:
        for part in _slices(anchors, dim, anchor_rows):
            found = merged(held.mapInArrow(positive_heaps(part, positives), HEAP), positives).collect()
            if not found:
                continue
            scores = np.full((len(part.ids), positives), NONE)
            for r in found:
                scores[r.heap, r["rank"] - 1] = r.score
            asked = spark.createDataFrame(
                [(r.heap * positives + r["rank"] - 1, int(part.ids[r.heap]), r.id, r.score) for r in found],
                "heap int, anchor_id bigint, positive_id bigint, positive_score bigint")
            best = merged(held.mapInArrow(window_heaps(part, scores, negatives, low, high), HEAP), negatives)
            best = best.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(F.broadcast(asked), "heap")
            best.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").write.mode("append").parquet(out)
    return spark.read.schema(NEGATIVES).parquet(out)
