"""Approximate nearest neighbours by inner product, on robust-pruned graphs, one per shard.

Equal vectors are one point; of each, the least ids are kept, as many as a result can show, so copies
neither spoil the graph nor crowd a task. Points are dealt to shards of about `shard_rows` by a hash of
the id. A shard's graph is built in one task: greedy searches from the growing graph propose
neighbours, pruning by relaxed distances keeps diverse ones. The index is a table of points with their
neighbours. A search takes blocks of queries to every shard of their length, runs a beam search there,
and merges the best of each shard. Scores are exact: double precision on the original vectors, summed
from the first component to the last.

Nulls: vectors that are null, zero, or hold null or non-finite components are neither found nor asked.
Vectors of another length are a space of their own. Rows without id take no part. Repeated rows of one
id and vector are one candidate; an id with several vectors is a candidate with each. Ties go to the
smaller id. Empty tables give empty results.
"""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from .common import arrow_rows, parts_of
from .graph import BATCH, Graph, build, on_sphere

SHARD_ROWS = 4096
QUERY_ROWS = 8192
BEAM = 96
INDEX = "dim int, shard int, point bigint, vector array<float>, node int, neighbours array<int>, entry boolean"
HITS = "query bigint, point bigint, score double"


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def points(rows: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """point (the least id of a vector), vector, vec_id: of equal vectors the k + 1 least ids, which is all a result can show."""
    rows = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<float>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    # Plus zero turns -0.0 into 0.0, so vectors that are equal as numbers are equal as keys.
    rows = rows.withColumn("vector", F.transform("vector", lambda v: v + F.lit(0.0).cast("float")))
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    rows = rows.dropDuplicates(["vec_id", "vector"]).withColumn("r", rank).where(F.col("r") <= k + 1)
    return rows.withColumn("point", F.min("vec_id").over(Window.partitionBy("vector"))).drop("r")


def make_index(distinct: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The graph of every shard, as a written table; distinct: point, vector."""

    def shard(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("point", ignore_index=True)
        graph = build(on_sphere(np.stack(rows.vector.to_list())))
        entry = np.zeros(len(rows), bool)
        entry[graph.entries] = True
        return pd.DataFrame({
            "dim": np.int32(key[0]), "shard": np.int32(key[1]), "point": rows.point, "vector": rows.vector, "node": np.arange(len(rows), dtype=np.int32),
            "neighbours": list(graph.neighbours), "entry": entry})

    sizes = distinct.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    shards = sizes.select("dim", F.ceil(F.col("n") / shard_rows).cast("bigint").alias("shards"))
    dealt = distinct.withColumn("dim", F.size("vector")).join(shards, "dim").withColumn("shard", F.pmod(F.xxhash64("point"), "shards").cast("int"))
    arrow_rows(distinct.sparkSession, 10_000)
    # Few bytes and much work: without a stated number, partitions would be merged by size into few tasks.
    dealt = dealt.select("dim", "shard", "point", "vector").repartition(parts_of(distinct.count(), shard_rows), "dim", "shard")
    return staged(dealt.groupBy("dim", "shard").applyInPandas(shard, INDEX), "ann-index")


def _inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


def _search(index: pd.DataFrame, queries: pd.DataFrame, k: int, beam: int) -> pd.DataFrame:
    if not len(index) or not len(queries):
        return pd.DataFrame({"query": [], "point": [], "score": []}).astype({"query": "int64", "point": "int64", "score": "float64"})
    index = index.sort_values("node")
    vectors, ids = np.stack(index.vector.to_list()), index.point.to_numpy()
    graph = Graph(on_sphere(vectors), np.stack(index.neighbours.to_list()), np.flatnonzero(index.entry.to_numpy()))
    asked = np.stack(queries.vector.to_list()).astype(np.float64)
    unit = np.c_[asked / np.sqrt((asked * asked).sum(axis=1, keepdims=True)), np.zeros(len(asked))].astype(np.float32)
    out = []
    for i in range(0, len(asked), BATCH):
        found, _ = graph.search(unit[i : i + BATCH], max(beam, k))
        rows, columns = np.nonzero(found >= 0)
        nodes = found[rows, columns]
        score = _inner(asked[i + rows], vectors[nodes].astype(np.float64))
        order = np.lexsort((ids[nodes], -score, rows))
        rows, nodes, score = rows[order], nodes[order], score[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        best = rank < k
        out.append(pd.DataFrame({"query": queries["query"].to_numpy()[i + rows[best]], "point": ids[nodes[best]], "score": score[best]}))
    return pd.concat(out)


def search(index: DataFrame, asked: DataFrame, k: int, beam: int = BEAM, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query, point, score: the k best points found in every shard; asked: query, vector, one row per query."""
    shards = index.groupBy("dim").agg((F.max("shard") + 1).alias("shards"))
    blocks = parts_of(asked.count(), query_rows)
    tasks = blocks * index.select("dim", "shard").distinct().count()
    asked = asked.withColumn("dim", F.size("vector")).join(shards, "dim")
    asked = asked.select("dim", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.pmod(F.xxhash64("query"), F.lit(blocks)).alias("block"), "query", "vector")
    placed = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
    arrow_rows(index.sparkSession, 10_000)
    key = ["dim", "shard", "block"]
    placed, asked = placed.repartition(max(1, tasks), *key), asked.repartition(max(1, tasks), *key)
    return placed.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(lambda a, b: _search(a, b, k, beam), HITS)


def _best(rows: DataFrame, by: str, order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("r") <= k).drop("r")


def nearest(rows: DataFrame, is_query: Column, k: int = 20, shard_rows: int = SHARD_ROWS, beam: int = BEAM, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row that `is_query` holds for, the k nearest rows but itself."""
    asking = rows.where(is_query).select(F.col(id_col).alias("query_id"), F.transform(F.col(vector_col).cast("array<float>"), lambda v: v + F.lit(0.0).cast("float")).alias("vector"))
    asking = asking.where(F.col("query_id").isNotNull() & usable(F.col("vector"))).distinct()
    members = staged(points(rows, k, id_col, vector_col), "ann-points")
    distinct = members.where("vec_id = point").select("point", "vector")
    index = make_index(distinct, shard_rows)
    asking = staged(asking.join(distinct, "vector").select("query_id", F.col("point").alias("query")), "ann-queries")
    asked = distinct.join(asking.select(F.col("query").alias("point")).distinct(), "point").withColumnRenamed("point", "query")
    hits = search(index, asked, k + 1, beam)
    hits = _best(hits, "query", [F.desc("score"), F.asc("point")], k + 1)
    hits = hits.join(members.select("point", "vec_id"), "point")
    hits = _best(hits, "query", [F.desc("score"), F.asc("vec_id")], k + 1)
    lists = hits.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("found"))
    answers = asking.join(lists, "query")
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    answers = answers.select("query_id", F.posexplode(others).alias("pos", "x"))
    return answers.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))
