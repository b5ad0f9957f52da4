"""Near duplicates by SimHash and BK-trees.

A fingerprint has 64 bits; a bit is set if it is set in over half of the XXH64 values (seed 42) of
the text's word shingles, repeats included. Fingerprints that differ in at most `radius` bits link;
classes are what links connect. Equal fingerprints are one node from the start.

Two fingerprints within the radius agree in all but `radius` of any m blocks of bits. So every choice
of m - radius blocks is a shard key, and a pair within the radius meets in at least one shard, which
loses nothing. m grows with the number of fingerprints, so that a shard stays small. A shard builds
a BK-tree and looks up its own members in it; it hands on only links that connect something new, so a
shard of n fingerprints gives fewer than n links. A shard of more than `tree_rows` is cut into trees of
that size, and every pair of them is a task of its own.

Nulls: a null text has no words and the fingerprint 0, as an empty one; it links like any other. A
null id takes part as a member, but names no class while another id is there. Repeated rows are
members like any other. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .bk_tree import links_between, spanning_links
from .common import arrow_rows, words
from .components import components

SEED = 42
TREE_ROWS = 4096


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    w = words(text)
    if not w:
        return np.zeros(0, np.uint64)
    line, h = b" ".join(w), xxhash.xxh64_intdigest
    if len(w) <= k:
        return np.array([h(line, SEED)], np.uint64)
    lengths = np.fromiter(map(len, w), np.int64, len(w))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    return np.array([h(line[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=False)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint, as a signed 64-bit integer."""
    if not len(hashes):
        return 0
    set_in = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        set_in += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_in * 2 > len(hashes), bitorder="little").view("<i8")[0])


def remixed(hashes: np.ndarray, turn: int) -> np.ndarray:
    """Other hashes of the same shingles; turn 0 leaves them as they are."""
    if not turn:
        return hashes
    x = hashes * np.uint64(0x9E3779B97F4A7C15 + 2 * turn)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def fingerprints(docs: DataFrame, shingle: int = 3, turns: int = 1, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key (the id), fps: one fingerprint per turn (other hashes of the same shingles), and the columns in `keep`."""

    @F.pandas_udf("array<bigint>")
    def prints(texts: pd.Series) -> pd.Series:
        hashes = [shingle_hashes(t, shingle) for t in texts]
        return pd.Series([[majority(remixed(h, t)) for t in range(turns)] for h in hashes], dtype=object)

    arrow_rows(docs.sparkSession)
    return docs.select(F.col(id_col).cast("bigint").alias("key"), *keep, prints(F.col(text_col)).alias("fps"))


def shard_masks(nodes: int, radius: int) -> list[int]:
    """Bit masks of the shard keys: all choices of m - radius of m blocks, m enough for small shards."""
    need = max(16, nodes.bit_length() - 2)
    m = next((m for m in range(radius + 1, 64) if 64 * (m - radius) // m >= need), 2 * radius + 2)
    edges = [64 * i // m for i in range(m + 1)]
    block = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(m)]
    masks = [sum(chosen) for chosen in combinations(block, m - radius)]
    return [x - (1 << 64) if x >> 63 else x for x in masks]


def _members(nodes: DataFrame, radius: int, n: int) -> DataFrame:
    masks = shard_masks(n, radius)
    first = F.col("turn") * len(masks) if "turn" in nodes.columns else F.lit(0)
    keys = F.array(*[F.struct((first + i).alias("combo"), F.col("fp").bitwiseAND(F.lit(mask).cast("bigint")).alias("masked")) for i, mask in enumerate(masks)])
    rows = nodes.select(F.explode(keys).alias("k"), "fp", "id").select("k.combo", "k.masked", "fp", "id")
    return rows.repartition("combo", "masked").sortWithinPartitions("combo", "masked", "id")


def _unsigned(values: np.ndarray) -> list[int]:
    return values.view(np.uint64).tolist()


def _shards(batches: Iterator[pd.DataFrame], radius: int, tree_rows: int) -> Iterator[pd.DataFrame]:
    """Links of each run of rows with one key; rows of a run over `tree_rows` come out numbered by tree."""
    columns = ["combo", "masked", "fp", "id"]
    held, trees = np.zeros((0, 4), np.int64), 0  # trees: how many of the open run have been cut off

    def out(pairs, members=np.zeros((0, 4), np.int64), tree=0):
        a, b = (np.array([p[i] for p in pairs], np.int64) for i in (0, 1))
        none = np.full(len(pairs), -1)
        return pd.DataFrame({
            "combo": np.r_[none, members[:, 0]], "masked": np.r_[none, members[:, 1]], "tree": np.r_[none, np.full(len(members), tree)],
            "fp": np.r_[none, members[:, 2]], "a": np.r_[a, members[:, 3]], "b": np.r_[b, members[:, 3]]})

    def whole(rows: np.ndarray) -> Iterator[pd.DataFrame]:
        """Complete runs: their links, or numbered trees where they are long."""
        at = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1), True]) if len(rows) else np.zeros(0, np.int64)
        pairs = []
        for i in np.flatnonzero(np.diff(at) > 1):
            run = rows[at[i] : at[i + 1]]
            if len(run) > tree_rows:
                yield from pieces(run, 0)
            else:
                pairs += [(run[x, 3], run[y, 3]) for x, y in spanning_links(_unsigned(run[:, 2].copy()), radius)]
        if pairs:
            yield out(pairs)

    def pieces(run: np.ndarray, first: int) -> Iterator[pd.DataFrame]:
        for n, i in enumerate(range(0, len(run), tree_rows), start=first):
            yield out([], run[i : i + tree_rows], n)

    for batch in batches:
        rows = np.r_[held, batch[columns].to_numpy(np.int64)]
        at = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
        last = at[-1] if len(at) else 0  # the last run may go on in the next batch
        if trees and len(at):  # the run that was cut ends here
            yield from pieces(rows[: at[0]], trees)
            trees = 0
            yield from whole(rows[at[0] : last])
        else:
            yield from whole(rows[:last])
        rows = rows[last:]
        full = (len(rows) - 1) // tree_rows  # what stays is never empty
        if full > 0:
            yield from pieces(rows[: full * tree_rows], trees)
            rows, trees = rows[full * tree_rows :], trees + full
        held = rows
    yield from pieces(held, trees) if trees else whole(held)


def _pair_of_trees(rows: pd.DataFrame, radius: int) -> pd.DataFrame:
    i, j = rows.i.iloc[0], rows.j.iloc[0]
    left, right = rows[rows.tree == i], rows[rows.tree == j]
    found = spanning_links(_unsigned(left.fp.to_numpy().copy()), radius) if i == j else links_between(_unsigned(left.fp.to_numpy().copy()), _unsigned(right.fp.to_numpy().copy()), radius)
    a, b = left.id.to_numpy(), right.id.to_numpy()
    return pd.DataFrame({"a": [a[x] for x, _ in found], "b": [b[y] for _, y in found]}, dtype="int64")


def links(nodes: DataFrame, radius: int = 3, tree_rows: int = TREE_ROWS) -> DataFrame:
    """Links (a, b) between ids of distinct fingerprints (fp, id), enough to connect every class; with a column `turn`, of every turn.

    nodes is read twice: pass a written table.
    """
    arrow_rows(nodes.sparkSession, 20_000)
    turns = ["turn"] if "turn" in nodes.columns else []
    members = _members(nodes, radius, nodes.groupBy(*turns).count().agg(F.max("count")).head()[0] or 0)
    found = members.mapInPandas(
        lambda batches: _shards(batches, radius, tree_rows), "combo int, masked bigint, tree int, fp bigint, a bigint, b bigint")
    found = staged(found, "simhash-links")
    cut = found.where("tree >= 0").select("combo", "masked", "tree", "fp", F.col("a").alias("id"))
    # The rest of a run that was cut may hold a single tree's worth of rows in several pieces; trees are numbered.
    trees = cut.groupBy("combo", "masked").agg(F.max("tree").alias("last"))
    paired = cut.join(trees, ["combo", "masked"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    paired = paired.select("combo", "masked", F.least("tree", "other").alias("i"), F.greatest("tree", "other").alias("j"), "tree", "fp", "id")
    between = paired.groupBy("combo", "masked", "i", "j").applyInPandas(lambda rows: _pair_of_trees(rows, radius), "a bigint, b bigint")
    return found.where("tree < 0").select("a", "b").unionByName(between)


def turn_links(prints: DataFrame, radius: int = 3, tree_rows: int = TREE_ROWS) -> DataFrame:
    """Links (a, b), enough to connect what is within the radius in any turn: prints has key and fps, a written table."""
    turns = prints.select(F.posexplode("fps").alias("turn", "fp"), "key").where("key IS NOT NULL")
    nodes = staged(turns.groupBy("turn", "fp").agg(F.min("key").alias("id")), "simhash-nodes")
    equal = turns.join(nodes, ["turn", "fp"]).where("key <> id").select(F.col("key").alias("a"), F.col("id").alias("b"))
    last = prints.select(F.max(F.size("fps"))).head()[0] or 0
    found = links(nodes, radius, tree_rows)
    return found.unionByName(equal) if last > 1 else found


def classes(prints: DataFrame, radius: int = 3, tree_rows: int = TREE_ROWS) -> DataFrame:
    """(id, component_id) of every id that isn't its own class: prints has key and fps, a written table."""
    return components(turn_links(prints, radius, tree_rows))


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, tree_rows: int = TREE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every document."""
    prints = staged(fingerprints(docs, shingle, 1, id_col, text_col), "simhash-prints")
    found = classes(prints, radius, tree_rows)
    rows = prints.select(F.col("key").alias("doc_id"), F.col("fps")[0].alias("fp"))
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("id"))
    named = nodes.join(found.withColumnRenamed("component", "component_id"), "id", "left").select("fp", F.coalesce("component_id", "id").alias("component_id"))
    return rows.join(named, "fp").select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")
