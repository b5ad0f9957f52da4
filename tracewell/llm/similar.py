"""Classes of similar texts: pairs proposed by SimHash and BK-trees, confirmed by the Jaccard index of their shingle sets.

Texts with the same set of word shingles are one node from the start. Fingerprints are SimHashes of
the set (each shingle once). At Jaccard j the cosine of two sets is 2j / (1 + j) at least, so a bit differs with
probability acos(2j / (1 + j)) / pi at most: 0.15 at 0.8. Classes grow in passes:

1. Spanning links within `NEAR` bits (`simhash.turn_links`) join what is almost equal.
2. Each block of `width` bits of each fingerprint is a shard key, first of `FIRST_TURNS` fingerprints, then of all others. A shard
   keeps a BK-tree of its members and looks each up within `RADIUS` bits. `turns_for` takes so many fingerprints that a pair at the
   asked index shares no block with probability `MISS` at most, whatever the number of nodes (blocks widen with it, so
   that shards stay small).

A row carries the next fingerprint too (`SKETCH`), and a pair that differs in over `NEARBY` of all these bits is no candidate in this
shard, so pairs by chance never leave it. A shard hands on a spanning forest: a pair only where its two classes aren't connected
yet by pairs it has handed on, so fewer pairs than members, never all pairs of a group of copies. Pairs whose fingerprints differ in over
`SCREEN` of all bits are refuted, all others are compared by their shingles and link from `least` on. Classes are contracted.
Pairs handed on connect parts of a shard. A part with a pair left out names its members; if one of its pairs was refuted, its members are worked once
more, with the classes as they are then, and with all fingerprints and the shingle hashes of the set in its rows: what differs in `NEARBY_ALL` of all bits at most is compared there, and only links leave,
fewer than members. So near misses, which can be all pairs of a group, are never rows, and the classes are those of all pairs that share a block and pass radius,
screens and comparison.

Sets of four and five shingles are worse than the law (a bit differs with probability 0.19): 98 of 100 such pairs are found.
A shard of any size is a sorted stream to one task, which holds its fingerprints (16 bytes and a tree node a member; when worked once more, all
fingerprints and 8 bytes a shingle).

Nulls: a null or empty text has no shingles; all of these are one node. A null key is left out. Columns of `docs` may have any names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Rounds, staged
from .bk_tree import BKTree
from .common import arrow_rows, words
from .components import components
from .decontamination import _bit_map
from .simhash import SEED, remixed, shingle_hashes, turn_links

#: Pass 1: bits and fingerprints; pass 2: bits within a shard; the share of pairs at `least` that share no block; differing bits of all.
NEAR, NEAR_TURNS, RADIUS, MISS, SCREEN = 3, 4, 16, 5e-4, 0.22
#: Fingerprints that are worked first; how many others a shard compares, and the share of bits in which they may differ;
#: the share where all fingerprints are compared (four deviations from the law at 0.8).
FIRST_TURNS, SKETCH, NEARBY, NEARBY_ALL = 6, 1, 0.2, 0.2
#: Bits of the map of ids whose texts are asked for, as a power of two.
MAP_BITS = 22
#: Rows of a batch when shards are worked once more, with sets of shingles.
SET_ROWS = 1_000
#: Pairs (a, b), and the members (a) of parts of shards that left out pairs.
PROPOSED = "combo bigint, masked bigint, part bigint, more boolean, a bigint, b bigint, member boolean"
LANES = np.uint64(0x0101010101010101)


def width_of(nodes: int) -> int:
    return min(32, max(16, nodes.bit_length() - 2))


def turns_for(nodes: int, least: float) -> int:
    """Fingerprints that leave a pair at `least` without a common block with probability MISS at most."""
    width = width_of(nodes)
    agree = (1 - math.acos(2 * least / (1 + least)) / math.pi) ** width
    return max(NEAR_TURNS, math.ceil(math.log(MISS) / math.log1p(-agree) / (64 // width)))


def majorities(hashes: np.ndarray, turns: int) -> np.ndarray:
    """One fingerprint per turn, as signed 64-bit integers; bits are counted in byte lanes, 255 hashes at a time."""
    counts = np.zeros((turns, 8, 8), np.int64)
    for i in range(0, len(hashes), 255):
        mixed = np.stack([remixed(hashes[i : i + 255], t) for t in range(turns)])
        for shift in range(8):
            lanes = ((mixed >> np.uint64(shift)) & LANES).sum(axis=1, dtype=np.uint64)
            counts[:, :, shift] += lanes.astype("<u8").view(np.uint8).reshape(turns, 8)
    return np.packbits(counts.reshape(turns, 64) * 2 > len(hashes), axis=1, bitorder="little").view("<i8")[:, 0]


def fingerprints(docs: DataFrame, shingle: int, turns: int, id_col: str, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key (the id), the columns in `keep`, n_shingles and set_hash of the set of shingles, fps."""

    @F.pandas_udf("n_shingles int, set_hash bigint, fps array<bigint>")
    def prints(texts: pd.Series) -> pd.DataFrame:
        sets = [np.unique(shingle_hashes(t, shingle)) for t in texts]
        hashes = [xxhash.xxh64_intdigest(s.astype("<u8").tobytes(), SEED) for s in sets]
        return pd.DataFrame({
            "n_shingles": np.array([len(s) for s in sets], np.int32), "set_hash": np.array(hashes, np.uint64).view(np.int64),
            "fps": pd.Series([majorities(s, turns) for s in sets], dtype=object)})

    arrow_rows(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("key"), *keep, prints(F.col(text_col)).alias("p"))
    return rows.select("key", *keep, "p.n_shingles", "p.set_hash", "p.fps")


def shingle_hash_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """id and the distinct shingle hashes of each text, in order."""

    @F.pandas_udf("array<bigint>")
    def hashes(values: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in values], dtype=object)

    return texts.select("id", hashes("text").alias("hashes"))


def alike(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    """Whether two sets of distinct hashes have a Jaccard index of `least` or more."""
    few, many = sorted((len(x), len(y)))
    if not many or few / many < least:
        return not many
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (few + many - both) >= least


def shingle_set(text: str | None, k: int) -> set[bytes]:
    w = words(text)
    if not w:
        return set()
    return {b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def jaccard(a: str | None, b: str | None, k: int) -> float:
    x, y = shingle_set(a, k), shingle_set(b, k)
    both = len(x & y)
    return both / (len(x) + len(y) - both) if x or y else 1.0


def maybe_needed(texts: DataFrame, needed: DataFrame) -> DataFrame:
    """The texts of the needed ids and few others, by a bit map of fixed size where texts are read; both have id."""
    hashed = F.xxhash64(F.col("id").cast("bigint"))
    bits = np.packbits(_bit_map(needed.select(hashed.alias("fp")), MAP_BITS), bitorder="little")

    @F.pandas_udf("boolean")
    def marked(hashes: pd.Series) -> pd.Series:
        slots = (hashes.to_numpy(np.int64).view(np.uint64) >> np.uint64(64 - MAP_BITS)).astype(np.int64)
        return pd.Series((bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1)

    return texts.where(marked(hashed))


def texts_of(texts: DataFrame, needed: DataFrame) -> DataFrame:
    """id and text of the needed ids, once each; other texts are not moved."""
    return maybe_needed(texts, needed).join(needed, "id", "left_semi").dropDuplicates(["id"])


def confirmed(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """Distinct pairs (a, b) with `good`: whether their shingle sets have a Jaccard index of `least` or more.

    nodes has id and fps, texts id and text. Texts are only read where fingerprints leave it open.
    """

    @F.pandas_udf("boolean")
    def similar(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([jaccard(a, b, shingle) >= least for a, b in zip(left, right, strict=True)], dtype=bool)

    both = pairs.select("a", "b").distinct()
    both = both.join(nodes.select(F.col("id").alias("a"), F.col("fps").alias("x")), "a").join(nodes.select(F.col("id").alias("b"), F.col("fps").alias("y")), "b")
    apart = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, d: n + d)
    screened = staged(both.select("a", "b", (apart <= F.size("x") * 64 * SCREEN).alias("open")), "similar-screened")
    open_ = screened.where("open").select("a", "b")
    needed = open_.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    held = texts_of(texts, needed)
    arrow_rows(pairs.sparkSession, 200)
    rows = open_.join(held.select(F.col("id").alias("a"), F.col("text").alias("left_text")), "a").join(held.select(F.col("id").alias("b"), F.col("text").alias("right_text")), "b")
    judged = rows.select("a", "b", similar("left_text", "right_text").alias("good"))
    return staged(judged.unionByName(screened.where("NOT open").select("a", "b", F.lit(False).alias("good"))), "similar-judged")


class _Forest:
    """Which classes of a shard are connected by the pairs it hands on."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, c: int) -> int:
        while (up := self.parent.get(c, c)) != c:
            self.parent[c] = c = self.parent.get(up, up)
        return c

    def connected(self, a: int, b: int) -> bool:
        return self.find(a) == self.find(b)

    def joined(self, a: int, b: int) -> bool:
        """Connect two classes; false if they were."""
        a, b = self.find(a), self.find(b)
        self.parent[a] = b
        return a != b


def run_pairs(fps: list[int], sketches: np.ndarray, ids: list[int], classes: list[int], refuted: set[tuple[int, int]], radius: int, forest: bool, good: Callable[[int, int], bool] | None = None) -> tuple[list[tuple[int, int]], bool]:
    """Pairs of ids of different classes within the radius, and whether others were left out for them.

    With `forest`, pairs that connect all classes that can be connected, else all that aren't refuted; with `good`, which compares two
    members by their places, pairs it confirms that connect all classes such pairs can connect. The largest class is only looked up in.
    """
    pairs, _, left, _ = connecting_pairs(fps, sketches, ids, classes, refuted, radius, forest, good)
    return pairs, bool(left)


def connecting_pairs(fps: list[int], sketches: np.ndarray, ids: list[int], classes: list[int], refuted: set[tuple[int, int]], radius: int, forest: bool, good: Callable[[int, int], bool] | None = None) -> tuple[list[tuple[int, int]], list[int], set[int], _Forest]:
    """As `run_pairs`: the pairs, a class of each, classes of pairs that were left out, and how the pairs connect classes."""
    large, n = Counter(classes).most_common(1)[0]
    if n == len(classes):
        return [], [], set(), _Forest()
    tree, order, pairs, of, left, links = BKTree(radius), [], [], [], set(), _Forest()
    most = int(64 * (1 + sketches.shape[1]) * (NEARBY if forest and good is None else NEARBY_ALL))
    for i in sorted(range(len(fps)), key=lambda i: classes[i] != large):
        if classes[i] != large:
            near = [j for j in map(order.__getitem__, tree.near(fps[i])) if classes[j] != classes[i]]
            if near:
                apart = np.bitwise_count((sketches[near] ^ sketches[i]).view(np.uint64)).sum(axis=1)
                for j, bits in zip(near, apart.tolist(), strict=True):
                    pair = (min(ids[i], ids[j]), max(ids[i], ids[j]))
                    if bits + (fps[i] ^ fps[j]).bit_count() > most or pair in refuted:
                        continue
                    if good is not None and (links.connected(classes[i], classes[j]) or not good(i, j)):
                        continue
                    if not forest or links.joined(classes[i], classes[j]):
                        pairs.append(pair)
                        of.append(classes[i])
                    else:
                        left.add(classes[i])
        tree.add(fps[i])
        order.append(i)
    return pairs, of, left, links


def _shards(batches: Iterator[pd.DataFrame], radius: int, least: float) -> Iterator[pd.DataFrame]:
    """Proposals of each run of rows with one shard key, or links where rows have their shingle hashes; a run may go on in the next batch."""
    columns, held = ["combo", "masked", "fp", "id", "class"], []

    def out(rows: np.ndarray, sets: np.ndarray) -> pd.DataFrame:
        at = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1), True]) if len(rows) else np.zeros(0, np.int64)
        found = []
        for i in np.flatnonzero(np.diff(at) > 1):
            run, own = rows[at[i] : at[i + 1]], sets[at[i] : at[i + 1]]
            good = (lambda x, y, own=own: alike(own[x], own[y], least)) if own[0] is not None else None
            ids, classes = run[:, 3].tolist(), (run[:, 4] ^ run[:, 3]).tolist()
            pairs, of, left, links = connecting_pairs(run[:, 2].copy().view(np.uint64).tolist(), run[:, 5:], ids, classes, set(), radius, True, good)
            more = {links.find(c) for c in left}
            found += [(rows[at[i], 0], rows[at[i], 1], part := links.find(c), part in more, a, b, False) for (a, b), c in zip(pairs, of, strict=True)]
            if more:
                found += [(rows[at[i], 0], rows[at[i], 1], part, True, a, a, True) for a, c in zip(ids, classes, strict=True) if (part := links.find(c)) in more]
        return pd.DataFrame(found, columns=["combo", "masked", "part", "more", "a", "b", "member"]).astype(
            {"combo": "int64", "masked": "int64", "part": "int64", "more": "bool", "a": "int64", "b": "int64", "member": "bool"})

    def joined() -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([r for r, _ in held]), np.concatenate([s for _, s in held])

    for batch in batches:
        rows = batch[[*columns, *[c for c in batch.columns if c not in columns and c != "hashes"]]].to_numpy(np.int64)
        sets = batch["hashes"].to_numpy() if "hashes" in batch.columns else np.full(len(rows), None, object)
        if not len(rows):
            continue
        last = held[-1][0][-1, :2] if held else None
        held.append((rows, sets))
        if last is not None and (rows[0, :2] == last).all() and (rows[0, :2] == rows[-1, :2]).all():
            continue
        rows, sets = joined()
        starts = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
        last = starts[-1] if len(starts) else 0
        yield out(rows[:last], sets[:last])
        held = [(rows[last:], sets[last:])]
    if held:
        yield out(*joined())


def _after(turn: Column, n: int) -> list[Column]:
    """The n fingerprints behind that of a turn."""
    return [F.get("fps", F.pmod(turn + 1 + i, F.size("fps")).cast("int")).alias(f"s{i}") for i in range(n)]


def _class() -> Column:
    """The class as its difference to the id: zero for most nodes."""
    return F.expr("class ^ id").alias("class")


def members(nodes: DataFrame, first: int, turns: int, width: int) -> DataFrame:
    """A row per node and block (combo, masked) of its fingerprints `first` …, with the fingerprints after it; nodes has id, fps, class."""
    per = 64 // width
    prints = nodes.select("id", _class(), "fps", F.posexplode(F.slice("fps", first + 1, turns)).alias("turn", "fp"))
    prints = prints.select("id", "class", "turn", "fp", *_after(F.col("turn") + first, SKETCH))
    blocks = F.array(*[
        F.struct(((F.col("turn") + first) * per + i).cast("bigint").alias("combo"), F.shiftright("fp", i * width).bitwiseAND(F.lit((1 << width) - 1).cast("bigint")).alias("masked"))
        for i in range(per)])
    rows = prints.withColumn("k", F.explode(blocks))
    return rows.select("k.combo", "k.masked", "fp", "id", "class", *[f"s{i}" for i in range(SKETCH)])


def linked(nodes: DataFrame, texts: DataFrame, known: DataFrame, first: int, turns: int, total: int, width: int, shingle: int, least: float, radius: int = RADIUS) -> DataFrame:
    """Confirmed links (a, b): those `known`, and enough to connect all pairs that share a block of the fingerprints `first` …"""
    spark, per = nodes.sparkSession, 64 // width
    links, classed, tables = (Rounds(spark, f"similar-{name}") for name in ("links", "classed", "proposed"))

    def stars(links: DataFrame) -> DataFrame:
        """The same classes: each node with the least of its class."""
        return components(links).where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))

    def with_class(known: DataFrame) -> DataFrame:
        rows = nodes.join(known.select(F.col("a").alias("id"), F.col("b").alias("class")), "id", "left")
        return classed.put(rows.withColumn("class", F.coalesce("class", "id")))

    def work(rows: DataFrame, batch: int) -> DataFrame:
        rows = rows.repartition("combo", "masked").sortWithinPartitions("combo", "masked")
        arrow_rows(spark, batch)
        return tables.put(rows.mapInPandas(lambda batches: _shards(batches, radius, least), PROPOSED))

    known = stars(known)
    found = work(members(with_class(known), first, turns, width), 20_000)
    judged = confirmed(found.where("NOT member"), nodes, texts, shingle, least)
    known = links.put(known.unionByName(judged.where("good").select("a", "b")))
    bad = found.where("more AND NOT member").join(judged.where("NOT good").select("a", "b"), ["a", "b"]).select("combo", "masked", "part").distinct()
    bad = staged(bad, "similar-refuted")
    if bad.head(1):
        again = found.where("member").select("combo", "masked", "part", F.col("a").alias("id")).join(bad, ["combo", "masked", "part"], "left_semi").drop("part")
        known = stars(known)
        asked = texts_of(texts, again.select("id").distinct())
        arrow_rows(spark, SET_ROWS)
        sets = staged(shingle_hash_sets(asked, shingle), "similar-sets")
        rows, turn = again.join(with_class(known), "id").join(sets, "id"), F.expr(f"combo div {per}")
        rows = rows.select("combo", "masked", F.get("fps", turn.cast("int")).alias("fp"), "id", _class(), *_after(turn, total - 1), "hashes")
        known = links.put(known.unionByName(work(rows, SET_ROWS).where("NOT member").select("a", "b")))
    classed.clear()
    tables.clear()
    return known


def groups(docs: DataFrame, shingle: int, least: float, id_col: str, text_col: str = "text", keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """key, the columns in `keep` and node of every row; (id, component) of the nodes that link to others."""
    n = docs.count()
    prints = staged(fingerprints(docs, shingle, turns_for(n, least), id_col, text_col, keep), "similar-prints").where("key IS NOT NULL")
    same = ["n_shingles", "set_hash"]
    named = staged(prints.groupBy(*same).agg(F.min("key").alias("id")), "similar-named")
    nodes = staged(prints.join(named, [*same]).where("key = id").select("id", "fps").dropDuplicates(["id"]), "similar-nodes")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    near = turn_links(staged(nodes.select(F.col("id").alias("key"), F.slice("fps", 1, NEAR_TURNS).alias("fps")), "similar-near"), NEAR)
    near = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b")
    known = confirmed(near, nodes, texts, shingle, least).where("good").select("a", "b")
    turns, width = turns_for(n, least), width_of(n)
    known = linked(nodes, texts, known, 0, FIRST_TURNS, turns, width, shingle, least)
    known = linked(nodes, texts, known, FIRST_TURNS, turns - FIRST_TURNS, turns, width, shingle, least)
    return prints.join(named, same).select("key", *keep, F.col("id").alias("node")), components(known)
