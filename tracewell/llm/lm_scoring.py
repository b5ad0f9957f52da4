"""Language-model scores by subword lattice likelihood.

The model gives a word the probability
    max(c - d, 0) / N  +  d * V / N * (sum over all cuts of the word into vocabulary pieces of the product of their probabilities),
in the lattice's terms: an arc over the whole word beside the piece arcs, summed by one forward recursion
in log space. c, N and V count training tokens; d is the absolute discount n1 / (n1 + 2 n2). The
pieces come from an existing vocabulary; their probabilities are learned from the distinct training
words by expectation maximisation. Both parts are proper distributions over words and the end of a
text, so the score of a text is the logarithm (base 10) of its marginal probability under the model.

How it runs. One pass cuts documents into blocks of a bounded number of tokens and writes each block
with its own word list and ids into it. Only word lists are shuffled, by word, to be counted over the
corpus; a word's probability is computed once for the corpus, and goes back to the blocks that hold
it. No vocabulary is broadcast or collected; the driver gets counts and one number per piece.

Nulls: a null text is empty, its only token is the end. A null id is never held out. Repeated rows are
counted and scored like any other. If nothing trains the model, pieces are equally likely. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from .common import arrow_rows, words
from .lattice import Lattice, Vocabulary

BLOCK_TOKENS = 4_000_000
ROUNDS = 3
ADDED = 0.1  # count added to every token of the base model, and to one more for unseen ones
PIECE_FLOOR = 0.01  # expected count added to every piece

BLOCKS = "block bigint, doc_ids array<string>, held array<boolean>, ends array<int>, ids binary, words binary, counts binary"
SCORES = "doc_id string, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def _packed(ids: np.ndarray) -> bytes:
    planes = ids.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def _blocks(batches: Iterator[pd.DataFrame], block_tokens: int) -> Iterator[pd.DataFrame]:
    """Token 0 of every block is the end of a text, written as the empty word."""
    block = TaskContext.get().partitionId() << 32

    def empty():
        return {b"": 0}, [], [], [], []

    def closed(known, parts, doc_ids, held, sizes):
        ends = np.cumsum(sizes)
        ids = np.concatenate(parts)
        trains = np.repeat(~np.array(held), sizes)
        counts = np.bincount(ids[trains], minlength=len(known)).astype("<i4")
        return pd.DataFrame({
            "block": [block], "doc_ids": [doc_ids], "held": [held], "ends": [ends.tolist()], "ids": [_packed(ids)],
            "words": [b"\n".join(known)], "counts": [counts.tobytes()]})

    known, parts, doc_ids, held, sizes = empty()
    total = 0
    for batch in batches:
        for doc_id, text, out in zip(batch.doc_id, batch.text, batch.held, strict=True):
            w = words(text)
            for x in w:
                if x not in known:
                    known[x] = len(known)
            parts.append(np.array([known[x] for x in w] + [0], np.uint32))
            doc_ids.append(doc_id)
            held.append(bool(out))
            sizes.append(len(w) + 1)
            total += len(w) + 1
            if total >= block_tokens:
                yield closed(known, parts, doc_ids, held, sizes)
                known, parts, doc_ids, held, sizes = empty()
                block, total = block + 1, 0
    if doc_ids:
        yield closed(known, parts, doc_ids, held, sizes)


def _word_lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for block, listed, counts in zip(batch.block, batch.words, batch.counts, strict=True):
            listed, counts = listed.decode().split("\n"), np.frombuffer(counts, "<i4")
            for i in range(0, len(listed), 50_000):
                part = listed[i : i + 50_000]
                yield pd.DataFrame({"word": part, "block": block, "local": np.arange(i, i + len(part), dtype=np.int32), "c": counts[i : i + 50_000].astype(np.int64)})


def _learn(vocabulary: Vocabulary, training: DataFrame, rounds: int) -> np.ndarray:
    """Natural logarithms of piece probabilities, learned from distinct words; sums are in whole millionths, so order doesn't matter."""
    lattice = Lattice(vocabulary)
    for _ in range(rounds):
        log_p = lattice.log_p

        def expected(batches: Iterator[pd.DataFrame], log_p=log_p) -> Iterator[pd.DataFrame]:
            own, total = Lattice(vocabulary, log_p), np.zeros(len(log_p))
            for batch in batches:
                total += own.expected(batch.word.tolist())
            at = np.flatnonzero(total)
            yield pd.DataFrame({"piece": at, "n": np.round(total[at] * 1e6).astype(np.int64)})

        counts = np.full(len(log_p), PIECE_FLOOR)
        counts[vocabulary.end] += 1
        for piece, n in training.mapInPandas(expected, "piece bigint, n bigint").groupBy("piece").agg(F.sum("n")).collect():
            counts[piece] += n / 1e6
        lattice = Lattice(vocabulary, np.log(counts / counts.sum()))
    return lattice.log_p


def _word_scores(batches: Iterator[pd.DataFrame], vocabulary: Vocabulary, log_p: np.ndarray, total: int, distinct: int, discount: float) -> Iterator[pd.DataFrame]:
    """log10 of the model's probability of each row's word; equal words stand side by side."""
    lattice = Lattice(vocabulary, log_p)
    for batch in batches:
        word = batch.word.to_numpy(object)
        new = np.r_[True, word[1:] != word[:-1]]
        first = np.flatnonzero(new)
        cuts = lattice.log_likelihood(word[first].tolist())
        cuts[word[first] == ""] = log_p[vocabulary.end]
        c = batch.c.to_numpy()[first]
        with np.errstate(divide="ignore"):
            if total:
                whole = np.log(np.maximum(c - discount, 0) / total)
                cuts = np.logaddexp(whole, cuts + np.log(discount * distinct / total))
        yield pd.DataFrame({"block": batch.block, "local": batch.local, "c": batch.c, "score": (cuts / np.log(10))[np.cumsum(new) - 1]})


def _document_scores(scores: pd.DataFrame, blocks: pd.DataFrame, total: int, distinct: int) -> pd.DataFrame:
    row = blocks.iloc[0]
    ends = np.asarray(row.ends)
    ids = _unpacked(row.ids, int(ends[-1]))
    n = len(scores)
    c, model = np.zeros(n, np.int64), np.zeros(n)
    c[scores.local.to_numpy()], model[scores.local.to_numpy()] = scores.c.to_numpy(), scores.score.to_numpy()
    base = np.log10((c + ADDED) / (total + ADDED * (distinct + 1)))
    starts = np.r_[0, ends[:-1]]
    add = lambda values: np.add.reduceat(values[ids], starts)  # noqa: E731  every document has its end, so none is empty
    return pd.DataFrame({
        "doc_id": row.doc_ids, "held_out": row.held, "n_tokens": ends - starts, "n_known": add((c > 0).astype(np.int64)), "base_score": add(base), "score": add(model)})


def scores(docs: DataFrame, held: F.Column, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    held: the condition of the documents the model doesn't learn from.
    """
    spark = docs.sparkSession
    vocabulary = Vocabulary.load(vocabulary_path)
    arrow_rows(spark)
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(held, F.lit(False)).alias("held"))
    blocks = staged(rows.mapInPandas(lambda b: _blocks(b, block_tokens), BLOCKS), "lm-blocks")
    arrow_rows(spark, 1)
    lists = blocks.select("block", "words", "counts").mapInPandas(_word_lists, "word string, block bigint, local int, c bigint")
    same = Window.partitionBy("word")
    lists = lists.withColumn("c", F.sum("c").over(same)).withColumn("head", F.row_number().over(same.orderBy("block")) == 1)
    lists = staged(lists, "lm-words")
    arrow_rows(spark, 50_000)
    training = lists.where("head AND c > 0")
    total, distinct, once, twice = training.agg(
        F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).head()
    discount = once / (once + 2 * twice) if once and twice else 0.5
    log_p = _learn(vocabulary, training.where("word <> ''").select("word"), rounds)
    by_word = lists.select("word", "c", "block", "local").mapInPandas(
        lambda b: _word_scores(b, vocabulary, log_p, total, distinct, discount), "block bigint, local int, c bigint, score double")
    found = by_word.groupBy("block").cogroup(blocks.select("block", "doc_ids", "held", "ends", "ids").groupBy("block")).applyInPandas(
        lambda a, b: _document_scores(a, b, total, distinct), SCORES)
    kind = docs.schema[id_col].dataType
    return found.withColumn("doc_id", F.col("doc_id").cast(kind)).withColumn("train_tokens", F.lit(total).cast("bigint"))
