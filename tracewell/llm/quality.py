"""Quality classifier: an additive model with pairwise interactions over features of the whole text.

Features are counts and shares found in the text alone. The model is fitted on at most `sample_rows`
labelled documents, those with the least hash of their id, and then scores every text in one scan:
bin numbers by search, table entries added, no shuffle.

Nulls: a null text is the empty text and gets a score like any other. Labels without id or value are
left out; a document labelled more than once counts as good only if every label says so. Repeated rows
of one id are one training row. With no labels, or labels of one kind, all texts get that kind's share.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .additive_model import Model, fit
from .common import arrow_rows

SAMPLE_ROWS = 20_000
ACCEPT = 0.7

_KIND = np.zeros(256, np.int64)  # 0 other
for _kind, _bytes in enumerate((range(65, 91), range(97, 123), range(48, 58), b".,;:", b"!?", b"'\"()-", b"#$%&*+/<=>@[\\]^_`{|}~", b" \t\v\f", b"\n\r", range(128, 256)), start=1):
    for _b in _bytes:
        _KIND[_b] = _kind
KINDS = 11

FEATURES = (
    "log_words", "word_length", "capitals", "digits", "points", "cries", "quotes", "symbols", "controls", "beyond_ascii", "line_length", "log_lines",
    "distinct_words", "top_word", "single_bytes", "long_words", "repeated_lines", "compressed", "distinct_bytes",
)


def features(text: str | None) -> list[float]:
    data = (text or "").encode()
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    kind = np.bincount(_KIND, counts, KINDS)
    words = data.split()
    n, size = max(1, len(words)), max(1, len(data))
    inside = max(1.0, size - kind[8] - kind[9])
    tally = Counter(words)
    lengths = Counter(map(len, words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    return [
        np.log1p(len(words)), inside / n, kind[1] / inside, kind[3] / inside, kind[4] / n, kind[5] / n, kind[6] / n, kind[7] / n, kind[0] / size,
        kind[10] / inside, np.log1p(size / max(1, len(lines))), np.log1p(len(lines)),
        len(tally) / n**0.85, max(tally.values(), default=0) / n, lengths[1] / n, sum(c for k, c in lengths.items() if k > 14) / n,
        1 - len(set(lines)) / max(1, len(lines)), len(zlib.compress(data, 1)) / size, np.count_nonzero(counts) / size**0.25,
    ]


def matrix(texts) -> np.ndarray:
    return np.array([features(t) for t in texts], np.float64).reshape(-1, len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """allowed: condition on labelled ids the model may learn from."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & allowed)
    known = known.groupBy(id_col).agg(F.min(label_col).cast("int").alias("__y"))
    # At most sample_rows rows of two numbers, so sending them to every task is bounded.
    sample = known.orderBy(F.xxhash64(id_col), id_col).limit(sample_rows).select(F.col(id_col).alias("__id"), "__y")

    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return pd.Series(list(matrix(texts)), dtype=object)

    arrow_rows(docs.sparkSession)
    found = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(sample), "__id")
    rows = found.select("__id", "__y", measured("__text").alias("__x")).groupBy("__id").agg(F.min("__y").alias("y"), F.min("__x").alias("x")).orderBy("__id").collect()
    x = np.array([r["x"] for r in rows], np.float64).reshape(-1, len(FEATURES))
    return fit(x, np.array([r["y"] for r in rows], np.float64))


def score(model: Model):
    """A column function: the probability that a text is of label 1."""

    @F.pandas_udf("double")
    def probability(texts: pd.Series) -> pd.Series:
        return pd.Series(model.probability(matrix(texts)))

    return probability


def classified(docs: DataFrame, model: Model, text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """docs with `score` and `predicted`; columns of these names are replaced."""
    arrow_rows(docs.sparkSession)
    rows = docs.withColumn("score", score(model)(F.col(text_col)))
    return rows.withColumn("predicted", (F.col("score") >= accept).cast("int"))


def accepted(docs: DataFrame, model: Model, text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """The documents that score at least `accept`, as they are."""
    arrow_rows(docs.sparkSession)
    return docs.where(score(model)(F.col(text_col)) >= accept)
