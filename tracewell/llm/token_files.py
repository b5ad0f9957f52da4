"""Token ids in shard files with a minimal perfect hash index for keyed access.

`write` makes three tables under one path, all in ascending order of the key:
  pages     shard, page, doc_ids, ends, ids: whole documents, their ids end to end (little-endian,
            2 bytes each, or 4 where the vocabulary needs it); ends are positions after each document
  shards    shard, base, n_tokens: ids in all shards before this one
  index     bucket, n, sizes, bits, prints, shard, offset, length, docs: a minimal perfect hash of the
            bucket's keys; per slot a 32-bit fingerprint of the key and where its ids lie in a shard
Keyed access hashes a key to its bucket, its slot there, compares the fingerprint, and has shard,
offset and length: constant time, whatever the number of documents.

Texts are encoded in the task that sorts them, once. The tokenizer sees each distinct stretch between
spaces or line ends once per worker (it drops white space and never looks across it); the memory for
that is bounded, and only speed depends on it.

Nulls: a null text is empty, its document is the end id alone; a null key sorts first, its ids are
stored and read back, but only other keys are in the index. Repeated keys are stored in a row, one
document each; the index has them as one stretch. An empty table gives empty tables.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scan import running_sum
from ..session import staged
from .common import arrow_rows, parts_of
from .perfect_hash import build, slots

DOCS_PER_SHARD = 4096
PAGE_TOKENS = 1 << 17
KEYS_PER_BUCKET = 4096
KNOWN_WORDS = 300_000
#: Punctuation that may be parted from the letters before it (no apostrophe: it can begin a group with letters).
TAIL = ".,;:!?*#$%&"
BEHIND = rf"([a-z])([{TAIL}]+)( |$)"

PAGES = "shard int, page int, doc_ids array<bigint>, ends array<int>, ids binary"
INDEX = "bucket bigint, n int, sizes array<int>, bits binary, prints binary, shard binary, offset binary, length binary, docs binary"
FOUND = "doc_id bigint, shard int, offset bigint, n_tokens bigint, n_docs bigint"


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next free one from U+0100."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b) if b in printable else chr(next(others)) for b in range(256)}


class Encoder:
    """Encode texts with a tokenizer that drops white space, keeping what each stretch of text becomes.

    The tokenizer makes one token group of a run of letters and one of a run of punctuation. So a
    stretch of plain Latin letters, with or without punctuation behind it, goes to the tokenizer's model
    directly, in small letters; any other stretch goes through the whole tokenizer. What is kept is
    bounded: when the newer half is full, the older half goes.
    """

    _made: dict[tuple[str, str], "Encoder"] = {}

    def __init__(self, path: str, dtype: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer, self.dtype, self.known, self.older = Tokenizer.from_file(path), dtype, {"": b""}, {}
        self.letters = _byte_letters()

    @classmethod
    def of(cls, path: str, dtype: str) -> "Encoder":
        """The worker's own, kept from task to task."""
        if (path, dtype) not in cls._made:
            cls._made[path, dtype] = cls(path, dtype)
        return cls._made[path, dtype]

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _encode_new(self, stretches: set[str]) -> None:
        known, older, model, rest, tailed = self.known, self.older, self.tokenizer.model, [], []
        for x in stretches:
            if (ids := older.get(x)) is not None:
                known[x] = ids
                continue
            stem = x.rstrip(TAIL)
            low = stem.lower()
            # Below U+0250 letters are composed, and only the capital I with a dot changes its length in small form.
            if not (stem.isalpha() and len(low) == len(stem) and (stem.isascii() or max(stem) < "\u0250")):
                rest.append(x)
                continue
            if (ids := known.get(low)) is None and (ids := older.get(low)) is None:
                own = low if low.isascii() else low.encode().decode("latin-1").translate(self.letters)
                ids = self._bytes([t.id for t in model.tokenize(own)])
            known[low] = ids
            if len(stem) < len(x):
                tailed.append((x, ids, x[len(stem) :]))
            else:
                known[x] = ids
        rest += {tail for _, _, tail in tailed}.difference(known)
        for x, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            known[x] = self._bytes(e.ids)
        for x, ids, tail in tailed:
            known[x] = ids + known[tail]

    def stretches(self, parts: list[str]) -> list[bytes]:
        """Ids of distinct stretches."""
        if len(self.known) > KNOWN_WORDS:
            self.known, self.older = {"": b""}, self.known
        found = list(map(self.known.get, parts))
        if new := {x for x, ids in zip(parts, found, strict=True) if ids is None}:
            self._encode_new(new)
            found = list(map(self.known.get, parts))
        return found

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id behind it, end to end, and where each text ends.

        Each distinct stretch of the texts is looked at once; its ids are then gathered by position.
        """
        # The tokenizer folds case; capitals A-Z and punctuation behind a letter would only make more stretches distinct.
        plain = pc.ascii_lower(pc.replace_substring(texts, "\n", " "))
        cut = pc.split_pattern(pc.replace_substring_regex(plain, BEHIND, r"\1 \2\3"), " ")
        coded = cut.flatten().dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        ids = [*self.stretches(coded.dictionary.to_pylist()), self._bytes([end_id])]
        width = np.dtype(self.dtype).itemsize
        sizes = np.array([len(x) for x in ids], np.int64) // width
        blob, starts = np.frombuffer(b"".join(ids), self.dtype), np.r_[0, np.cumsum(sizes)[:-1]]
        offsets = cut.offsets.to_numpy().astype(np.int64) - cut.offsets[0].as_py()
        codes = np.insert(coded.indices.to_numpy().astype(np.int64), offsets[1:], len(ids) - 1)
        lengths = sizes[codes]
        ends = np.cumsum(lengths)
        at = np.repeat(starts[codes] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
        return blob[at], ends[offsets[1:] + np.arange(len(texts))]


def _vocabulary_size(path: str) -> int:
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    return max([0, *model["model"]["vocab"].values(), *(t["id"] for t in model["added_tokens"])]) + 1


def write(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text",
    docs_per_shard: int = DOCS_PER_SHARD, page_tokens: int = PAGE_TOKENS, keys_per_bucket: int = KEYS_PER_BUCKET,
) -> None:
    spark = docs.sparkSession
    arrow_rows(spark)
    dtype = "<u2" if max(_vocabulary_size(tokenizer), end_id + 1) <= 1 << 16 else "<u4"
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = ["doc_id", "__h"]  # the text's hash lets documents of one key go to several shards
    rows = rows.withColumn("__h", F.xxhash64("text")).repartitionByRange(parts_of(docs.count(), docs_per_shard), *order)
    rows.sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(
        lambda batches: _encoded(batches, tokenizer, end_id, dtype, page_tokens), PAGES).write.parquet(f"{path}/pages")
    spark.createDataFrame([(dtype, end_id)], "dtype string, end_id int").coalesce(1).write.parquet(f"{path}/format")
    pages = spark.read.parquet(f"{path}/pages")
    sizes = pages.groupBy("shard").agg(F.sum(F.element_at("ends", -1).cast("bigint")).alias("n_tokens")).withColumn("__all", F.lit(0))
    running_sum(sizes, ["__all"], "shard", "n_tokens", "base", exclusive=True).drop("__all").write.parquet(f"{path}/shards")
    entries = _documents(pages, dtype, with_crc=False).where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min(F.struct("shard", "offset")).alias("first"), F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_docs"))
    entries = staged(entries, "token-entries")
    buckets = parts_of(entries.count(), keys_per_bucket)
    hashed = entries.select(
        *_hashes("doc_id", buckets), F.col("first.shard").alias("shard"), F.col("first.offset").alias("offset"), "n_tokens", "n_docs")
    hashed.groupBy("bucket").applyInPandas(_index, INDEX).write.parquet(f"{path}/index")
    spark.createDataFrame([(buckets,)], "buckets bigint").coalesce(1).write.parquet(f"{path}/buckets")


def _encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int, dtype: str, page_tokens: int) -> Iterator[pa.RecordBatch]:
    encode, shard, page = Encoder.of(path, dtype), TaskContext.get().partitionId(), 0
    ids, ends, parts, total = [], [], [], 0

    def closed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([page], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int32())), pa.array([b"".join(parts)], pa.binary())],
            ["shard", "page", "doc_ids", "ends", "ids"])

    for batch in batches:
        if not batch.num_rows:
            continue
        found, upto = encode(batch.column("text"), end_id)
        begin = 0
        for doc_id, end in zip(batch.column("doc_id").to_pylist(), upto.tolist(), strict=True):
            parts.append(found[begin:end].tobytes())
            total += end - begin
            begin = end
            ids.append(doc_id)
            ends.append(total)
            if total >= page_tokens:
                yield closed()
                ids, ends, parts, total, page = [], [], [], 0, page + 1
    if ids:
        yield closed()


def _documents(pages: DataFrame, dtype: str, with_crc: bool = True) -> DataFrame:
    """doc_id, shard, offset (in the shard) and n_tokens of each stored document, and a sum over its ids."""
    ends = pages.select("shard", "page", F.element_at("ends", -1).cast("bigint").alias("__n"))
    before = running_sum(ends, ["shard"], "page", "__n", "__base", exclusive=True).select("shard", "page", "__base")
    if with_crc:
        pages = pages.mapInPandas(lambda b: _sums(b, dtype), "shard int, page int, doc_ids array<bigint>, ends array<int>, crcs array<bigint>")
    else:
        pages = pages.select("shard", "page", "doc_ids", "ends", F.transform("ends", lambda _: F.lit(0).cast("bigint")).alias("crcs"))
    pages = pages.join(before, ["shard", "page"])
    starts = F.concat(F.array(F.lit(0)), F.slice("ends", 1, F.size("ends") - 1))
    rows = pages.select("shard", "__base", F.explode(F.arrays_zip("doc_ids", "ends", starts.alias("starts"), "crcs")).alias("d"))
    return rows.select(
        F.col("d.doc_ids").alias("doc_id"), "shard", (F.col("__base") + F.col("d.starts")).alias("offset"),
        (F.col("d.ends") - F.col("d.starts")).cast("bigint").alias("n_tokens"), F.col("d.crcs").alias("ids_crc32"))


def _sums(batches: Iterator[pd.DataFrame], dtype: str) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sums = []
        for ids, ends in zip(batch.ids, batch.ends, strict=True):
            wide, ends = np.frombuffer(ids, dtype).astype("<u4"), np.asarray(ends)
            sums.append([zlib.crc32(wide[a:b].tobytes()) for a, b in zip([0, *ends[:-1]], ends, strict=True)])
        yield pd.DataFrame({"shard": batch["shard"], "page": batch.page, "doc_ids": batch.doc_ids, "ends": batch.ends, "crcs": sums})


def _hashes(key: str, buckets: int) -> list:
    h = F.xxhash64(F.col(key))
    return [F.pmod(F.hash(F.col(key), F.lit(1)), F.lit(buckets)).cast("bigint").alias("bucket"), h.alias("h"), F.hash(F.lit(7), F.col(key)).alias("print")]


def _index(rows: pd.DataFrame) -> pd.DataFrame:
    sizes, bits, slot = build(rows.h.to_numpy().view(np.uint64))
    by_slot = rows.iloc[np.argsort(slot)]
    pack = lambda c, t: [by_slot[c].to_numpy().astype(t).tobytes()]
    return pd.DataFrame({
        "bucket": rows.bucket.iloc[:1].to_numpy(), "n": [len(rows)], "sizes": [sizes], "bits": [bits], "prints": pack("print", "<i4"),
        "shard": pack("shard", "<i4"), "offset": pack("offset", "<i8"), "length": pack("n_tokens", "<i8"), "docs": pack("n_docs", "<i8")})


def lookup(keys: DataFrame, path: str) -> DataFrame:
    """Where the ids of each key lie; keys the index doesn't have are left out (but for one in 2**32)."""
    spark = keys.sparkSession
    buckets = spark.read.parquet(f"{path}/buckets").head()[0]
    asked = keys.where("doc_id IS NOT NULL").distinct().select("doc_id", *_hashes("doc_id", buckets))
    index = spark.read.parquet(f"{path}/index")
    return asked.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(_looked_up, FOUND)


def _looked_up(keys: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    if not len(keys) or not len(index):
        return pd.DataFrame({"doc_id": [], "shard": [], "offset": [], "n_tokens": [], "n_docs": []}).astype("int64")
    row = index.iloc[0]
    slot = slots(keys.h.to_numpy().view(np.uint64), list(row.sizes), row.bits)
    take = lambda c, t: np.frombuffer(row[c], t)[np.maximum(slot, 0)]
    ok = (slot >= 0) & (take("prints", "<i4") == keys["print"].to_numpy())
    found = pd.DataFrame({
        "doc_id": keys.doc_id, "shard": take("shard", "<i4"), "offset": take("offset", "<i8"), "n_tokens": take("length", "<i8"), "n_docs": take("docs", "<i8")})
    return found[ok]


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Every stored document, read from the files: doc_id, shard, offset, start, n_tokens, ids_crc32."""
    dtype = spark.read.parquet(f"{path}/format").head()[0]
    arrow_rows(spark, 32)  # a row is a page of many documents
    rows = _documents(spark.read.parquet(f"{path}/pages"), dtype)
    shards = spark.read.parquet(f"{path}/shards").select("shard", "base")
    return rows.join(shards, "shard").withColumn("start", F.col("base") + F.col("offset")).drop("base")


def by_key(keys: DataFrame, path: str) -> DataFrame:
    """The stored documents of the given keys: those at the shard and offset that the index names; null keys by their place before all others.

    A document is taken where its stretch begins, and its stored key is compared. Of a repeated key the index names the first
    document and the length of the whole stretch, so all documents of the key from there on, over shards, are taken.
    """
    spark = keys.sparkSession
    found = staged(lookup(keys, path), "token-found")
    stored = documents(spark, path)
    one = found.where("n_docs = 1").select(F.col("doc_id").alias("asked"), "shard", "offset", F.col("n_tokens").alias("length"))
    single = stored.join(one, ["shard", "offset"]).where("doc_id = asked AND n_tokens = length").select(*stored.columns)
    if found.where("n_docs > 1").head(1):
        several = found.where("n_docs > 1").select(F.col("doc_id").alias("asked"), F.col("shard").alias("from_shard"), F.col("offset").alias("from_offset"))
        behind = (F.col("shard") > F.col("from_shard")) | ((F.col("shard") == F.col("from_shard")) & (F.col("offset") >= F.col("from_offset")))
        single = single.unionByName(stored.join(several, (F.col("doc_id") == F.col("asked")) & behind).select(*stored.columns))
    return single.unionByName(stored.where("doc_id IS NULL")) if keys.where("doc_id IS NULL").head(1) else single
