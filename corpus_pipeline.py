"""The corpus pipeline: stages over `documents`, each written as Parquet and read by the next.

A stage that drops documents names a row by a 64-bit hash of its id and text, so ids may be null or
repeat. Every stage keeps the columns of its input, but for the last, which reports the token files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import decontamination, mixing, quality, queries, similar, token_files
from tracewell.llm.common import remainder, table
from tracewell.session import stage_path, staged, tune

#: Near duplicates: the least Jaccard index of the sets of five-word shingles.
SHINGLE, SIMILAR = 5, 0.8


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__key", F.xxhash64("doc_id", "text"))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 4) != 2)
    return quality.accepted(docs, model)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least id.

    SimHash and BK-trees propose pairs; a pair links if its shingle sets have a Jaccard index of SIMILAR or more.
    """
    keyed = _keyed(docs)
    rows, found = similar.groups(keyed, SHINGLE, SIMILAR, "__key", keep=("doc_id",))
    members = rows.join(found.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    members = staged(members.select("key", "doc_id", "component"), "pipeline-groups")
    first = members.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("first"))
    gone = members.join(first, "component").where(F.col("key") != F.col("first.key")).select(F.col("key").alias("__key"))
    rows = keyed.join(gone, "__key", "left_anti")
    again = members.groupBy(F.col("key").alias("__key")).count().where("count > 1").select("__key")
    one = rows.join(again, "__key", "left_semi").dropDuplicates(["__key", "doc_id", "text"])
    return rows.join(again, "__key", "left_anti").unionByName(one).select(*docs.columns)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten consecutive words of a benchmark item, and that aren't as a whole a shorter item."""
    keyed = _keyed(docs)
    found = decontamination.repeating(keyed, table(spark, sf_dir, "benchmark"), id_col="__key")
    gone = found.withColumnRenamed("doc_id", "__key")
    return keyed.join(gone, "__key", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document is there as often as the mix takes it."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and what they hold per document, found through their index."""
    path = stage_path(spark, "pipeline-tokens")
    token_files.write(docs, path, queries.word_bpe(), end_id=1)
    return token_files.by_key(docs.select("doc_id"), path).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("quality classifier", good), ("SimHash near-dedup", distinct), ("benchmark decontamination", uncontaminated),
    ("mixing sources to target weights", mix), ("token-ID output", tokens)]

#: A trained classifier is the first stage, so SQL can't express the rows of run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tune(spark).read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
