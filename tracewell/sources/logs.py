"""Typed reads of logs, stage outputs and evaluation reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AGENT_EVENT = "run_id string, step int, kind string, message string, payload map<string,string>, created_at timestamp"


def read_agent_events(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """One JSON object per line."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(AGENT_EVENT).json(path)


STAGE_SCHEMAS = {
    "clean": "reviews array<struct<review_id string, content_original string, rating int>>, stats struct<input_count bigint, output_count bigint>",
    "validate_findings": "findings array<struct<finding_id string, support_count bigint, confidence double, supporting_review_ids array<string>>>",
    "plan": "requirements array<struct<requirement_id string, finding_ids array<string>>>, quantity_notice string",
    "generate_tests": "test_cases array<struct<test_case_id string, requirement_id string>>",
    "validate_traceability": "valid boolean, issues array<struct<rule string, message string, severity string>>",
}


def read_stage_outputs(df: DataFrame, stage: str) -> tuple[DataFrame, DataFrame]:
    """Typed payloads of one stage, and the rows whose payload does not have the shape."""
    schema = STAGE_SCHEMAS[stage]
    first = schema.split(" ", 1)[0]
    rows = df.where(F.col("stage") == stage).withColumn("p", F.from_json("payload", schema))
    bad = F.col("p").isNull() | F.col(f"p.{first}").isNull()
    keys = ["run_id", "stage", "batch_index"]
    return rows.where(~bad).select(*keys, "p.*"), rows.where(bad).select(*keys, "payload")


def read_eval_history(spark: SparkSession, path: str) -> DataFrame:
    """Metric rows of every report file of a folder."""
    schema = "prompt_fingerprint string, dataset string, summary map<string,double>"
    rows = spark.read.schema(schema).json(path, multiLine=True)
    return rows.select(
        F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file"), F.col("prompt_fingerprint").alias("fingerprint"),
        "dataset", F.explode("summary").alias("metric", "value"),
    ).where("value is not null")
