"""Session settings the jobs rely on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    # Else listing the files of a micro-batch is a task per file.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "100",
}


def get_session(app: str = "tracewell", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def tune(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session made elsewhere."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints, from `spark.checkpoint.dir`.

    A temporary folder is used only where the whole session runs on one machine and names none, as
    in tests; on a cluster, executors could not see it, so the setting is required there.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir() or folder


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path for a table written once and read again, in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared checkpoint folder and read it back: lineage ends here."""
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


class Rounds:
    """Tables that a loop writes one after another: each takes the place of the one `keep` rounds before it."""

    def __init__(self, spark: SparkSession, name: str, keep: int = 2):
        self.spark, self.paths, self.n = spark, [stage_path(spark, name) for _ in range(keep)], 0

    def put(self, df: DataFrame) -> DataFrame:
        path = self.paths[self.n % len(self.paths)]
        self.n += 1
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def clear(self, but_last: bool = False) -> None:
        """Give the space back; a table that was read from here is gone then."""
        last = (self.n - 1) % len(self.paths)
        for i, path in enumerate(self.paths[: self.n]):
            if not (but_last and i == last):
                self.spark.range(0).write.mode("overwrite").parquet(path)
