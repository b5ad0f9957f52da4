"""Structured Streaming forms of ingestion, upserts, alerts, metrics and budgets."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.alerts import TERMINAL
from ..sources import reviews as rv
from ..sources.sinks import latest_by


#: What a micro-batch reads at most, unless a number of files is given: small files must not each cost a share of a batch.
BYTES_PER_TRIGGER = 1 << 28


def stream_reviews(spark: SparkSession, path: str, app_id: str, files_per_trigger: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Landed JSON import files as two streams: valid reviews and rejects with their reason.

    No row is dropped for its age: files of any order and date arrive whole. Repeats of a review are settled by key in
    the corpus, where the latest row wins (`read_corpus`), so no state is kept and nothing is lost behind a watermark.
    """
    limit = ("maxBytesPerTrigger", BYTES_PER_TRIGGER) if files_per_trigger is None else ("maxFilesPerTrigger", files_per_trigger)
    files = spark.readStream.format("text").option("wholetext", True).option(*limit).load(path)
    rows = rv.record_columns(rv.parse_records(files))
    named = rv.normalize_review_columns(rows.withColumns({"app_id": F.lit(app_id), "source": F.lit("import:json"), "ord": F.col("n")}))
    return rv.validate_import(named)


def stream_upsert_corpus(reviews: DataFrame, path: str, checkpoint: str):
    """Write each micro-batch under its own number; a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return reviews.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """The latest row of each review over all micro-batches."""
    return latest_by(spark.read.parquet(path), "review_id", ["batch", "ord"])


def status_alerts(jobs: DataFrame) -> DataFrame:
    """Alerts from status changes; the state of a job is its last status."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("ord", kind="stable")
        out = []
        for o, status in zip(rows["ord"], rows["status"]):
            if status == "failed" and last != "failed":
                out.append((key[0], o, status, "failure"))
            elif status == "completed" and last == "failed":
                out.append((key[0], o, status, "recovery"))
            last = status
        state.update((last,))
        yield pd.DataFrame(out, columns=["job_id", "ord", "status", "alert"])

    return jobs.select("job_id", "ord", "status").groupBy("job_id").applyInPandasWithState(
        step, f"job_id {dict(jobs.dtypes)['job_id']}, ord bigint, status string, alert string", "last string", "append", GroupStateTimeout.NoTimeout)


def held_alerts(samples: DataFrame, step_minutes: int = 10) -> DataFrame:
    """Threshold rules over a stream of evaluated samples (rule, series, ts, met, hold_minutes).

    State per rule and series: start of the current run of met samples, the last sample, whether
    it has fired.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, last, fired = state.get if state.exists else (None, None, False)
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        out: list[Any] = []
        for ts, met, hold in zip(rows["ts"], rows["met"], rows["hold_minutes"]):
            now = int(pd.Timestamp(ts).timestamp())
            if not met:
                start, fired = None, False
            elif start is None or now - last > step_minutes * 60:
                start, fired = now, False
            if start is not None and not fired and now - start >= hold * 60:
                out.append((*key, pd.Timestamp(start, unit="s"), pd.Timestamp(now, unit="s")))
                fired = True
            last = now
        state.update((start, last, fired))
        yield pd.DataFrame(out, columns=["rule", "series", "started_at", "fired_at"])

    return samples.groupBy("rule", "series").applyInPandasWithState(
        step, "rule string, series string, started_at timestamp, fired_at timestamp",
        "start bigint, last bigint, fired boolean", "append", GroupStateTimeout.NoTimeout)


def tail_events(events: DataFrame) -> DataFrame:
    """New events per run in order until a terminal status, then a `done` row; later events are dropped."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, done = state.get if state.exists else (-1, False)
        rows = pd.concat(list(batches)).sort_values("id", kind="stable")
        out = []
        for i, status in zip(rows["id"], rows["status"]):
            if done or i <= last:
                continue
            out.append((key[0], i, status))
            last = i
            if status in TERMINAL:
                out.append((key[0], i, "done"))
                done = True
        state.update((int(last), done))
        yield pd.DataFrame(out, columns=["run_id", "id", "status"])

    return events.select("run_id", "id", "status").groupBy("run_id").applyInPandasWithState(
        step, f"run_id {dict(events.dtypes)['run_id']}, id bigint, status string", "last bigint, done boolean", "append", GroupStateTimeout.NoTimeout)


def rolling_metrics(timings: DataFrame, width: str, delay: str) -> DataFrame:
    """Windowed count, approximate percentiles and maximum; late rows behind the watermark are dropped."""
    return (
        timings.withWatermark("started_at", delay)
        .groupBy(F.window("started_at", width).alias("w"), "stage")
        .agg(F.count("*").alias("count"), F.percentile_approx("duration_ms", [0.5, 0.95], 10_000).alias("p"), F.max("duration_ms").alias("max"))
        .select(F.col("w.start").alias("window_start"), "stage", "count", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"), "max")
    )


def budget_meter(priced: DataFrame, key: str, limit_e8: int) -> DataFrame:
    """The call at which the running spend of a key reaches the limit."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spent = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values("id", kind="stable")
        running = spent + rows["cost_e8"].cumsum()
        crossed = rows[(running >= limit_e8) & (running - rows["cost_e8"] < limit_e8)]
        state.update((int(running.iloc[-1]),))
        yield pd.DataFrame({key: [k[0]] * len(crossed), "id": crossed["id"], "spent_e8": running[crossed.index]})

    kind = dict(priced.dtypes)[key]
    return priced.select(key, "id", "cost_e8").groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, id bigint, spent_e8 bigint", "spent bigint", "append", GroupStateTimeout.NoTimeout)


def late_rejects(rows: DataFrame, good_path: str, reject_path: str, progress_path: str, delay_seconds: int, checkpoint: str):
    """Split each micro-batch: malformed rows (null `ts`) and rows behind the watermark go to a side table.

    The watermark is the largest event time of earlier batches less the delay, kept as one row per
    batch; a repeated batch sees the same earlier rows and so splits the same way.
    """

    def split(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            seen = spark.read.parquet(progress_path).where(F.col("batch") < batch_id).agg(F.max("max_ts")).first()[0]
        except Exception as error:  # noqa: BLE001 - the first batch has no progress yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            seen = None
        late = F.lit(False) if seen is None else F.col("ts") < F.lit(seen) - F.expr(f"interval {delay_seconds} seconds")
        reason = F.when(F.col("ts").isNull(), "malformed").when(late, "late")
        marked = batch.withColumn("reject_reason", reason)
        marked.where("reject_reason is null").drop("reject_reason").write.mode("overwrite").parquet(f"{good_path}/batch={batch_id}")
        marked.where("reject_reason is not null").write.mode("overwrite").parquet(f"{reject_path}/batch={batch_id}")
        batch.agg(F.max("ts").alias("max_ts")).write.mode("overwrite").parquet(f"{progress_path}/batch={batch_id}")

    return rows.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint)
