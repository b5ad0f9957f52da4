"""Status alerts, threshold rules with a hold time, rolling metrics and event tails over stored tables.

The stream forms are in `streaming/`; both follow the same rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import spread_join
from ..functions.numeric import round_half_even
from ..functions.scan import previous
from .usage import exact_percentiles

TERMINAL = ("completed", "partial", "failed", "timed_out", "cancelled")  # fixed values

# Rule, gauge, comparison, threshold, minutes it must hold, severity.
RULES = [
    ("process_down", "up", "==", 0.0, 2, "critical"),
    ("not_ready", "worker_ready", "==", 0.0, 5, "warning"),
    ("stage_slow", "stage_p95_seconds", ">", 120.0, 10, "warning"),
    ("model_slow", "model_p95_seconds", ">", 60.0, 10, "warning"),
    ("queue_backlog", "queue_depth", ">", 5.0, 10, "warning"),
    ("executor_missing", "queued_without_executor", ">", 0.0, 10, "critical"),
    ("job_failures", "failed_jobs_1h", ">", 0.0, 5, "warning"),
]


def alert_of(before: Column, status: Column) -> Column:
    """First failure alerts, repeats are silent, completion after a failure is a recovery."""
    failed = F.coalesce(before == "failed", F.lit(False))
    return F.when((status == "failed") & ~failed, "failure").when((status == "completed") & failed, "recovery")


def status_alerts(jobs: DataFrame) -> DataFrame:
    rows = previous(jobs, ["job_id"], "ord", F.col("status"), "before")
    return rows.withColumn("alert", alert_of(F.col("before.v"), F.col("status"))).where("alert is not null").select(
        "job_id", "ord", "status", "alert")


def queued_without_executor(depth: DataFrame, seen: DataFrame) -> DataFrame:
    """Gauge of queue depth at the times no executor was seen. Inputs: series, ts, value."""
    s = seen.select("series", "ts", F.col("value").alias("seen"))
    rows = depth.join(s, ["series", "ts"], "left")
    return rows.select("series", "ts", F.when(F.coalesce("seen", F.lit(0.0)) == 0, F.col("value")).otherwise(0.0).alias("value"))


def failures_last_hour(jobs: DataFrame, step: str = "10 minutes") -> DataFrame:
    """Failed jobs of the hour before each step, per job."""
    failed = jobs.where("status = 'failed'").groupBy("job_id", F.window("ts", "1 hour", step).alias("w")).agg(F.count("*").alias("n"))
    return failed.select(F.col("job_id").cast("string").alias("series"), F.col("w.end").alias("ts"), F.col("n").cast("double").alias("value"))


def alert_rules(gauges: DataFrame, rules: DataFrame, step_minutes: int = 10) -> DataFrame:
    """Alerts that fire: a threshold met at every sample for the hold time of its rule.

    Gauges (metric, series, ts, value) are samples at fixed steps, so a series is small however
    much traffic it measures. A missing sample ends the run of samples.
    """
    value, limit = F.col("value"), F.col("threshold")
    met = F.when(F.col("op") == ">", value > limit).otherwise(value == limit)
    rows = gauges.join(F.broadcast(rules), "metric").withColumn("met", met)  # the fixed list of rules
    w = Window.partitionBy("rule", "series").orderBy("ts")
    gap = F.timestamp_diff("MINUTE", F.lag("ts").over(w), F.col("ts")) > step_minutes
    starts = F.col("met") & (~F.coalesce(F.lag("met").over(w), F.lit(False)) | F.coalesce(gap, F.lit(True)))
    runs = rows.withColumn("island", F.sum(F.when(starts, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("met")
    began = F.min("ts").over(Window.partitionBy("rule", "series", "island"))
    held = runs.withColumn("started_at", began).where(
        F.timestamp_diff("MINUTE", F.col("started_at"), F.col("ts")) >= F.col("hold_minutes"))
    return held.groupBy("rule", "severity", "series", "started_at").agg(F.min("ts").alias("fired_at"), F.max("ts").alias("last_at"))


def rolling_metrics(timings: DataFrame, width: str) -> DataFrame:
    """Exact count, median, 95th percentile and maximum per window and stage."""
    rows = timings.withColumn("window_start", F.window("started_at", width)["start"])
    out = exact_percentiles(rows, ["window_start", "stage"], "duration_ms", {"p50": 0.5, "p95": 0.95})
    return out.select("window_start", "stage", "count", *[round_half_even(F.col(c), 3).alias(c) for c in ("p50", "p95", "max")])


def tail_events(events: DataFrame) -> DataFrame:
    """Events of each run up to its first terminal status, then one `done` row."""
    ends = events.where(F.col("status").isin(*TERMINAL)).groupBy("run_id").agg(F.min("id").alias("end_id"))
    closed = spread_join(events, ends, ["run_id"], ["id"], "inner").where("id <= end_id")
    open_runs = events.join(ends, "run_id", "left_anti")
    rows = closed.select("run_id", "id", "status").unionByName(open_runs.select("run_id", "id", "status"))
    done = ends.select("run_id", F.col("end_id").alias("id"), F.lit("done").alias("status"))
    return rows.unionByName(done)
