"""Batch twins of the stream jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alerts as al, usage as us
from .registry import cte, query
from .sqlbase import half_even


@query("status_alerts", "STR-3", sql="""
SELECT job_id, ord, status, CASE WHEN status = 'failed' THEN 'failure' ELSE 'recovery' END AS alert
FROM (SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY ord) AS b FROM job_status)
WHERE (status = 'failed' AND b IS DISTINCT FROM 'failed') OR (status = 'completed' AND b = 'failed')
""")
def _(t):
    return al.status_alerts(t.job_status)


cte("gauge_rows", """
SELECT 'stage_p95_seconds' AS metric, stage AS series, ts, v AS value FROM (
  SELECT event_type AS stage, time_bucket(INTERVAL 3 HOUR, ts) AS ts, max(value) AS v FROM events GROUP BY 1, 2)
UNION ALL SELECT 'queue_depth', stage, ts, v FROM (SELECT event_type AS stage, time_bucket(INTERVAL 3 HOUR, ts) AS ts, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY 1, 2)
UNION ALL SELECT 'queued_without_executor', stage, ts, CASE WHEN p = 0 THEN v ELSE 0 END FROM (
  SELECT event_type AS stage, time_bucket(INTERVAL 3 HOUR, ts) AS ts, CAST(count(*) AS DOUBLE) AS v, count(*) FILTER (WHERE user_id % 4 = 0) AS p FROM events GROUP BY 1, 2)
UNION ALL SELECT 'failed_jobs_1h', CAST(user_id AS VARCHAR), b + INTERVAL 1 HOUR, CAST(count(*) AS DOUBLE)
  FROM (SELECT user_id, unnest([time_bucket(INTERVAL 10 MINUTE, ts) - to_minutes(10 * i) FOR i IN range(6)]) AS b FROM events WHERE event_type = 'error') GROUP BY 2, 3
""")
cte("rule_rows", """
SELECT * FROM (VALUES
  ('process_down', 'up', '==', CAST(0.0 AS DOUBLE), 2, 'critical'),
  ('not_ready', 'worker_ready', '==', CAST(0.0 AS DOUBLE), 5, 'warning'),
  ('stage_slow', 'stage_p95_seconds', '>', CAST(120.0 AS DOUBLE), 10, 'warning'),
  ('model_slow', 'model_p95_seconds', '>', CAST(60.0 AS DOUBLE), 10, 'warning'),
  ('queue_backlog', 'queue_depth', '>', CAST(5.0 AS DOUBLE), 10, 'warning'),
  ('executor_missing', 'queued_without_executor', '>', CAST(0.0 AS DOUBLE), 10, 'critical'),
  ('job_failures', 'failed_jobs_1h', '>', CAST(0.0 AS DOUBLE), 5, 'warning')
) v(rule, metric, op, threshold, hold_minutes, severity)
""")


def islands(step: int, metrics: str) -> str:
    return f"""
SELECT rule, severity, series, started_at, min(ts) AS fired_at, max(ts) AS last_at FROM (
  SELECT *, min(ts) OVER (PARTITION BY rule, series, island) AS started_at FROM (
    SELECT *, sum(s) OVER (PARTITION BY rule, series ORDER BY ts) AS island FROM (
      SELECT *, CASE WHEN met AND (NOT coalesce(lag(met) OVER w, false) OR date_sub('minute', lag(ts) OVER w, ts) > {step}) THEN 1 ELSE 0 END AS s FROM (
        SELECT *, CASE op WHEN '>' THEN value > threshold ELSE value = threshold END AS met FROM gauge_rows JOIN rule_rows USING (metric) WHERE metric IN ({metrics}))
      WINDOW w AS (PARTITION BY rule, series ORDER BY ts))) WHERE met)
WHERE date_sub('minute', started_at, ts) >= hold_minutes GROUP BY ALL"""


def gauges(t):
    e = t.raw("events")
    by = [F.col("event_type").alias("series"), F.window("ts", "3 hours")["start"].alias("ts")]
    slots = e.groupBy(*by).agg(F.max("value").alias("m"), F.count("*").cast("double").alias("n"), F.count_if(F.col("user_id") % 4 == 0).alias("p"))
    row = lambda m, v: slots.select(F.lit(m).alias("metric"), "series", "ts", v.alias("value"))
    depth = slots.select("series", "ts", F.col("n").alias("value"))
    seen = slots.select("series", "ts", F.col("p").cast("double").alias("value"))
    missing = al.queued_without_executor(depth, seen).withColumn("metric", F.lit("queued_without_executor"))
    return row("stage_p95_seconds", F.col("m")).unionByName(row("queue_depth", F.col("n"))).unionByName(missing)


def rules(t):
    return t.spark.createDataFrame(al.RULES, "rule string, metric string, op string, threshold double, hold_minutes int, severity string")


@query("alerts_fired", "STR-4", sql=islands(180, "'stage_p95_seconds', 'queue_depth', 'queued_without_executor'"))
def _(t):
    return al.alert_rules(gauges(t), rules(t), 180)


@query("alerts_job_failures", "STR-4", sql=islands(10, "'failed_jobs_1h'"))
def _(t):
    failures = al.failures_last_hour(t.job_status).withColumn("metric", F.lit("failed_jobs_1h"))
    return al.alert_rules(failures, rules(t), 10)


@query("tailed_events", "STR-5", sql="""
WITH e AS (SELECT user_id AS run_id, event_id AS id, CASE WHEN event_id % 37 = 0 THEN 'completed' ELSE 'running' END AS status FROM events),
x AS (SELECT run_id, min(id) AS end_id FROM e WHERE status = 'completed' GROUP BY run_id)
SELECT e.run_id, e.id, e.status FROM e LEFT JOIN x USING (run_id) WHERE end_id IS NULL OR id <= end_id UNION ALL SELECT run_id, end_id, 'done' FROM x
""")
def _(t):
    status = F.when(F.col("id") % 37 == 0, "completed").otherwise("running")
    return al.tail_events(t.run_events.withColumn("status", status))


def window_stats() -> str:
    def q(p):
        pos = f"(len(l) - 1) * CAST({p} AS DOUBLE)"
        low, high = f"l[CAST(floor({pos}) AS BIGINT) + 1]", f"l[CAST(ceil({pos}) AS BIGINT) + 1]"
        return half_even(f"{low} * (1 - ({pos} - floor({pos}))) + {high} * ({pos} - floor({pos}))", 3)

    return f"""SELECT window_start, stage, len(l) AS count, {q(0.5)} AS p50, {q(0.95)} AS p95, {half_even('list_max(l)', 3)} AS max
FROM (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, event_type AS stage, list_sort(list(value)) AS l FROM events GROUP BY 1, 2)"""


@query("rolling_metrics", "STR-6", sql=window_stats())
def _(t):
    return al.rolling_metrics(t.stage_timings, "6 hours")
