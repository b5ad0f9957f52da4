"""Usage, retention, projection and comparison queries."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import functions as F

from ..operators import compare, project, retention as rt, usage as us
from ..session import stage_path, staged
from ..sources import keyed
from .registry import cte, query
from .sqlbase import half_even

NOW = datetime(2024, 1, 30, 12)
RUNS_NOW = datetime(2001, 8, 1)
SINCE = datetime(2024, 1, 10)
TOTALS = """count(*) AS calls, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
 CAST(sum(total_tokens) AS BIGINT) AS total_tokens, CAST(sum(cost_e8) AS DOUBLE) / 1e8 AS cost_usd"""


def priced(t):
    return us.price_usage(t.model_usage, t.prices)


@query("usage_priced", "USE-1", sql="SELECT id, model, total_tokens, CAST(cost_e8 AS DOUBLE) / 1e8 AS cost_usd FROM priced_usage")
def _(t):
    return priced(t).select("id", "model", "total_tokens", "cost_usd")


@query("usage_filtered", "PRJ-7", sql="SELECT id, run_id, prompt_tokens FROM model_usage WHERE run_id = 8 AND created_at >= TIMESTAMP '2024-01-10'")
def _(t):
    return us.filter_usage(t.model_usage, 8, SINCE).select("id", "run_id", "prompt_tokens")


@query("usage_total", "USE-2", sql=f"SELECT {TOTALS} FROM priced_usage WHERE created_at >= TIMESTAMP '2024-01-10'")
def _(t):
    return us.usage_summary(priced(t), since=SINCE)


@query("usage_per_run", "USE-2", sql=f"SELECT run_id, {TOTALS} FROM priced_usage GROUP BY run_id")
def _(t):
    return us.usage_summary(priced(t), ["run_id"])


@query("usage_by_stage", "USE-3", sql=f"SELECT coalesce(stage, 'unknown') AS stage, {TOTALS} FROM priced_usage GROUP BY 1")
def _(t):
    return us.usage_by_stage(priced(t))


@query("usage_rollup", "USE-12", sql=f"""
SELECT run_id, stage, model, {TOTALS}, CAST(GROUPING(run_id, stage, model) AS BIGINT) AS level
FROM (SELECT * REPLACE (coalesce(stage, 'unknown') AS stage) FROM priced_usage) GROUP BY GROUPING SETS ((run_id), (stage), (model), ())
""")
def _(t):
    return us.usage_rollup(priced(t))


@query("usage_budget_runs", "USE-4", "INF-7", sql="""
SELECT run_id, CAST(sum(cost_e8) AS DOUBLE) / 1e8 AS spent_usd, CAST(sum(cost_e8) AS DOUBLE) / 1e8 >= 0.03 AS over FROM priced_usage GROUP BY run_id
""")
def _(t):
    return us.budget_status(priced(t), 0.03, 1.0, NOW)[0]


@query("usage_budget_day", "USE-4", sql="""
SELECT coalesce(CAST(sum(cost_e8) FILTER (WHERE created_at >= TIMESTAMP '2024-01-30') AS DOUBLE), 0) / 1e8 AS spent_usd,
       coalesce(CAST(sum(cost_e8) FILTER (WHERE created_at >= TIMESTAMP '2024-01-30') AS DOUBLE), 0) / 1e8 >= 0.05 AS over FROM priced_usage
""")
def _(t):
    return us.budget_status(priced(t), 0.03, 0.05, NOW)[1]


@query("usage_budget_crossing", "USE-4", "STR-7", sql="""
SELECT run_id, id, CAST(s AS DOUBLE) / 1e8 AS spent_usd
FROM (SELECT run_id, id, cost_e8, sum(cost_e8) OVER (PARTITION BY run_id ORDER BY id) AS s FROM priced_usage)
WHERE s >= 2000000 AND s - cost_e8 < 2000000
""")
def _(t):
    return us.budget_crossings(priced(t), ["run_id"], 0.02)


@query("usage_budget_crossing_day", "USE-4", "STR-7", sql="""
SELECT day, id, CAST(s AS DOUBLE) / 1e8 AS spent_usd
FROM (SELECT strftime(created_at, '%Y-%m-%d') AS day, id, cost_e8, sum(cost_e8) OVER (PARTITION BY strftime(created_at, '%Y-%m-%d') ORDER BY id) AS s FROM priced_usage)
WHERE s >= 5000000 AND s - cost_e8 < 5000000
""")
def _(t):
    return us.budget_crossings(priced(t).withColumn("day", F.date_format("created_at", "yyyy-MM-dd")), ["day"], 0.05)


def stats_sql(value: str, table: str, ts: str) -> str:
    def q(p):
        pos = f"(len(l) - 1) * CAST({p} AS DOUBLE)"
        low, high = f"l[CAST(floor({pos}) AS BIGINT) + 1]", f"l[CAST(ceil({pos}) AS BIGINT) + 1]"
        return half_even(f"{low} * (1 - ({pos} - floor({pos}))) + {high} * ({pos} - floor({pos}))", 3)

    return f"""SELECT stage, len(l) AS count, {q(0.5)} AS p50, {q(0.95)} AS p95, {half_even('list_max(l)', 3)} AS max
FROM (SELECT coalesce(stage, 'unknown') AS stage, list_sort(list({value})) AS l FROM {table} WHERE {ts} >= TIMESTAMP '2024-01-10' GROUP BY 1)"""


cte("stage_timings", "SELECT event_id AS id, user_id AS run_id, event_type AS stage, value AS duration_ms, ts AS started_at FROM events")


@query("usage_stage_timing", "USE-5", sql=stats_sql("duration_ms", "stage_timings", "started_at"))
def _(t):
    return us.stage_timing_summary(t.stage_timings, SINCE)


@query("usage_model_latency", "USE-6", sql=stats_sql("latency_ms", "model_usage", "created_at"))
def _(t):
    return us.model_latency_summary(t.model_usage, SINCE)


@query("usage_duration_rows", "USE-11", sql=f"""
SELECT stage, quantile, CASE WHEN quantile = 'count' THEN value ELSE value / 1000 END AS value, 'stage_duration_seconds' AS metric
FROM (SELECT stage, unnest(['0.5', '0.95', 'max', 'count']) AS quantile, unnest([p50, p95, max, CAST(count AS DOUBLE)]) AS value
      FROM ({stats_sql("duration_ms", "stage_timings", "started_at")}))
""")
def _(t):
    return us.duration_metrics_table(us.stage_timing_summary(t.stage_timings, SINCE), "stage_duration_seconds")


@query("queue_state", "USE-7", sql="""
SELECT count(*) AS depth, CAST(max(greatest(date_sub('second', created_at, TIMESTAMP '2001-08-01'), 0)) AS BIGINT) AS oldest_seconds FROM ops_runs WHERE status = 'pending'
""")
def _(t):
    return us.queue_state(t.ops_runs, RUNS_NOW)


@query("queue_executors", "USE-8", sql="""
SELECT 'owner-' || user_id AS owner, max(ts) AS last_seen, date_sub('second', max(ts), TIMESTAMP '2024-01-30 12:00:00') <= 3600 AS seen FROM events GROUP BY user_id
""")
def _(t):
    return us.executor_seen(t.heartbeats, NOW, 3600)


@query("job_success_rate", "USE-9", sql="""
SELECT job_id, date_trunc('day', ts) AS window_start, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed,
  CASE WHEN count(*) FILTER (WHERE status <> 'waiting_for_model') > 0
       THEN count(*) FILTER (WHERE status = 'completed') / count(*) FILTER (WHERE status <> 'waiting_for_model') END AS success_rate
FROM job_status GROUP BY 1, 2
""")
def _(t):
    return us.job_success_rate(t.job_status, ["job_id"])


@query("slo_report", "USE-10", sql="""
SELECT objective, entity, value, target, higher, met, share AS budget_share, CASE WHEN share < 0.5 THEN 'normal' WHEN share < 1 THEN 'fix only' ELSE 'freeze' END AS tier FROM (
  SELECT 'job_success_rate' AS objective, CAST(job_id AS VARCHAR) AS entity, r AS value, CAST(0.95 AS DOUBLE) AS target, true AS higher, r >= CAST(0.95 AS DOUBLE) AS met,
         (1 - r) / (1 - CAST(0.95 AS DOUBLE)) AS share
  FROM (SELECT job_id, count(*) FILTER (WHERE status = 'completed') / count(*) AS r FROM job_status WHERE status <> 'waiting_for_model' GROUP BY job_id)
  UNION ALL
  SELECT 'run_cost_usd', CAST(run_id AS VARCHAR), c, CAST(0.1 AS DOUBLE), false, c <= CAST(0.1 AS DOUBLE), c / CAST(0.1 AS DOUBLE)
  FROM (SELECT run_id, CAST(sum(cost_e8) AS DOUBLE) / 1e8 AS c FROM priced_usage GROUP BY run_id))
""")
def _(t):
    jobs = t.job_status.where("status <> 'waiting_for_model'").groupBy("job_id").agg(
        (F.count_if(F.col("status") == "completed") / F.count("*")).alias("value"))
    rate = jobs.select(F.lit("job_success_rate").alias("objective"), F.col("job_id").cast("string").alias("entity"), "value")
    cost = us.usage_summary(priced(t), ["run_id"]).select(
        F.lit("run_cost_usd").alias("objective"), F.col("run_id").cast("string").alias("entity"), F.col("cost_usd").alias("value"))
    targets = t.spark.createDataFrame(us.SLO_TARGETS, "objective string, target double, higher boolean")
    return us.slo_report(rate.unionByName(cost), targets)


# ---- retention and listings ----


@query("prune_events", "WIN-1", sql="""
SELECT run_id, least(count(*), 20) AS kept, greatest(count(*) - 20, 0) AS removed FROM (SELECT user_id AS run_id FROM events) GROUP BY run_id
""")
def _(t):
    return rt.removed(t.run_events, rt.prune_events(t.run_events, 20), ["run_id"])


@query("prune_events_kept", "WIN-1", sql="SELECT event_id AS id, user_id AS run_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 20")
def _(t):
    return rt.prune_events(t.run_events, 20).select("id", "run_id")


@query("prune_reports_kept", "WIN-2", sql="SELECT report_id, app_url FROM reports QUALIFY row_number() OVER (PARTITION BY app_url ORDER BY created_at DESC, report_id DESC) <= 5")
def _(t):
    return rt.prune_reports(t.reports, 5).select("report_id", "app_url")


EXPIRED = "SELECT run_id FROM ops_runs WHERE updated_at < TIMESTAMP '2001-08-01' - INTERVAL 900 DAY AND status NOT IN ('pending', 'running', 'waiting_for_model')"


@query("prune_runs_kept", "WIN-3", sql=f"SELECT run_id, status FROM ops_runs WHERE run_id NOT IN ({EXPIRED})")
def _(t):
    return rt.prune_runs(t.ops_runs, {}, t.heartbeats, 900, RUNS_NOW)[0].select("run_id", "status")


@query("prune_runs_children", "WIN-3", sql=f"SELECT l_orderkey AS run_id, l_linenumber FROM lineitem WHERE l_orderkey NOT IN ({EXPIRED})")
def _(t):
    children = t.raw("lineitem").select(F.col("l_orderkey").alias("run_id"), "l_linenumber")
    return rt.prune_runs(t.ops_runs, {"stage_outputs": children}, t.heartbeats, 900, RUNS_NOW)[1]["stage_outputs"]


@query("prune_heartbeats", "WIN-3", sql="SELECT 'owner-' || user_id AS owner, ts AS heartbeat_at FROM events WHERE ts >= TIMESTAMP '2024-01-29 12:00:00'")
def _(t):
    return rt.prune_runs(t.ops_runs, {}, t.heartbeats, 900, NOW)[2]


@query("latest_report", "WIN-4", sql="""
SELECT app_url, created_at, report_id, findings_count FROM reports QUALIFY row_number() OVER (PARTITION BY app_url ORDER BY created_at DESC, report_id DESC) = 1
""")
def _(t):
    return rt.latest_report(t.reports)


@query("report_changes", "WIN-5", sql="""
SELECT app_url, report_id, CASE WHEN b IS NULL THEN '首次报告' ELSE printf('发现数量变化：%d → %d', b, findings_count) END AS change
FROM (SELECT *, lag(findings_count) OVER (PARTITION BY app_url ORDER BY created_at, report_id) AS b FROM reports) WHERE b IS NULL OR b <> findings_count
""")
def _(t):
    return rt.change_summary(t.reports)


@query("active_runs", "WIN-6", sql="""
SELECT run_id, app_url, status FROM ops_runs WHERE updated_at >= TIMESTAMP '2001-08-01' - INTERVAL 100 DAY
 AND (status IN ('pending', 'waiting_for_model') OR (status = 'running' AND coalesce(heartbeat_at, updated_at) >= TIMESTAMP '2001-08-01' - INTERVAL 100 DAY))
QUALIFY row_number() OVER (PARTITION BY app_url ORDER BY updated_at DESC, run_id DESC) = 1
""")
def _(t):
    return rt.active_runs(t.ops_runs, RUNS_NOW, 100 * 24 * 60).select("run_id", "app_url", "status")


@query("queue_order", "WIN-7", sql="SELECT run_id, updated_at FROM ops_runs WHERE status = 'pending' AND lease_owner IS NULL ORDER BY updated_at, run_id LIMIT 50")
def _(t):
    return rt.queue_order(t.ops_runs, 50).select("run_id", "updated_at")


@query("runs_by_status", "PRJ-8", sql="SELECT run_id, updated_at FROM ops_runs WHERE status = 'failed' ORDER BY updated_at DESC, run_id DESC LIMIT 50")
def _(t):
    return rt.list_by_status(t.ops_runs, "failed", 50).select("run_id", "updated_at")


@query("recent_events", "WIN-8", sql="""
SELECT event_id AS id, user_id AS run_id, event_type AS stage, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS place FROM events
QUALIFY place <= 6
""")
def _(t):
    return rt.recent_events(t.run_events).select("id", "run_id", "stage", "place")


@query("run_listing", "WIN-9", sql="""
SELECT r.run_id, r.status, r.run_id % 5 = 0 AS cancel_requested, coalesce(u.calls, 0) AS calls, coalesce(u.c, 0) AS cost_usd
FROM (SELECT * FROM ops_runs ORDER BY updated_at DESC, run_id DESC LIMIT 200) r
LEFT JOIN (SELECT run_id, count(*) AS calls, CAST(sum(cost_e8) AS DOUBLE) / 1e8 AS c FROM priced_usage GROUP BY run_id) u USING (run_id)
""")
def _(t):
    cancels = t.ops_runs.where("run_id % 5 = 0").select("run_id")
    return rt.run_listing(t.ops_runs, cancels, priced(t), 500).select("run_id", "status", "cancel_requested", "calls", "cost_usd")


@query("maintenance_counts", "WIN-10", sql=f"""
SELECT 'events' AS rule, CAST(sum(greatest(n - 50, 0)) AS BIGINT) AS removed FROM (SELECT count(*) AS n FROM events GROUP BY user_id)
UNION ALL SELECT 'reports', CAST(sum(greatest(n - 5, 0)) AS BIGINT) FROM (SELECT count(*) AS n FROM reports GROUP BY app_url)
UNION ALL SELECT 'runs', count(*) FROM ({EXPIRED.replace('2001-08-01', '2024-01-30 12:00:00')})
UNION ALL SELECT 'cache', count(*) FROM events WHERE ts < TIMESTAMP '2024-01-23 12:00:00'
""")
def _(t):
    cache = t.raw("events").select(F.col("ts").alias("created_at"))
    return rt.maintenance(t.run_events, t.reports, t.ops_runs, cache, NOW, keep_reports=5, days=900)


@query("maintenance_rewritten", "WIN-10", sql=f"""
SELECT "table", count(*) FILTER (NOT gone) AS kept, count(*) FILTER (gone) AS removed FROM (
  SELECT 'runs' AS "table", run_id IN ({EXPIRED}) AS gone FROM ops_runs
  UNION ALL SELECT 'lines', l_orderkey IN ({EXPIRED}) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
  UNION ALL SELECT 'usage', event_id IN ({EXPIRED}) FROM events
  UNION ALL SELECT 'heartbeats', max(ts) < TIMESTAMP '2001-07-31' FROM events GROUP BY user_id) GROUP BY "table"
""")
def _(t):
    """Stored tables by run; expired runs leave all of them, and what stays is read back."""
    store = lambda rows, key, by: keyed.create(rows, stage_path(t.spark, "maintained"), key, [key], 32, by)
    lines = t.raw("lineitem").select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("line"), F.col("l_orderkey").alias("run_id"), "l_quantity")
    runs = store(t.ops_runs.select("run_id", "status", "updated_at"), "run_id", None)
    usage = store(t.raw("events").select("event_id", F.col("event_id").alias("run_id"), "value"), "event_id", "run_id")
    beats = t.heartbeats.groupBy("owner").agg(F.max("heartbeat_at").alias("heartbeat_at"))
    tables = {"lines": store(lines, "line", "run_id"), "usage": usage}
    heartbeats = store(beats, "owner", None)
    gone = rt.maintain(runs, tables, heartbeats, 900, datetime(2001, 8, 1))
    tables |= {"runs": runs, "heartbeats": heartbeats}
    parts = [table.read().agg(F.count("*").alias("kept")).select(F.lit(name).alias("table"), "kept", F.lit(gone[name]).cast("bigint").alias("removed")) for name, table in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("report_summary", "WIN-11", sql="""
SELECT a.run_id, coalesce(f.n, 0) AS n_findings, coalesce(r.n, 0) AS n_requirements, coalesce(t.n, 0) AS n_tests, coalesce(u.tokens, 0) AS tokens,
       printf('「goal %s」分析完成：发现 %d 条、需求 %d 条、测试用例 %d 条。模型成本 $%d.%04d（%d tokens）。数据状态：%s。',
              a.run_id, coalesce(f.n, 0), coalesce(r.n, 0), coalesce(t.n, 0), coalesce(u.e4, 0) // 10000, coalesce(u.e4, 0) % 10000, coalesce(u.tokens, 0),
              CASE WHEN a.status = 'completed' THEN '有效' ELSE a.status END) AS summary
FROM analysis_runs a
LEFT JOIN (SELECT run_id, count(*) AS n FROM findings GROUP BY run_id) f USING (run_id)
LEFT JOIN (SELECT run_id, count(*) AS n FROM requirements GROUP BY run_id) r USING (run_id)
LEFT JOIN (SELECT run_id, count(*) AS n FROM tests GROUP BY run_id) t USING (run_id)
LEFT JOIN (SELECT 'src' || (run_id % 20) AS run_id, CAST(sum(total_tokens) AS BIGINT) AS tokens, CAST((sum(cost_e8) + 5000) // 10000 AS BIGINT) AS e4 FROM priced_usage GROUP BY ALL) u USING (run_id)
""")
def _(t):
    from .evidence import Chain

    c = Chain(t, staged=True)
    usage = priced(t).withColumn("run_id", F.concat(F.lit("src"), F.col("run_id") % 20))
    return rt.report_rows(t.analysis_runs.withColumn("goal", F.concat(F.lit("goal "), "run_id")), c.findings, c.requirements, c.tests, usage)


@query("report_lines", "WIN-11", sql="""
SELECT run_id, 'finding' AS section, finding_id AS entity_id, printf('%s · 状态 %s · 支持 %d / 冲突 %d', title, evidence_status, support_count, conflict_count) AS line FROM findings
UNION ALL SELECT run_id, 'requirement', requirement_id, printf('%s · 影响 %d/5 · 复杂度 %s · 目标版本 %s', title, impact, complexity, target_version) FROM requirements
UNION ALL SELECT run_id, 'test', test_case_id, printf('%s %s（%s）', test_case_id, title, case_type) FROM tests
""")
def _(t):
    from .evidence import Chain

    c = Chain(t, staged=True)
    return rt.report_lines(c.findings, c.requirements, c.tests)


# ---- projections ----

cte("requests", """
SELECT run_id, CASE WHEN n % 2 = 0 THEN [1, 2, 3] ELSE [2, 3, 4, 5] END AS ratings, CASE WHEN n % 3 = 0 THEN [] ELSE ['1.0', '1.2'] END AS app_versions, 10 + n AS review_limit
FROM (SELECT DISTINCT run_id, CAST(regexp_extract(run_id, '([0-9]+)$', 1) AS INTEGER) AS n FROM reviews)
""")


@query("filter_request", "PRJ-1", sql="""
SELECT r.run_id, r.review_id FROM reviews r JOIN requests q USING (run_id)
WHERE list_contains(q.ratings, r.rating) AND (len(q.app_versions) = 0 OR list_contains(q.app_versions, r.app_version))
QUALIFY row_number() OVER (PARTITION BY r.run_id ORDER BY r.ord) <= any_value(q.review_limit) OVER (PARTITION BY r.run_id)
""")
def _(t):
    n = F.regexp_extract("run_id", r"(\d+)$", 1).cast("int")
    lits = lambda *v: F.array(*[F.lit(x) for x in v])
    requests = t.analysis_runs.select(
        "run_id", F.when(n % 2 == 0, lits(1, 2, 3)).otherwise(lits(2, 3, 4, 5)).alias("ratings"),
        F.when(n % 3 == 0, F.array().cast("array<string>")).otherwise(lits("1.0", "1.2")).alias("app_versions"),
        (n + 10).alias("review_limit"),
    )
    return project.filter_request(t.reviews, requests).select("run_id", "review_id")


@query("filter_platform", "PRJ-2", sql="""
SELECT review_id, platform FROM (SELECT review_id, CASE WHEN ord % 7 = 0 THEN NULL ELSE platform END AS platform FROM reviews) WHERE coalesce(platform, 'app-store') <> 'social'
""")
def _(t):
    p = F.when(F.col("ord") % 7 != 0, F.col("platform"))
    return t.reviews.select("review_id", p.alias("platform")).where(project.allowed_platform(F.col("platform")))


# Display labels.
LABELS = [
    ("status", "completed", "已完成"), ("status", "partial", "部分完成"), ("mode", "live", "实时"), ("mode", "replay", "回放"),
]


@query("localized_runs", "PRJ-5", sql="""
SELECT run_id, CASE status WHEN 'completed' THEN '已完成' WHEN 'partial' THEN '部分完成' ELSE status END AS status,
       CASE mode WHEN 'live' THEN '实时' WHEN 'replay' THEN '回放' ELSE mode END AS mode,
       CASE WHEN input_count % 3 = 0 THEN '待生成' ELSE 'n ' || input_count END AS summary FROM analysis_runs
""")
def _(t):
    labels = t.spark.createDataFrame(LABELS, "column string, code string, label string")
    runs = t.analysis_runs.select(
        "run_id", "status", "mode",
        F.when(F.col("input_count") % 3 == 0, "  ").otherwise(F.concat(F.lit("n "), "input_count")).alias("summary"),
    )
    return project.localize(runs, labels, ["status", "mode"], "summary")


@query("empty_columns", "PRJ-5", sql="""
SELECT 'lease_owner' AS "column", count(lease_owner) = 0 AS all_null FROM ops_runs UNION ALL SELECT 'status', false FROM (SELECT 1)
UNION ALL SELECT 'finished_at', true FROM (SELECT 1)
""")
def _(t):
    runs = t.ops_runs.withColumn("finished_at", F.lit(None).cast("timestamp_ntz"))
    return project.empty_columns(runs, ["lease_owner", "status", "finished_at"])


@query("redacted_messages", "PRJ-6", sql="""
SELECT event_id, 'fail ' || event_type || ' API_KEY=[REDACTED] [REDACTED] in [REDACTED_ENV]' AS message FROM events
""")
def _(t):
    message = F.concat(F.lit("fail\n"), "event_type", F.lit(" API_KEY="), "event_id", F.lit(" sk-abcdefgh"), "event_id", F.lit(" in .env.local"))
    return t.raw("events").select("event_id", project.redact(message).alias("message"))


@query("masked_reviews", "PRJ-6", sql="""
SELECT ord AS message_id, 'model failed: [REDACTED_REVIEW] | ' || ord || ' | [REDACTED_REVIEW]' AS message FROM reviews WHERE content_original <> ''
""")
def _(t):
    """Each message quotes its own review and the first one of its run; all reviews of the run are asked for."""
    reviews = t.reviews.where("content_original <> ''").select("run_id", "ord", "content_original")
    # Written, so that its size is known: a few rows go to the messages, not the messages to a few runs.
    first = staged(reviews.groupBy("run_id").agg(F.min_by("content_original", "ord").alias("other")), "mask-first")
    message = F.concat(F.lit("model failed: "), "content_original", F.lit(" | "), "ord", F.lit(" | "), "other")
    parts = reviews.select(F.col("ord").alias("message_id"), "run_id", "ord", "content_original")
    return project.mask_reviews(parts, reviews, message, first).select("message_id", "message")


# ---- sets and comparison ----


@query("set_reference_gap", "SET-1", sql="""
SELECT DISTINCT run_id, review_id, (run_id, review_id) IN (SELECT (run_id, review_id) FROM known_reviews) AS known FROM draft_evidence
""")
def _(t):
    return compare.reference_gap(t.draft_evidence, t.known_reviews, ["run_id"], "review_id")


@query("set_merge_evidence", "SET-4", sql="""
SELECT run_id, finding_index, review_id, CAST(min(side) AS INTEGER) AS side, arg_min(pos, (side, pos)) AS pos
FROM (SELECT *, CASE role WHEN 'supporting' THEN 0 ELSE 1 END AS side FROM draft_evidence) GROUP BY ALL
""")
def _(t):
    e = t.draft_evidence
    return compare.merge_evidence(e.where("role = 'supporting'"), e.where("role = 'conflicting'"), ["run_id", "finding_index"], "review_id")


@query("compare_tables", "SET-2", sql="""
SELECT 'customer' AS "table", count(*) AS n_a, count(*) AS n_b, 'content' AS verdict FROM customer
UNION ALL SELECT 'nation', count(*), count(*), 'same' FROM nation
UNION ALL SELECT 'orders', count(*), count(*) FILTER (WHERE o_orderkey <> 7), 'row count' FROM orders
UNION ALL SELECT 'supplier', count(*), NULL, 'missing table' FROM supplier
""")
def _(t):
    c, o = t.raw("customer"), t.raw("orders")
    changed = c.withColumn("c_name", F.when(F.col("c_custkey") == 3, "changed").otherwise(F.col("c_name")))
    return compare.compare_tables({
        "customer": (c, changed), "nation": (t.raw("nation"), t.raw("nation")),
        "orders": (o, o.where("o_orderkey <> 7")), "supplier": (t.raw("supplier"), None),
    })


def restored(t):
    """A copy of the orders with changed, missing and extra rows."""
    o, k = t.raw("orders"), F.col("o_orderkey")
    kept = o.where(k % 1000 != 4).withColumn("o_totalprice", F.when(k % 1000 == 3, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return o, kept.unionByName(o.where(k % 1000 == 5).withColumn("o_orderkey", -k))


@query("compare_rows", "SET-2", sql="""
SELECT o_orderkey, 'changed' AS change FROM orders WHERE o_orderkey % 1000 = 3 UNION ALL SELECT o_orderkey, 'missing' FROM orders WHERE o_orderkey % 1000 = 4
UNION ALL SELECT -o_orderkey, 'extra' FROM orders WHERE o_orderkey % 1000 = 5
""")
def _(t):
    return compare.compare_rows(*restored(t), ["o_orderkey"])


@query("compare_tree", "SET-2", sql="""
WITH k AS (
  SELECT sha256(CAST(o_orderkey AS VARCHAR)) AS h, 1 AS a, CASE WHEN o_orderkey % 1000 = 4 THEN 0 ELSE 1 END AS b, o_orderkey % 1000 IN (3, 4) AS d FROM orders
  UNION ALL SELECT sha256(CAST(-o_orderkey AS VARCHAR)), 0, 1, true FROM orders WHERE o_orderkey % 1000 = 5)
SELECT CAST(level AS INTEGER) AS level, left(h, level) AS node, CAST(sum(a) AS BIGINT) AS n_a, CAST(sum(b) AS BIGINT) AS n_b, bool_or(d) AS differs FROM k, range(4) r(level) GROUP BY ALL
""")
def _(t):
    return compare.compare_tree(*restored(t), ["o_orderkey"])


@query("canonical_diff", "SET-3", sql="""
SELECT o_orderkey, 'o_orderstatus' AS field, o_orderstatus AS before, 'X' AS after FROM orders WHERE o_orderkey % 100 = 3
UNION ALL SELECT o_orderkey, '*', 'present', NULL FROM orders WHERE o_orderkey % 100 = 4
""")
def _(t):
    a = t.raw("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    b = a.where("o_orderkey % 100 <> 4").withColumn(
        "o_orderstatus", F.when(F.col("o_orderkey") % 100 == 3, "X").otherwise(F.col("o_orderstatus"))
    ).withColumn("o_orderdate", F.expr("o_orderdate + interval 1 day"))
    return compare.canonical_diff(a, b, ["o_orderkey"], ["o_orderdate"])
