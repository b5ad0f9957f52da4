"""Retention, listings and newest-per-key views of the operational tables.

`row_number() <= k` filters are kept directly above the window, so Spark trims each key to k rows
before the shuffle and a hot key never reaches one task whole.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scan import previous
from .usage import ntz

RESUMABLE = ("pending", "running", "waiting_for_model")  # fixed values


def newest(df: DataFrame, keys: list[str], order: list[Column], keep: int) -> DataFrame:
    if keep < 0:
        raise ValueError("keep must not be negative")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__place", place).where(F.col("__place") <= keep).drop("__place")


def prune_events(events: DataFrame, keep: int = 50) -> DataFrame:
    return newest(events, ["run_id"], [F.desc("id")], keep)


def prune_reports(reports: DataFrame, keep: int = 20) -> DataFrame:
    return newest(reports, ["app_url"], [F.desc("created_at"), F.desc("report_id")], keep)


def removed(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Rows removed per key."""
    a = before.groupBy(*keys).agg(F.count("*").alias("n"))
    b = after.groupBy(*keys).agg(F.count("*").alias("kept"))
    return a.join(b, keys, "left").fillna(0, ["kept"]).select(*keys, "kept", (F.col("n") - F.col("kept")).alias("removed"))


def expired_runs(runs: DataFrame, days: int, now: datetime) -> DataFrame:
    """Runs last updated before the cutoff that cannot be resumed.

    Timed-out and cancelled runs are pruned although they could be taken up again; kept as is.
    """
    if days < 0:
        raise ValueError("days must not be negative")
    return runs.where(
        (F.col("updated_at") < ntz(now - timedelta(days=days))) & ~F.col("status").isin(*RESUMABLE)
    ).select("run_id")


def prune_runs(runs: DataFrame, children: dict[str, DataFrame], heartbeats: DataFrame, days: int, now: datetime):
    """Runs, children and heartbeats that stay."""
    victims = expired_runs(runs, days, now)
    kept = {name: child.join(victims, "run_id", "left_anti") for name, child in children.items()}
    fresh = heartbeats.where(F.col("heartbeat_at") >= ntz(now - timedelta(days=1)))
    return runs.join(victims, "run_id", "left_anti"), kept, fresh


def latest_report(reports: DataFrame) -> DataFrame:
    best = F.max_by(F.struct("report_id", "findings_count"), F.struct("created_at", "report_id"))
    return reports.groupBy("app_url").agg(best.alias("r"), F.max("created_at").alias("created_at")).select(
        "app_url", "created_at", "r.report_id", "r.findings_count"
    )


def change_summary(reports: DataFrame) -> DataFrame:
    """First report of an app, and every change of the number of findings against the one before."""
    day = F.date_trunc("day", "created_at")
    order = reports.withColumn("__at", F.struct("created_at", "report_id"))
    rows = previous(order, ["app_url"], "__at", F.col("findings_count"), "before", block=day)
    return rows.where(F.col("before").isNull() | (F.col("before.v") != F.col("findings_count"))).select(
        "app_url", "report_id",
        F.when(F.col("before").isNull(), "首次报告")
        .otherwise(F.format_string("发现数量变化：%d → %d", "before.v", "findings_count")).alias("change"),
    )


def active_runs(runs: DataFrame, now: datetime, timeout_minutes: int = 60) -> DataFrame:
    """The newest run per app that blocks another one."""
    seconds = timeout_minutes * 60
    since = ntz(now - timedelta(seconds=seconds))
    beat = F.coalesce("heartbeat_at", "updated_at")
    blocks = F.col("status").isin("pending", "waiting_for_model") | ((F.col("status") == "running") & (beat >= since))
    return newest(runs.where((F.col("updated_at") >= since) & blocks), ["app_url"], [F.desc("updated_at"), F.desc("run_id")], 1)


def queue_order(runs: DataFrame, limit: int) -> DataFrame:
    """Pending runs nobody holds, oldest first."""
    free = runs.where((F.col("status") == "pending") & F.col("lease_owner").isNull())
    return free.orderBy("updated_at", "run_id").limit(limit)


def list_by_status(runs: DataFrame, status: str, limit: int) -> DataFrame:
    return runs.where(F.col("status") == status).orderBy(F.desc("updated_at"), F.desc("run_id")).limit(limit)


def maintain(runs, children: dict, heartbeats, days: int, now: datetime) -> dict[str, int]:
    """Remove expired runs from stored tables (`sources.keyed`), their children and stale heartbeats with them; rows removed by table.

    Tables are bucketed by run, heartbeats by owner: only buckets that hold something to remove are rewritten.
    """
    victims = expired_runs(runs.read(), days, now)
    removed_rows = {name: table.delete_of(victims)[1] for name, table in children.items()}
    removed_rows["heartbeats"] = heartbeats.delete(F.col("heartbeat_at") < ntz(now - timedelta(days=1)))[1]
    # Runs last: until then a job that failed finds its victims again.
    removed_rows["runs"] = runs.delete_of(victims)[1]
    return removed_rows


def recent_events(events: DataFrame, n: int = 6) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("id")))
    return events.withColumn("place", place).where(F.col("place") <= n)


def run_listing(runs: DataFrame, cancels: DataFrame, usage: DataFrame, limit: int = 20) -> DataFrame:
    """Newest runs with cancel flag and usage; the page is cut before anything is joined."""
    page = runs.orderBy(F.desc("updated_at"), F.desc("run_id")).limit(max(1, min(limit, 200)))
    ids = F.broadcast(page.select("run_id"))  # at most 200 rows
    flag = cancels.join(ids, "run_id", "left_semi").select("run_id").distinct().withColumn("cancel", F.lit(True))
    spent = usage.join(ids, "run_id", "left_semi").groupBy("run_id").agg(
        F.count("*").alias("calls"), (F.sum("cost_e8") / F.lit(1e8)).alias("cost_usd")
    )
    return (
        page.join(flag, "run_id", "left").join(spent, "run_id", "left")
        .withColumn("cancel_requested", F.coalesce("cancel", F.lit(False))).drop("cancel")
        .fillna(0, ["calls"]).fillna(0.0, ["cost_usd"])
    )


def maintenance(events: DataFrame, reports: DataFrame, runs: DataFrame, cache: DataFrame, now: datetime,
                keep_events: int = 50, keep_reports: int = 20, days: int = 90, ttl_days: int = 7) -> DataFrame:
    """How many rows every retention rule removes."""
    cut = lambda name, before, after: before.agg(F.count("*").alias("n")).join(
        after.agg(F.count("*").alias("k")), F.lit(True)
    ).select(F.lit(name).alias("rule"), (F.col("n") - F.col("k")).alias("removed"))
    kept_runs = runs.join(expired_runs(runs, days, now), "run_id", "left_anti")
    kept_cache = cache.where(F.col("created_at") >= ntz(now - timedelta(days=ttl_days)))
    return (
        cut("events", events, prune_events(events, keep_events))
        .unionByName(cut("reports", reports, prune_reports(reports, keep_reports)))
        .unionByName(cut("runs", runs, kept_runs))
        .unionByName(cut("cache", cache, kept_cache))
    )


def report_rows(runs: DataFrame, findings: DataFrame, requirements: DataFrame, tests: DataFrame, usage: DataFrame) -> DataFrame:
    """Summary line of each run."""
    count = lambda df, name: df.groupBy("run_id").agg(F.count("*").alias(name))
    spent = usage.groupBy("run_id").agg(F.sum("total_tokens").alias("tokens"), (F.sum("cost_e8") / F.lit(1e8)).alias("cost"))
    rows = (
        runs.join(count(findings, "n_findings"), "run_id", "left").join(count(requirements, "n_requirements"), "run_id", "left")
        .join(count(tests, "n_tests"), "run_id", "left").join(spent, "run_id", "left").fillna(0)
    )
    state = F.when(F.col("status") == "completed", "有效").otherwise(F.col("status"))
    return rows.select(
        "run_id", "n_findings", "n_requirements", "n_tests", "tokens",
        F.format_string(
            "「%s」分析完成：发现 %d 条、需求 %d 条、测试用例 %d 条。模型成本 $%.4f（%d tokens）。数据状态：%s。",
            "goal", "n_findings", "n_requirements", "n_tests", "cost", "tokens", state,
        ).alias("summary"),
    )


def report_lines(findings: DataFrame, requirements: DataFrame, tests: DataFrame) -> DataFrame:
    """Ordered body lines of each run's report, one row per entity."""
    line = lambda df, section, ident, text: df.select(
        "run_id", F.lit(section).alias("section"), F.col(ident).alias("entity_id"), text.alias("line")
    )
    f = F.format_string("%s · 状态 %s · 支持 %d / 冲突 %d", "title", "evidence_status", "support_count", "conflict_count")
    r = F.format_string("%s · 影响 %d/5 · 复杂度 %s · 目标版本 %s", "title", "impact", "complexity", "target_version")
    c = F.format_string("%s %s（%s）", "test_case_id", "title", "case_type")
    return (
        line(findings, "finding", "finding_id", f)
        .unionByName(line(requirements, "requirement", "requirement_id", r))
        .unionByName(line(tests, "test", "test_case_id", c))
    )
