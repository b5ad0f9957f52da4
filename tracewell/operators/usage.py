"""Usage, cost, latency, queue and objective reports over append-only operational tables.

Money is kept as whole units of 1e-8 dollars (cents per million tokens times tokens), so sums do
not depend on the order of rows.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import round_half_even
from ..functions.scan import running_sum

DEFAULT_PRICE = (27, 110)  # fixed values: cents per million prompt and completion tokens
UNIT = 1e8


def ntz(moment: datetime):
    return F.lit(moment.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def price_usage(usage: DataFrame, prices: DataFrame, model: str = "model") -> DataFrame:
    """First matching model prefix in list order, else the default price.

    The price list is configuration of a few rows; it becomes one expression, so usage rows are priced where they lie.
    """
    listed = prices.orderBy("ord").select("prefix", "prompt_cents", "completion_cents").collect()

    def cents(i: int) -> Column:
        price = None
        for row in listed:
            fits = F.startswith(F.coalesce(F.col(model), F.lit("")), F.lit(row.prefix))
            price = F.when(fits, row[i + 1]) if price is None else price.when(fits, row[i + 1])
        default = F.lit(DEFAULT_PRICE[i])
        return default if price is None else price.otherwise(default)

    return (
        usage.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))
        .withColumn(
            "cost_e8",
            F.col("prompt_tokens") * cents(0) + F.col("completion_tokens") * cents(1),
        )
        .withColumn("cost_usd", F.col("cost_e8") / F.lit(UNIT))
    )


def filter_usage(df: DataFrame, run_id=None, since: datetime | None = None, ts: str = "created_at") -> DataFrame:
    """A missing argument means no filter."""
    if run_id is not None:
        df = df.where(F.col("run_id") == run_id)
    if since is not None:
        df = df.where(F.col(ts) >= ntz(since))
    return df


def _totals():
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return [
        F.count("*").alias("calls"), total("prompt_tokens"), total("completion_tokens"), total("total_tokens"),
        (F.coalesce(F.sum("cost_e8"), F.lit(0)) / F.lit(UNIT)).alias("cost_usd"),
    ]


def usage_summary(priced: DataFrame, keys: list[str] = (), run_id=None, since=None) -> DataFrame:
    """Calls, tokens and cost; one row of zeros when nothing matches and no keys are given."""
    return filter_usage(priced, run_id, since).groupBy(*keys).agg(*_totals())


def usage_by_stage(priced: DataFrame, run_id=None) -> DataFrame:
    rows = filter_usage(priced, run_id).withColumn("stage", F.coalesce("stage", F.lit("unknown")))
    return rows.groupBy("stage").agg(*_totals())


def usage_rollup(priced: DataFrame) -> DataFrame:
    """Totals per run, per stage, per model and overall in one pass."""
    rows = priced.withColumn("stage", F.coalesce("stage", F.lit("unknown")))
    run, stage, model = F.col("run_id"), F.col("stage"), F.col("model")
    return rows.groupingSets([[run], [stage], [model], []], run, stage, model).agg(
        *_totals(), F.grouping_id().alias("level")
    )


def budget_status(priced: DataFrame, per_run_usd: float, per_day_usd: float, now: datetime) -> tuple[DataFrame, DataFrame]:
    """Spend per run over all time, and the one-row spend since 00:00 UTC, against their limits."""
    day = now.replace(hour=0, minute=0, second=0, microsecond=0)
    runs = priced.groupBy("run_id").agg((F.sum("cost_e8") / F.lit(UNIT)).alias("spent_usd"))
    runs = runs.withColumn("over", F.lit(per_run_usd > 0) & (F.col("spent_usd") >= F.lit(per_run_usd)))
    today = F.coalesce(F.sum(F.when(F.col("created_at") >= ntz(day), F.col("cost_e8"))), F.lit(0))
    daily = priced.agg((today / F.lit(UNIT)).alias("spent_usd"))
    daily = daily.withColumn("over", F.lit(per_day_usd > 0) & (F.col("spent_usd") >= F.lit(per_day_usd)))
    return runs, daily


def budget_crossings(priced: DataFrame, keys: list[str], limit_usd: float) -> DataFrame:
    """The call at which each key's running spend reaches the limit."""
    limit = round(limit_usd * UNIT)
    running = running_sum(priced, keys, "id", "cost_e8", "spent_e8")
    return (
        running.where((F.col("spent_e8") >= limit) & (F.col("spent_e8") - F.col("cost_e8") < limit))
        .groupBy(*keys).agg(F.min_by(F.struct("id", "spent_e8"), "id").alias("c"))
        .select(*keys, F.col("c.id").alias("id"), (F.col("c.spent_e8") / F.lit(UNIT)).alias("spent_usd"))
    )


def exact_percentiles(df: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Linear-interpolated percentiles of every key, exact, without holding a key in one place.

    Equal values are counted first; unit-wide buckets carry running totals; each percentile then
    is the pair of values whose rank ranges cover its position.
    """
    counts = df.groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    counts = counts.withColumn("__b", F.floor("__v"))
    buckets = counts.groupBy(*keys, "__b").agg(F.sum("__n").alias("__bn"))
    before = running_sum(buckets, keys, "__b", "__bn", "__before", exclusive=True).drop("__bn")
    totals = buckets.groupBy(*keys).agg(F.sum("__bn").alias("__total"))
    inside = Window.partitionBy(*keys, "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        counts.withColumn("__inside", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
        .join(before, [*keys, "__b"])
        .join(totals, keys)
        .withColumn("__start", F.col("__before") + F.col("__inside"))
    )
    at = lambda rank: F.max(
        F.when((F.col("__start") <= rank) & (rank < F.col("__start") + F.col("__n")), F.col("__v"))
    )
    pos = {name: (F.col("__total") - 1) * F.lit(q) for name, q in points.items()}
    aggs = [F.max("__v").alias("__max"), F.max("__total").alias("count")]
    for name, position in pos.items():
        aggs += [at(F.floor(position)).alias(f"__lo_{name}"), at(F.ceil(position)).alias(f"__hi_{name}")]
    found = ranked.groupBy(*keys).agg(*aggs)
    out = []
    for name, q in points.items():
        weight = (F.col("count") - 1) * F.lit(q)
        weight = weight - F.floor(weight)
        out.append((F.col(f"__lo_{name}") * (1 - weight) + F.col(f"__hi_{name}") * weight).alias(name))
    return found.select(*keys, "count", *out, F.col("__max").alias("max"))


def duration_summary(df: DataFrame, value: str, keys: list[str], since=None, ts: str = "started_at") -> DataFrame:
    """Count, median, 95th percentile and maximum, linear interpolation, three decimals."""
    if since is not None:
        df = df.where(F.col(ts) >= ntz(since))
    exact = exact_percentiles(df, keys, value, {"p50": 0.5, "p95": 0.95})
    rounded = [round_half_even(F.col(c), 3).alias(c) for c in ("p50", "p95", "max")]
    return exact.select(*keys, "count", *rounded)


def stage_timing_summary(timings: DataFrame, since=None) -> DataFrame:
    return duration_summary(timings, "duration_ms", ["stage"], since)


def model_latency_summary(usage: DataFrame, since=None) -> DataFrame:
    rows = usage.withColumn("stage", F.coalesce("stage", F.lit("unknown")))
    return duration_summary(rows, "latency_ms", ["stage"], since, "created_at")


def duration_metrics_table(stats: DataFrame, metric: str) -> DataFrame:
    """Long rows in seconds; stages without samples are dropped."""
    row = lambda q, v: F.struct(F.lit(q).alias("quantile"), v.alias("value"))
    cells = [row(q, F.col(c) / 1000) for q, c in (("0.5", "p50"), ("0.95", "p95"), ("max", "max"))]
    cells.append(row("count", F.col("count").cast("double")))
    return stats.where("count > 0").select(
        "stage", F.inline(F.array(*cells)), F.lit(metric).alias("metric")
    )


def queue_state(runs: DataFrame, now: datetime) -> DataFrame:
    """Pending runs and the longest wait in seconds."""
    pending = F.col("status") == "pending"
    wait = F.greatest(F.timestamp_diff("SECOND", F.col("created_at"), ntz(now)), F.lit(0))
    return runs.agg(
        F.count_if(pending).alias("depth"), F.coalesce(F.max(F.when(pending, wait)), F.lit(0)).alias("oldest_seconds")
    )


def executor_seen(heartbeats: DataFrame, now: datetime, seconds: int) -> DataFrame:
    """Latest heartbeat per owner and whether it is recent enough."""
    latest = heartbeats.groupBy("owner").agg(F.max("heartbeat_at").alias("last_seen"))
    return latest.withColumn("seen", F.timestamp_diff("SECOND", F.col("last_seen"), ntz(now)) <= seconds)


def job_success_rate(jobs: DataFrame, keys: list[str], width: str = "1 day") -> DataFrame:
    """Completed over completed plus failed, per window; other states do not count."""
    done, failed = F.count_if(F.col("status") == "completed"), F.count_if(F.col("status") == "failed")
    rows = jobs.groupBy(*keys, F.window("ts", width).alias("w")).agg(done.alias("completed"), failed.alias("failed"))
    total = F.col("completed") + F.col("failed")
    return rows.select(
        *keys, F.col("w.start").alias("window_start"), "completed", "failed",
        F.when(total > 0, F.col("completed") / total).alias("success_rate"),
    )


# Objective, target, and whether the measured number must stay above it.
SLO_TARGETS = [
    ("availability", 0.99, True),
    ("stage_p95_seconds", 120.0, False),
    ("model_p95_seconds", 60.0, False),
    ("job_success_rate", 0.95, True),
    ("run_cost_usd", 0.10, False),
    ("queue_depth", 5.0, False),
    ("oldest_wait_seconds", 600.0, False),
    ("executor_presence", 0.99, True),
]


def slo_report(measured: DataFrame, targets: DataFrame) -> DataFrame:
    """Measured (objective, entity, value) against targets; ratios get a budget share and a tier."""
    rows = measured.join(F.broadcast(targets), "objective")  # the fixed list of objectives
    spent = F.when(F.col("higher"), (1 - F.col("value")) / (1 - F.col("target"))).otherwise(F.col("value") / F.col("target"))
    met = F.when(F.col("higher"), F.col("value") >= F.col("target")).otherwise(F.col("value") <= F.col("target"))
    return rows.withColumn("met", met).withColumn("budget_share", spent).withColumn(
        "tier",
        F.when(F.col("budget_share") < 0.5, "normal").when(F.col("budget_share") < 1.0, "fix only").otherwise("freeze"),
    )
