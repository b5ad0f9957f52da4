"""Timers, order, restarts and dropped state of the stream jobs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tracewell.operators import alerts as al
from tracewell.streaming import stateful as sf

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


class Feed:
    """Files that come one after the other, each start of the stream takes up where the last one ended."""

    def __init__(self, spark, folder, schema, job):
        self.spark, self.folder, self.schema, self.job, self.n = spark, folder, schema, job, 0

    def __call__(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        source = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/in")
        q = self.job(source).writeStream.format("parquet").option("path", f"{self.folder}/out").option("checkpointLocation", f"{self.folder}/c").trigger(availableNow=True).start()
        q.awaitTermination(180)
        return sorted(tuple(r) for r in self.spark.read.parquet(f"{self.folder}/out").collect()), q.lastProgress


SAMPLES = "rule string, series string, ts timestamp, met boolean, hold_minutes int, on_silence boolean"


def test_samples_that_just_stop_fire(spark, tmp_path):
    feed = Feed(spark, str(tmp_path), SAMPLES, lambda s: sf.held_rules(s, step_minutes=1))
    down = lambda m, met: ("process_down", "a", at(m), met, 2, True)
    other = lambda m: ("queue_backlog", "b", at(m), False, 10, False)
    got, _ = feed([down(0, False), down(1, False), other(1)])
    assert got == []
    got, _ = feed([other(3)])  # time goes on for all, two minutes are not over
    assert got == []
    got, _ = feed([other(9)])
    assert [(r[0], r[1], r[2], r[3], r[4]) for r in got] == [("process_down", "a", at(2), at(4), True)]
    got, _ = feed([other(30)])
    assert len(got) == 1  # fires once
    got, _ = feed([down(31, False), other(32), down(33, True), down(34, True), down(35, True), other(40)])
    got, _ = feed([other(60)])
    assert [r[2:] for r in got[1:]] == [(at(33), at(35), False)]


def test_all_rules_are_fed_in_any_order_and_over_restarts(spark, tmp_path):
    silence = {"process_down", "not_ready", "executor_missing"}
    rows = []
    for rule, _, op, threshold, hold, _ in al.RULES:
        for m in range(0, 41, 1):
            value = threshold + (0 if op == "==" else 1) if 10 <= m <= 10 + hold + 1 else threshold + (1 if op == "==" else 0)
            rows.append((rule, "s", at(m), (value == threshold) if op == "==" else value > threshold, hold, rule in silence))
    feed = Feed(spark, str(tmp_path), SAMPLES, lambda s: sf.held_rules(s, step_minutes=1, delay="60 minutes"))
    rows.sort(key=lambda r: hash((r[0], r[2].minute * 7 % 11)))
    half = len(rows) // 2
    feed(rows[:half])
    feed(rows[half:])
    got, _ = feed([("tick", "t", at(500), False, 1, False)])
    got, _ = feed([("tick", "t", at(501), False, 1, False)])
    fired = {r[0]: r[2:4] for r in got if not r[4]}
    assert fired == {rule: (at(10), at(10 + hold)) for rule, _, _, _, hold, _ in al.RULES}
    assert {r[0] for r in got if r[4]} == silence


def test_status_changes_match_the_batch_form(spark, tmp_path):
    rows = [(i, i % 3, ["completed", "failed", "failed", "waiting", "completed"][(i * 7 // 3) % 5], at(i)) for i in range(60)]
    schema = "ord bigint, job_id bigint, status string, ts timestamp"
    feed = Feed(spark, str(tmp_path), schema, lambda s: sf.status_changes(s, delay="30 minutes", idle_minutes=100))
    feed(rows[20:40][::-1] + rows[:20])  # out of order within the delay
    feed(rows[40:])
    feed([(1000, 99, "x", at(120))])
    got, _ = feed([(1001, 99, "x", at(121))])
    want = sorted(tuple(r) for r in al.status_alerts(spark.createDataFrame(rows, schema)).collect())
    assert got == want
    # Jobs of which nothing comes any more are forgotten.
    feed([(1002, 99, "x", at(5000))])
    _, progress = feed([(1003, 99, "x", at(5001))])
    held = progress["stateOperators"][0]["customMetrics"] if "customMetrics" in progress["stateOperators"][0] else {}
    assert progress["stateOperators"][0]["numRowsTotal"] <= 12, held


def test_tail_ends_and_drops_its_state(spark, tmp_path):
    events = [(1, i, "completed" if i == 5 else "running", at(i)) for i in range(9)] + [(2, i, "running", at(i)) for i in range(4)]
    schema = "run_id bigint, id bigint, status string, ts timestamp"
    feed = Feed(spark, str(tmp_path), schema, lambda s: sf.run_tail(s, idle_minutes=60))
    feed(events)
    feed([(3, 0, "running", at(30))])
    got, _ = feed([(1, 50, "running", at(31)), (3, 1, "running", at(32))])
    want = sorted(tuple(r) for r in al.tail_events(spark.createDataFrame(events, schema).select("run_id", "id", "status")).collect())
    assert [r for r in got if r[0] < 3] == want
