"""Stream jobs whose state lives in keyed stores with event-time timers.

Rows wait in a map by event time and are worked when the watermark has passed them, one by one and in order,
whatever order they came in; so a micro-batch of a key is never held whole, and a series that falls silent is seen by a timer.
State is small per key: what waits behind the watermark, and one value. It is dropped when a timer says that nothing more is expected.

The session's state store must be RocksDB (`use_rocksdb`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.alerts import TERMINAL

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MINUTE = 60_000


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _ms(ts) -> int:
    return int(pd.Timestamp(ts).value // 1_000_000)


def _time(ms: int) -> pd.Timestamp:
    return pd.Timestamp(ms, unit="ms")


class InOrder(StatefulProcessor):
    """Rows of a key by event time: `work` gets each when the watermark has passed it, `quiet` any other timer."""

    value_schema = ""
    columns: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at bigint, n bigint", self.value_schema)
        self.setup(handle)

    def setup(self, handle: StatefulProcessorHandle) -> None: ...

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for ts, n, *values in zip(batch["ts"], batch["n"], *[batch[c] for c in self.columns], strict=True):
                at = _ms(ts)
                self.waiting.updateValue((at, int(n)), tuple(values))
                self.handle.registerTimer(at)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted((tuple(k), tuple(v)) for k, v in self.waiting.iterator() if k[0] == at)
        out = []
        for where, values in due:
            self.waiting.removeKey(where)
            out += self.work(key, where[0], where[1], values)
        if not due:
            out += self.quiet(key, at)
        if out:
            yield pd.DataFrame(out, columns=self.names)

    def work(self, key, at: int, n: int, values: tuple) -> list[tuple]:
        raise NotImplementedError

    def quiet(self, key, at: int) -> list[tuple]:
        return []

    def close(self) -> None: ...


class HeldRules(InOrder):
    """Threshold rules with a hold time, and silence: a series that sends no sample for its hold time fires too."""

    value_schema = "met boolean, hold_minutes int, on_silence boolean"
    columns = ["met", "hold_minutes", "on_silence"]
    names = ["rule", "series", "started_at", "fired_at", "silent"]

    def __init__(self, step_minutes: int):
        self.step = step_minutes * MINUTE

    def setup(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "start bigint, last bigint, fired boolean, deadline bigint")

    def work(self, key, at, n, values):
        met, hold, on_silence = bool(values[0]), int(values[1]) * MINUTE, bool(values[2])
        start, last, fired, deadline = self.run.get() if self.run.exists() else (-1, -1, False, -1)
        if deadline >= 0:
            self.handle.deleteTimer(deadline)
        if not met:
            start, fired = -1, False
        elif start < 0 or at - last > self.step:
            start, fired = at, False
        out = []
        if start >= 0 and not fired and at - start >= hold:
            out, fired = [(*key, _time(start), _time(at), False)], True
        # From one step after the last sample the series counts as down; one millisecond keeps the timer apart from samples.
        deadline = at + self.step + hold + 1 if on_silence else -1
        if deadline >= 0:
            self.handle.registerTimer(deadline)
        self.run.update((start, at, fired, deadline))
        return out

    def quiet(self, key, at):
        start, last, fired, deadline = self.run.get() if self.run.exists() else (-1, -1, False, -1)
        if deadline != at:
            return []
        down = start if start >= 0 else last + self.step
        self.run.update((down, last, True, -1))
        return [] if fired else [(*key, _time(down), _time(at - 1), True)]


class StatusChanges(InOrder):
    """First failure alerts, repeats are silent, completion after a failure is a recovery. A job of which nothing came for `idle` is forgotten."""

    value_schema = "status string"
    columns = ["status"]
    names = ["job_id", "ord", "status", "alert"]

    def __init__(self, idle_minutes: int):
        self.idle = idle_minutes * MINUTE

    def setup(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "status string, forget bigint")

    def work(self, key, at, n, values):
        before, forget = self.last.get() if self.last.exists() else ("", -1)
        if forget >= 0:
            self.handle.deleteTimer(forget)
        status, forget = values[0], at + self.idle + 1
        self.handle.registerTimer(forget)
        self.last.update((status, forget))
        alert = "failure" if status == "failed" != before else "recovery" if (before, status) == ("failed", "completed") else None
        return [(key[0], n, status, alert)] if alert else []

    def quiet(self, key, at):
        if self.last.exists() and self.last.get()[1] == at:
            self.last.clear()
        return []


class Tail(InOrder):
    """Events of a run up to its first terminal status, then a `done` row. A finished run keeps one flag for `idle`, then nothing."""

    value_schema = "status string"
    columns = ["status"]
    names = ["run_id", "id", "status"]

    def __init__(self, idle_minutes: int):
        self.idle = idle_minutes * MINUTE

    def setup(self, handle: StatefulProcessorHandle) -> None:
        self.over = handle.getValueState("over", "at bigint")

    def handleInputRows(self, key, rows, timerValues):
        if self.over.exists():
            return iter(())
        return super().handleInputRows(key, rows, timerValues)

    def work(self, key, at, n, values):
        if self.over.exists():
            return []
        if values[0] not in TERMINAL:
            return [(key[0], n, values[0])]
        self.over.update((at + self.idle + 1,))
        self.handle.registerTimer(at + self.idle + 1)
        return [(key[0], n, values[0]), (key[0], n, "done")]

    def quiet(self, key, at):
        if self.over.exists() and self.over.get()[0] == at:
            self.over.clear()
        return []


def _apply(rows: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, delay: str) -> DataFrame:
    use_rocksdb(rows.sparkSession)
    return rows.withWatermark("ts", delay).groupBy(*keys).transformWithStateInPandas(processor, schema, "append", "EventTime")


def held_rules(samples: DataFrame, step_minutes: int = 10, delay: str = "0 seconds") -> DataFrame:
    """Alerts of evaluated samples (rule, series, ts, met, hold_minutes, on_silence) of one fixed step; `silent` says that samples stopped."""
    rows = samples.select("rule", "series", "ts", F.lit(0).cast("bigint").alias("n"), "met", "hold_minutes", "on_silence")
    return _apply(rows, ["rule", "series"], HeldRules(step_minutes), "rule string, series string, started_at timestamp, fired_at timestamp, silent boolean", delay)


def status_changes(jobs: DataFrame, delay: str = "0 seconds", idle_minutes: int = 7 * 24 * 60) -> DataFrame:
    """Alerts of status rows (job_id, ord, status, ts)."""
    rows = jobs.select("job_id", "ts", F.col("ord").cast("bigint").alias("n"), "status")
    return _apply(rows, ["job_id"], StatusChanges(idle_minutes), f"job_id {dict(jobs.dtypes)['job_id']}, ord bigint, status string, alert string", delay)


def run_tail(events: DataFrame, delay: str = "0 seconds", idle_minutes: int = 24 * 60) -> DataFrame:
    """Events (run_id, id, status, ts) in order of time and id until the run is over."""
    rows = events.select("run_id", "ts", F.col("id").cast("bigint").alias("n"), "status")
    return _apply(rows, ["run_id"], Tail(idle_minutes), f"run_id {dict(events.dtypes)['run_id']}, id bigint, status string", delay)
