"""Alarms on event streams. Each twin of a batch operator gives what that gives, for events no later than the
watermark; later ones are dropped (STM-11)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "10 minutes"


def timed(events: DataFrame, at: str = "ts", late: str = LATE) -> DataFrame:
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)


def rates(events: DataFrame, failed: Column, width: str = "15 minutes", slide: str | None = None, least: int = 20) -> DataFrame:
    """Share of failures in each window with enough samples (STM-1)."""
    made = timed(events).groupBy(F.window("ts", width, slide).alias("w")).agg(F.count("*").alias("n"), F.count_if(failed).alias("failed"))
    return made.filter(F.col("n") >= least).select(F.col("w.start").alias("window_start"), "n", "failed", (F.col("failed") / F.col("n")).alias("rate"))


def percentiles(events: DataFrame, value: str, width: str = "15 minutes", least: int = 20, p: float = 0.95) -> DataFrame:
    """Nearest-rank percentile of each window with enough samples (STM-2)."""
    made = timed(events).groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").alias("value"))
    return made.filter(F.col("n") >= least).select(F.col("w.start").alias("window_start"), "n", "value")


def once(events: DataFrame, key: str, forget: str = "24 hours") -> DataFrame:
    """The first event of each key; keys are forgotten after a day (STM-4)."""
    return timed(events, late=forget).dropDuplicatesWithinWatermark([key])


def cooled_down(alerts: DataFrame, key: str, seconds: int) -> DataFrame:
    """Alerts (key, ts) of which none follows a kept one of its key within `seconds` (STM-5); a key's state is
    one time, and goes when that has passed by."""

    def run(code: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        rows = []
        for t in sorted(pd.concat(list(frames)).ts):
            if last is None or (t - last).total_seconds() >= seconds:
                rows.append((code[0], t))
                last = t
        state.update((last.value // 1000,))
        until = last.value // 1_000_000 + 1000 * seconds
        state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=[key, "ts"])

    kind = alerts.schema[key].dataType.simpleString()
    grouped = timed(alerts.select(key, "ts")).groupBy(key)
    return grouped.applyInPandasWithState(run, f"{key} {kind}, ts timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


class _Edges(StatefulProcessor):
    """Keeps whether a key's condition is on, and the states that the watermark hasn't passed yet, each with a timer."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.active = handle.getValueState("active", "active boolean")
        self.waiting = handle.getMapState("waiting", "at long", "active boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            for at, active in zip(frame["ts"].astype("datetime64[us]").astype("int64"), frame["active"], strict=True):
                if at > known * 1000 and active is not None:
                    self.waiting.updateValue((int(at),), (bool(active),))
                    self.handle.registerTimer(-(-int(at) // 1000))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs() * 1000
        old = self.active.get()[0] if self.active.exists() else False
        due = sorted((k[0], v[0]) for k, v in self.waiting.iterator() if k[0] <= until) if self.waiting.exists() else []
        out = []
        for at, active in due:
            if active != old:
                out.append((key[0], pd.Timestamp(at, unit="us"), "raised" if active else "cleared"))
            old = active
            self.waiting.removeKey((at,))
        self.active.update((old,))
        if out:
            yield pd.DataFrame(out, columns=["key", "ts", "change"])

    def close(self) -> None:
        pass


def edges(states: DataFrame, key: str) -> DataFrame:
    """(key, ts, change) where a condition of states (key, ts, active) turns on or off (STM-3), when the watermark has passed
    them; of states of one time the last that came counts. Needs the RocksDB state store."""
    kind = states.schema[key].dataType.simpleString()
    known = timed(states.select(F.col(key).alias("key"), "ts", "active")).groupBy("key")
    made = known.transformWithStateInPandas(_Edges(), f"key {kind}, ts timestamp, change string", "append", "eventTime")
    return made.withColumnRenamed("key", key)
