"""Rollback triggers over a stream of observations: tumbling windows with a watermark, told when they close or as soon as they pass."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plumbline.operators.evaluation import rollback_events


def windowed_metrics(events: DataFrame, window_seconds: int, watermark: str | None = None, *by: str) -> DataFrame:
    """metric, window_start, window_end, observed_value (mean), samples of events (metric, ts, value). With a watermark, of a stream; later events are left out."""
    timed = events.withWatermark("ts", watermark) if watermark else events
    w = F.window("ts", f"{window_seconds} seconds")
    return timed.groupBy("metric", *by, w).agg(F.avg("value").alias("observed_value"), F.count("*").alias("samples")).select("metric", *by, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "observed_value", "samples", F.lit(window_seconds).alias("window_seconds"))


def watch(events: DataFrame, triggers: DataFrame, window_seconds: int, watermark: str = "10 minutes") -> DataFrame:
    """A stream of the rollback events that closed windows fire."""
    return rollback_events(windowed_metrics(events, window_seconds, watermark), triggers)


#: What keyed state with timers needs; set it on the session before a query with watch_early() starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
FIRED = "trigger_id string, metric string, window_start timestamp, observed_value double, samples long"


class OncePerWindow(StatefulProcessor):
    """State of one trigger and window: the sum and count of its samples and whether it has fired. A timer at the window's end clears it; rows of a window that the watermark has passed are left out, so they cannot fire again what was cleared."""

    def __init__(self, window_seconds: int) -> None:
        self.length = window_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "total double, samples long, fired boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        end = int(key[1].timestamp() * 1000) + self.length
        known = self.window.get() if self.window.exists() else None
        total, samples, fired = known or (0.0, 0, False)
        last = None
        for batch in rows:
            total, samples, last = total + float(batch["value"].sum()), samples + int(batch["value"].count()), batch.iloc[-1]
        if last is None or fired or timerValues.getCurrentWatermarkInMs() >= end:
            return
        if known is None:
            self.handle.registerTimer(end)
        mean = total / samples if samples else 0.0
        breached = {"lt": mean < last["threshold"], "lte": mean <= last["threshold"], "gt": mean > last["threshold"], "gte": mean >= last["threshold"]}[last["operator"]]
        fires = samples > 0 and samples >= last["min_samples"] and bool(breached)
        self.window.update((total, samples, fires))
        if fires:
            yield pd.DataFrame([{"trigger_id": key[0], "metric": last["metric"], "window_start": key[1], "observed_value": mean, "samples": samples}])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        self.window.clear()
        yield pd.DataFrame(columns=["trigger_id", "metric", "window_start", "observed_value", "samples"])

    def close(self) -> None:
        pass


def watch_early(events: DataFrame, triggers: DataFrame, window_seconds: int, watermark: str = "10 minutes") -> DataFrame:
    """A stream of rollback events (FIRED) that come as soon as a window's samples so far pass a trigger, and once for each trigger and window, over restarts too; watch() waits for the window's end instead. Null values are no samples. A window of a trigger is one key, whose rows of a batch are read one Arrow batch at a time."""
    at = F.window("ts", f"{window_seconds} seconds")["start"]
    held = triggers.where(F.col("window_seconds") == window_seconds).select("trigger_id", "metric", "operator", "threshold", "min_samples")
    met = events.withWatermark("ts", watermark).where("value is not null").join(held, "metric").withColumn("window_start", at)
    return met.select("trigger_id", "metric", "operator", "threshold", "min_samples", "window_start", "value", "ts").groupBy("trigger_id", "window_start").transformWithStateInPandas(OncePerWindow(window_seconds), FIRED, "update", "EventTime")
