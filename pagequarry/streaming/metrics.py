"""Durations of the last samples of each rule, kept as state of a stream.

A rule's state is a ring of its `samples` latest durations, by time and then id, whatever order they arrive in. What can't be
among them is dropped where it is read, in each task and batch, so a rule with most of all events sends no more than `samples`
rows a task through the shuffle. A timer clears the ring of a rule without events for `idle`, by the events' own time, and says
so with a row without samples. The session needs the RocksDB state store (`STATE_STORE`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
OUT = "rule_name string, samples long, avg_ms double, min_ms long, max_ms long, p50 double, p95 double, p99 double"
#: Columns of the ring, and of the events that reach it: microseconds, id, duration.
RING = "at long, event_id long, ms long"


def latest(rows: pd.DataFrame, samples: int) -> pd.DataFrame:
    """The latest rows, of equal times those of the smallest ids."""
    return rows.sort_values(["at", "event_id"], ascending=[False, True], kind="stable").head(samples)


def measured(rule: str, ms: np.ndarray) -> pd.DataFrame:
    if not len(ms):
        return pd.DataFrame({"rule_name": [rule], "samples": [0], "avg_ms": [None], "min_ms": pd.array([None], dtype="Int64"), "max_ms": pd.array([None], dtype="Int64"), "p50": [None], "p95": [None], "p99": [None]})
    p = np.percentile(ms, [50, 95, 99])
    return pd.DataFrame({"rule_name": [rule], "samples": [len(ms)], "avg_ms": [ms.mean()], "min_ms": [ms.min()], "max_ms": [ms.max()], "p50": [p[0]], "p95": [p[1]], "p99": [p[2]]})


class Ring(StatefulProcessor):
    def __init__(self, samples: int, idle_ms: int):
        self.samples, self.idle_ms = samples, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getListState("ring", RING)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame(list(self.ring.get()) if self.ring.exists() else [], columns=["at", "event_id", "ms"])
        for part in rows:
            held = latest(pd.concat([held, part[["at", "event_id", "ms"]]], ignore_index=True), self.samples)
        self.ring.put([tuple(map(int, r)) for r in held.itertuples(index=False)])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(held["at"].max()) // 1000 + self.idle_ms)
        yield measured(key[0], held["ms"].to_numpy(dtype=np.int64))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.ring.clear()
        yield measured(key[0], np.empty(0, dtype=np.int64))

    def close(self) -> None:
        pass


def last_samples(events: DataFrame, samples: int = 1000, late: str = "1 hour", idle: str = "30 days") -> DataFrame:
    """A stream of a rule's metrics over its last `samples` known durations, for update mode: a row a rule and batch with new
    events. events: event_id, ts, rule_name, duration_ms. Events later than `late` are left out, null durations too."""
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    known = events.where(F.col("duration_ms").isNotNull() & F.col("ts").isNotNull()).select(F.coalesce("rule_name", F.lit("")).alias("rule_name"), F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", F.col("duration_ms").cast("long").alias("ms"))

    def trim(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, pd.DataFrame] = {}
        for part in parts:
            for rule, own in part.groupby("rule_name", sort=False):
                held[rule] = latest(pd.concat([held[rule], own], ignore_index=True) if rule in held else own, samples)
        yield from held.values()

    trimmed = known.mapInPandas(trim, known.schema).withWatermark("ts", late)
    return trimmed.groupBy("rule_name").transformWithStateInPandas(Ring(samples, idle_ms), OUT, "Update", "EventTime")
