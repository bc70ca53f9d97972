"""The failure breaker over a stream of attempts: per key, when ``limit`` failures in a row stop the run.

State per key: how many attempts were seen, how many failed in a row, and where the run
stopped. It lies in the state store and comes back from the checkpoint after a restart.
An event-time timer closes a key that has been quiet for ``idle_s``: its state goes, and a
later attempt begins a new run, numbered from 1. Without ``idle_s`` a key never closes, and
the result is that of the batch operator ``ingest.breaker``.

Attempts of a key must arrive in order from batch to batch; within a batch a key's are
sorted by (ts, seq) in one task, so the source's options bound what that holds
(``maxFilesPerTrigger`` and the like). Null keys are left out, a null failure is none.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tessera.operators.ingest import BREAKER_LIMIT

# the worker that plans a stateful stream doesn't get the files that the session ships, so the processor travels whole
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STOPPED = "key long, stop_at long, stopped timestamp"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Breaker(StatefulProcessor):
    def __init__(self, limit: int = BREAKER_LIMIT, idle_s: float | None = None):
        self.limit, self.idle_ms = limit, None if idle_s is None else int(idle_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "seen long, failed long, stop_at long, last_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen, failed, stop_at, last_ms = self.run.get() if self.run.exists() else (0, 0, 0, 0)
        parts = [part for part in rows if len(part)]
        for part in [pd.concat(parts).sort_values(["ts", "seq"], kind="stable")] if parts else []:
            for ts, failure in zip(part["ts"], part["failure"], strict=True):
                seen += 1
                failed = failed + 1 if failure is True or failure == 1 else 0
                if failed == self.limit and not stop_at:
                    stop_at = seen
                    yield pd.DataFrame({"key": [key[0]], "stop_at": [seen], "stopped": [ts]})
                last_ms = max(last_ms, int(ts.timestamp() * 1000))
        self.run.update((seen, failed, stop_at, last_ms))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(last_ms + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.run.clear()
        return iter(())

    def close(self) -> None:
        pass


def stops(attempts: DataFrame, limit: int = BREAKER_LIMIT, idle_s: float | None = None, late_s: float = 0) -> DataFrame:
    """key, stop_at (the attempt's number in its key, from 1), stopped of a stream (key long, seq long, ts timestamp, failure boolean)."""
    own = attempts.filter("key is not null").select("key", "seq", "ts", "failure")
    if idle_s is not None:
        own = own.withWatermark("ts", f"{late_s} seconds")
    return own.groupBy("key").transformWithStateInPandas(Breaker(limit, idle_s), STOPPED, outputMode="append", timeMode="None" if idle_s is None else "EventTime")


def start(attempts: DataFrame, target: str, checkpoint: str, limit: int = BREAKER_LIMIT, idle_s: float | None = None, late_s: float = 0) -> StreamingQuery:
    """Append the stops of ``attempts`` to ``target``; what is there is processed, then the query ends. The same checkpoint goes on where it ended."""
    spark: SparkSession = attempts.sparkSession
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)  # keeps timers and lists; read when the query starts
    try:
        out = stops(attempts, limit, idle_s, late_s).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
        return out.outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(_STORE, before)
