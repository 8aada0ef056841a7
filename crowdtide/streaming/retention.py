"""Retention on a stream: the windows of the last minutes of every stream of chat, kept as state and evicted by timers."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from crowdtide.streaming.pipelines import STREAM, run_to_end

WINDOW = ["window_start", "window_end"]
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGE = "session_id string, channel_id string, start long, stop long, row string, kept boolean"


class KeepRecent(StatefulProcessor):
    """Windows of one stream that ended at most ``span`` microseconds before its newest one.

    State: the windows by their range, and the newest end. Each batch sets a timer at the newest end; when the watermark
    passes it, no earlier window can come, and what has become too old goes. A window that is too old when it comes is
    not kept, and a range that comes again replaces its row.
    """

    def __init__(self, span: int):
        self.span = span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.windows = handle.getMapState("windows", "start long, stop long", "row string")
        self.newest = handle.getValueState("newest", "stop long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        parts = pd.concat(list(rows))
        newest = int(parts["stop"].max())
        if self.newest.exists():
            newest = max(newest, self.newest.get()[0])
        self.newest.update((newest,))
        parts = parts[parts["stop"] >= newest - self.span].sort_values(["start", "stop", "row"]).drop_duplicates(["start", "stop"], keep="last")
        for start, stop, row in parts[["start", "stop", "row"]].itertuples(index=False, name=None):
            self.windows.updateValue((start, stop), (row,))
        self.handle.registerTimer(newest // 1000)
        yield self._changes(key, parts, True)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        limit = self.newest.get()[0] - self.span
        old = [k for k in self.windows.keys() if k[1] < limit]
        for k in old:
            self.windows.removeKey(k)
        yield self._changes(key, pd.DataFrame(old, columns=["start", "stop"]).assign(row=""), False)

    def close(self) -> None:
        pass

    @staticmethod
    def _changes(key: Any, rows: pd.DataFrame, kept: bool) -> pd.DataFrame:
        out = rows[["start", "stop", "row"]].assign(session_id=key[0], channel_id=key[1], kept=kept)
        return out[["session_id", "channel_id", "start", "stop", "row", "kept"]]


@contextmanager
def _map_state(spark: SparkSession):
    """The state store that map state and timers need, for the queries started inside."""
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, before)


def retention_changes(windows: DataFrame, minutes: float = 5, watermark: str = "30 seconds") -> DataFrame:
    """What retention does to a stream of windows: a row for each window kept, and another when it is evicted.

    ``row`` holds the window's columns as JSON. Windows without a range take no part.
    """
    packed = windows.where("window_start IS NOT NULL AND window_end IS NOT NULL").withWatermark("window_end", watermark)
    rest = [c for c in windows.columns if c not in (*STREAM, *WINDOW)]
    row = F.to_json(F.struct(*rest)) if rest else F.lit("{}")
    packed = packed.select(*STREAM, F.unix_micros("window_start").alias("start"), F.unix_micros("window_end").alias("stop"), row.alias("row"), "window_end")
    return packed.groupBy(*STREAM).transformWithStateInPandas(KeepRecent(round(minutes * 60_000_000)), CHANGE, "Append", "EventTime")


def retained_windows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The windows that the query at ``path`` keeps now, read from its state."""
    state = spark.read.format("statestore").option("stateVarName", "windows").load(f"{path}/checkpoint")
    rest = StructType([f for f in schema if f.name not in (*STREAM, *WINDOW)])
    columns = [F.col(f"r.{f.name}").alias(f.name) if f.name in rest.names else F.col(f.name) for f in schema]
    keys = [F.col(f"key.{c}").alias(c) for c in STREAM]
    ends = [F.timestamp_micros("user_map_key.start").alias("window_start"), F.timestamp_micros("user_map_key.stop").alias("window_end")]
    rows = state.select(*keys, *ends, F.from_json("user_map_value.row", rest).alias("r") if len(rest) else F.lit(None).alias("r"))
    return rows.select(*columns)


def stream_retention(windows: DataFrame, path: str, minutes: float = 5, watermark: str = "30 seconds") -> DataFrame:
    """Read everything a stream of windows brings and return what is kept of it, over this and earlier runs.

    A query started again with the same path goes on with its state. The changes are written below ``path`` as well.
    State never holds more than the windows of the span and of the watermark's delay, for each stream.
    """
    spark = windows.sparkSession
    with _map_state(spark):
        run_to_end(retention_changes(windows, minutes, watermark), path)
    return retained_windows(spark, path, windows.schema)
