"""Structured Streaming forms of batch operators: extensions, each equal to its batch form on closed data."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..sources.shared import shared_dir


def read_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def timed(stream: DataFrame, at: str, late: str) -> DataFrame:
    """The stream with its time as a timestamp and a watermark."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)


def tumbling_counts(stream: DataFrame, at: str, width: str, keys: list[str]) -> DataFrame:
    """start, keys, n of each window."""
    out = stream.groupBy(F.window(at, width), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("start"), *keys, "n")


def session_counts(stream: DataFrame, at: str, gap: str, keys: list[str]) -> DataFrame:
    """keys, start, end, n of each session."""
    out = stream.groupBy(F.session_window(at, gap), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def deduplicated(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.dropDuplicatesWithinWatermark(keys)


def interval_join(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, within: str) -> DataFrame:
    """Rows of the left with those of the right at most ``within`` before them; both sides carry watermarks."""
    near = (F.col(f"r.{right_at}") <= F.col(f"l.{left_at}")) & (F.col(f"r.{right_at}") >= F.col(f"l.{left_at}") - F.expr(f"interval {within}"))
    return left.alias("l").join(right.alias("r"), (F.col(f"l.{key}") == F.col(f"r.{key}")) & near)


#: The store that keeps lists and timers of many keys on disk.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


#: Groups of keys that share one state: a call of the processor serves all keys of a group.
STATE_GROUPS = 1024


class SinceFlag(StatefulProcessor):
    """Rows of a group of keys wait in a list until the watermark has passed them; then each key's are answered in time order."""

    def __init__(self, key: str, at: str, flag: str, row: str, row_type: T.DataType) -> None:
        self.key, self.at, self.flag, self.row, self.row_type = key, at, flag, row, row_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        waiting = [T.StructField("at", T.LongType()), T.StructField("key", T.StringType()), T.StructField("row", self.row_type), T.StructField("hit", T.BooleanType())]
        self.waiting = handle.getListState("waiting", T.StructType(waiting))
        # A list, read and written whole: a call for each key would cost more than the count itself.
        self.since = handle.getListState("since", T.StructType([T.StructField("key", T.StringType()), T.StructField("n", T.LongType())]))
        self.handle = handle

    def _wait_for(self, earliest: int, expired: int | None = None) -> None:
        """One timer for each group, at its earliest waiting row (microseconds); the one that has just expired goes by itself."""
        at = earliest // 1000 + 1
        for timer in [x for x in self.handle.listTimers() if x != expired]:
            if timer <= at:
                return
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for f in rows:
            micros = f[self.at].astype("datetime64[us]").astype("int64").tolist()
            self.waiting.appendList(list(zip(micros, f[self.key].tolist(), f[self.row].tolist(), [bool(x) for x in f[self.flag]])))
            earliest = min([*micros, *([] if earliest is None else [earliest])])
        if earliest is not None:
            self._wait_for(earliest)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [tuple(x) for x in self.waiting.get()]
        ready, left = sorted((x for x in rows if x[0] < passed), key=lambda x: (x[0], x[2])), [x for x in rows if x[0] >= passed]
        since = {k: n for k, n in self.since.get()}
        keys, out = [], []
        for _, k, row, hit in ready:
            n = since.get(k, 0)
            keys.append(k)
            out.append((row, n))
            since[k] = 0 if hit else n + 1
        if since:
            self.since.put(list(since.items()))
        if left:
            self.waiting.put(left)
            self._wait_for(min(x[0] for x in left), expiredTimerInfo.getExpiryTimeInMs())
        else:
            self.waiting.clear()
        if ready:
            yield pd.DataFrame({self.key: pd.Series(keys, dtype=object), self.row: [x for x, _ in out], "since": [n for _, n in out]})


def rows_since_flag(stream: DataFrame, key: str, at: str, flag: str, row: str) -> DataFrame:
    """key, row, since: rows since the last flagged row of the key, in the order of time and row.

    Needs a watermark on ``at`` and a session with ROCKSDB: rows wait as list state until the watermark has passed them, so
    rows that come late, within the watermark, in whatever batch, are counted in their place. Rows behind the watermark are
    dropped; rows that it hasn't passed when the stream stops stay in the state for the next run. What a key holds is
    what came within the watermark's delay. Keys are dealt to STATE_GROUPS groups, each with one state and timer.
    """
    kinds = {f.name: f.dataType for f in stream.schema.fields}
    schema = T.StructType([T.StructField(key, T.StringType()), T.StructField(row, kinds[row]), T.StructField("since", T.LongType())])
    # Keys travel as text: pandas would make floats of whole numbers beside nulls.
    grouped = stream.select(F.pmod(F.xxhash64(key), F.lit(STATE_GROUPS)).alias("_group"), F.col(key).cast("string").alias(key), at, flag, row).groupBy("_group")
    return grouped.transformWithStateInPandas(SinceFlag(key, at, flag, row, kinds[row]), schema, "Append", "EventTime").withColumn(key, F.col(key).cast(kinds[key]))


def run_to_table(build: Callable[[], DataFrame], name: str, mode: str = "append", conf: Mapping[str, str] | None = None) -> DataFrame:
    """Run a stream over what is there now, into Parquet in the shared folder, and read it back; ``conf`` holds meanwhile."""
    stream = build()
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in conf or {}}
    try:
        for k, v in (conf or {}).items():
            spark.conf.set(k, v)
        query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(stream.schema).parquet(f"{root}/out")
