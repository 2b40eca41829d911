"""The append-only label log as a stream: the latest row of each rater and item wins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tropelens.operators.ranking import latest

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, schema: str = EVENTS) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).parquet(path)


def without_repeats(events: DataFrame, key: str = "event_id", stamp: str = "ts", late: str = "1 hour") -> DataFrame:
    """Events that are sent twice within the watermark count once; state is dropped behind it."""
    return events.withWatermark(stamp, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, kind: str = "event_type", stamp: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(stamp, late).groupBy(F.window(stamp, width), kind).agg(F.count(F.lit(1)).alias("n"))


def upsert_latest(events: DataFrame, target: str, checkpoint: str, keys: list[str], order: list[str], values: list[str]):
    """Starts a query that keeps the latest row per key. Each batch is reduced first; a batch writes the next version of the
    table beside the last, so a batch that is run again after a failure overwrites its own version only."""

    def apply(batch: DataFrame, epoch: int) -> None:
        spark, rows = batch.sparkSession, batch.select(*keys, *order, *[v for v in values if v not in order])
        if epoch:
            rows = rows.unionByName(spark.read.parquet(f"{target}/v={epoch - 1}").select(rows.columns))
        rest = [c for c in rows.columns if c not in keys]
        latest(rows, keys, order, rest).write.mode("overwrite").parquet(f"{target}/v={epoch}")

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class LatestRow(StatefulProcessor):
    """State of one key: stamp and tie of its latest row. Rows that are newer than it come out, the newest of a batch only."""

    def __init__(self, names: list[str], forget_ms: int | None):
        self.names, self.forget_ms = names, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "stamp long, tie long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best, found = self.latest.get() if self.latest.exists() else None, None
        for batch in rows:
            order = batch.sort_values(["order_stamp", "order_tie"], kind="stable")
            last = order.iloc[-1:]
            place = (int(last["order_stamp"].iloc[0]), int(last["order_tie"].iloc[0]))
            if best is None or place > tuple(best):
                best, found = place, last
        if found is not None:
            self.latest.update(best)
            if self.forget_ms is not None:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(best[0] // 1000 + self.forget_ms)
            yield found[self.names]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A key that has been quiet for long leaves the state; rows older than the watermark don't come any more."""
        self.latest.clear()
        return iter([])

    def close(self) -> None:
        pass


def latest_changes(events: DataFrame, keys: list[str], stamp: str, tie: str, values: list[str], late: str = "1 hour", forget: str | None = "90 days") -> DataFrame:
    """A stream of the rows by which a key's latest value changes: keys, stamp, tie, values. State holds two numbers a key.

    Of a key's rows the one with the greatest (stamp, tie) is its latest; tie is a whole number. Rows that come more than
    `late` behind are dropped by the watermark; a key without rows for `forget` leaves the state (None: it stays). Rows with a
    null key, stamp or tie are no events. No column may be called order_stamp or order_tie, or begin with an underscore. Needs the RocksDB state store.
    """
    names = [*keys, stamp, tie, *values]
    rows = events.dropna(subset=[*keys, stamp, tie]).withWatermark(stamp, late).select(*names, F.unix_micros(stamp).alias("order_stamp"), F.col(tie).cast("long").alias("order_tie"))
    ms = None if forget is None else int(pd.Timedelta(forget).total_seconds() * 1000)
    out = rows.select(*names).schema
    return rows.groupBy(*keys).transformWithStateInPandas(statefulProcessor=LatestRow(names, ms), outputStructType=out, outputMode="append", timeMode="none" if ms is None else "eventtime")


def follow(changes: DataFrame, target: str, checkpoint: str):
    """Starts a query that appends the changes to a table, each once, also over restarts: a batch writes its changed keys only."""
    return changes.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def latest_of(changes: DataFrame, keys: list[str], stamp: str, tie: str) -> DataFrame:
    """The latest row of each key of a table of changes; a forgotten key's later changes are just newer rows."""
    return latest(changes, keys, [stamp, tie], [c for c in changes.columns if c not in keys])
