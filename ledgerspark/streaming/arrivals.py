"""Streams that go on over several deliveries: late and replayed rows, state that outlives a restart, and what was dropped.

Each delivery's files land in one folder, and the stream takes what is there and stops; the next delivery starts it again
from its checkpoint, so watermark and state are carried over as after a restart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.store import new_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def deliveries(spark: SparkSession, sf_dir: str, days: int = 10, late: str = "event_id % 50 = 7", again: str = "event_id % 20 = 3") -> list[DataFrame]:
    """The events by periods of days; late ones come with the period after their own, and some come a second time with it."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    own = F.floor((F.unix_seconds("ts") - 1704067200) / (86400 * days))
    events = events.withColumn("at", own + F.expr(f"CAST({late} AS INT)"))
    every = events.unionByName(events.where(again).withColumn("at", own + 1))
    last = every.agg(F.max("at")).first()[0]
    return [every.where(F.col("at") == k).drop("at") for k in range(0 if last is None else last + 1)]


def delivered(parts: list[DataFrame], build: Callable[[DataFrame], DataFrame], mode: str = "append") -> tuple[DataFrame, int]:
    """The result of build's stream after all deliveries, and how many rows its stateful operators dropped as late. The stream is
    started anew for each delivery, from its checkpoint."""
    spark = parts[0].sparkSession
    landing, out, notes = (new_path(spark, n) for n in ("landing", "arrived", "arrived-checkpoint"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    dropped = 0
    try:
        for part in parts:
            part.write.mode("append").parquet(landing)
            stream = build(spark.readStream.schema(part.schema).parquet(landing))
            writer = stream.writeStream.outputMode(mode).option("checkpointLocation", notes).trigger(availableNow=True)
            if mode == "append":
                query = writer.format("parquet").option("path", out).start()
            else:
                query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start()
            query.awaitTermination()
            dropped += sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(stream.schema).parquet(out), dropped


class InOrder(StatefulProcessor):
    """Gap to and difference from the user's event before, by event time: rows wait until the watermark passes them, then leave in
    order of time, so rows of a later delivery that belong before others are put there. State: the rows that wait, and
    the time and value of the last that left."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at double, value double")
        self.held = handle.getListState("held", "us long, event_id long, value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            us = part["ts"].astype("datetime64[us]").astype("int64")
            self.held.appendList(list(zip(us.tolist(), part["event_id"].tolist(), part["value"].astype(float).tolist())))
            first = us.min() if first is None else min(first, us.min())
        if first is not None:
            self.handle.registerTimer(int(first) // 1000 + 1)
        yield self.made(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.held.get())
        due, rest = [r for r in rows if r[0] < mark], [r for r in rows if r[0] >= mark]
        if rest:
            self.held.put(rest)
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        else:
            self.held.clear()
        yield self.made(key, due)

    def made(self, key, rows: list[tuple]) -> pd.DataFrame:
        at, value = self.last.get() if self.last.exists() else (None, None)
        out = []
        for us, event, v in rows:
            out.append((key[0], event, 999999.0 if at is None else us / 1e6 - at, 0.0 if value is None else v - value))
            at, value = us / 1e6, v
        if rows:
            self.last.update((at, value))
        return pd.DataFrame(out, columns=["user_id", "event_id", "gap", "delta"]).astype({"user_id": "int64", "event_id": "int64", "gap": "float64", "delta": "float64"})

    def close(self) -> None:
        pass


def lag_in_order(stream: DataFrame, late: str = "5 days") -> DataFrame:
    """user_id, event_id, gap (seconds since the user's event before; 999999 for the first), is_rapid_fire, delta: each event once,
    when the watermark has passed it; later ones than that are dropped."""
    once = stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]).select("user_id", "event_id", "ts", "value")
    out = once.groupBy("user_id").transformWithStateInPandas(InOrder(), "user_id long, event_id long, gap double, delta double", "Append", "EventTime")
    return out.select("user_id", "event_id", "gap", (F.col("gap") < 300).cast("int").alias("is_rapid_fire"), "delta")
