"""Structured Streaming over the events table: file source, event time, watermarks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import new_path


def event_stream(spark: SparkSession, sf_dir: str, instant: bool = True) -> DataFrame:
    """The events as a file stream; instant: their time as a timestamp, as watermarks need."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")) if instant else raw


def running_totals(stream: DataFrame) -> DataFrame:
    return stream.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def velocity_bins(stream: DataFrame, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and sums a user and tumbling window; rows later than late are dropped."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


#: Watermarks count milliseconds, so a row up to one behind them would pass as in time. A stretched time has a millisecond for each
#: microsecond; it reaches some 290 years from here.
ORIGIN, STRETCH = 946684800_000_000, 1000


def stretched(stream: DataFrame, late: str) -> DataFrame:
    """The stream with _at, its time stretched, and a watermark on it that is exact to the microsecond; late: a number and a unit."""
    count, unit = late.split()
    return stream.withColumn("_at", F.timestamp_micros((F.unix_micros("ts") - ORIGIN) * STRETCH)).withWatermark("_at", f"{int(count) * STRETCH} {unit}")


def shrunk(at: str) -> Column:
    return F.timestamp_micros(F.expr(f"unix_micros({at}) div {STRETCH}") + ORIGIN)


def burst_sessions(stream: DataFrame, gap: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    count, unit = gap.split()
    out = stretched(stream, late).groupBy(F.session_window("_at", f"{int(count) * STRETCH} {unit}").alias("_session"), "user_id").agg(F.count("*").alias("n"))
    return out.select(F.struct(shrunk("_session.start").alias("start"), shrunk("_session.end").alias("end")).alias("session"), "user_id", "n")


def deduplicated(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    return stretched(stream, late).dropDuplicatesWithinWatermark(["event_id"]).drop("_at")


def enriched(stream: DataFrame, profile: DataFrame, key: str = "user_id") -> DataFrame:
    """The profile's columns by key; 0 where it has none."""
    return stream.join(profile, key, "left").fillna(0, [c for c in profile.columns if c != key])


def lag_state(stream: DataFrame) -> DataFrame:
    """user_id, event_id, gap (seconds since the user's event before; 999999 for the first), is_rapid_fire (gap under 300), delta of the value.
    The state is a user's last time and value; events of one batch are taken in order of time."""

    def step(key, frames, state):
        at, value = state.get if state.exists else (None, None)
        e = pd.concat(frames).sort_values(["ts", "event_id"])
        sec, v = e["ts"].astype("datetime64[us]").astype("int64") / 1e6, e["value"]
        before, old = sec.shift(fill_value=np.nan), v.shift(fill_value=np.nan)
        if at is not None:
            before.iloc[0], old.iloc[0] = at, value
        state.update((float(sec.iloc[-1]), float(v.iloc[-1])))
        gap = (sec - before).fillna(999999.0)
        yield pd.DataFrame({"user_id": key[0], "event_id": e["event_id"], "gap": gap, "is_rapid_fire": (gap < 300).astype("int32"), "delta": (v - old).fillna(0.0)})

    rows = stream.select("user_id", "event_id", "ts", "value")
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, gap double, is_rapid_fire int, delta double", "at double, value double", "append", "NoTimeout")


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Runs what is available now. Appended rows go to Parquet in the shared folder, with their checkpoint; complete
    results (a row a group, kept small by their query) are written by batch, the last one stays."""
    spark = stream.sparkSession
    path = new_path(spark, "stream")
    out = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True)
    if mode == "append":
        out.format("parquet").option("path", path).start().awaitTermination()
    else:
        out.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
