"""Change logs as streams: state with deadlines, counters, tails, and windows over event time."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.io import WAL


def read_wal_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(WAL)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def materialise(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """key, value, expire_at_ms, live: each key's state after the micro-batches so far. A batch is sorted by time and
    sequence within its key; rows at or before what a key has applied are skipped, so a replay changes nothing. The state
    of a key that a Del or its deadline ended goes once the watermark (`late` behind the newest time) is past that by
    `late` again; the engine drops records that come behind the watermark."""
    wait = int(pd.Timedelta(late).total_seconds() * 1000)

    def apply(key: tuple[Any], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            here, value = state.get[2], state.get[3]
            state.remove()
            if here:  # its deadline is over
                yield pd.DataFrame({"key": [key[0]], "value": pd.Series([value], dtype="float64"), "expire_at_ms": pd.Series([None], dtype="Int64"), "live": [False]})
            return
        at_ms, at_seq, here, value, expire = state.get if state.exists else (-1, -1, False, None, None)
        for pdf in frames:
            for r in pdf.sort_values(["timestamp_ms", "sequence"]).itertuples():
                if (r.timestamp_ms, r.sequence) <= (at_ms, at_seq):
                    continue
                at_ms, at_seq = int(r.timestamp_ms), int(r.sequence)
                deadline = None if pd.isna(r.expire_at_ms) else int(r.expire_at_ms)
                if r.op == "Set":
                    here, value, expire = True, float(r.value), deadline
                elif r.op == "Del":
                    here, value, expire = False, None, None
                elif here:
                    expire = deadline
        state.update((at_ms, at_seq, here, value, expire))
        over = max(expire, at_ms) if here and expire is not None else at_ms if not here else None
        if over is not None:
            state.setTimeoutTimestamp(max(over + wait, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [key[0]], "value": pd.Series([value], dtype="float64"), "expire_at_ms": pd.Series([expire], dtype="Int64"), "live": [here]})

    timed = log.withColumn("_at", F.timestamp_millis("timestamp_ms")).withWatermark("_at", late)
    return timed.groupBy("key").applyInPandasWithState(
        apply, "key string, value double, expire_at_ms bigint, live boolean", "at_ms bigint, at_seq bigint, here boolean, value double, expire_at_ms bigint", "update", GroupStateTimeout.EventTimeTimeout
    )


def counters(log: DataFrame) -> DataFrame:
    """key, value: running counters (complete or update mode)."""
    return log.groupBy("key").agg(F.sum("delta").alias("value"))


def _watermarked(events: DataFrame, time: str, late: str) -> DataFrame:
    return events.withWatermark(time, late) if events.isStreaming else events


def tumbling(events: DataFrame, time: str, length: str, late: str, *by: str) -> DataFrame:
    """Counts and sums of `value` in windows; rows later than the watermark allows are dropped by the engine."""
    w = F.window(time, length)
    return _watermarked(events, time, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def sliding(events: DataFrame, time: str, length: str, step: str, late: str, *by: str) -> DataFrame:
    """The same in windows that begin at every step: an event is in several."""
    w = F.window(time, length, step)
    return _watermarked(events, time, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, late: str, *by: str) -> DataFrame:
    w = F.session_window(time, gap)
    return _watermarked(events, time, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def append(stream: DataFrame, path: str, checkpoint: str):
    """A sink that appends to a change log; the query is returned."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
