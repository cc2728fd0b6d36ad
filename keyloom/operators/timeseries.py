"""Time series as rows (key, ts, value) with labels in (key, labels)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last(ts: DataFrame) -> DataFrame:
    """key, ts, value of the latest sample."""
    return ts.groupBy("key").agg(F.max(F.struct("ts", "value")).alias("r")).select("key", "r.*")


def between(ts: DataFrame, start: int, stop: int) -> DataFrame:
    """Samples in a range, ends included (TS.RANGE, TS.REVRANGE)."""
    return ts.filter(F.col("ts").between(start, stop))


def matching(series: DataFrame, **labels: str) -> DataFrame:
    """key of the series with these labels (TS.QUERYINDEX)."""
    out = series
    for k, v in labels.items():
        out = out.filter(F.col("labels")[k] == v)
    return out.select("key")


def mrange(ts: DataFrame, series: DataFrame, start: int, stop: int, **labels: str) -> DataFrame:
    return between(ts, start, stop).join(matching(series, **labels), "key", "left_semi")


def mget(ts: DataFrame, series: DataFrame, **labels: str) -> DataFrame:
    return last(ts.join(matching(series, **labels), "key", "left_semi"))


def delete(ts: DataFrame, start: int, stop: int) -> DataFrame:
    return ts.filter(~F.col("ts").between(start, stop))


def incrby(log: DataFrame) -> DataFrame:
    """key, ts, value: the running sum of (key, ts, seq, delta); of equal times the last."""
    w = Window.partitionBy("key").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    run = log.withColumn("value", F.sum("delta").over(w))
    return run.groupBy("key", "ts").agg(F.max_by("value", "seq").alias("value"))


def info(ts: DataFrame) -> DataFrame:
    return ts.groupBy("key").agg(F.count("*").alias("samples"), (F.count("*") * 16).alias("bytes"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def rollup(ts: DataFrame, bucket_ms: int) -> DataFrame:
    """key, bucket, n, total, least, most: what a compaction rule would keep."""
    bucket = (F.col("ts") - F.pmod("ts", F.lit(bucket_ms))).alias("bucket")
    return ts.groupBy("key", bucket).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("least"), F.max("value").alias("most"))
