"""Hashes as rows (key, field, value, field_expire_at_ms)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import expire_gate, live, ttl
from .state import delete, insert_absent, matching, upsert

KEYS = ["key", "field"]


def alive(h: DataFrame, now_ms: int) -> DataFrame:
    return h.filter(live(F.col("field_expire_at_ms"), now_ms))


def hgetall(h: DataFrame) -> DataFrame:
    """key, pairs (a map). A hash is one value here; keep it as rows where hashes are large."""
    return h.groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("pairs"))


def hmget(h: DataFrame, probes: DataFrame) -> DataFrame:
    """key, field, value of probes (key, field): null for a miss."""
    return probes.join(matching(h, probes, KEYS).select(*KEYS, "value"), KEYS, "left").select(*KEYS, "value")


def hlen(h: DataFrame) -> DataFrame:
    return h.groupBy("key").agg(F.count("*").alias("n"))


def hstrlen(h: DataFrame, field: str) -> DataFrame:
    return h.filter(F.col("field") == field).select("key", F.octet_length("value").alias("n"))


def hset(h: DataFrame, delta: DataFrame) -> DataFrame:
    return upsert(h, delta, KEYS)


def hset_created(h: DataFrame, delta: DataFrame) -> DataFrame:
    """key, created: fields that a write adds."""
    new = delta.select(*KEYS).distinct().join(h.select(*KEYS), KEYS, "left_anti")
    return delta.select("key").distinct().join(new.groupBy("key").agg(F.count("*").alias("n")), "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("created"))


def hsetnx(h: DataFrame, delta: DataFrame) -> DataFrame:
    return insert_absent(h, delta, KEYS)


def hdel(h: DataFrame, fields: DataFrame) -> DataFrame:
    return delete(h, fields, KEYS)


def hincrby(h: DataFrame, log: DataFrame) -> DataFrame:
    """key, field, value (a number) after adding (key, field, delta)."""
    add = log.groupBy(*KEYS).agg(F.sum("delta").alias("d"))
    found = add.join(h.select(*KEYS, F.col("value").try_cast("bigint").alias("old")), KEYS, "left")
    return found.select(*KEYS, (F.coalesce("old", F.lit(0)) + F.col("d")).alias("value"))


def hexpire(h: DataFrame, probes: DataFrame, at_ms: Column, now_ms: int, flag: str | None = None) -> DataFrame:
    """key, field, code: -2 no field, 0 the flag forbids, 2 deadline passed (deleted), 1 set."""
    found = probes.join(matching(h, probes, KEYS).select(*KEYS, "field_expire_at_ms", F.lit(True).alias("here")), KEYS, "left").withColumn("new", at_ms)
    gate = expire_gate(F.col("field_expire_at_ms"), F.col("new"), flag)
    code = F.when(F.col("here").isNull(), -2).when(~gate, 0).when(F.col("new") <= now_ms, 2).otherwise(1)
    return found.select(*KEYS, code.alias("code"))


def httl(h: DataFrame, probes: DataFrame, now_ms: int) -> DataFrame:
    found = probes.join(matching(h, probes, KEYS).select(*KEYS, "field_expire_at_ms", F.lit(True).alias("here")), KEYS, "left")
    here, at = F.coalesce("here", F.lit(False)), F.col("field_expire_at_ms")
    return found.select(*KEYS, ttl(here, at, now_ms).alias("httl"), ttl(here, at, now_ms, False).alias("hpttl"))


def hrandfield(h: DataFrame, n: int) -> DataFrame:
    """The first |n| fields of each key."""
    from pyspark.sql import Window

    w = Window.partitionBy("key").orderBy("field")
    return h.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= abs(n)).select("key", "field", "value")
