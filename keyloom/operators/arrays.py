"""Sparse arrays as rows (key, idx, value): ranges, text predicates and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import glob
from .state import delete, upsert


def arset(a: DataFrame, delta: DataFrame) -> DataFrame:
    return upsert(a, delta, ["key", "idx"])


def ardel(a: DataFrame, gone: DataFrame) -> DataFrame:
    return delete(a, gone, ["key", "idx"])


def ardelrange(a: DataFrame, start: int, stop: int) -> DataFrame:
    return a.filter(~F.col("idx").between(start, stop))


def armget(a: DataFrame, probes: DataFrame) -> DataFrame:
    return probes.join(a, ["key", "idx"], "left").select("key", "idx", "value")


def argetrange(a: DataFrame, start: int, stop: int) -> DataFrame:
    """key, idx, value of every index in a range, null in the gaps."""
    every = a.select("key").distinct().select("key", F.explode(F.sequence(F.lit(start).cast("bigint"), F.lit(stop).cast("bigint"))).alias("idx"))
    return every.join(a, ["key", "idx"], "left").select("key", "idx", "value")


def arscan(a: DataFrame, start: int, stop: int, limit: int | None = None) -> DataFrame:
    rows = a.filter(F.col("idx").between(start, stop))
    if limit is None:
        return rows
    w = Window.partitionBy("key").orderBy("idx")
    return rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= limit).drop("rn")


def argrep(a: DataFrame, start: int, stop: int, tests: list[tuple[str, str]], any_of: bool = True, nocase: bool = False) -> DataFrame:
    """Rows whose value passes tests (EXACT, MATCH and RE: contained; GLOB), any or all of them."""
    text = F.col("value").cast("string")
    text = F.lower(text) if nocase else text
    out = F.lit(not any_of)
    for kind, p in tests:
        p = p.lower() if nocase else p
        hit = text == p if kind == "EXACT" else glob(text, p) if kind == "GLOB" else text.contains(p)
        out = (out | hit) if any_of else (out & hit)
    return a.filter(F.col("idx").between(start, stop) & out)


def arop(a: DataFrame, start: int, stop: int, match=None) -> DataFrame:
    """key, used, matches, total, least, most, all_and, all_or, all_xor of a range in one pass."""
    v = F.col("value").cast("bigint")
    aggs = [F.count("*").alias("used"), F.count(F.when(F.col("value") == match, 1)).alias("matches"), F.sum(v).alias("total"), F.min(v).alias("least"), F.max(v).alias("most"), F.bit_and(v).alias("all_and"), F.bit_or(v).alias("all_or"), F.bit_xor(v).alias("all_xor")]
    return a.filter(F.col("idx").between(start, stop)).groupBy("key").agg(*aggs)


def arinfo(a: DataFrame) -> DataFrame:
    """key, count, length (highest index + 1)."""
    return a.groupBy("key").agg(F.count("*").alias("count"), (F.max("idx") + 1).alias("length"))


def arring(log: DataFrame, size: int) -> DataFrame:
    """key, idx, value of a ring that (key, seq, value) were written to in order."""
    n = F.row_number().over(Window.partitionBy("key").orderBy("seq")) - 1
    return log.withColumn("n", n).groupBy("key", F.pmod("n", F.lit(size)).cast("bigint").alias("idx")).agg(F.max_by("value", "n").alias("value"))


def arlastitems(log: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("key").orderBy(F.desc("seq"))
    return log.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n).drop("rn")
