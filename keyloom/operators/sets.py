"""Sets as rows (key, member). Algebra over keys is one grouping by member, not a chain of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .state import delete, matching


def scard(s: DataFrame) -> DataFrame:
    return s.groupBy("key").agg(F.count("*").alias("n"))


def smismember(s: DataFrame, probes: DataFrame) -> DataFrame:
    """key, member, found (1 or 0) of probes."""
    found = probes.join(matching(s, probes, ["key", "member"]).select("key", "member", F.lit(1).alias("f")), ["key", "member"], "left")
    return found.select("key", "member", F.coalesce("f", F.lit(0)).alias("found"))


def algebra(s: DataFrame, how: str, keys: list[str]) -> DataFrame:
    """member of the union, inter(section) or diff(erence: the first without the rest) of keys."""
    rows = s.filter(F.col("key").isin(keys))
    if how == "union":
        return rows.select("member").distinct()
    first = F.max((F.col("key") == keys[0]).cast("int"))
    grouped = rows.groupBy("member").agg(F.count_distinct("key").alias("n"), first.alias("first"))
    if how == "inter":
        return grouped.filter(F.col("n") == len(set(keys))).select("member")
    if keys[0] in keys[1:]:
        return grouped.filter(F.lit(False)).select("member")
    return grouped.filter((F.col("n") == 1) & (F.col("first") == 1)).select("member")


def sintercard(s: DataFrame, keys: list[str], limit: int = 0) -> DataFrame:
    n = algebra(s, "inter", keys).agg(F.count("*").alias("n"))
    return n.select(F.least("n", F.lit(limit)).alias("n")) if limit else n


def store(s: DataFrame, dst: str, members: DataFrame) -> DataFrame:
    return s.filter(F.col("key") != dst).unionByName(members.select(F.lit(dst).alias("key"), "member"))


def sadd(s: DataFrame, delta: DataFrame) -> DataFrame:
    return s.unionByName(delta).distinct()


def sadd_added(s: DataFrame, delta: DataFrame) -> DataFrame:
    return delta.distinct().join(s, ["key", "member"], "left_anti").groupBy("key").agg(F.count("*").alias("added"))


def srem(s: DataFrame, gone: DataFrame) -> DataFrame:
    return delete(s, gone, ["key", "member"])


def smove(s: DataFrame, src: str, dst: str, member: str) -> DataFrame:
    moved = s.filter((F.col("key") == src) & (F.col("member") == member)).withColumn("key", F.lit(dst))
    return s.filter(~((F.col("key") == src) & (F.col("member") == member))).unionByName(moved).distinct()


def pick(s: DataFrame, n: int) -> DataFrame:
    """n members of each key: SRANDMEMBER and SPOP. A negative n goes round with repetition."""
    w = Window.partitionBy("key").orderBy("member")
    rows = s.withColumn("rn", F.row_number().over(w) - 1).withColumn("size", F.count("*").over(Window.partitionBy("key")))
    if n >= 0:
        return rows.filter(F.col("rn") < n).select("key", "member")
    times = F.floor((F.lit(-n - 1) - F.col("rn")) / F.col("size")).cast("int") + 1
    return rows.filter(F.col("rn") < -n).select("key", "member", F.explode(F.sequence(F.lit(1), times)).alias("t")).drop("t")
