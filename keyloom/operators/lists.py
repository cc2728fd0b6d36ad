"""Lists as rows (key, pos, value): slices, positions, removals and pops, all by ranks within the key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.exprs import range_norm


def _key() -> WindowSpec:
    return Window.partitionBy("key")


def ranked(l: DataFrame) -> DataFrame:  # noqa: E741
    """l with i (from 0) and n."""
    return l.withColumn("i", (F.row_number().over(_key().orderBy("pos")) - 1).cast("bigint")).withColumn("n", F.count("*").over(_key()))


def lrange(l: DataFrame, start: int, stop: int) -> DataFrame:  # noqa: E741
    """key, i, value of elements start to stop (also what LTRIM keeps)."""
    first, last = range_norm(F.col("n"), start, stop)
    return ranked(l).filter(F.col("i").between(first, last)).select("key", "i", "value")


def lindex(l: DataFrame, index: int) -> DataFrame:  # noqa: E741
    return ranked(l).filter(F.col("i") == (F.col("n") + index if index < 0 else F.lit(index))).select("key", "value")


def llen(l: DataFrame) -> DataFrame:  # noqa: E741
    return l.groupBy("key").agg(F.count("*").alias("n"))


def lpos(l: DataFrame, value: str, rank: int = 1, count: int = 1) -> DataFrame:  # noqa: E741
    """key, i of matches: from the rank-th on (from the end where negative), count of them (0: all)."""
    hits = ranked(l).filter(F.col("value") == value)
    order = F.col("pos") if rank > 0 else F.desc("pos")
    hits = hits.withColumn("m", F.row_number().over(_key().orderBy(order))).filter(F.col("m") >= abs(rank))
    return (hits.filter(F.col("m") < abs(rank) + count) if count else hits).select("key", "i")


def lrem(l: DataFrame, count: int, value: str) -> DataFrame:  # noqa: E741
    """key, pos, value without the first (last where negative) |count| matches, or all for 0."""
    if not count:
        return l.filter(F.col("value") != value)
    order = F.col("pos") if count > 0 else F.desc("pos")
    m = F.row_number().over(Window.partitionBy("key", "value").orderBy(order))
    return l.withColumn("m", m).filter((F.col("value") != value) | (F.col("m") > abs(count))).drop("m")


def linsert(l: DataFrame, pivot: str, value: str, before: bool = True) -> DataFrame:  # noqa: E741
    """key, i, value with the value put before or after the first pivot of each key."""
    at = ranked(l).filter(F.col("value") == pivot).groupBy("key").agg(F.min("i").alias("at"))
    new = at.select("key", (F.col("at") - 0.5 if before else F.col("at") + 0.5).alias("i"), F.lit(value).alias("value"))
    both = ranked(l).select("key", F.col("i").cast("double").alias("i"), "value").unionByName(new)
    return both.select("key", (F.row_number().over(_key().orderBy("i")) - 1).cast("bigint").alias("i"), "value")


def lset(l: DataFrame, index: int, value: str) -> DataFrame:  # noqa: E741
    i = F.col("n") + index if index < 0 else F.lit(index)
    return ranked(l).select("key", "i", F.when(F.col("i") == i, F.lit(value)).otherwise(F.col("value")).alias("value"))


def lset_replies(l: DataFrame, index: int) -> DataFrame:  # noqa: E741
    """key, reply of LSET: OK, or an error where the index is out of range."""
    inside = F.lit(-index) <= F.col("n") if index < 0 else F.lit(index) < F.col("n")
    return llen(l).select("key", F.when(inside, "OK").otherwise("ERR index out of range").alias("reply"))


def push(l: DataFrame, values: list[str], left: bool = False, only_existing: bool = True) -> DataFrame:  # noqa: E741
    """key, pos, value after a push of the values to every key (a left push turns their order)."""
    ends = l.groupBy("key").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    rows = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("o"), F.lit(v).alias("value")) for i, v in enumerate(values)])).alias("r")
    pos = F.col("lo") - F.col("r.o") if left else F.col("hi") + F.col("r.o")
    return l.select("key", "pos", "value").unionByName(ends.select("key", "lo", "hi", rows).select("key", pos.alias("pos"), F.col("r.value").alias("value")))


def pop(l: DataFrame, count: int, left: bool = True) -> tuple[DataFrame, DataFrame]:  # noqa: E741
    """What each key gives, and what is left."""
    order = F.col("pos").asc() if left else F.col("pos").desc()
    m = l.withColumn("m", F.row_number().over(_key().orderBy(order)))
    return m.filter(F.col("m") <= count).drop("m"), m.filter(F.col("m") > count).drop("m")


def move(l: DataFrame, src, dst, from_left: bool, to_left: bool) -> DataFrame:  # noqa: E741
    """key, pos, value after LMOVE (RPOPLPUSH: from the right to the left)."""
    one = l.filter(F.col("key") == src)
    end = one.agg((F.min("pos") if from_left else F.max("pos")).alias("p"))
    element = one.join(F.broadcast(end), F.col("pos") == F.col("p")).select("value")
    rest = l.join(F.broadcast(end.select(F.lit(src).alias("key"), F.col("p").alias("pos"))), ["key", "pos"], "left_anti")
    goal = rest.filter(F.col("key") == dst).agg(F.coalesce(F.min("pos") - 1 if to_left else F.max("pos") + 1, F.lit(0)).alias("pos"))
    new = element.join(F.broadcast(goal), F.lit(True)).select(F.lit(dst).cast(l.schema["key"].dataType).alias("key"), "pos", "value")
    return rest.select("key", "pos", "value").unionByName(new)


def mpop(l: DataFrame, keys: list, count: int, left: bool = True) -> DataFrame:  # noqa: E741
    """What the first of the keys that is not empty gives."""
    order = F.array_position(F.lit(keys), F.col("key"))
    mine = l.filter(F.col("key").isin(keys)).withColumn("o", order)
    first = mine.agg(F.min("o").alias("first"))
    chosen = mine.join(F.broadcast(first), F.col("o") == F.col("first")).drop("o", "first")
    return pop(chosen, count, left)[0]
