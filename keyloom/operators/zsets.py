"""Sorted sets as rows (key, member, score), ordered by score and then member bytes. Ranks are row numbers; a top-k
within keys keeps k rows a task before the exchange (WindowGroupLimit)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.exprs import lex_bound, range_norm, score_bound
from .state import folded, matching


def _key() -> WindowSpec:
    return Window.partitionBy("key")


def _order(rev: bool) -> WindowSpec:
    return _key().orderBy(F.desc("score"), F.desc("member")) if rev else _key().orderBy("score", "member")


def zrank(z: DataFrame, rev: bool = False) -> DataFrame:
    return z.select("key", "member", "score", (F.row_number().over(_order(rev)) - 1).cast("bigint").alias("rank"))


def zrange(z: DataFrame, start: int, stop: int, rev: bool = False) -> DataFrame:
    """key, member, score, rank of ranks start to stop. Bounds from the front need no count and stop early."""
    ranked = zrank(z, rev)
    if start >= 0 and stop >= 0:
        return ranked.filter((F.col("rank") >= start) & (F.col("rank") <= stop))
    first, last = range_norm(F.col("n"), start, stop)
    return ranked.withColumn("n", F.count("*").over(_key())).filter(F.col("rank").between(first, last)).drop("n")


def zrangebyscore(z: DataFrame, low, high, rev: bool = False, offset: int = 0, count: int | None = None) -> DataFrame:
    """key, member, score with the score within bounds; a page of them with offset and count."""
    rows = z.filter(score_bound(F.col("score"), low, True) & score_bound(F.col("score"), high, False))
    if offset == 0 and count is None:
        return rows.select("key", "member", "score")
    rows = rows.withColumn("rn", F.row_number().over(_order(rev)) - 1).filter(F.col("rn") >= offset)
    return (rows if count is None else rows.filter(F.col("rn") < offset + count)).select("key", "member", "score")


def zrangebylex(z: DataFrame, low: str, high: str) -> DataFrame:
    return z.filter(lex_bound(F.col("member"), low, True) & lex_bound(F.col("member"), high, False)).select("key", "member", "score")


def zcount(z: DataFrame, low, high) -> DataFrame:
    hit = score_bound(F.col("score"), low, True) & score_bound(F.col("score"), high, False)
    return z.groupBy("key").agg(F.count(F.when(hit, 1)).alias("n"))


def zlexcount(z: DataFrame, low: str, high: str) -> DataFrame:
    hit = lex_bound(F.col("member"), low, True) & lex_bound(F.col("member"), high, False)
    return z.groupBy("key").agg(F.count(F.when(hit, 1)).alias("n"))


def zcard(z: DataFrame) -> DataFrame:
    return z.groupBy("key").agg(F.count("*").alias("n"))


def zmscore(z: DataFrame, probes: DataFrame) -> DataFrame:
    return probes.join(matching(z, probes, ["key", "member"]), ["key", "member"], "left").select("key", "member", "score")


def zpop(z: DataFrame, n: int, highest: bool = False) -> tuple[DataFrame, DataFrame]:
    """The n lowest (highest) of each key, and the rest."""
    ranked = zrank(z, highest)
    return ranked.filter(F.col("rank") < n).drop("rank"), ranked.filter(F.col("rank") >= n).drop("rank")


def zmpop(z: DataFrame, keys: list[str], n: int, highest: bool = False) -> DataFrame:
    mine = z.filter(F.col("key").isin(keys)).withColumn("o", F.array_position(F.lit(keys), F.col("key")))
    first = mine.agg(F.min("o").alias("first"))
    return zpop(mine.join(F.broadcast(first), F.col("o") == F.col("first")).select("key", "member", "score"), n, highest)[0]


def zremrangebyrank(z: DataFrame, start: int, stop: int) -> DataFrame:
    first, last = range_norm(F.col("n"), start, stop, formal=True)
    ranked = zrank(z).withColumn("n", F.count("*").over(_key()))
    return ranked.filter(~F.col("rank").between(first, last)).drop("rank", "n")


def zremrangebyscore(z: DataFrame, low, high) -> DataFrame:
    return z.filter(~(score_bound(F.col("score"), low, True) & score_bound(F.col("score"), high, False)))


def zremrangebylex(z: DataFrame, low: str, high: str) -> DataFrame:
    return z.filter(~(lex_bound(F.col("member"), low, True) & lex_bound(F.col("member"), high, False)))


def zadd(z: DataFrame, delta: DataFrame, nx: bool = False, xx: bool = False, gt: bool = False, lt: bool = False, incr: bool = False) -> DataFrame:
    """z after delta (key, member, score[, seq]). GT and LT compare the given score with the old one, also with INCR.
    Scores of one member apply by seq, or as they come: the last counts, the first with NX, the largest or smallest
    with GT or LT, the sum with INCR; INCR with GT or LT folds them one by one."""
    if incr and (gt or lt):
        return _zadd_compared(z, delta, xx, gt)
    by = F.col("seq")
    if "seq" not in delta.columns:
        delta = delta.withColumn("seq", F.monotonically_increasing_id())
    pick = F.min_by("score", by) if nx else F.max("score") if gt else F.min("score") if lt else F.sum("score") if incr else F.max_by("score", by)
    found = z.join(delta.groupBy("key", "member").agg(pick.alias("new")), ["key", "member"], "full")
    old, new = F.col("score"), F.col("new")
    passes = F.lit(True)
    if gt:
        passes = new > old
    if lt:
        passes = new < old
    value = old + new if incr else new
    insert, update = F.lit(None) if xx else new, old if nx else F.when(passes, value).otherwise(old)
    score = F.when(new.isNull(), old).when(old.isNull(), insert).otherwise(update)
    return found.select("key", "member", score.alias("score")).filter("score IS NOT NULL")


def _zadd_compared(z: DataFrame, delta: DataFrame, xx: bool, gt: bool) -> DataFrame:
    if "seq" not in delta.columns:
        delta = delta.withColumn("seq", F.monotonically_increasing_id())

    def step(state, old, new):
        now = old if state is None else state
        if now is None:
            now = None if xx else new
        elif (new > now) if gt else (new < now):
            now += new
        return now, (now,)

    found = delta.join(z.select("key", "member", F.col("score").alias("old")), ["key", "member"], "left")
    after = folded(found, ["key", "member"], ["seq"], None, step, "now double", ["old", "score"])
    last = after.groupBy("key", "member").agg(F.max_by("now", "seq").alias("new"))
    both = z.join(last, ["key", "member"], "full")
    return both.select("key", "member", F.coalesce("new", "score").alias("score")).filter("score IS NOT NULL")


def zincrby(z: DataFrame, log: DataFrame) -> DataFrame:
    """z with the sums of (key, member, delta) added."""
    both = z.unionByName(log.select("key", "member", F.col("delta").cast("double").alias("score")))
    return both.groupBy("key", "member").agg(F.sum("score").alias("score"))


def combine(sources: list[DataFrame], how: str = "union", weights: list[float] | None = None, agg: str = "sum") -> DataFrame:
    """member, score of the weighted union, inter(section) or diff(erence) of sources (member, score). Weights come
    before the aggregate. One grouping over tagged rows; a source given twice counts twice."""
    weights = weights or [1.0] * len(sources)
    rows = [df.select("member", (F.col("score") * w).alias("score"), F.lit(i).alias("src")) for i, (df, w) in enumerate(zip(sources, weights, strict=True))]
    both = rows[0]
    for r in rows[1:]:
        both = both.unionByName(r)
    total: Column = {"sum": F.sum, "min": F.min, "max": F.max}[agg]("score")
    if how == "diff":
        total = F.max(F.when(F.col("src") == 0, F.col("score")))
    grouped = both.groupBy("member").agg(total.alias("score"), F.count("*").alias("n"), F.max("src").alias("last"))
    if how == "inter":
        grouped = grouped.filter(F.col("n") == len(sources))
    if how == "diff":
        grouped = grouped.filter(F.col("last") == 0)
    return grouped.select("member", "score")


def zrandmember(z: DataFrame, n: int) -> DataFrame:
    """The n lowest of each key; a negative n goes round with repetition."""
    if n >= 0:
        return zrange(z, 0, n - 1).drop("rank") if n else z.filter(F.lit(False))
    rows = zrank(z).withColumn("size", F.count("*").over(_key())).filter(F.col("rank") < -n)
    times = F.floor((F.lit(-n - 1) - F.col("rank")) / F.col("size")).cast("int") + 1
    return rows.select("key", "member", "score", F.explode(F.sequence(F.lit(1), times)).alias("t")).drop("t")
