"""Append logs as rows (key, ms, seq, ...): ranges by id, trims, tails and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def _up() -> WindowSpec:
    return Window.partitionBy("key").orderBy("ms", "seq")


def _down() -> WindowSpec:
    return Window.partitionBy("key").orderBy(F.desc("ms"), F.desc("seq"))


def stream_id(text: str, end: bool = False) -> tuple[int, int]:
    """(ms, seq) of '-', '+', 'ms' or 'ms-seq'."""
    if text == "-":
        return 0, 0
    if text == "+":
        return (1 << 63) - 1, (1 << 63) - 1
    ms, _, seq = text.partition("-")
    return int(ms), int(seq) if seq else ((1 << 63) - 1 if end else 0)


def _at_least(ms: int, seq: int) -> Column:
    return (F.col("ms") > ms) | ((F.col("ms") == ms) & (F.col("seq") >= seq))


def _at_most(ms: int, seq: int) -> Column:
    return (F.col("ms") < ms) | ((F.col("ms") == ms) & (F.col("seq") <= seq))


def xrange(x: DataFrame, start: str = "-", end: str = "+", count: int | None = None, rev: bool = False) -> DataFrame:
    """Entries with ids within bounds; the first (last) count of each key."""
    rows = x.filter(_at_least(*stream_id(start)) & _at_most(*stream_id(end, True)))
    if count is None:
        return rows
    return rows.withColumn("rn", F.row_number().over(_down() if rev else _up())).filter(F.col("rn") <= count).drop("rn")


def xread(x: DataFrame, cursors: DataFrame, count: int | None = None) -> DataFrame:
    """Entries after each key's cursor (key, c_ms, c_seq)."""
    rows = x.join(cursors, "key").filter((F.col("ms") > F.col("c_ms")) | ((F.col("ms") == F.col("c_ms")) & (F.col("seq") > F.col("c_seq")))).select(x.columns)
    return rows if count is None else rows.withColumn("rn", F.row_number().over(_up())).filter(F.col("rn") <= count).drop("rn")


def xlen(x: DataFrame) -> DataFrame:
    return x.groupBy("key").agg(F.count("*").alias("n"))


def xtrim(x: DataFrame, most: int, about: bool = False) -> DataFrame:
    """The newest `most` of each key; about allows a slack of a tenth, 64 at least, before anything goes."""
    slack = max(64, most // 10) if about else 0
    rows = x.withColumn("rn", F.row_number().over(_down()))
    if not slack:
        return rows.filter(F.col("rn") <= most).drop("rn")
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("key")))
    return rows.filter((F.col("n") <= most + slack) | (F.col("rn") <= most)).drop("rn", "n")


def xdel(x: DataFrame, ids: DataFrame) -> DataFrame:
    return x.join(ids, ["key", "ms", "seq"], "left_anti")


def xinfo(x: DataFrame) -> DataFrame:
    """key, length, first and last id."""
    at = F.struct("ms", "seq")
    out = x.groupBy("key").agg(F.count("*").alias("length"), F.min(at).alias("f"), F.max(at).alias("l"))
    return out.select("key", "length", F.col("f.ms").alias("first_ms"), F.col("f.seq").alias("first_seq"), F.col("l.ms").alias("last_ms"), F.col("l.seq").alias("last_seq"))


def xadd_ids(rows: DataFrame) -> DataFrame:
    """ms and seq for (key, ms, ord) rows: seq counts rows of a key within a millisecond."""
    w = Window.partitionBy("key", "ms").orderBy("ord")
    return rows.withColumn("seq", (F.row_number().over(w) - 1).cast("bigint"))
