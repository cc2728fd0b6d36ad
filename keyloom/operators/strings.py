"""Byte strings: lookups, slices, counters, conditional writes, digests and longest common subsequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import range_norm
from .state import folded, insert_absent, matching, reduced, upsert


def mget(kv: DataFrame, probes: DataFrame) -> DataFrame:
    """ord, key, value: null for a miss (GET of many; batch_get)."""
    return probes.join(matching(kv, probes, ["key"]).select("key", "value"), "key", "left").select("ord", "key", "value")


def getrange(value: Column, start: int, stop: int) -> Column:
    """Bytes start to stop, both included, from the end where negative."""
    data = value.cast("binary")
    first, last = range_norm(F.octet_length(data), start, stop, formal=True)
    return F.when(first <= last, F.substring(data, (first + 1).cast("int"), (last - first + 1).cast("int"))).otherwise(F.lit("").cast("binary")).cast("string")


def setrange(value: Column, offset: int, piece: str) -> Column:
    """Bytes overwritten from an offset, zeros in between."""
    data, n = value.cast("binary"), len(piece.encode())
    head = F.rpad(F.substring(data, 1, offset), offset, F.lit(b"\0"))
    return F.concat(head, F.lit(piece.encode()), F.substring(data, offset + n + 1, 1 << 30)).cast("string")


def appended(log: DataFrame) -> DataFrame:
    """key, value, bytes of all pieces of (key, seq, piece) in order."""
    pieces = F.array_sort(F.collect_list(F.struct("seq", "piece")))["piece"]
    return log.groupBy("key").agg(F.array_join(pieces, "").alias("value")).withColumn("bytes", F.octet_length("value"))


def running(log: DataFrame) -> DataFrame:
    """The counter after each of (key, seq, delta): INCR, INCRBY, DECR, DECRBY."""
    w = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return log.select("key", "seq", F.sum("delta").over(w).alias("value"))


def totals(log: DataFrame) -> DataFrame:
    """The counters after all: a sum that combines on the map side."""
    return log.groupBy("key").agg(F.sum("delta").alias("value"))


def increx(log: DataFrame, lower: float, upper: float, saturate: bool = True, real: bool = False) -> DataFrame:
    """key, seq, value, applied of each ordered addition within bounds: one beyond them saturates or is refused; applied
    is what was added. real: BYFLOAT, in doubles."""

    def step(value, delta):
        new = value + delta
        inside = max(min(new, upper), lower)
        if not saturate and inside != new:
            inside = value
        return inside, (inside, inside - value)

    kind = "double" if real else "bigint"
    rows = log.select("key", "seq", F.col("delta").cast(kind).alias("delta"))
    return folded(rows, ["key"], ["seq"], 0.0 if real else 0, step, f"value {kind}, applied {kind}", ["delta"])


def bounded(log: DataFrame, lower: int, upper: int, saturate: bool = True) -> DataFrame:
    """key, value after ordered additions within bounds."""
    return increx(log, lower, upper, saturate).groupBy("key").agg(F.max_by("value", "seq").alias("value"))


def getset(log: DataFrame) -> DataFrame:
    """key, seq, value, old: what each write of (key, seq, value) replaces."""
    return log.withColumn("old", F.lag("value").over(Window.partitionBy("key").orderBy("seq")))


def set_if(kv: DataFrame, delta: DataFrame, condition: str | None = None) -> DataFrame:
    """kv after SET of delta (key, value[, expect][, seq]) under NX, XX, IFEQ or IFNE; deadlines go. Writes of one key
    apply by seq (or as they come): without a condition and under XX the last counts, under NX the first, and the
    others are compared with what the write before left."""
    if condition in ("IFEQ", "IFNE") and "expect" in delta.columns:
        return _set_compared(kv, delta, condition == "IFEQ")
    if condition == "NX":
        return setnx(kv, delta.select(*[c for c in ("key", "value", "seq") if c in delta.columns]))
    new = reduced(delta.select(*[c for c in ("key", "value", "seq") if c in delta.columns]), ["key"])
    if condition == "XX":
        new = new.join(kv.select("key"), "key", "left_semi")
    if condition == "IFEQ":
        return kv
    return upsert(kv, new.withColumn("expire_at_ms", F.lit(None).cast("bigint")), ["key"])


def _set_compared(kv: DataFrame, delta: DataFrame, equal: bool) -> DataFrame:
    if "seq" not in delta.columns:
        delta = delta.withColumn("seq", F.monotonically_increasing_id())

    def step(state, old, value, expect):
        here, now = state if state else (old is not None, old)
        same = here and now == expect
        if same == equal:
            state = (True, value)
            return state, (True, value)
        return (here, now), (False, now)

    found = delta.join(kv.select("key", F.col("value").alias("old")), "key", "left")
    after = folded(found, ["key"], ["seq"], None, step, "written boolean, value string", ["old", "value", "expect"])
    new = after.groupBy("key").agg(F.max("written").alias("any"), F.max_by("value", "seq").alias("value")).filter("any").drop("any")
    return upsert(kv, new.withColumn("expire_at_ms", F.lit(None).cast("bigint")), ["key"])


def setnx(kv: DataFrame, delta: DataFrame) -> DataFrame:
    return insert_absent(kv, delta, ["key"])


def msetnx(kv: DataFrame, delta: DataFrame) -> DataFrame:
    """All of delta or nothing."""
    clash = delta.join(kv.select("key"), "key", "left_semi").agg(F.count("*").alias("_n"))
    return kv.unionByName(reduced(delta, ["key"]).join(F.broadcast(clash), F.col("_n") == 0).drop("_n"), allowMissingColumns=True)


def set_range(kv: DataFrame, offset: int, piece: str) -> DataFrame:
    """kv after SETRANGE of every key: the value is written over, and its deadline goes."""
    return _rewritten(kv, setrange(F.col("value"), offset, piece))


def _rewritten(kv: DataFrame, value: Column) -> DataFrame:
    cleared = F.lit(None).cast("bigint")
    return kv.select(*[value.alias(c) if c == "value" else cleared.alias(c) if c == "expire_at_ms" else F.col(c) for c in kv.columns])


def incr_by_float(kv: DataFrame, delta: DataFrame) -> DataFrame:
    """kv after INCRBYFLOAT of delta (key, delta): numbers are added up, a missing key counts as 0, deadlines of the keys
    go; a value that is no number stays."""
    sums = delta.groupBy("key").agg(F.sum("delta").alias("d"))
    both = kv.join(sums, "key", "full")
    number = F.coalesce("value", F.lit("0")).try_cast("double") + F.col("d")
    hit = F.col("d").isNotNull() & number.isNotNull()
    made = {"value": F.when(hit, number.cast("string")).otherwise(F.col("value")), "expire_at_ms": F.when(~hit, F.col("expire_at_ms"))}
    return both.select(*[made[c].alias(c) if c in made else F.col(c) for c in kv.columns])


def digest(value: Column) -> Column:
    """XXH3-64 of the bytes in hexadecimal: Spark has no such function."""

    def run(values: pa.Array) -> pa.Array:
        import xxhash

        return pa.array([None if v is None else f"{xxhash.xxh3_64_intdigest(v):016x}" for v in values.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(value.cast("binary"))


def _lcs_rows(x: np.ndarray, y: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows of the table of lengths after each element of x, from the row before."""
    out = np.zeros((len(x) + 1, len(y) + 1), np.int32)
    out[0] = first
    for i in range(len(x)):
        hit = out[i, :-1] + (y == x[i])
        out[i + 1, 1:] = np.maximum.accumulate(np.maximum(hit, out[i, 1:]))
    return out


def lcs_matches(a: bytes, b: bytes) -> list[tuple[int, int]]:
    """Places in a and b of a longest common subsequence, last first. Every sqrt(len(a))-th row of the table is kept
    and the rows between are made again on the way back, so memory is some len(b) * sqrt(len(a)) numbers."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    step = max(1, int(len(x) ** 0.5))
    kept = [np.zeros(len(y) + 1, np.int32)]
    for at in range(0, len(x), step):
        kept.append(_lcs_rows(x[at : at + step], y, kept[-1])[-1])
    out, i, j = [], len(x), len(y)
    while i and j:
        block = (i - 1) // step
        low = block * step
        rows = _lcs_rows(x[low:i], y[:j], kept[block][: j + 1])
        while i > low and j:
            if rows[i - low, j] == rows[i - low - 1, j]:
                i -= 1
            elif rows[i - low, j] == rows[i - low, j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((i, j))
    return out


def lcs_ranges(a: bytes, b: bytes, least: int = 0) -> list[tuple[int, int, int, int, int]]:
    """(first and last place in a, the same in b, length) of runs of a common subsequence, last run first; LCS with IDX,
    MINMATCHLEN and WITHMATCHLEN."""
    runs: list[list[int]] = []
    for i, j in lcs_matches(a, b):
        if runs and runs[-1][0] == i + 1 and runs[-1][2] == j + 1:
            runs[-1][0], runs[-1][2] = i, j
        else:
            runs.append([i, i, j, j])
    return [(p, q, r, s, q - p + 1) for p, q, r, s in runs if q - p + 1 >= least]


def lcs(pairs: DataFrame) -> DataFrame:
    """id, length and text of the longest common subsequence of (id, a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common = [bytes(a[i] for i, _ in reversed(lcs_matches(a, b))) for a, b in _texts(batch)]
            yield pa.record_batch([batch.column("id"), pa.array([len(c) for c in common], pa.int32()), pa.array([c.decode(errors="replace") for c in common], pa.string())], names=["id", "length", "common"])

    return _binary(pairs).mapInArrow(run, f"id {pairs.schema['id'].dataType.simpleString()}, length int, common string")


def lcs_idx(pairs: DataFrame, least: int = 0) -> DataFrame:
    """id, length, ranges of (id, a, b): LCS IDX, ranges of `least` bytes at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = [lcs_ranges(a, b) for a, b in _texts(batch)]
            ranges = [[dict(zip(_RANGE, r, strict=True)) for r in w if r[4] >= least] for w in whole]
            kind = pa.list_(pa.struct([(n, pa.int32()) for n in _RANGE]))
            yield pa.record_batch([batch.column("id"), pa.array([sum(r[4] for r in w) for w in whole], pa.int32()), pa.array(ranges, kind)], names=["id", "length", "ranges"])

    fields = ", ".join(f"{n}: int" for n in _RANGE)
    return _binary(pairs).mapInArrow(run, f"id {pairs.schema['id'].dataType.simpleString()}, length int, ranges array<struct<{fields}>>")


_RANGE = ("a_first", "a_last", "b_first", "b_last", "n")


def _binary(pairs: DataFrame) -> DataFrame:
    return pairs.select("id", F.col("a").cast("binary").alias("a"), F.col("b").cast("binary").alias("b"))


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[bytes, bytes]]:
    for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
        yield a or b"", b or b""
