"""Building blocks of writes: upserts, deletes, and folds of a changelog into its latest state."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import staged


def reduced(delta: DataFrame, keys: Sequence[str], order: str = "seq", first: bool = False) -> DataFrame:
    """One row for each key: the last (or first) by the order column, which goes; without such a column, as the rows
    come. An aggregate that combines on the map side."""
    if order not in delta.columns:
        delta = delta.withColumn(order, F.monotonically_increasing_id())
    rest = [c for c in delta.columns if c not in (*keys, order)]
    if not rest:
        return delta.select(*keys).distinct()
    pick = F.min_by if first else F.max_by
    return delta.groupBy(*keys).agg(pick(F.struct(*rest), F.col(order)).alias("_r")).select(*keys, "_r.*")


def upsert(base: DataFrame, delta: DataFrame, keys: Sequence[str], order: str = "seq") -> DataFrame:
    """base with delta's rows in place of those with equal keys; of a key that delta has twice the last row counts."""
    new = reduced(delta, keys, order)
    return base.join(new.select(*keys), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def insert_absent(base: DataFrame, delta: DataFrame, keys: Sequence[str], order: str = "seq") -> DataFrame:
    """base with delta's rows whose keys it doesn't have; of a key that delta has twice the first row counts."""
    new = reduced(delta, keys, order, first=True)
    return base.unionByName(new.join(base.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def delete(base: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return base.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def latest(log: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The last row of each key: an aggregate that combines on the map side."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def recovery_fold(wal: DataFrame, snapshot_ms: int = 0) -> DataFrame:
    """key, value, expire_at_ms after replaying a changelog (timestamp_ms, sequence, op, key, value, expire_at_ms).

    The last Set or Del of a key decides; the last Expire after a Set gives the deadline. Two conditional
    aggregates over one grouping; rows from before the snapshot are dropped at the scan.
    """
    rows = wal.filter(F.col("timestamp_ms") >= snapshot_ms)
    at = F.struct("timestamp_ms", "sequence")
    write = F.col("op").isin("Set", "Del")
    last = F.max(F.when(write, F.struct(at.alias("at"), "op", "value", "expire_at_ms"))).alias("w")
    expire = F.max(F.when(F.col("op") == "Expire", F.struct(at.alias("at"), "expire_at_ms"))).alias("e")
    out = rows.groupBy("key").agg(last, expire).filter("w.op = 'Set'")
    deadline = F.when(F.col("e.at") > F.col("w.at"), F.col("e.expire_at_ms")).otherwise(F.col("w.expire_at_ms"))
    return out.select("key", F.col("w.value").alias("value"), deadline.alias("expire_at_ms"))


#: Lists of probes up to so many rows are given to all tasks; longer ones meet the table in a shuffle.
PROBES = 100_000


def matching(table: DataFrame, probes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of a table that probes can find: a short list of probes, counted first, filters the table where it is
    read, so only what it finds is exchanged."""
    wanted = probes.select(*keys).distinct()
    if wanted.limit(PROBES + 1).count() <= PROBES:
        return table.join(F.broadcast(wanted), list(keys), "left_semi")
    return table


def split_ranks(df: DataFrame, keys: Sequence[str], order: Sequence[Column], weight: str | None = None) -> DataFrame:
    """df with lo, the sum of weights (or number) of the rows before a row within its key, and total, that of all of its key.
    The rows are sorted in ranges of key and order together, so a hot key takes many tasks; totals of each range and key
    are summed up apart. The ranges are written, as their bounds come from a sample."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = df.repartitionByRange(n, *[F.col(k) for k in keys], *order).withColumn("_part", F.spark_partition_id())
    ranged = staged(part)
    w = F.lit(1).cast("bigint") if weight is None else F.col(weight)
    sums = ranged.groupBy(*keys, "_part").agg(F.sum(w).alias("_sum"))
    whole = Window.partitionBy(*keys)
    before = F.sum("_sum").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select(*keys, "_part", F.coalesce(before, F.lit(0)).alias("_offset"), F.sum("_sum").over(whole).alias("total"))
    inside = F.sum(w).over(Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    out = ranged.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(offsets, [*keys, "_part"])
    return out.select(*df.columns, (F.col("_inside") + F.col("_offset")).alias("lo"), "total")


def evict(entries: DataFrame, target_bytes: int, rank: Sequence[Column]) -> DataFrame:
    """Entries (key, bytes, ...) that stay when the coldest by rank go until at most target_bytes are left."""
    rows = split_ranks(entries.withColumn("_all", F.lit(0)), ["_all"], rank, "bytes")
    return rows.filter(F.col("lo") + F.col("bytes") > F.col("total") - target_bytes).select(*entries.columns)


def evict_prefixes(entries: DataFrame, target_bytes: int) -> DataFrame:
    """Entries (key, prefix, suffix_len, touch, bytes) that stay when whole groups go, coldest group first, and in a
    group the deepest suffix first."""
    groups = entries.groupBy("prefix").agg(F.max("touch").alias("_group"))
    ranked = entries.join(groups, "prefix")
    return evict(ranked, target_bytes, [F.col("_group").asc(), F.col("prefix").asc(), F.col("suffix_len").desc(), F.col("touch").asc(), F.col("key").asc()]).select(*entries.columns)


def folded(rows: DataFrame, keys: Sequence[str], order: Sequence[str], start: Any, step: Callable[..., tuple[Any, tuple]], schema: str, sends: Sequence[str]) -> DataFrame:
    """A fold over each key's rows in order, for rules whose next step depends on the last. step(state, *values of the
    columns `sends`) gives the new state and what is appended to the row's keys and order columns (schema). Rows are sorted within
    partitions and streamed in Arrow batches: a task holds one state, never a key's rows."""
    kept = [*keys, *order]
    names = [f.split()[0] for f in schema.split(", ")]
    head = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, types = None, start, None
        for batch in batches:
            out = []
            for key, values in zip(zip(*(batch.column(c).to_pylist() for c in keys), strict=True), zip(*(batch.column(c).to_pylist() for c in sends), strict=True), strict=True):
                if key != last:
                    last, state = key, start
                state, row = step(state, *values)
                out.append(row)
            types = types or [_ARROW[f.split()[1]] for f in schema.split(", ")]
            new = [pa.array([r[i] for r in out], t) for i, t in enumerate(types)]
            yield pa.record_batch([*(batch.column(c) for c in kept), *new], names=[*kept, *names])

    few = rows.select(*dict.fromkeys([*kept, *sends]))
    return few.repartition(*keys).sortWithinPartitions(*kept).mapInArrow(run, f"{head}, {schema}")


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}


def throttle(requests: DataFrame, budget: int) -> DataFrame:
    """key, seq, qty, limited, remaining: a budget that is spent and never refilled; a request beyond it is rejected
    and costs nothing; a quantity is one at least."""

    def step(left: int, qty: int) -> tuple[int, tuple]:
        limited = qty > left
        left -= 0 if limited else qty
        return left, (int(limited), left)

    rows = requests.select("key", "seq", F.greatest("qty", F.lit(1)).cast("bigint").alias("qty"))
    return folded(rows, ["key"], ["seq", "qty"], budget, step, "limited int, remaining bigint", ["qty"])


def locks(events: DataFrame) -> DataFrame:
    """key, token, until of locks held after (key, seq, at_ms, op, token, ttl_ms) events: an acquire succeeds where no
    live lock is held, release and renew need the holder's token."""

    def step(held: tuple, at: int, op: str, token: str, ttl: int) -> tuple[tuple, tuple]:
        free = held[0] is None or held[1] <= at
        mine = not free and held[0] == token
        if (op == "acquire" and free) or (op == "renew" and mine):
            held = (token, at + ttl)
        elif op == "release" and mine:
            held = (None, None)
        return held, (*held, at)

    after = folded(events, ["key"], ["seq"], (None, None), step, "token string, until bigint, now bigint", ["at_ms", "op", "token", "ttl_ms"])
    last = after.groupBy("key").agg(F.max_by(F.struct("token", "until"), "seq").alias("r"), F.max("now").alias("now"))
    return last.filter("r.token IS NOT NULL AND r.until > now").select("key", "r.token", "r.until")


def transactions(kv: DataFrame, queued: DataFrame, watched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """MULTI, WATCH and EXEC as one commit point. queued (txn, ord, key, op, value) holds the commands between MULTI and
    EXEC, watched (txn, key, version) what WATCH saw (version null: no such key), kv (key, value, version) the state at
    the commit point. A transaction whose watched keys all still have their versions applies as a whole, others not at
    all; those that apply do so by (txn, ord), and each key they touch gets the next version.

    Returns kv afterwards, and txn, committed. A discarded transaction is one without queued rows."""
    now = kv.select("key", F.col("version").alias("now"))
    stale = watched.join(now, "key", "left").filter(~F.col("version").eqNullSafe(F.col("now"))).select("txn").distinct()
    every = queued.select("txn").union(watched.select("txn")).distinct()
    replies = every.join(stale.withColumn("stale", F.lit(True)), "txn", "left").select("txn", F.col("stale").isNull().alias("committed"))
    writes = queued.filter(F.col("op").isin("SET", "DEL")).join(stale, "txn", "left_anti")
    last = writes.groupBy("key").agg(F.max_by(F.struct("op", "value"), F.struct("txn", "ord")).alias("w"))
    both = kv.join(last, "key", "full").filter("w IS NULL OR w.op = 'SET'")
    value = F.when(F.col("w").isNull(), F.col("value")).otherwise(F.col("w.value"))
    version = F.when(F.col("w").isNull(), F.col("version")).otherwise(F.coalesce(F.col("version"), F.lit(0)) + 1)
    return both.select("key", value.alias("value"), version.alias("version")), replies


def flushed(df: DataFrame) -> DataFrame:
    """FLUSHDB, FLUSHALL: the relation without rows."""
    return df.filter(F.lit(False))
