"""Scans of the keyspace, key metadata, deadlines, renames and sorting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import expire_gate, glob, ttl
from .state import delete, insert_absent, matching, upsert


def scan(keys: DataFrame, pattern: str = "*", kind: str | None = None, cursor: str | None = None, count: int | None = None) -> DataFrame:
    """A page of keys after a cursor (key, type); glob and type reach the scan."""
    out = keys.filter(glob(F.col("key"), pattern))
    if kind:
        out = out.filter(F.col("type") == kind)
    if cursor is not None:
        out = out.filter(F.col("key") > cursor)
    return out if count is None else out.orderBy("key").limit(count)


def keyspace(**relations: DataFrame) -> DataFrame:
    """key, type of all relations, named by type."""
    parts = [df.select(F.col("key").cast("string").alias("key"), F.lit(t).alias("type")).distinct() for t, df in relations.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def entries(df: DataFrame, first: str | None = None, count: int | None = None) -> DataFrame:
    """A snapshot of keys or entries from a key on, in order where it stops early (visit_keys, visit_entries, key_snapshot,
    entry_snapshot); toLocalIterator() visits it a partition at a time."""
    out = df if first is None else df.filter(F.col("key") >= first)
    return out if count is None else out.orderBy("key").limit(count)


def dbsize(keys: DataFrame) -> DataFrame:
    return keys.agg(F.count("*").alias("size"))


def types(keys: DataFrame, probes: DataFrame) -> DataFrame:
    return probes.join(matching(keys, probes, ["key"]), "key", "left").select("ord", "key", F.coalesce("type", F.lit("none")).alias("type"))


def exists(keys: DataFrame, probes: DataFrame) -> DataFrame:
    """Present probes, repeated ones counted again (also TOUCH)."""
    return probes.join(keys.select("key").distinct(), "key", "left_semi").agg(F.count("*").alias("n"))


def removed(keys: DataFrame, probes: DataFrame) -> DataFrame:
    """How many keys a delete of the probes removes (DEL, UNLINK)."""
    return keys.join(probes.select("key").distinct(), "key", "left_semi").agg(F.count("*").alias("n"))


def randomkey(keys: DataFrame) -> DataFrame:
    return keys.orderBy(F.xxhash64("key")).limit(1)


def ttls(kv: DataFrame, probes: DataFrame, now_ms: int) -> DataFrame:
    """ord, key, ttl, pttl, expiretime, pexpiretime."""
    found = probes.join(matching(kv, probes, ["key"]).select("key", "expire_at_ms", F.lit(True).alias("here")), "key", "left")
    here, at = F.coalesce("here", F.lit(False)), F.col("expire_at_ms")
    absolute = lambda c: F.when(~here, F.lit(-2)).when(at.isNull(), F.lit(-1)).otherwise(c).cast("bigint")
    return found.select("ord", "key", ttl(here, at, now_ms).alias("ttl"), ttl(here, at, now_ms, False).alias("pttl"), absolute(F.floor(at / 1000)).alias("expiretime"), absolute(at).alias("pexpiretime"))


def expire(kv: DataFrame, keys: DataFrame, at_ms: Column, now_ms: int, flag: str | None = None) -> DataFrame:
    """kv after EXPIREAT of the keys: a deadline that has passed deletes."""
    hit = kv.join(keys.select("key", F.lit(True).alias("_hit")), "key", "left").withColumn("_new", at_ms)
    gate = F.coalesce("_hit", F.lit(False)) & expire_gate(F.col("expire_at_ms"), F.col("_new"), flag)
    out = hit.withColumn("expire_at_ms", F.when(gate, F.col("_new")).otherwise(F.col("expire_at_ms")))
    return out.filter(~gate | (F.col("_new") > now_ms)).drop("_hit", "_new")


def persist(kv: DataFrame, keys: DataFrame) -> DataFrame:
    hit = kv.join(keys.select("key", F.lit(True).alias("_hit")), "key", "left")
    return hit.withColumn("expire_at_ms", F.when(F.col("_hit"), F.lit(None)).otherwise(F.col("expire_at_ms"))).drop("_hit")


def copy(kv: DataFrame, src: str, dst: str, replace: bool = False) -> DataFrame:
    new = kv.filter(F.col("key") == src).withColumn("key", F.lit(dst))
    return upsert(kv, new, ["key"]) if replace else insert_absent(kv, new, ["key"])


def rename(kv: DataFrame, src: str, dst: str, only_absent: bool = False) -> DataFrame:
    """Moves a key. With only_absent nothing happens where dst exists."""
    new = kv.filter(F.col("key") == src).withColumn("key", F.lit(dst))
    if only_absent:
        new = new.join(kv.select("key"), "key", "left_anti")
    return upsert(delete(kv, new.select(F.lit(src).alias("key")), ["key"]), new, ["key"])


def sort(members: DataFrame, alpha: bool = False, desc: bool = False, offset: int = 0, count: int | None = None) -> DataFrame:
    """key, member in order with `rn` (from 0): numbers by value and then bytes, or bytes alone; DESC turns all round."""
    from pyspark.sql import Window

    order = [F.col("member")] if alpha else [F.col("member").try_cast("double"), F.col("member")]
    w = Window.partitionBy("key").orderBy(*[c.desc() if desc else c.asc() for c in order])
    out = members.withColumn("rn", F.row_number().over(w) - 1).filter(F.col("rn") >= offset)
    return out if count is None else out.filter(F.col("rn") < offset + count)


def dump(kv: DataFrame) -> DataFrame:
    """key, payload: the row as JSON with a checksum in front (RESTORE reads it)."""
    body = F.to_json(F.struct("value", "expire_at_ms"))
    return kv.select("key", F.concat(F.lpad(F.hex(F.crc32(body.cast("binary"))), 8, "0"), body).alias("payload"))


def restore(dumped: DataFrame) -> DataFrame:
    body = F.substring("payload", 9, 1 << 30)
    right = F.lpad(F.hex(F.crc32(body.cast("binary"))), 8, "0") == F.substring("payload", 1, 8)
    return dumped.filter(right).select("key", F.from_json(body, "value string, expire_at_ms bigint").alias("r")).select("key", "r.*")
