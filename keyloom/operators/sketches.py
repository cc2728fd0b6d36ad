"""Sketches that are exact here: distinct counts, filters, counters, top-k and quantiles as plain aggregates, which
combine on the map side. Spark's own sketches are offered beside them for when an estimate is enough."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .state import split_ranks


# HyperLogLog (exact)
def pfcount(members: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """n distinct members of the union of keys, or for each key."""
    if keys is None:
        return members.groupBy("key").agg(F.count_distinct("member").alias("n"))
    return members.filter(F.col("key").isin(keys)).agg(F.count_distinct("member").alias("n"))


def pfcount_estimate(members: DataFrame, error: float = 0.02) -> DataFrame:
    return members.groupBy("key").agg(F.approx_count_distinct("member", error).alias("n"))


def pfmerge(members: DataFrame, dst: str, keys: list[str]) -> DataFrame:
    """dst holds the union of the keys and nothing else."""
    union = members.filter(F.col("key").isin(keys)).select(F.lit(dst).alias("key"), "member").distinct()
    return members.filter(F.col("key") != dst).unionByName(union)


# Bloom and cuckoo filters (exact)
def first_seen(items: DataFrame) -> DataFrame:
    """key, item, seq, added: 1 where the item is new to its key (BF.ADD, CF.ADDNX)."""
    w = Window.partitionBy("key", "item").orderBy("seq")
    return items.withColumn("added", (F.row_number().over(w) == 1).cast("int"))


def contains(items: DataFrame, probes: DataFrame) -> DataFrame:
    found = probes.join(items.select("key", "item", F.lit(1).alias("f")).distinct(), ["key", "item"], "left")
    return found.select("key", "item", F.coalesce("f", F.lit(0)).alias("found"))


def card(items: DataFrame) -> DataFrame:
    return items.groupBy("key").agg(F.count_distinct("item").alias("n"))


def cuckoo_counts(log: DataFrame) -> DataFrame:
    """key, item, cnt after ordered adds (+1) and deletes (-1): a delete below zero does nothing. A sum that is held at
    zero is the plain sum less its lowest point below zero, so a running sum and two aggregates do."""
    w = Window.partitionBy("key", "item").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    sums = log.select("key", "item", "sign", F.sum("sign").over(w).alias("s"))
    out = sums.groupBy("key", "item").agg((F.sum("sign") - F.least(F.min("s"), F.lit(0))).cast("int").alias("cnt"))
    return out.filter(F.col("cnt") > 0)


# Count-min (exact)
def counts(items: DataFrame, weight=None) -> DataFrame:
    return items.groupBy("key", "item").agg((F.count("*") if weight is None else F.sum(weight)).alias("cnt"))


def cms_query(items: DataFrame, probes: DataFrame) -> DataFrame:
    found = probes.join(counts(items), ["key", "item"], "left")
    return found.select("key", "item", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def cms_merge(items: DataFrame, keys: list[str]) -> DataFrame:
    return items.filter(F.col("key").isin(keys)).groupBy("item").agg(F.count("*").alias("cnt"))


def cms_info(items: DataFrame) -> DataFrame:
    return items.groupBy("key").agg(F.greatest(F.count_distinct("item"), F.lit(1)).alias("width"), F.lit(1).alias("depth"), F.count_distinct("item").alias("count"))


# Top-k (exact)
def topk_list(items: DataFrame, k: int) -> DataFrame:
    """key, item, cnt, rank: by count, then first seen, then item."""
    sums = items.groupBy("key", "item").agg(F.count("*").alias("cnt"), F.min("seq").alias("first"))
    w = Window.partitionBy("key").orderBy(F.desc("cnt"), "first", "item")
    return sums.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("key", "item", "cnt", "rank")


def topk_expelled(items: DataFrame, k: int) -> DataFrame:
    """key, item, seq, expelled: what each add pushes out of its key's list, if anything. A fold over sorted rows: a
    task holds the counts of one key at a time, never its rows. Each add looks at the k + 1 candidates, so k is to be
    some hundreds at most."""

    def run(batches):
        import pyarrow as pa

        key, counts, top = None, {}, []
        for batch in batches:
            out = []
            for row_key, item, seq in zip(*(batch.column(c).to_pylist() for c in ("key", "item", "seq")), strict=True):
                if row_key != key or not counts:
                    key, counts, top = row_key, {}, []
                n, first = counts.get(item, (0, seq))
                counts[item] = (n + 1, first)
                order = lambda x: (-counts[x][0], counts[x][1], x)
                gone = None
                if item not in top:
                    top.append(item)
                    if len(top) > k:
                        worst = max(top, key=order)
                        top.remove(worst)
                        gone = None if worst == item else worst
                out.append(gone)
            yield pa.record_batch([batch.column("key"), batch.column("item"), batch.column("seq"), pa.array(out, pa.string())], names=["key", "item", "seq", "expelled"])

    rows = items.select(F.col("key").cast("string").alias("key"), F.col("item").cast("string").alias("item"), F.col("seq").cast("bigint").alias("seq"))
    return rows.repartition("key").sortWithinPartitions("key", "seq").mapInArrow(run, "key string, item string, seq bigint, expelled string")


def topk_query(items: DataFrame, k: int, probes: DataFrame) -> DataFrame:
    top = topk_list(items, k).select("key", "item", F.lit(1).alias("f"))
    return probes.join(top, ["key", "item"], "left").select("key", "item", F.coalesce("f", F.lit(0)).alias("found"))


# t-digest (exact). Ranks are of distinct values with counts, so repeated values cost nothing, and a key with most of the
# samples takes many tasks.
def _ranked(samples: DataFrame) -> DataFrame:
    sums = samples.filter("value IS NOT NULL").groupBy("key", "value").agg(F.count("*").alias("c"))
    ranked = split_ranks(sums, ["key"], [F.col("value")], "c")
    return ranked.select("key", "value", "c", "lo", (F.col("lo") + F.col("c")).alias("hi"), F.col("total").alias("n"))


def tdigest_add(samples: DataFrame, delta: DataFrame) -> DataFrame:
    """key, value with more samples (TDIGEST.ADD); values that are no numbers don't count."""
    return samples.select("key", "value").unionByName(delta.select("key", F.col("value").try_cast("double").alias("value"))).filter("value IS NOT NULL")


def tdigest_merge(samples: DataFrame, dst: str, keys: list[str], override: bool = False) -> DataFrame:
    """key, value with the samples of keys added to dst's, or in their place."""
    merged = samples.filter(F.col("key").isin(keys)).select(F.lit(dst).alias("key"), "value")
    kept = samples.select("key", "value")
    return (kept.filter(F.col("key") != dst) if override else kept).unionByName(merged)


def quantiles(samples: DataFrame, qs: list[float]) -> DataFrame:
    """key, q, value: the sorted value at round((n - 1) q)."""
    rows = _ranked(samples).withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs])))
    at = F.round((F.col("n") - 1) * F.least(F.greatest(F.col("q"), F.lit(0.0)), F.lit(1.0))).cast("bigint")
    return rows.filter((F.col("lo") <= at) & (at < F.col("hi"))).select("key", "q", "value")


def by_rank(samples: DataFrame, rank: int, rev: bool = False) -> DataFrame:
    at = F.col("n") - 1 - rank if rev else F.lit(rank)
    return _ranked(samples).filter((F.col("lo") <= at) & (at < F.col("hi"))).select("key", "value")


def ranks(samples: DataFrame, value: float) -> DataFrame:
    """key, cdf, rank (below), revrank (above) of a value."""
    v = F.col("value")
    return samples.filter(v.isNotNull()).groupBy("key").agg(F.avg((v <= value).cast("double")).alias("cdf"), F.count(F.when(v < value, 1)).alias("rank"), F.count(F.when(v > value, 1)).alias("revrank"))


def trimmed_mean(samples: DataFrame, low: float, high: float) -> DataFrame:
    """The mean of sorted values floor((n - 1) low) to ceil((n - 1) high)."""
    rows = _ranked(samples)
    first, last = F.floor((F.col("n") - 1) * low), F.ceil((F.col("n") - 1) * high)
    used = F.greatest(F.least("hi", last + 1) - F.greatest("lo", first), F.lit(0))
    return rows.withColumn("u", used).groupBy("key").agg((F.sum(F.col("value") * F.col("u")) / F.sum("u")).alias("mean"))


def extremes(samples: DataFrame) -> DataFrame:
    return samples.groupBy("key").agg(F.min("value").alias("least"), F.max("value").alias("most"), F.count("value").alias("nodes"))
