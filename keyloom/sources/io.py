"""Files: snapshots, change logs, pair files, and the text and columnar formats Spark reads."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T



def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or in a local session a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: files need a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="keyloom-")
    return f"{base.rstrip('/')}/keyloom-io-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """df written to a scratch folder and read back: a partition's number, say, that must not change if it is computed
    again. Plans that read such a table need no lineage above it."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def offload(entries: DataFrame, path: str, now_ms: int, idle_ms: int, min_bytes: int) -> DataFrame:
    """entries (key, value, touch) that stay; those idle for so long and as large go to Parquet at a path (any store that
    Spark writes to)."""
    cold = (F.lit(now_ms) - F.col("touch") >= idle_ms) & (F.octet_length("value") >= min_bytes)
    entries.filter(cold).write.mode("append").parquet(path)
    return entries.filter(~F.coalesce(cold, F.lit(False)))


def faulted(resident: DataFrame, path: str, probes: DataFrame) -> DataFrame:
    """ord, key, value, tier of probes (ord, key): resident entries first, else what was offloaded."""
    both = resident.select("key", "value", F.lit("resident").alias("tier")).unionByName(resident.sparkSession.read.schema(resident.schema).parquet(path).select("key", "value", F.lit("offloaded").alias("tier")))
    found = both.join(probes.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.max_by(F.struct("value", "tier"), "tier").alias("r"))
    return probes.join(found, "key", "left").select("ord", "key", "r.value", "r.tier")


WAL = T.StructType([T.StructField(n, t) for n, t in (("shard_id", T.IntegerType()), ("sequence", T.LongType()), ("timestamp_ms", T.LongType()), ("op", T.StringType()), ("key", T.StringType()), ("value", T.DoubleType()), ("expire_at_ms", T.LongType()))])


def write_snapshot(entries: DataFrame, path: str, snapshot_ms: int) -> None:
    entries.withColumn("snapshot_ms", F.lit(snapshot_ms)).write.mode("overwrite").parquet(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_wal(log: DataFrame, path: str) -> None:
    """Segments by shard: replay of one shard prunes the others."""
    log.write.mode("append").partitionBy("shard_id").parquet(path)


def read_wal(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(WAL).parquet(path)


def recover(spark: SparkSession, snapshot: str, wal: str) -> DataFrame:
    """key, value, expire_at_ms from the snapshot and the change log from its time on."""
    from ..operators.state import recovery_fold

    saved = read_snapshot(spark, snapshot)
    at = saved.agg(F.coalesce(F.max("snapshot_ms"), F.lit(0))).first()[0]
    base = saved.select(F.lit(-1).alias("shard_id"), F.lit(-1).cast("bigint").alias("sequence"), F.lit(at).cast("bigint").alias("timestamp_ms"), F.lit("Set").alias("op"), "key", "value", "expire_at_ms")
    return recovery_fold(base.unionByName(read_wal(spark, wal).select(*base.columns)), at)


def write_pairs(pairs: DataFrame, path: str) -> None:
    """A pair file of (dataset, pair_id, label, cache_embedding, query_embedding): arrays as parts split by spaces."""
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("double").cast("string")), " ").alias(c)
    pairs.select("dataset", "pair_id", "label", text("cache_embedding"), text("query_embedding")).write.csv(path, header=True)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """dataset, pair_id, label, cache_embedding, query_embedding (arrays; parts split by space, ';' or '|')."""
    rows = spark.read.schema("dataset string, pair_id string, label int, cache_embedding string, query_embedding string").csv(path, header=True)
    split = lambda c: F.transform(F.split(F.trim(F.col(c)), r"[ ;|]+"), lambda x: x.try_cast("double"))
    return rows.select("dataset", "pair_id", "label", split("cache_embedding").alias("cache_embedding"), split("query_embedding").alias("query_embedding"))


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """parquet, orc, csv, json or text; give a schema to spare a pass over the data."""
    reader = spark.read.options(**options)
    return (reader.schema(schema) if schema else reader).format(kind).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None, **options) -> None:
    writer = df.write.mode("overwrite").options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).format(kind).save(path)
