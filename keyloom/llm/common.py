"""Helpers shared by the operators: tables, the shared work folder, rows carried through, Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import threading
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Of each thread: the folders of the tables it staged and has not dropped.
_STAGED = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset a local session, whose
    executors are the driver, gets one of its own; a cluster gets an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    base = base or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: staged tables need a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="keyloom-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def stage_table(df: DataFrame, name: str, codec: str = "zstd", limit: int = 0, group_bytes: int = 0, page_bytes: int = 0, level: int = 0) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back, which cuts its lineage: a lost
    executor costs no recomputation of what stands above. limit: most rows in a file (0: any). group_bytes: size of
    a row group, which a reading task holds at most in one batch of columns (0: the default). page_bytes: what is compressed at once;
    level: of zstd (0: the defaults).

    The table stays until drop() or sweep(): a result that is not consumed yet may read it."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/keyloom-{uuid.uuid4().hex}"
    writer = df.write.option("compression", codec)
    if limit:
        writer = writer.option("maxRecordsPerFile", limit)
    if group_bytes:
        writer = writer.option("parquet.block.size", group_bytes)
    if page_bytes:
        writer = writer.option("parquet.page.size", page_bytes)
    if level:
        writer = writer.option("parquet.compression.codec.zstd.level", level)
    writer.parquet(f"{folder}/{name}")
    out = spark.read.schema(df.schema).parquet(f"{folder}/{name}")
    out.staged_in = folder
    _folders().append(folder)
    return out


def _folders() -> list[str]:
    if not hasattr(_STAGED, "folders"):
        _STAGED.folders = []
    return _STAGED.folders


def drop(*tables: DataFrame) -> None:
    """Deletes tables that stage_table() returned and nothing reads any more."""
    for df in tables:
        if folder := getattr(df, "staged_in", None):
            _delete(df.sparkSession, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if folder in _folders():
        _folders().remove(folder)


def staged() -> int:
    """A mark for sweep()."""
    return len(_folders())


def sweep(spark: SparkSession, mark: int = 0, *keep: DataFrame) -> None:
    """Deletes what this thread staged since the mark, but for the tables to keep. To be called once the results that
    read those tables are written or collected."""
    kept = {df.staged_in for df in keep}
    for folder in [f for f in _folders()[mark:] if f not in kept]:
        _delete(spark, folder)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def carried(df: DataFrame, **extra: Column) -> DataFrame:
    """One struct column `row` with all of df's columns, beside columns of our own: nothing can clash."""
    return df.select(F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("row"), *[c.alias(n) for n, c in extra.items()])


def released(df: DataFrame, columns: Sequence[str], **new: Column) -> DataFrame:
    """Undoes carried(): the old columns, then the new ones. A new column replaces an old one of its name."""
    taken = {n.lower() for n in new}
    return df.select(*[F.col("row")[c].alias(c) for c in columns if c.lower() not in taken], *[c.alias(n) for n, c in new.items()])


def placed(df: DataFrame) -> list[Column]:
    """Columns that sort df's rows as they are written, or else as its partitions hold them. Spark reads the longest
    files first, so the partitions of a table just read are not in its order."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.nodeName() == "LogicalRelation" and "_metadata" not in df.columns:
        file = F.col("_metadata.file_path")
        return [F.length(file), file, F.col("_metadata.row_index")]
    return [F.lit(0), F.lit(""), F.monotonically_increasing_id()]


def give_back() -> None:
    """Returns a Python worker's free memory to the system: workers idle between tasks beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the texts of a slice hold about most_bytes (a longer text stands alone)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size)
        if start < batch.num_rows:
            yield batch.slice(start)


def runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """The groups of rows with equal keys out of batches sorted by them, a table for each."""
    rest: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in keys]
        start = 0
        for i, key in enumerate(zip(*columns, strict=True)):
            if key != last:
                if i > start:
                    rest.append(batch.slice(start, i - start))
                if rest:
                    yield pa.Table.from_batches(rest)
                rest, start, last = [], i, key
        if start < batch.num_rows:
            rest.append(batch.slice(start))
    if rest:
        yield pa.Table.from_batches(rest)
