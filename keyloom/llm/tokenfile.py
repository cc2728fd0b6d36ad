"""Token-ID files: ids of whole texts in Simple-8b words, with blocks that can be decoded alone.

A token file is a folder of Parquet parts. A row is a segment of one shard: `shard`, `first` (ids of the shard
before it), `n_ids`, `doc_ids` and `lengths` of its documents in ascending doc_id order, `words` (Simple-8b,
little-endian) and `blocks` (pairs of first word and first id). Shards ascend in doc_id, too.

Edge cases: a null or empty text has the end id alone. Null doc_ids come first. Equal doc_ids stand side by
side, ordered by their ids. Other columns are ignored. An empty table makes an empty file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simple8b
from .common import partitions, slices, stage_table
from .tokens import encoder, with_end

_IDS = "pid int, doc_id bigint, n bigint, ids binary"
_SEGMENT = "shard int, first bigint, n_ids bigint, doc_ids array<bigint>, lengths array<bigint>, words binary, blocks array<bigint>"
_DECODED = 1 << 16  # ids
_READ = "shard int, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def binary_column(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """One binary value for each end, out of data's bytes."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def token_ids(docs: DataFrame, path: str, end_id: int, bounds: list[int]) -> DataFrame:
    """pid (bounds at or below the doc_id), doc_id, n, ids (little-endian, of 16 bits if they all fit, or else of 32)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array(bounds, np.int64)
        for batch in slices(batches, "text"):
            flat, n = with_end(*encoder(path).encode(batch.column("text").to_pylist()), end_id)
            ids = batch.column("doc_id")
            pid = np.searchsorted(edges, ids.fill_null(0).to_numpy(zero_copy_only=False), side="right")
            pid[ids.is_null().to_numpy(zero_copy_only=False)] = 0
            flat = flat.astype("<u2") if flat.max() < 1 << 16 else flat.astype("<u4")
            yield pa.record_batch([pa.array(pid, pa.int32()), ids, pa.array(n), binary_column(flat, np.cumsum(n) * flat.itemsize)], names=["pid", "doc_id", "n", "ids"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _IDS)


def _segments(most_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, shard, held, docs, lengths = 0, None, [], [], []

        def segment() -> pa.RecordBatch:
            values = np.concatenate(held)
            words, blocks = simple8b.encode(values)
            row = {"shard": [shard], "first": [first], "n_ids": [len(values)], "doc_ids": [docs], "lengths": [lengths], "words": [words.astype("<u8").tobytes()], "blocks": [blocks.ravel().tolist()]}
            return pa.record_batch([pa.array(row[f.name], f.type) for f in schema], schema=schema)

        count = 0
        for batch in batches:
            for pid, doc, n, ids in zip(*(batch.column(c).to_pylist() for c in ("pid", "doc_id", "n", "ids")), strict=True):
                if held and (pid != shard or count >= most_ids):
                    yield segment()
                    first = first + count if pid == shard else 0
                    held, docs, lengths, count = [], [], [], 0
                shard = pid
                held.append(np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4"))
                docs.append(doc)
                lengths.append(len(held[-1]))
                count += lengths[-1]
        if held:
            yield segment()

    schema = pa.schema([("shard", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("words", pa.binary()), ("blocks", pa.list_(pa.int64()))])
    return run


def write_tokens(docs: DataFrame, path: str, end_id: int, most_ids: int = 1 << 19) -> DataFrame:
    """Encodes docs (doc_id, text) with the tokenizer file at path and returns the written token file.

    The texts are read once and never shuffled: their ids go to shards by doc_id, whose bounds are quantiles
    of the doc_id column, one shard for each shuffle partition.
    """
    n = partitions(docs.sparkSession)
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"))
    bounds = ids.approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (4 * n)) if n > 1 else []
    tokens = token_ids(docs, path, end_id, sorted({int(b) for b in bounds}))
    sorted_ids = tokens.repartitionById(n, F.col("pid")).sortWithinPartitions("pid", F.col("doc_id").asc_nulls_first(), "n", "ids")
    return stage_table(sorted_ids.mapInArrow(_segments(most_ids), _SEGMENT), "tokens")


def read_tokens(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from a token file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, blocks = np.frombuffer(row["words"], "<u8"), np.array(row["blocks"], np.int64).reshape(-1, 2)
                lengths = np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                # Runs of documents of some blocks each: only these are decoded at a time.
                crcs, at = [], 0
                while at < len(lengths):
                    first = int(ends[at] - lengths[at])
                    stop = max(at + 1, int(np.searchsorted(ends, first + _DECODED, side="right")))
                    ids = simple8b.decode_from(words, blocks, row["n_ids"], first, int(ends[stop - 1]) - first).astype("<u4")
                    crcs += [zlib.crc32(ids[a - first : b - first]) for a, b in zip((ends - lengths)[at:stop].tolist(), ends[at:stop].tolist(), strict=True)]
                    at = stop
                yield pa.record_batch(
                    [pa.array([row["shard"]] * len(ends), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["first"] + ends - lengths + base[row["shard"]]), pa.array(lengths), pa.array(crcs, pa.int64())],
                    names=["shard", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    # One total for each shard: as many rows as shuffle partitions.
    totals = sorted((r.shard, r.n) for r in segments.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    base, before = {}, 0
    for shard, n in totals:
        base[shard], before = before, before + n
    return segments.mapInArrow(run, _READ).select("doc_id", "start", "n_tokens", "ids_crc32", "shard")
