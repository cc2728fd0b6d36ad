"""Sum-of-squares packing of token pieces into sequences of a fixed length.

An open sequence with room for g more tokens counts in N(g). A piece goes where the sum of N(g)^2 over all g
becomes smallest: into an open sequence, or, where none has room, into a new one. Pieces come by falling length,
so that late short pieces find the gaps that earlier ones left. Only pieces shorter than a sequence compete.
Pieces compete in runs of the rows' order (as written, or as in the partitions of a table that is not read from
files), and sequences are numbered by the first row they hold a piece of: the order of a mixed corpus stays.

Edge cases: a null or empty text is one piece with the end id alone. Each repeated row is packed for itself.
Null doc_ids stay null. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, placed, slices, stage_table
from .tokens import encoder, with_end

_PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_ORDER = ["name", "file", "at"]
_PLACED = f"{_PIECE}, sequence_id bigint, offset bigint"


def token_pieces(docs: DataFrame, path: str, end_id: int, size: int) -> DataFrame:
    """Every document's pieces, and its place: its first holds what is over after whole pieces of `size` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):  # looking pieces up takes some twenty bytes for each of text
            flat, n = with_end(*encoder(path, 450_000).encode(batch.column("text").to_pylist()), end_id)
            pieces = -(-n // size)
            owner = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            head = (n - (pieces - 1) * size)[owner]
            start = np.where(piece == 0, 0, head + (piece - 1) * size)
            length = np.where(piece == 0, head, size)
            at = (np.cumsum(n) - n)[owner] + start
            crcs = [zlib.crc32(flat[a:b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
            doc_id, *order = (batch.column(c).take(pa.array(owner)) for c in ("doc_id", *_ORDER))
            yield pa.record_batch([doc_id, pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crcs, pa.int64()), *order], names=["doc_id", "piece", "start", "length", "ids_crc32", *_ORDER])
        encoder(path, 450_000).forget()  # workers serve other stages, too
        give_back()

    order = [c.alias(n) for c, n in zip(placed(docs), _ORDER, strict=True)]
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *order).mapInArrow(run, f"{_PIECE}, name int, file string, at bigint")


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece."""
    n = len(lengths)
    sequence, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    open_by_gap: list[list[int]] = [[] for _ in range(size + 1)]
    count = np.zeros(size + 1, np.int64)
    opened = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        if length < size:
            # From gap g to g - length: the sum of squares changes by 2 (N(g - length) - N(g) + 1), or by
            # 1 - 2 N(g) where the sequence gets full.
            change = 2 * (count[: size - length] - count[length:size] + 1)
            change[0] = 1 - 2 * count[length]
            change[count[length:size] == 0] = np.iinfo(np.int64).max
            gap = length + int(change.argmin())
            if count[gap]:
                bin_ = open_by_gap[gap].pop()
                count[gap] -= 1
                sequence[i], offset[i], left = bin_, size - gap, gap - length
                if left:
                    open_by_gap[left].append(bin_)
                    count[left] += 1
                continue
            open_by_gap[size - length].append(opened)
            count[size - length] += 1
        sequence[i] = opened
        opened += 1
    return sequence, offset


def pack(docs: DataFrame, path: str, end_id: int, size: int = 1024, group: int = 65_536) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    Runs of about `group` pieces in the rows' order are packed by one task each, which holds their lengths alone;
    a run leaves a handful of sequences part-filled, a share that doesn't grow with the data.
    """
    pieces = stage_table(token_pieces(docs, path, end_id, size), "pieces")
    groups = max(1, -(-pieces.count() // group))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        got = list(batches)
        if not got:
            return
        table = pa.Table.from_batches(got)
        sequence, offset = sum_of_squares(table.column("length").to_numpy(), size)
        first = np.unique(sequence, return_index=True)[1]
        sequence = np.argsort(np.argsort(first))[sequence]
        base = TaskContext.get().partitionId() << 32
        table = table.append_column("sequence_id", pa.array(sequence + base)).append_column("offset", pa.array(offset))
        yield from table.to_batches(max_chunksize=10_000)

    runs = pieces.repartitionByRange(groups, *_ORDER, "piece").sortWithinPartitions(*_ORDER, "piece")
    return runs.select(*pieces.columns[: -len(_ORDER)]).mapInArrow(run, _PLACED)
