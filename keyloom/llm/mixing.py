"""Pfair mixing of sources to target weights.

Each source's documents, in the order of a hash, form a stream of bytes cut into blocks. In the fluid mix every source
flows at its exact weight, and when one ends the others share its weight in proportion. A block is released at the
slot in which the fluid mix begins it and due by the slot after the one in which that ends it; each slot goes to the
released block that is due first. The fluid mix fills every slot and serves each block inside its window, so windows
can all be met, and earliest deadline first meets them: a source is always less than one block from its exact share,
however long the input. The driver runs through the blocks once; rows find theirs by a join. Blocks have block_bytes,
or beyond 4 million of them (256 GB) a four-millionth of the input: the driver's schedule stays bounded, and the
deviation stays below one block, then 2.4e-7 of the corpus.

Edge cases: null sources form one source, apart from that with the empty name. Null or empty texts count one byte, as the
end of any text. Repeated rows each get a place. Every source is a class of its own; the driver holds a row for each.
Sources that weights don't name, or name with 0, come after those with a weight. Other columns pass through, but those
that mix() adds replace the caller's of the same name. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Callable, Mapping
from fractions import Fraction
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import carried, partitions, released, stage_table

_NULL = "\x00null"
#: Blocks that the driver schedules at most (five numbers each), and cells of a source that one task sums up.
MOST_BLOCKS, MOST_CELL_BITS = 1 << 22, 20


def fluid_windows(blocks: list[int], weights: list[float]) -> Callable[[int, int], tuple[int, int]]:
    """Where in the fluid mix block i of source s begins, in slots, as floor and ceiling; all in whole numbers.

    At virtual time v source s has had min(v * weight, blocks), so i blocks at i / weight, when the sources that end
    before have had all of theirs and the others v times their weights."""
    exact = [Fraction(w) for w in weights]
    scale = max((w.denominator for w in exact), default=1)  # of floats: powers of two
    share = [w.numerator * (scale // w.denominator) for w in exact]
    order = sorted(range(len(blocks)), key=lambda s: Fraction(blocks[s], share[s]))
    ends = [blocks[s] / share[s] for s in order]
    had, live = [0], [sum(share)]
    for s in order:
        had.append(had[-1] + blocks[s])
        live.append(live[-1] - share[s])

    def at(s: int, i: int) -> tuple[int, int]:
        p = bisect(ends, i / share[s])
        while p < len(order) and blocks[order[p]] * share[s] <= i * share[order[p]]:
            p += 1
        while p and blocks[order[p - 1]] * share[s] > i * share[order[p - 1]]:
            p -= 1
        whole, rest = divmod(i * live[p], share[s])
        return had[p] + whole, had[p] + whole + (rest > 0)

    return at


def edf(blocks: list[int], weights: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each slot: its source, that source's block number, the block's release and its deadline."""
    at, n = fluid_windows(blocks, weights), sum(blocks)
    out = tuple(np.zeros(n, np.int64) for _ in range(4))
    waiting = [(0, s, 0, at(s, 1)) for s, b in enumerate(blocks) if b]  # release, source, block, and where the next begins
    ready: list[tuple] = []
    heapify(waiting)
    for t in range(n):
        while waiting and waiting[0][0] <= t:
            release, s, i, (following, deadline) = heappop(waiting)
            heappush(ready, (deadline, s, i, release, following))
        deadline, s, i, release, following = heappop(ready)
        for column, x in zip(out, (s, i, release, deadline), strict=True):
            column[t] = x
        if i + 1 < blocks[s]:
            heappush(waiting, (following, s, i + 1, at(s, i + 2)))
    return out


def text_size() -> Column:
    return F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("bigint") + 1


def text_spin() -> Column:
    return F.xxhash64(F.col("doc_id").cast("string"), F.col("text").cast("string"))


def schedule(docs: DataFrame, weights: Mapping[str | None, float] | None = None, temperature: float = 0.5, block_bytes: int = 65_536, size: Column | None = None, spin: Column | None = None) -> tuple[DataFrame, int]:
    """carried() docs with mix_class, size, block, release, deadline, slot and start, and the number of slots.

    weights: of sources by name (None: of null sources; others have none: they come after); without them, bytes to the
    power of temperature. size and spin: bytes and place of a row, by default those of its text (text_size, text_spin).
    """
    spark = docs.sparkSession
    source = F.coalesce(F.col("source").cast("string"), F.lit(_NULL))
    rows = carried(docs, mix_class=source, size=text_size() if size is None else size, spin=text_spin() if spin is None else spin)
    # One row a source comes to the driver.
    found = {r.mix_class: (r.bytes, r.n) for r in rows.groupBy("mix_class").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}
    totals, n = {c: b for c, (b, _) in found.items()}, sum(k for _, k in found.values())
    block_bytes = max(block_bytes, -(-sum(totals.values()) // MOST_BLOCKS))
    # Cells of a source in hash order, of some thousand rows each: prefix sums without one task a source.
    bits = max(1, min(MOST_CELL_BITS, int(n // 4096).bit_length()))
    cell = F.shiftrightunsigned(F.col("spin"), 64 - bits)
    rows = rows.select("row", "size", "spin", "mix_class", cell.alias("cell"))
    cells = stage_table(rows.groupBy("mix_class", "cell").agg(F.sum("size").alias("bytes")), "cells")
    before = Window.partitionBy("mix_class").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    ends = cells.select("mix_class", "cell", "bytes", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("offset"))
    order = sorted(totals)
    if weights:  # sources without a weight come after those with one: a weight too small for a slot of their own
        named = {_NULL if c is None else c: w for c, w in weights.items()}
        share = [named.get(c, 0.0) for c in order]
        share = [w or min([x for x in share if x] or [1.0]) * 1e-9 for w in share]
    else:
        share = [float(totals[c]) ** temperature for c in order]
    blocks = [-(-totals[c] // block_bytes) for c in order]
    owner, block, release, deadline = edf(blocks, share)
    slots = len(owner)
    columns = [pa.array(order, pa.string()).take(pa.array(owner)), pa.array(block), pa.array(np.arange(slots)), pa.array(release), pa.array(deadline)]
    table = stage_table(spark.createDataFrame(pa.table(columns, names=["mix_class", "block", "slot", "release", "deadline"])), "slots")
    # Each cell gets the slots of the blocks it has bytes in, so rows need no further exchange.
    first, last = (F.floor(x / F.lit(block_bytes)).cast("bigint") for x in (F.col("offset"), F.col("offset") + F.col("bytes") - 1))
    plan = F.sort_array(F.collect_list(F.struct("block", "slot", "release", "deadline")))
    ends = ends.withColumn("block", F.explode(F.sequence(first, last))).join(table, ["mix_class", "block"]).groupBy("mix_class", "cell", "offset").agg(plan.alias("plan"))
    inside = Window.partitionBy("mix_class", "cell").orderBy("spin", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("size").over(inside), F.lit(0))
    placed = rows.withColumn("inside", start).join(ends, ["mix_class", "cell"])
    placed = placed.withColumn("start", F.col("offset") + F.col("inside"))
    b = F.floor(F.col("start") / F.lit(block_bytes)).cast("bigint")
    placed = placed.withColumn("at", F.element_at("plan", (b - F.col("plan")[0]["block"] + 1).cast("int")))
    name = F.when(F.col("mix_class") != _NULL, F.col("mix_class"))
    return placed.select("row", name.alias("mix_class"), "size", "at.block", "at.release", "at.deadline", "at.slot", "start"), slots


_NEW = ("mix_class", "size", "block", "release", "deadline", "slot", "start")


def mix(docs: DataFrame, **parameters) -> DataFrame:
    """docs with their place: ordered by slot, then start, they are the mixed corpus. Columns of _NEW replace docs' own."""
    rows, _ = schedule(docs, **parameters)
    return released(rows, docs.columns, **{c: F.col(c) for c in _NEW})


def mixed_documents(docs: DataFrame, **parameters) -> DataFrame:
    """docs in mixed order, over and within the partitions; columns as in docs. A slot is about a block of bytes,
    so even runs of slots are even partitions and need no sample."""
    rows, slots = schedule(docs, **parameters)
    n = partitions(docs.sparkSession)
    part = F.least(F.floor(F.col("slot") * n / F.lit(max(1, slots))), F.lit(n - 1)).cast("int")
    ordered = rows.withColumn("part", part).repartitionById(n, F.col("part")).sortWithinPartitions("slot", "start")
    return ordered.select(*[F.col("row")[c].alias(c) for c in docs.columns])
