"""Histogram sort: shards of near equal bytes, ordered by a key, with one exchange.

The sort key is (hash of the group, tie), so rows of one group stand together. Splitters are found by rounds:
probe keys cut the key space, every partition counts exact bytes below them, and only the intervals around a
splitter that is not yet within the tolerance get new probes. Probes lie between groups; only a group larger
than the tolerance is cut inside, by its tie. Splitters also cut each shard into ranges small enough for one
sorting task each, so the exchange is even whatever the groups' sizes. The driver holds at most 16384 ranges and 65536
probes a round; beyond 1.6e10 rows the ranges grow, and their tasks spill.

Edge cases: a null group is a group of its own; a null tie comes first in its group. Rows equal in group and
tie stay together. Other columns pass through. An empty table gives no rows. Shards may be empty where rows
are fewer than shards.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, released, stage_table

_HALF = 1 << 63
_LOW = -(1 << 63)
MOST_RANGES, MOST_PROBES = 1 << 14, 1 << 16


def _find(k1: np.ndarray, k2: np.ndarray, keys: list[tuple[int, int]]) -> np.ndarray:
    """How many of the sorted keys are at or below (k1, k2)."""
    first = np.array([k[0] for k in keys], np.int64)
    at = np.searchsorted(first, k1, side="right")
    for i in np.flatnonzero(np.searchsorted(first, k1, side="left") < at).tolist():
        at[i] = bisect_right(keys, (int(k1[i]), int(k2[i])))
    return at


def _histogram(rows: DataFrame, keys: list[tuple[int, int]]) -> dict[int, tuple[int, int, tuple[int, int], tuple[int, int]]]:
    """For each non-empty bin between the keys: bytes, rows, least and greatest key. A row for each bin comes
    to the driver; there are at most 65536 probes, and three keys for each splitter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, size = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2", "size"))
            if not len(k1):
                continue
            bins = _find(k1, k2, keys)
            order = np.lexsort((k2, k1, bins))
            b = bins[order]
            start = np.flatnonzero(np.diff(b, prepend=-1))
            end = np.append(start[1:], len(b)) - 1
            total = np.add.reduceat(size[order], start)
            yield pa.record_batch([pa.array(x) for x in (b[start], total, end - start + 1, k1[order][start], k2[order][start], k1[order][end], k2[order][end])], names=["bin", "bytes", "n", "a1", "a2", "z1", "z2"])

    found = rows.select("k1", "k2", "size").mapInArrow(run, "bin bigint, bytes bigint, n bigint, a1 bigint, a2 bigint, z1 bigint, z2 bigint")
    least, most = F.min(F.struct("a1", "a2")).alias("a"), F.max(F.struct("z1", "z2")).alias("z")
    return {r.bin: (r.bytes, r.n, tuple(r.a), tuple(r.z)) for r in found.groupBy("bin").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), least, most).collect()}


def _between(lo: tuple[int, int], hi: tuple[int, int], n: int) -> list[tuple[int, int]]:
    """Up to n keys in (lo, hi]: between groups, or inside the one group that both lie in."""
    if hi[0] > lo[0]:
        span = hi[0] - lo[0]
        return sorted({(lo[0] + max(1, span * i // n), _LOW) for i in range(1, n + 1)})
    span = hi[1] - lo[1]
    return sorted({(lo[0], lo[1] + max(1, span * i // n)) for i in range(1, n + 1)}) if span else []


def _after(key: tuple[int, int], group: bool) -> tuple[int, int]:
    """The next key, or the first key of the next group."""
    return (min(key[0] + 1, _HALF - 1), _LOW) if group else (key[0], min(key[1] + 1, _HALF - 1))


def splitters(rows: DataFrame, targets: list[int], tolerance: float, probes: int = 32) -> list[tuple[int, int]]:
    """Keys whose bytes below are within tolerance of targets, or as near as single keys allow."""
    whole = _histogram(rows, []).get(0)
    if whole is None:
        return [(_LOW, _LOW)] * len(targets)
    total, _, least, most = whole
    probes = max(3, min(probes, MOST_PROBES // max(1, len(targets))))
    # For each target: bounds of the splitter and the exact bytes below them.
    state = [(((least[0], _LOW), 0), (_after(most, True), total)) for _ in targets]
    done: list[tuple[int, int] | None] = [None] * len(targets)
    while None in done:
        open_ = [s for s, d in zip(state, done, strict=True) if d is None]
        keys = sorted({k for (lo, _), (hi, _) in open_ for k in (lo, hi, *_between(lo, hi, probes))})
        counts = _histogram(rows, keys)
        below, at = [], 0  # bytes below keys[j]
        for j in range(len(keys)):
            at += counts.get(j, (0,))[0]
            below.append(at)
        for i, target in enumerate(targets):
            if done[i] is not None:
                continue
            j = min(max(bisect_right(below, target), 1), len(keys) - 1)
            lo, hi = keys[j - 1], keys[j]
            over, under = below[j] - target, target - below[j - 1]
            near = (lo, under) if under <= over else (hi, over)
            inside = counts.get(j)
            if near[1] <= tolerance or inside is None or inside[2] == inside[3]:
                done[i] = near[0]
                continue
            # The bounds move to the least and greatest real key between them: inside one group, or around groups.
            first, last = inside[2], inside[3]
            one = first[0] == last[0]
            state[i] = ((first if one else (first[0], _LOW), below[j - 1]), (_after(last, not one), below[j]))
    return [k for k in done if k is not None]


def histogram_shards(df: DataFrame, shards: int, size: Column, group: Column, tie: Column, tolerance: float = 0.01, task_rows: int = 1_000_000) -> DataFrame:
    """df with `shard` and `slot` (gapless from 0, in key order). tolerance: share of a shard's bytes by which a
    splitter may miss. task_rows: rows of a sorting task, about."""
    rows = stage_table(carried(df, k1=F.xxhash64(group), k2=F.coalesce(tie.cast("bigint"), F.lit(_LOW)), size=size.cast("bigint")), "keys")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = shards * max(4, min(MOST_RANGES // shards, -(-n // (shards * task_rows))))
    targets = [total * i // ranges for i in range(1, ranges)]
    keys = splitters(rows, targets, tolerance * total / shards)
    for i in range(1, len(keys)):
        keys[i] = max(keys[i], keys[i - 1])
    per_shard = ranges // shards
    counts = {b: c[1] for b, c in _histogram(rows, keys).items()}
    offsets, at = [], 0
    for r in range(ranges):
        at = 0 if r % per_shard == 0 else at
        offsets.append(at)
        at += counts.get(r, 0)
    kind = rows.schema["row"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = _find(batch.column("k1").to_numpy(), batch.column("k2").to_numpy(), keys)
            yield pa.record_batch([*batch.columns, pa.array(bins, pa.int32())], names=[*batch.schema.names, "range"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = -1, 0
        for batch in batches:
            ranges_ = batch.column("range").to_numpy()
            slots = np.zeros(len(ranges_), np.int64)
            for r in np.unique(ranges_).tolist():
                mine = ranges_ == r
                at = at if r == last else offsets[r]
                slots[mine] = at + np.arange(int(mine.sum()))
                last, at = r, at + int(mine.sum())
            yield pa.record_batch([batch.column("row"), pa.array(ranges_ // per_shard, pa.int32()), pa.array(slots)], names=["row", "shard", "slot"])

    placed = rows.mapInArrow(place, f"row {kind}, k1 bigint, k2 bigint, size bigint, range int")
    out = placed.repartitionById(ranges, F.col("range")).sortWithinPartitions("range", "k1", "k2").mapInArrow(number, f"row {kind}, shard int, slot bigint")
    return released(out, df.columns, shard=F.col("shard"), slot=F.col("slot"))
