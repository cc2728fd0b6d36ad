"""Near-duplicate classes: circulant MinHash, banding, exact Jaccard verification, connected components.

1. Every text gives its set of word shingles, a digest of the set, a signature whose 192 coordinates come from two
   permutations, and 32 band keys of six coordinates. Sets are nodes; equal sets are one node. Nodes that share a
   band key are candidates; for those alone the texts are read again for the full set and the parities of its hashes.
2. In each bucket two hubs (the least and the greatest node) are paired with the others, so pairs grow with the
   bucket, not with its square. A pair is dropped if the parities prove that it can't reach the similarity; the
   nearest hub of each node is confirmed on the full sets.
3. In buckets that still hold several components, blocks of nodes compare parities across components. A component
   that fills blocks has blocks of its own, which never meet each other: beside one large component the work grows with
   the bucket, not with its square. What could link makes a forest, the nearest pairs first, whose edges are confirmed:
   again as many as nodes at most. After that only pairs that the parities leave open can link two components, and all
   of these are confirmed. No link between candidates is lost; a pair at 0.85 is no candidate with probability 3e-7, one
   at 0.8 with 6e-5.

Edge cases: a text without words, or null, has an empty set and stays alone. A text with fewer words than a
shingle is one shingle. Null doc_ids: their rows form classes with others but never name them, and a class of
null doc_ids alone has a null component; they are kept only there. Rows equal in doc_id and set are all kept or
all dropped (near_distinct() keeps one of them). Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingles as sh
from .common import carried, drop, give_back, runs, slices, stage_table
from .components import components

BANDS, ROWS = 32, 6
#: Nodes, and bytes of parities, that a block of a bucket holds (a single larger node stands alone).
BLOCK, BLOCK_BYTES = 1024, 16 << 20
#: A list of doc_ids up to this long is broadcast (8 bytes each); a longer one is joined with a shuffle.
BROADCAST_IDS = 2_000_000

_CIRCULANT: list[sh.Circulant] = []


def _circulant() -> sh.Circulant:
    if not _CIRCULANT:
        _CIRCULANT.append(sh.Circulant(BANDS * ROWS))
    return _CIRCULANT[0]


def _sets(batch: pa.RecordBatch, k: int) -> list[np.ndarray]:
    text = batch.column("text").cast(pa.large_binary())
    texts = [t or b"" for t in text.to_pylist()]
    edges = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return sh.shingle_sets(np.frombuffer(b"".join(texts), np.uint8), edges, k)


def _digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text_hash, node (null for empty sets), n, bands of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):  # hashing takes some fifty bytes for each of text
            sets = _sets(batch, k)
            full = [s for s in sets if len(s)]
            keys = iter(sh.band_keys(np.array([_circulant().signature(s) for s in full]), BANDS).tolist() if full else [])
            node = [_digest(s) if len(s) else None for s in sets]
            bands = [next(keys) if len(s) else None for s in sets]
            columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(node, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.record_batch(columns, names=["doc_id", "text_hash", "node", "n", "bands"])
        sh.forget()
        give_back()

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, text_hash bigint, node binary, n bigint, bands array<bigint>")


def _could(n: Column, m: Column, percent: int) -> Column:
    """Sets of n and m can reach percent by their sizes alone."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _may_link(n: int, m: int, differ: int, percent: int) -> bool:
    """differ or more of n + m are outside the intersection: 100 |A & B| >= percent |A | B| is still possible."""
    return 100 * (n + m - differ) >= percent * (n + m + differ)


def _near_hubs(rows: DataFrame, percent: int) -> DataFrame:
    """Of rows (node, n, parity, hub, hub_n, hub_parity): those that could link, with a lower bound on differences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, differ = [], [], []
            for r in zip(*(batch.column(c).to_pylist() for c in ("node", "hub", "n", "hub_n", "parity", "hub_parity")), strict=True):
                d = sh.differ_least(r[4], r[5])
                if _may_link(r[2], r[3], d, percent):
                    a.append(r[0])
                    b.append(r[1])
                    differ.append(d)
            yield pa.record_batch([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(differ, pa.int64())], names=["node", "hub", "differ"])

    return rows.mapInArrow(run, "node binary, hub binary, differ bigint")


def _across(percent: int, forest: bool):
    """Pairs of different components within blocks of a bucket that could link: a forest of the nearest over the
    components, or all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["key", "lo", "hi"]):
            if len(group) < 2:
                continue
            rows = sorted(zip(*(group.column(c).to_pylist() for c in ("n", "node", "component", "block", "parity")), strict=True))
            one = group.column("lo")[0].as_py() == group.column("hi")[0].as_py()
            sizes, block = np.array([r[0] for r in rows]), np.array([r[3] for r in rows])
            names = {c: i for i, c in enumerate(sorted({r[2] for r in rows}))}
            part = np.array([names[r[2]] for r in rows])
            maps = [np.frombuffer(r[4], np.uint64) for r in rows]
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for words in sorted({len(m) for m in maps}):
                low = next(i for i, m in enumerate(maps) if len(m) >= words)  # maps grow with sizes: all from here on do
                fold = np.array([sh.folded(m, words) for m in maps[low:]])
                for i in np.flatnonzero([len(m) == words for m in maps]).tolist():  # with those as large or larger, as far as sizes allow
                    other = np.arange(i + 1, int(np.searchsorted(sizes * percent, sizes[i] * 100, side="right")))
                    other = other[(part[other] != part[i]) & (one | (block[other] != block[i]))]
                    if len(other):
                        differ = np.bitwise_count(fold[other - low] ^ fold[i - low]).sum(axis=1).astype(np.int64)
                        total = sizes[other] + sizes[i]
                        near = 100 * (total - differ) >= percent * (total + differ)
                        if near.any():
                            found.append((differ[near] / total[near], np.full(int(near.sum()), i), other[near]))
            if not found:
                continue
            far, x, y = (np.concatenate(c) for c in zip(*found, strict=True))
            pairs = list(zip(x.tolist(), y.tolist(), strict=True))
            if forest:
                root = list(range(len(names)))

                def find(c: int) -> int:
                    while root[c] != c:
                        root[c] = root[root[c]]
                        c = root[c]
                    return c

                chosen = []
                for k in np.argsort(far, kind="stable").tolist():
                    p, q = find(int(part[x[k]])), find(int(part[y[k]]))
                    if p != q:
                        root[p] = q
                        chosen.append(pairs[k])
                pairs = chosen
            ends = [sorted((rows[i][1], rows[j][1])) for i, j in pairs]
            yield pa.record_batch([pa.array([e[0] for e in ends], pa.binary()), pa.array([e[1] for e in ends], pa.binary())], names=["a", "b"])

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 |A & B| >= percent |A | B| on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return joined.mapInArrow(run, "a binary, b binary")


def _full_sets(docs: DataFrame, wanted: DataFrame, count: int, k: int) -> DataFrame:
    """node, n, parity, hashes of the wanted (doc_id, text_hash): the texts are read again, those wanted alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):  # hashing takes some fifty bytes for each of text
            sets = _sets(batch, k)
            columns = [pa.array([_digest(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64())]
            columns += [pa.array([f(s) for s in sets], pa.binary()) for f in (sh.parity, np.ndarray.tobytes)]
            yield pa.record_batch(columns, names=["node", "n", "parity", "hashes"])
        sh.forget()
        give_back()

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    few = wanted.withColumnsRenamed({"doc_id": "d", "text_hash": "h"})
    if count <= BROADCAST_IDS:
        few = F.broadcast(few)
    rows = rows.join(few, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left_semi")
    return rows.select("text").mapInArrow(run, "node binary, n bigint, parity binary, hashes binary").dropDuplicates(["node"])


def _blocks(placed: DataFrame) -> DataFrame:
    """placed (key, node, component, bytes) with block, a number within the bucket, and owner: the component whose
    nodes alone are in the block, or null where small components share it."""

    def needed(n: str, size: str) -> Column:
        return F.greatest(F.ceil(F.col(n) / BLOCK), F.ceil(F.col(size) / BLOCK_BYTES), F.lit(1))

    own = placed.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("bytes").alias("size")).withColumn("ways", needed("n", "size"))
    pool = own.filter("ways = 1").groupBy("key").agg(F.sum("n").alias("n"), F.sum("size").alias("size")).select("key", needed("n", "size").alias("shared"))
    both = placed.join(own.select("key", "component", "ways"), ["key", "component"]).join(pool, "key", "left")
    large = F.col("ways") > 1
    number = F.when(large, F.xxhash64("component", F.pmod(F.xxhash64("node"), F.col("ways")))).otherwise(F.xxhash64(F.pmod(F.xxhash64("component"), F.col("shared"))))
    return both.select("key", "node", "component", number.alias("block"), F.when(large, F.col("component")).alias("owner"))


def _open_pairs(members: DataFrame, known: DataFrame, labels: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Pairs (a, b) across components in buckets with more than one: their nodes meet in blocks, a block with itself
    and with each other block of the bucket that another component has nodes in. Most buckets are one block."""
    placed = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    bucket = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("nodes"), F.sum("bytes").alias("size"))
    wide = (F.col("nodes") > BLOCK) | (F.col("size") > BLOCK_BYTES)
    mixed = bucket.filter("x <> y").select("key", wide.alias("wide"))
    rest = stage_table(placed.join(mixed, "key").select("key", "node", "component", "bytes", "wide"), "mixed")
    zero = F.lit(0).cast("bigint")
    met = rest.filter("NOT wide").select("key", zero.alias("lo"), zero.alias("hi"), zero.alias("block"), "node", "component")
    if rest.filter("wide").limit(1).count():
        blocks = stage_table(_blocks(rest.filter("wide")), "blocks")
        others = blocks.select("key", F.col("block").alias("other"), F.col("owner").alias("of")).distinct()
        across = blocks.join(others, "key").filter("owner IS NULL OR of IS NULL OR owner <> of")
        met = met.union(across.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "component"))
    met = met.join(known, "node").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return met.mapInArrow(_across(percent, forest), "a binary, b binary").distinct()


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after more links, as components of components: links inside one, or repeated between two, are gone."""
    ends = links.join(labels.toDF("a", "p"), "a", "left").join(labels.toDF("b", "q"), "b", "left").select(F.coalesce("p", "a").alias("a"), F.coalesce("q", "b").alias("b"))
    wider = components(ends.filter("a <> b").distinct())
    known = labels.join(wider.toDF("component", "wider"), "component", "left").select("node", F.coalesce("wider", "component").alias("component"))
    return known.union(wider.join(labels.select("node"), "node", "left_anti"))


def near_duplicates(docs: DataFrame, k: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept of every row."""
    marks = stage_table(signatures(docs, k), "signatures")
    name = F.min(F.struct("doc_id", "text_hash")).alias("first")
    names = F.min(F.when(F.col("doc_id").isNotNull(), F.col("doc_id"))).alias("least")
    nodes = marks.filter("node IS NOT NULL").groupBy("node").agg(name, names, F.first("n").alias("n"))
    # A parity has less than 16 bits for each hash, and 1024 at least.
    keys = marks.filter("node IS NOT NULL").dropDuplicates(["node"]).select("node", F.greatest(F.col("n") * 2, F.lit(128)).alias("bytes"), F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1").select("key")
    members = stage_table(keys.join(shared, "key"), "members")
    alike = stage_table(members.select("node").distinct().join(nodes.select("node", "first"), "node").select("first.*"), "alike")
    sets = stage_table(_full_sets(docs, alike, alike.count(), k), "sets")
    known, full = sets.select("node", "n", "parity"), sets.select("node", "hashes")

    ends = members.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most"))
    hubs = members.join(ends, "key").select("node", F.explode(F.array("least", "most")).alias("hub")).filter("node <> hub").distinct()
    near = hubs.join(known, "node").join(known.toDF("hub", "hub_n", "hub_parity"), "hub").filter(_could(F.col("n"), F.col("hub_n"), percent))
    near = _near_hubs(near, percent).groupBy("node").agg(F.min(F.struct("differ", "hub")).alias("best"))
    links = stage_table(_confirmed(near.select(F.col("node").alias("a"), F.col("best.hub").alias("b")), full, percent), "links")
    labels = components(links)

    for forest in (True, False):
        pairs = _open_pairs(members, known, labels, percent, forest)
        drop(links)
        links = stage_table(_confirmed(pairs, full, percent), "links")
        if links.limit(1).count():
            labels = stage_table(_joined(labels, links), "labels")
    drop(members, alike, sets, links)

    named = nodes.join(labels, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = named.join(smallest, "component").select("node", "component_id")
    out = marks.select("doc_id", "text_hash", "node", F.col("n").alias("n_shingles")).join(classes, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def near_distinct(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each class: that with the least doc_id. Columns as in docs."""
    found = stage_table(near_duplicates(docs, k, percent), "classes")
    gone = stage_table(found.filter("NOT kept").select("doc_id", "text_hash").distinct(), "gone")
    # doc_ids that several kept rows with words have: such rows of one class are repeated, one of them stays.
    again = found.filter("kept AND n_shingles > 0").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    again = stage_table(again, "again")

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= BROADCAST_IDS else df

    text = F.col("text").cast("string")
    rows = carried(docs, doc_id=F.col("doc_id").cast("bigint"), text_hash=F.xxhash64(text), words=text.rlike(r"[^ \x09-\x0D]"))

    def same(other: DataFrame, *columns: str) -> Column:
        on = F.lit(True)
        for c in columns:
            on = on & rows[c].eqNullSafe(other[c])
        return on

    gone, again = small(gone), small(again)
    rows = rows.join(gone, same(gone, "doc_id", "text_hash"), "left_anti")
    once = rows.join(again, same(again, "doc_id") & F.coalesce("words", F.lit(False)), "left_anti").select("row")
    twice = rows.filter("words").join(again, same(again, "doc_id"), "left_semi")
    classes = found.select("doc_id", "text_hash", F.coalesce("component_id", "text_hash").alias("class")).distinct()
    twice = twice.join(classes, same(classes, "doc_id", "text_hash")).dropDuplicates(["class"]).select("row")
    return once.union(twice).select(*[F.col("row")[c].alias(c) for c in docs.columns])
