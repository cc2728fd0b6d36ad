import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.llm import mixing, sharding


def deviation(weights, slots):
    """The most blocks by which any source is ever from its exact share, while all sources still flow."""
    exact = np.array(weights) / sum(weights)
    blocks = [int(slots * w) + 1 for w in exact]
    source = mixing.edf(blocks, list(weights))[0]
    ends = int(min(b / w for b, w in zip(blocks, exact, strict=True)))  # then the first source has had all of its blocks
    return max(np.abs(np.cumsum(source[:ends] == s) - np.arange(1, ends + 1) * exact[s]).max() for s in range(len(weights))), ends


@pytest.mark.parametrize(
    "weights", [[1, 1], [5, 3, 1], [0.7, 0.2, 0.05, 0.05], [1] * 20, [100, 1, 1, 1], [0.97, 0.02, 0.01], [0.9, 0.1], [0.1395, *np.linspace(0.02, 0.08, 19)], [1 / 3, *[2 / 3 / 999] * 999]],
)
def test_each_source_is_less_than_a_block_from_its_target(weights):
    most, _ = deviation([float(w) for w in weights], 20_000)
    assert most < 1 + 1e-9  # below 1 in whole numbers; this sum is of floats


def test_deviation_over_a_million_slots():
    most, ends = deviation([0.97, 0.02, 0.0099, 0.0001], 1_000_000)
    assert most < 1 + 1e-9 and ends > 900_000


def test_every_block_lies_in_its_window_when_sources_end():
    rng = np.random.default_rng(4)
    for _ in range(20):
        k = int(rng.integers(1, 30))
        blocks, weights = rng.integers(1, 60, k).tolist(), (rng.random(k) + 1e-9).tolist()
        source, block, release, deadline = mixing.edf(blocks, weights)
        assert sorted(zip(source.tolist(), block.tolist(), strict=True)) == [(s, i) for s in range(k) for i in range(blocks[s])]
        assert (release <= np.arange(len(source))).all() and (np.arange(len(source)) < deadline).all()


def test_mix(docs, texts):
    out = mixing.mix(docs, block_bytes=200).collect()
    assert len(out) == len(texts) and sorted(r.doc_id for r in out) == list(range(len(texts)))
    by_class = {}
    for r in out:
        assert r.size == len((r.text or "").encode()) + 1 and r.block == r.start // 200 and r.release <= r.slot < r.deadline
        by_class.setdefault(r.mix_class, []).append(r)
    for rows in by_class.values():  # each source is one stream of bytes without gaps
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at
            at += r.size
    slots = {}
    for r in out:
        assert slots.setdefault(r.slot, (r.mix_class, r.block)) == (r.mix_class, r.block)


def test_mix_weights_and_columns(spark, docs, texts, nothing):
    out = mixing.mix(docs, weights={"s0": 1.0}, block_bytes=100).collect()
    assert len(out) == len(texts) and {r.mix_class for r in out} == {r.source for r in out}
    named, others = [r.slot for r in out if r.source == "s0"], [r.slot for r in out if r.source != "s0"]
    assert max(named) < min(others)
    empty = mixing.mix(nothing)
    assert empty.count() == 0 and empty.columns == [*[c for c in docs.columns if c != "slot"], *mixing._NEW]
    ordered = mixing.mixed_documents(docs, block_bytes=100)
    assert ordered.columns == docs.columns and ordered.count() == len(texts)
    two = spark.createDataFrame([(i, "x" * 50, "" if i % 2 else None) for i in range(40)], "doc_id bigint, text string, source string")
    for first in (None, ""):
        out = mixing.mix(two, weights={first: 1.0}, block_bytes=10).collect()
        assert {r.source for r in sorted(out, key=lambda r: r.slot)[:20]} == {first}


def test_every_source_is_mixed_at_its_own_weight(spark):
    rows = [(i, f"text {i} " * (1 + i % 3), f"site{i % 600}") for i in range(3000)]
    many = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = mixing.mix(many, block_bytes=32).collect()
    assert len(out) == 3000 and all(r.mix_class == r.source for r in out)
    assert all(r.release <= r.slot < r.deadline for r in out)
    small = {"site1": 3.0, "site2": 1.0}
    named = mixing.mix(many, weights=small, block_bytes=32).collect()
    last = max(r.slot for r in named if r.source in small)
    assert last <= 1.2 * sum(len(r.text) + 1 for r in named if r.source in small) / 32 + 5
    assert len(named) == 3000


def test_blocks_and_cells_are_bounded(spark, monkeypatch):
    rows = [(i, f"text {i} " * (1 + i % 3), f"s{i % 3}") for i in range(9000)]
    many = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    monkeypatch.setattr(mixing, "MOST_BLOCKS", 50)
    monkeypatch.setattr(mixing, "MOST_CELL_BITS", 1)
    out = mixing.mix(many, block_bytes=32).collect()
    assert len(out) == 9000 and max(r.slot for r in out) <= 53 and all(r.release <= r.slot < r.deadline for r in out)


def test_mixed_order_holds_over_partitions(docs):
    place = {r.doc_id: (r.slot, r.start) for r in mixing.mix(docs.drop("slot"), block_bytes=100).collect()}
    seen = [place[r.doc_id] for r in mixing.mixed_documents(docs.drop("slot"), block_bytes=100).collect()]
    assert seen == sorted(seen)


def shards(df, n, **more):
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 1
    return sharding.histogram_shards(df, n, size, F.xxhash64("text"), F.col("doc_id"), **more)


def test_shards_of_near_equal_bytes(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "x" * int(rng.integers(1, 400)) + str(i)) for i in range(6000)]
    out = shards(spark.createDataFrame(rows, "doc_id bigint, text string"), 16).collect()
    sizes, slots = np.zeros(16), {}
    for r in out:
        sizes[r.shard] += len(r.text) + 1
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(out) == 6000 and sizes.max() <= 1.03 * sizes.mean() and sizes.min() >= 0.97 * sizes.mean()
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_a_hot_group_is_split_and_others_are_not(spark):
    rows = [(i, "same text") for i in range(3000)] + [(3000 + i, f"text {i // 2} of two") for i in range(6000)]
    out = shards(spark.createDataFrame(rows, "doc_id bigint, text string"), 8, task_rows=500).collect()
    sizes, homes = np.zeros(8), {}
    for r in out:
        sizes[r.shard] += len(r.text) + 1
        homes.setdefault(r.text, set()).add(r.shard)
    assert sizes.max() <= 1.05 * sizes.mean()
    assert sum(len(h) > 1 for h in homes.values()) <= 2


def test_shards_edge_cases(spark, docs, texts, nothing):
    out = shards(docs, 4)
    assert out.count() == len(texts) and set(out.columns) == set(docs.columns) and dict(out.dtypes)["shard"] == "int"
    assert shards(nothing, 4).count() == 0
    one = shards(spark.createDataFrame([(None, None), (None, None), (2, None)], "doc_id bigint, text string"), 4).collect()
    assert len(one) == 3


def plain_shards(rows, n):
    """The same by a plain sort: cut where the bytes below come nearest to each target."""
    total, below, cuts = sum(r[2] for r in rows), 0, []
    ends = [0]
    for r in sorted(rows):
        below += r[2]
        ends.append(below)
    cuts = [min(range(len(ends)), key=lambda i: abs(ends[i] - total * k / n)) for k in range(1, n)]
    return cuts, total


def test_shards_against_a_plain_sort(spark):
    """Shards follow the order of the keys, and their bounds are as near to the targets as the tolerance says."""
    rng = np.random.default_rng(7)
    texts = [f"text {i % 400} " * int(rng.integers(1, 9)) for i in range(3000)] + [None, "", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    out = shards(df.withColumn("k1", F.xxhash64(F.xxhash64("text"))), 16).collect()
    size = lambda r: len((r.text or "").encode()) + 1
    cuts, total = plain_shards([(r.k1, r.doc_id, size(r)) for r in out], 16)
    order = sorted(out, key=lambda r: (r.k1, r.doc_id))
    assert [r.shard for r in order] == sorted(r.shard for r in out)
    for k in range(16):
        mine = [r for r in order if r.shard == k]
        assert [r.slot for r in mine] == list(range(len(mine)))
    for k, cut in enumerate(cuts, 1):
        below = sum(size(r) for r in out if r.shard < k)
        nearest = sum(size(r) for r in order[:cut])
        assert abs(below - total * k / 16) <= max(0.01 * total / 16, abs(nearest - total * k / 16)) + 0.01 * total / 16
