import itertools
import random

import numpy as np
import pytest

from keyloom.llm import minhash, shingles
from keyloom.llm.components import components


def sets_of(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, percent):
    """component and size of every row by comparing all pairs."""
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    found = [sets_of(t, k) for _, t in rows]
    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(found[i] & found[j])
        if both and 100 * both >= percent * (len(found[i]) + len(found[j]) - both):
            parent[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {(d, t): (len(found[i]), least[find(i)]) for i, (d, t) in enumerate(rows)}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    out = []
    for _ in range(12):
        base = [word() for _ in range(rng.randint(20, 300))]
        for _ in range(rng.randint(1, 25)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    out += ["", None, " \n", "Aa", "aA", "one two", "ONE  two", "é x", out[0], out[0].upper()]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_classes_equal_brute_force(spark, corpus, k, percent):
    docs = spark.createDataFrame(corpus, "doc_id bigint, text string").repartition(5)
    out = minhash.near_duplicates(docs, k, percent).collect()
    want = brute(corpus, k, percent)
    assert len(out) == len(corpus)
    for r in out:
        assert (r.n_shingles, r.component_id) == want[(r.doc_id, dict(corpus)[r.doc_id])], r
        assert r.kept == (r.component_id == r.doc_id)


@pytest.mark.parametrize("name,value", [("BLOCK", 3), ("BLOCK_BYTES", 300)])
def test_blocks_of_a_large_bucket(spark, corpus, monkeypatch, name, value):
    monkeypatch.setattr(minhash, name, value)
    docs = spark.createDataFrame(corpus, "doc_id bigint, text string")
    want = brute(corpus, 3, 85)
    for r in minhash.near_duplicates(docs).collect():
        assert r.component_id == want[(r.doc_id, dict(corpus)[r.doc_id])][1]


def test_one_of_each_class_stays(spark, corpus):
    docs = spark.createDataFrame([(d, t, "x", d % 3) for d, t in corpus] + [(3, dict(corpus)[3], "x", 0)] * 2, "doc_id bigint, text string, node string, n int")
    kept = minhash.near_distinct(docs, 5, 80)
    assert kept.columns == docs.columns
    want = brute(corpus, 5, 80)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want.values()})


def test_nulls_and_empty_table(spark, nothing):
    docs = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (4, "a b c d"), (None, "other words are here"), (None, None)], "doc_id bigint, text string")
    out = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert out == {(None, 2, 4, False), (4, 2, 4, True), (None, 2, None, True), (None, 0, None, True)}
    assert minhash.near_duplicates(nothing).count() == 0 and minhash.near_distinct(nothing).count() == 0


def test_parity_is_a_lower_bound():
    rng = np.random.default_rng(2)
    for n in (1, 10, 700, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n - n // 10], rng.integers(0, 1 << 63, n // 20 + 1).astype(np.uint64)]))
        assert shingles.differ_least(shingles.parity(a), shingles.parity(b)) <= len(np.setxor1d(a, b))


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(4)
    a = np.unique(rng.integers(0, 1 << 63, 2000).astype(np.uint64))
    b = np.concatenate([a[:1800], rng.integers(0, 1 << 63, 200).astype(np.uint64)])
    c = shingles.Circulant(512)
    assert abs((c.signature(a) == c.signature(b)).mean() - 1800 / 2200) < 0.08


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (7, 9), (20, 20), (5, None), (3, 4), (4, 5), (5, 6)] + [(i, i + 1) for i in range(100, 160)]
    out = dict(components(spark.createDataFrame(links, "a bigint, b bigint")).collect())
    assert {out[i] for i in range(1, 7)} == {1} and {out[i] for i in (7, 8, 9)} == {7} and out[20] == 20
    assert {out[i] for i in range(100, 161)} == {100}


def test_blocks_of_one_component_do_not_meet(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rows = [(1, bytes([i]), b"big", 1) for i in range(100)] + [(1, bytes([100 + i]), b"s%d" % i, 1) for i in range(6)]
    placed = spark.createDataFrame(rows, "key bigint, node binary, component binary, bytes int")
    out = minhash._blocks(placed).collect()
    assert len(out) == 106 and {r.owner for r in out if r.component == b"big"} == {b"big"} and {r.owner for r in out if r.component != b"big"} == {None}
    assert len({r.block for r in out if r.owner}) == 25 and len({r.block for r in out if not r.owner}) <= 2


def test_long_texts_with_long_neighbours(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60_000)]
    near = list(base)
    near[::700] = ["x"] * len(near[::700])
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base[:300])), (4, " ".join(base[:300]) + " x"), (5, " ".join(base[::-1]))]
    out = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert out == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}
