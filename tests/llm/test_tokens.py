import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from keyloom.llm import packing, simple8b, tokenfile
from keyloom.llm.tokens import PieceEncoder

NAMES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


def plain(name, text):
    return Tokenizer.from_file(P.path(name)).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", NAMES)
def test_pieces_give_the_ids_of_whole_texts(name, texts):
    rng = random.Random(3)
    odd = ["".join(rng.choice(" \n\ta'|bA.,!1é<>ΣÍß̇İ²") for _ in range(rng.randint(1, 30))) for _ in range(800)]
    odd += ["<|endoftext|> hi", "don't we'll", "x\n \ny", "   lead", "trail  ", "a | b || c", "\x1c a"]
    encoder, whole = PieceEncoder(P.path(name)), Tokenizer.from_file(P.path(name))
    for batch in (odd, texts, odd):
        flat, n = encoder.encode(batch)
        ends = np.cumsum(n)
        for i, e in enumerate(whole.encode_batch([t or "" for t in batch], add_special_tokens=False)):
            assert flat[ends[i] - n[i] : ends[i]].tolist() == e.ids, batch[i]


def test_encoder_forgets_and_learns_again(texts):
    encoder = PieceEncoder(P.path(NAMES[0]), most=5)
    first = encoder.encode(texts)
    again = encoder.encode(texts)
    assert (first[0] == again[0]).all() and (first[1] == again[1]).all()


@pytest.mark.parametrize("n,top", [(0, 1), (1, 3), (5000, 50_000), (3000, 2), (2000, 1 << 40), (500, 1 << 63)])
def test_simple8b_round_trip(n, top):
    rng = np.random.default_rng(n)
    values = (rng.random(n) * top).astype(np.uint64)
    words, blocks = simple8b.encode(values)
    assert (simple8b.decode(words, n) == values).all()
    for _ in range(10):
        if n:
            first = int(rng.integers(0, n))
            count = int(rng.integers(0, n - first + 1))
            assert (simple8b.decode_from(words, blocks, n, first, count) == values[first : first + count]).all()


def test_simple8b_runs_of_zeros_and_escapes():
    values = np.zeros(1000, np.uint64)
    values[::100] = (1 << 64) - 1
    words, _ = simple8b.encode(values)
    assert (simple8b.decode(words, 1000) == values).all()
    words, _ = simple8b.encode(np.zeros(960, np.uint64))
    assert len(words) == 4 and not words.any() and not simple8b.decode(words, 960).any()


def test_token_file(docs, texts):
    out = {r.doc_id: r for r in tokenfile.read_tokens(tokenfile.write_tokens(docs, P.path(NAMES[0]), 1, most_ids=500)).collect()}
    start = 0
    for i, text in enumerate(texts):
        ids = np.array([*plain(NAMES[0], text), 1], "<u4")
        assert (out[i].start, out[i].n_tokens, out[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(out) == len(texts)


def test_token_file_read_in_small_runs(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "_DECODED", 100)
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["word", "tokens", "é", "12"]) for _ in range(rng.choice([0, 3, 50, 4000])))) for i in range(60)]
    out = tokenfile.read_tokens(tokenfile.write_tokens(spark.createDataFrame(rows, "doc_id bigint, text string"), P.path(NAMES[0]), 1)).collect()
    assert {(r.doc_id, r.ids_crc32) for r in out} == {(i, zlib.crc32(np.array([*plain(NAMES[0], t), 1], "<u4").tobytes())) for i, t in rows}


def test_token_file_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (5, "c"), (5, "c"), (5, None)], "doc_id bigint, text string")
    out = tokenfile.read_tokens(tokenfile.write_tokens(docs, P.path(NAMES[0]), 1)).orderBy("start").collect()
    assert [r.doc_id for r in out] == [None, 5, 5, 5]
    assert [r.start for r in out] == [0, *np.cumsum([r.n_tokens for r in out])[:-1].tolist()]


def test_packing(docs, texts):
    rows = packing.pack(docs, P.path(NAMES[1]), 2, size=64, group=50).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, text in enumerate(texts):
        ids, at = np.array([*plain(NAMES[1], text), 2], "<u4"), 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (r.length == 64 or k == 0)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for found in by_sequence.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64


def test_sequences_follow_the_order_of_rows(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, "word " * int(rng.integers(1, 60))) for i in rng.permutation(600).tolist()]
    made = spark.createDataFrame(rows, "doc_id bigint, text string").repartitionByRange(5, F.length("text")).sortWithinPartitions("doc_id")
    made.write.parquet(f"{tmp_path}/t")
    whole = [r.doc_id for r in made.collect()]
    for table in (spark.read.parquet(f"{tmp_path}/t"), made):
        out = packing.pack(table, P.path(NAMES[1]), 2, size=64, group=100).collect()
        place = {d: i for i, d in enumerate(whole)}
        by_run, first = {}, {}
        for r in out:
            by_run.setdefault(r.sequence_id >> 32, []).append(place[r.doc_id])
            first[r.sequence_id] = min(first.get(r.sequence_id, 1 << 60), place[r.doc_id])
        runs = [by_run[k] for k in sorted(by_run)]
        assert len(runs) > 4 and all(max(a) <= min(b) for a, b in zip(runs, runs[1:]))  # noqa: B905
        firsts = [first[k] for k in sorted(first)]
        assert firsts == sorted(firsts)


def test_sum_of_squares_is_near_the_least_number():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 1025, 20_000)
    sequence, _ = packing.sum_of_squares(lengths, 1024)
    assert np.bincount(sequence, lengths).max() <= 1024
    assert sequence.max() + 1 <= 1.005 * np.ceil(lengths.sum() / 1024)


def plain_sum_of_squares(lengths, size):
    """Step by step: of all open sequences with room, that after which the sum of squared counts per gap is least."""
    gaps, place = [], [None] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n, best = lengths[i], None
        if n < size:
            counts = {}
            for g in gaps:
                if 0 < g < size:
                    counts[g] = counts.get(g, 0) + 1
            for g in sorted(x for x in counts if x >= n):
                after = dict(counts)
                after[g] -= 1
                if g > n:
                    after[g - n] = after.get(g - n, 0) + 1
                total = sum(c * c for c in after.values())
                if best is None or total < best[0]:
                    best = (total, g)
        if best is None:
            place[i] = (size, len(gaps))
            gaps.append(size - n)
        else:
            place[i] = (best[1], None)
            gaps[gaps.index(best[1])] -= n
    return place, len(gaps)


@pytest.mark.parametrize("seed", range(6))
def test_sum_of_squares_step_by_step(seed):
    rng = np.random.default_rng(seed)
    size = 40
    lengths = rng.integers(1, size + 1, 150) if seed % 2 else np.concatenate([rng.integers(1, 6, 100), np.full(8, size)])
    sequence, offset = packing.sum_of_squares(lengths, size)
    place, opened = plain_sum_of_squares(lengths.tolist(), size)
    assert sequence.max() + 1 == opened
    assert [size - int(o) for o in offset] == [p[0] for p in place]


def test_empty_tables(nothing):
    assert packing.pack(nothing, P.path(NAMES[1]), 2).count() == 0
    assert tokenfile.read_tokens(tokenfile.write_tokens(nothing, P.path(NAMES[0]), 1)).count() == 0
