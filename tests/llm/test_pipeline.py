"""The pipeline against plain versions of its stages, on a small table."""

from collections import Counter

import corpus_pipeline as C

from keyloom.llm.common import read_table
from tests.llm.test_minhash import brute

SF = "/root/testdata/sf0.001"


def test_stages_and_result(spark):
    docs = read_table(spark, SF, "documents")
    columns, seen = docs.columns, {}
    for name, stage in C.STAGES:
        before = docs
        docs = stage(spark, docs, SF).cache()
        seen[name] = docs
        if name != "packing":
            assert docs.columns == columns
    text_of = {r.doc_id: r.text for r in read_table(spark, SF, "documents").collect()}
    language = {r.doc_id for r in seen["language_id"].collect()}
    assert len(language) >= 0.98 * len(text_of)
    want = brute([(d, text_of[d]) for d in sorted(language)], 5, 80)
    kept = {r.doc_id for r in seen["near_duplicates"].collect()}
    assert kept == {d for (d, _), (_, least) in want.items() if d == least}
    clean = {r.doc_id: r.text for r in seen["pii"].collect()}
    assert clean.keys() == kept and sum(clean[d] != text_of[d] for d in kept) < 0.2 * len(kept)
    mixed = [r.doc_id for r in seen["mixing"].collect()]
    assert Counter(mixed) == Counter(kept)
    packed = seen["packing"].collect()
    assert {r.doc_id for r in packed} == kept
    tokens = Counter()
    for r in packed:
        tokens[r.sequence_id] += r.length
    assert max(tokens.values()) <= 1024 and len(tokens) <= 1.02 * -(-sum(tokens.values()) // 1024) + 1
    assert C.run(spark, SF).count() == len(packed)
    assert before is not None
