import pytest

WORDS = "the of and a to in is you that it he was for on are as with his they at be this have from or one had by word but not what all were we when your can said".split()


@pytest.fixture(scope="session")
def texts():
    """Texts with what is hard: nulls, empty ones, copies, near copies, other scripts, and a long one."""
    import random

    rng = random.Random(5)
    base = [" ".join(rng.choice(WORDS) + rng.choice(["", "", ".", ","]) for _ in range(rng.randint(3, 120))) for _ in range(40)]
    near = base[7].split()
    near[3] = "changed"
    return [*base, base[3], base[3], " ".join(near), None, "", " ", "one", "two words", "été à Paris, naïve.", "日本語 テスト\n\nx", "x" * 3000, " ".join(WORDS * 300)]


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, ["en", "fr", None][i % 3], ["s0", "s1", "s2", None][0 if i % 3 else i % 4], len(t or ""), f"own{i}", i) for i, t in enumerate(texts)]
    # shard, slot and row clash with names that operators use
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, shard string, slot int").repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.filter("doc_id < 0")
