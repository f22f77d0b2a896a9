import pytest


@pytest.fixture(scope="session")
def tok():
    return pytest.importorskip("public_tokenizers").path


@pytest.fixture()
def docs(spark):
    """Nulls, empty and long texts, repeats, ties and columns whose names clash with what operators add."""
    long = " ".join(f"word{i % 97} of line {i}" for i in range(3000))
    rows = [(1, "a b c d e f g h i j", "s1"), (2, None, "s1"), (3, "", None), (4, long, "s2"), (5, "a b c d e f g h i j", "s1"), (5, "a b c d e f g h i j", "s1"), (None, "x", "s3"), (None, None, None), (6, "é ß 中文 \t tab\n\nnew", "s2"), (7, "y" * 3000, "s3")]
    return spark.createDataFrame([(i, t, s, k, k, k, 0.5) for k, (i, t, s) in enumerate(rows)], "doc_id long, text string, source string, n_tokens int, shard int, mix_copies int, score double")


@pytest.fixture()
def empty(docs):
    return docs.limit(0)
