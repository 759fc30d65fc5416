import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in all columns, empty and blank texts, ties, repeated rows, a very long text, and columns of names the operators use."""
    prose = "the quick brown fox jumps over the lazy dog and then walks home through the rain while nobody looks at all"
    long = " ".join(f"word{i % 997}x{i % 31}" for i in range(60_000))
    rows = [
        (1, prose, "en", "a", 1), (2, prose, "en", "a", 1), (2, prose, "en", "a", 1), (3, prose + " ", "en", None, 1), (4, prose.replace(" ", "\n"), "en", "b", None),
        (5, None, None, None, None), (6, "", "en", "b", 0), (7, " \t\n\x0b\x0c\r ", "en", "b", 7), (None, prose, "en", "a", 1), (None, None, None, None, None),
        (8, "one", "en", "c", 3), (9, "one two", "en", "c", 7), (10, long, "en", "c", len(long)), (11, prose.upper(), "en", "c", 1), (12, "a\x00b   İ K \U0001f600" * 20, "xx", "c", 1),
        (13, prose.replace("lazy", "idle"), "en", "a", 1),
    ]
    df = spark.createDataFrame(rows, DOCS)
    clash = {c: df["n_chars"] for c in ("fp", "key", "kept", "slot", "size", "n_words", "sequence_id", "node", "root", "count", "id", "block", "__kept")}
    return df.withColumns(clash).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
