import pytest

TABLES = "/root/testdata/sf0.001"
CLASHING = ["kept", "keep_id", "row", "key", "digest", "size", "target", "taken", "_text", "fp", "part", "score", "removed"]


@pytest.fixture(scope="session")
def llm_spark(spark):
    from talkweave.llm.queries import prepare

    prepare(spark)
    return spark


@pytest.fixture(scope="session")
def table(llm_spark):
    """A documents table from (doc_id, text, source) rows, with extra columns whose names operators use."""

    def make(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
        return llm_spark.createDataFrame([(i, t, None, s, None if t is None else len(t), *["x"] * len(CLASHING)) for i, t, s in rows], schema)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, a very long text, copies, repeated rows, a null id."""
    long = " ".join(f"word{i % 977} sentence{i % 31}." for i in range(30_000))
    return [(1, None, "a"), (2, "", None), (3, " \t\n ", "a"), (4, long, "b"), (5, "one two three four five six seven.", "a"), (6, "one two three four five six seven.", "b"),
            (6, "one two three four five six seven.", "b"), (None, "one two three four five six seven.", None), (7, "Größe naïve 漢字 <|endoftext|> don't  stop\r\n\x0bnow", "é"), (8, "x", "b")]
