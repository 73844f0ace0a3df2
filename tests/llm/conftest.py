import pytest

from geoweave.llm.common import prepared

# Null, empty, white space only, control characters, other scripts, and a very long text.
TEXTS = [
    None, "", "   ", "\n\n", "one", "Two words", "The cat sat on the mat.", "the CAT sat on the mat.", "ÄÖÜ straße été",
    "äöü straße été", "tab\tand  two spaces\n\n and lines ", "日本語のテキスト。空白なし", "nul\x00byte \x1f unit \x85 next　wide",
    "<|endoftext|> inside <|endoftext|>", "é combining \U0001f600 emoji", "1,234.56 it's we'll 'd", "x" * 3000,
    "word " * 30_000, "a b\n" * 400, "don't stop\n'll go",
]


@pytest.fixture(scope="session")
def texts():
    return TEXTS


@pytest.fixture(scope="session")
def ready(spark):
    return prepared(spark)


@pytest.fixture(scope="session")
def odd_docs(ready):
    """Odd texts with repeated and null ids, a repeated row, and columns whose names clash."""
    rows = [(i, t, "other", i, i) for i, t in enumerate(TEXTS)]
    rows += [(4, "again an id", "x", 0, 0), (6, TEXTS[6], "y", 0, 0), (6, TEXTS[6], "y", 0, 0), (None, "no id", "z", 0, 0), (None, "no id", "z", 0, 0), (None, None, None, None, None)]
    docs = ready.createDataFrame(rows, "doc_id bigint, text string, a string, fp bigint, component bigint")
    return docs.toDF("doc_id", "text", "TEXT", "fp", "Doc_Id")


@pytest.fixture(scope="session")
def no_docs(ready):
    return ready.createDataFrame([], "doc_id bigint, text string")
