import pytest
from pyspark.sql import Row


@pytest.fixture(scope="session")
def hard_docs(spark):
    """Null and empty texts, a null id, repeated rows, a very long text, odd characters, and a column with a clashing name."""
    texts = [None, "", " \n\t ", "one two three one two three", "one two three one two three", "x" * 70_000, "word " * 30_000, "Ünï ΑΣ 日本 😀 <|endoftext|> don't", "a\x1cb\x85c", "\n\n b  c \n"]
    rows = [Row(doc_id=i, text=t, lang=None, source="s", n_chars=None, score="clash", word=1) for i, t in enumerate(texts)]
    rows += [rows[3], Row(doc_id=None, text="no id", lang=None, source=None, n_chars=1, score=None, word=None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, word int").repartition(3)


@pytest.fixture(scope="session")
def no_docs(hard_docs):
    return hard_docs.limit(0)
