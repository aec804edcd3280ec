import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Null and repeated ids, null and empty texts, odd white space, special strings, repeated rows, clashing columns."""
    texts = [None, "", " ", "\n\n", "a", "  two  spaces ", "tab\tand\r\nline", "x y", "<|endoftext|> b  <|endoftext|>", "</s> <s>", "Ünïcode ÀÉ İ ß ﬁ 中文字 😀 ́", "word, word. can't '' 12 3", "a" * 3000, "And " * 400, "▁ ▁▁a", "a\x1cb\x85c\u3000d"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "null id"), (None, "null id"), (3, "again"), (4, "a"), (4, "a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return df.withColumns({"lang": F.lit(None).cast("string"), "score": F.lit("s"), "kept": F.lit(1), "host": F.lit(2), "ids": F.lit(3), "n": F.lit(4), "part": F.lit(5)})


@pytest.fixture
def no_documents(documents):
    return documents.limit(0)
