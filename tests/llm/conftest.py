import pytest

#: Nulls, empty and odd texts, ties and repeated rows, and a column whose name clashes with results.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and then it runs away from the hounds again", "x"),
    (2, "", "x"),
    (3, None, "x"),
    (None, "a text without an id, which is kept as it is", "x"),
    (4, "spam and eggs " * 400, "x"),
    (4, "spam and eggs " * 400, "x"),
    (5, "ÄÖÜ İstanbul   wide space <|endoftext|> it's 1234 naïve é", "x"),
    (6, "word\x1cjoined by a separator\n\n\n  lines\r\nand\ttabs <s> </s> 你好世界 😀", "x"),
    (7, "longword" * 3000, "x"),
    (8, " ".join(f"w{i % 997}" for i in range(9000)), "x"),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, n_tokens string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
