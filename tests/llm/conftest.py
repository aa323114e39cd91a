import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and blank texts, repeated rows, ties, one very long text, and columns with the operators' own names."""
    long_text = " ".join(f"word{i % 977} Filler{i % 31}" for i in range(30_000))
    rows = [
        (1, "The quick brown Fox jumps over the lazy dog.\nAnd again it jumps"),
        (2, "the QUICK brown fox jumps over the lazy dog.\nand again it jumps"),
        (3, None),
        (4, ""),
        (5, " \t\n "),
        (6, "one"),
        (7, "Zwei Wörter"),
        (8, long_text),
        (9, long_text + " end"),
        (10, "repeated row"),
        (10, "repeated row"),
        (None, "a row without an id"),
        (11, "a b c " * 400),
        (12, "é" * 500 + "   ünï <|endoftext|> 'S it's"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("clash") for c in ("id", "fp", "shard", "slot", "start", "key", "label", "component", "score", "n")})


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
