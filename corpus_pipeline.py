"""A training corpus from documents: each stage works on all that the one before kept.

toxic documents go; one document of each near-duplicate group stays; bytes that repeat elsewhere go; documents that hold a
benchmark item go; what is left is packed into sequences. Every stage but the last returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmill.llm import packing, simhash, suffix_dedup, templates, toxicity
from segmill.llm.common import new_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the classifier doesn't take for toxic. It learns from labelled documents whose crc32(doc_id) mod 5 is not 0.

    Null and empty texts are scored like any other and stay as they are. Equal texts have equal scores, so repeated rows stay or go together;
    a score of exactly 0.5 is toxic, which is that of all rows if none is labelled. Rows with a null id are scored. An empty table stays empty; columns but those of documents go.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    return toxicity.keep_clean(docs, labels, held_out).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of texts that links of at least 0.8 common five-word shingles reach.

    Candidates come from the covering masks of SimHash fingerprints and from bands of minimum hashes; each is verified. The smallest id
    stays, of equal ids the smallest hash of the text; rows with a null id come last. Null, empty and blank texts are one group;
    the row that stays keeps its text as it is. Repeated rows are one group. An empty table stays empty; columns but those of documents go.
    """
    return simhash.keep_one(docs).select(*COLUMNS)


def drop_repeated_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 200 bytes that start elsewhere too; characters cut at an edge go, and documents of which nothing but white space is left.

    A document that loses nothing stays as it is: a null text stays null, an empty or blank one stays. Every place of a repeated string
    loses it, the first too; so do repeated rows of 200 bytes or more, which lose all and go. n_chars is counted anew where a text
    changes. Null ids change nothing. An empty table stays empty; columns but those of documents go.
    """
    kept = suffix_dedup.remove_repeats(docs.withColumn("null_text", F.col("text").isNull()), carry=[*(c for c in COLUMNS if c != "text"), "null_text"], whole_characters=True)
    text = F.when(~F.col("null_text"), F.col("kept").cast("string"))
    left = kept.withColumn("text", text).where((F.col("n_removed") == 0) | F.col("text").rlike("(?U)\\S"))
    chars = F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return left.withColumn("n_chars", chars).select(*COLUMNS)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that hold no benchmark item, in its own words or with other values in its places.

    Null, empty and blank texts hold none. Equal rows stay or go together; a row goes by its id and text, so rows that share an id with
    a contaminated one stay. Null ids are compared like values. An empty table, of documents or of items, drops nothing; columns but
    those of documents go.
    """
    return templates.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 2048 tokens; of a source at most 4 pieces and of equal texts one in each.

    Null and empty texts take one token, the end. Repeated rows are packed each, in different sequences; rows with a null id are packed too,
    a null source conflicts with nothing. Ties in the order are settled by text and position. An empty table has no sequences.
    """
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("simhash near-dedup", drop_near_duplicates), ("suffix-array dedup", drop_repeated_bytes), ("benchmark decontamination", drop_benchmark), ("best-fit packing", pack)]

#: SQL can't express the classifier, the fingerprints' XXH64 or best fit; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = new_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
