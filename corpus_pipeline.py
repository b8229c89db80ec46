"""From raw documents to token files: five stages over the corpus operators.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame that is
written as Parquet and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatework.llm import decontaminate, fertility, mixing, simhash, tokenbin
from slatework.llm.queries import PIECE_VOCABULARY, WORD_VOCABULARY
from slatework.llm.text import count_words, read
from slatework.scratch import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the tokeniser's bands reject go: null, empty and short texts too. Kept rows stay as they were, repeated ones each."""
    return fertility.score(docs, PIECE_VOCABULARY).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash class the document with the smallest id stays, null ids last; of equal rows one. Null and empty texts are one class."""
    return simhash.deduplicate(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any window of a benchmark item go; null and empty texts have none and stay, repeated rows are judged alike."""
    return decontaminate.remove_documents(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares: documents are dropped or repeated whole. A null source is one of its own; empty texts take no words but may go or come again."""
    return mixing.emit(mixing.mix(docs, count_words(F.col("text"))))


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left; a row per document as read back from them. A null or empty text is its end id, null ids come first, equal rows stay apart."""
    tokens = tokenbin.write(docs, WORD_VOCABULARY)
    return tokenbin.digest(tokens).withColumnRenamed("key", "doc_id")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("mix_sources", mix_sources),
    ("token_files", token_files),
]

#: Fingerprints, hash-ordered sampling and the tokeniser are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = read(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
