"""The jobs as registered queries: each runs twice into one new folder, and what then stands there is the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import embed_documents, search_index
from slatework.plans.queries_search import CATALOGUE
from slatework.scratch import scratch_path


def job1_search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyword index of all documents; the second run finds nothing to do."""
    output = scratch_path(spark, "job1")
    search_index.run(spark, f"{sf_dir}/documents.parquet", output)
    return search_index.run(spark, f"{sf_dir}/documents.parquet", output)


def job2_embed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their vectors' signs; the second run takes no file."""
    output = scratch_path(spark, "job2")
    embed_documents.run(spark, f"{sf_dir}/documents.parquet", output)
    rows = embed_documents.run(spark, f"{sf_dir}/documents.parquet", output)
    bits = F.array_join(F.transform(F.slice("embedding", 1, 128), lambda x: F.when(x > 0, "1").otherwise("0")), "")
    return rows.select("doc_id", "source", "lang", "hash", "n_chars", bits.alias("bits"), F.size("embedding").cast("long").alias("dimension"))


QUERIES = {"job1_search_index": job1_search_index, "job2_embed_documents": job2_embed_documents}
ORACLES = {
    "job1_search_index": CATALOGUE.oracles["index_postings"],
    "job2_embed_documents": r"""
SELECT doc_id, source, lang, CASE WHEN full_text THEN sha256(cut) END AS hash, coalesce(length(text), 0) AS n_chars, CASE WHEN full_text THEN 768 END AS dimension,
  CASE WHEN full_text THEN array_to_string(list_transform(range(0, 128), lambda i: CASE WHEN (CAST('0x' || substr(md5(cut), CAST(32 - i // 4 AS BIGINT), 1) AS INTEGER) >> CAST(i % 4 AS INTEGER)) % 2 = 1 THEN '1' ELSE '0' END), '') END AS bits
FROM (SELECT *, substr(text, 1, 4000) AS cut, coalesce(regexp_matches(text, '[^\x20\x09-\x0D]'), false) AS full_text FROM documents)
""",
}
