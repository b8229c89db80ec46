"""Embed the documents that have come in since the last run.

    python -m jobs.embed_documents --documents hdfs:///corpus/documents --output hdfs:///vectors --config jobs/embed_documents.json

A file stream over the table's folder takes the files that are new by its checkpoint, some at a time, and ends when there
are no more. Of a batch's texts only those reach the embedding model that are distinct and have no vector from this provider
yet. Then the batch's documents are written, with the hash that leads to their vector, over what an earlier attempt at the
same batch may have left. If a text cannot be embedded the run fails before that, and the next one takes the batch again.

Output: ``vectors`` (partitioned by provider and hash), ``documents`` (partitioned by batch) and ``checkpoint``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import LOG, command
from slatework.functions.text import is_blank
from slatework.operators.vector_store import VectorStore
from slatework.sources import embedding

#: provider: mock or http, whose server is named by the environment; width: characters that are embedded of a text.
DEFAULTS = {"provider": "mock", "model": "nomic-embed-text", "width": 4000, "files_per_batch": 1000}
COLUMNS = ["doc_id", "source", "lang"]


def run(spark: SparkSession, documents: str, output: str, settings: dict = DEFAULTS, provider: embedding.Provider | embedding.ExpressionProvider | None = None) -> DataFrame:
    """One run; doc_id, source, lang, hash, n_chars and embedding of all documents so far. The last version of a document counts."""
    output = output.rstrip("/")
    provider = provider or embedding.provider_named(settings["provider"], settings["model"])
    store, kind = VectorStore(spark, f"{output}/vectors", settings["width"]), spark.read.parquet(documents).schema

    def take(batch: DataFrame, number: int) -> None:
        filled = store.fill(batch, provider, "text")
        failed = filled.errors.agg(F.count("*").alias("n"), F.min("embed_error").alias("error")).first()
        if failed.n:
            raise RuntimeError(f"{failed.n} texts of batch {number} could not be embedded: {failed.error}")
        rows = batch.select(*COLUMNS, F.when(~is_blank(F.col("text")), store.hash("text")).alias("hash"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), F.lit(number).alias("batch"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{output}/documents")
        LOG.info("%s: batch %d has %d documents, %d texts were embedded", documents, number, spark.read.parquet(f"{output}/documents").where(F.col("batch") == number).count(), filled.embedded)

    # A pattern: as a plain path a stream takes folders only, and a table may be a single file.
    pattern = documents if any(c in documents for c in "*?[{") else f"{documents.rstrip('/')[:-1]}[{documents.rstrip('/')[-1]}]"
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", settings["files_per_batch"]).parquet(pattern)
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{output}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    LOG.info("%s: %d batches so far", output, max((p["batchId"] for p in query.recentProgress), default=-1) + 1)
    return _output(spark, output, store, provider)


def _output(spark: SparkSession, output: str, store: VectorStore, provider: embedding.Provider | embedding.ExpressionProvider) -> DataFrame:
    rows = spark.read.schema("doc_id long, source string, lang string, hash string, n_chars long, batch long").parquet(f"{output}/documents")
    last = rows.groupBy("doc_id").agg(F.max(F.struct("batch", "source", "lang", "hash", "n_chars")).alias("r")).select("doc_id", "r.source", "r.lang", "r.hash", "r.n_chars")
    return last.join(store.known(provider), "hash", "left").select("doc_id", "source", "lang", "hash", "n_chars", "embedding")


if __name__ == "__main__":
    command(run, DEFAULTS, __doc__)
