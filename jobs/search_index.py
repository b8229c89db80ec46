"""Keep the keyword index of a table of documents up to date.

    python -m jobs.search_index --documents hdfs:///corpus/documents --output hdfs:///index --config jobs/search_index.json

The first run indexes everything. Later runs compare the documents' hashes with those of the last run (the manifest) and
write only the shards in which a document is new, changed or gone; without any such document nothing is written. The
manifest of a shard follows its blocks, so a run that died is done again by the next one, with the same result.

Output: ``index/blocks`` (posting blocks, partitioned by shard) and ``manifest`` (key and hash, partitioned by shard), both
overwritten partition by partition. ``slatework.operators.inverted_index`` searches the index.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import LOG, command
from slatework.functions.ids import content_hash
from slatework.operators import change
from slatework.operators.inverted_index import InvertedIndex
from slatework.scratch import materialize

#: shards: 0 lets the first run choose by the number of documents.
DEFAULTS = {"key": "doc_id", "text": "text", "shards": 0}


def _manifest(spark: SparkSession, path: str, key: str, kind: str) -> DataFrame:
    """Key and hash of what was indexed; a row without a hash marks a shard."""
    try:
        rows = spark.read.schema(f"{key} {kind}, hash string, shard int").parquet(path)
    except AnalysisException:
        rows = spark.createDataFrame([], f"{key} {kind}, hash string, shard int")
    return rows.where("hash IS NOT NULL").select(key, "hash")


def run(spark: SparkSession, documents: str, output: str, settings: dict = DEFAULTS) -> DataFrame:
    """One run over the table at ``documents`` into ``output``; term, key, tf and len of the index as it then stands."""
    key, text, output = settings["key"], settings["text"], output.rstrip("/")
    index_path, manifest_path = f"{output}/index", f"{output}/manifest"
    docs = spark.read.parquet(documents).select(key, text)
    now = docs.select(key, F.coalesce(content_hash(F.col(text)), F.lit("-")).alias("hash"))
    known = _manifest(spark, manifest_path, key, docs.schema[key].dataType.simpleString())
    status = materialize(change.diff(now, known, key, "hash").where("status != 'unchanged'"), "index-status")
    counts = {r.status: r["count"] for r in status.groupBy("status").count().collect()}  # three rows at most
    LOG.info("%s: %s", documents, ", ".join(f"{n} {s}" for s, n in sorted(counts.items())) or "nothing new")
    made = InvertedIndex.exists(spark, index_path)
    if made and not counts:
        return _output(InvertedIndex(spark, index_path), key)
    if made:
        index = InvertedIndex(spark, index_path).refresh(docs, status, key, text)
    else:
        index = InvertedIndex.build(docs, index_path, key, text, shards=settings["shards"] or None)
    shard = F.pmod(F.xxhash64(key), F.lit(index.shards)).cast("int")
    touched = status.select(shard.alias("shard")).distinct() if made else spark.range(index.shards).select(F.col("id").cast("int").alias("shard"))
    touched = touched.select("shard").collect()  # at most the number of shards
    marks = spark.createDataFrame([(None, None, r.shard) for r in touched], f"{key} {docs.schema[key].dataType.simpleString()}, hash string, shard int")
    entries = now.withColumn("shard", shard).where(F.col("shard").isin([r.shard for r in touched])).unionByName(marks)
    entries.repartition("shard").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(manifest_path)
    LOG.info("%s: wrote %d of %d shards, which hold %d documents of %d terms", output, len(touched), index.shards, index.documents, index.terms)
    return _output(index, key)


def _output(index: InvertedIndex, key: str) -> DataFrame:
    return index.postings().select("term", F.col("key").alias(key), F.col("tf").cast("long").alias("tf"), F.col("len").cast("long").alias("len"))


if __name__ == "__main__":
    command(run, DEFAULTS, __doc__)
