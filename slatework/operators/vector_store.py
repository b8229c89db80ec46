"""Vectors by content: a text is embedded once, whatever its file, codebase or number of copies.

A vector's key is the hash of the text as it is embedded (cut to the width), and the provider. What is to be embedded is reduced to
distinct texts that have no vector yet by an anti-join, and only those reach the provider. The table is Parquet below one
folder, partitioned by provider and the hash's first digit, and only ever appended to: a row that is added again, by a
job that was repeated or by two at once, says the same as the first, and readers take one.
"""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatework.functions.ids import content_hash
from slatework.functions.text import is_blank, truncate
from slatework.scratch import materialize
from slatework.sources import embedding

SCHEMA = "hash string, embedding array<float>, provider string, bucket string"


@dataclass(frozen=True)
class Filled:
    """Texts that were embedded now, and hash and embed_error of those that could not be."""

    embedded: int
    errors: DataFrame


class VectorStore:
    """The vectors below one folder."""

    def __init__(self, spark: SparkSession, path: str, width: int = 4000):
        self.spark, self.path, self.width = spark, path.rstrip("/"), width

    def hash(self, column: str):
        """The key of a text: the hash of what is embedded of it."""
        return content_hash(truncate(F.col(column), self.width))

    def known(self, provider: embedding.Provider | embedding.ExpressionProvider) -> DataFrame:
        """hash and embedding of the provider's vectors."""
        try:
            rows = self.spark.read.schema(SCHEMA).parquet(self.path)
        except AnalysisException:
            rows = self.spark.createDataFrame([], SCHEMA)
        return rows.where(F.col("provider") == quote(provider.key, safe="")).groupBy("hash").agg(F.min("embedding").alias("embedding"))

    def fill(self, rows: DataFrame, provider: embedding.Provider | embedding.ExpressionProvider, column: str = "content") -> Filled:
        """Embed the distinct texts of ``rows`` that have no vector yet. Blank texts have none; texts that fail are asked for again by the next call."""
        texts = rows.where(~is_blank(F.col(column))).select(self.hash(column).alias("hash"), truncate(F.col(column), self.width).alias("text")).dropDuplicates(["hash"])
        new = texts.join(self.known(provider).select("hash"), "hash", "left_anti")
        new = materialize(embedding.embed(new, provider, "text", self.width).select("hash", "embedding", "embed_error"), "vectors")
        good = new.where("embed_error IS NULL")
        n = good.count()
        if n:
            placed = good.select("hash", "embedding", F.lit(quote(provider.key, safe="")).alias("provider"), F.substring("hash", 1, 1).alias("bucket"))
            placed.repartition("bucket").write.mode("append").partitionBy("provider", "bucket").parquet(self.path)
        return Filled(n, new.where("embed_error IS NOT NULL").select("hash", "embed_error"))

    def embed(self, rows: DataFrame, provider: embedding.Provider | embedding.ExpressionProvider, column: str = "content") -> DataFrame:
        """Add embedding and embed_error, as ``embedding.embed`` does: texts known by their hash are looked up, others embedded first."""
        held = materialize(rows.where(~is_blank(F.col(column))).withColumn("__hash", self.hash(column)), "to-embed")
        filled = self.fill(held, provider, column)
        found = held.join(self.known(provider).withColumnRenamed("hash", "__hash"), "__hash", "left")
        return found.join(filled.errors.withColumnRenamed("hash", "__hash"), "__hash", "left").drop("__hash")
