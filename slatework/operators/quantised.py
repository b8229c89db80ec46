"""Product-quantised vectors: a few bytes a row are scanned, and only the candidates' vectors are read and compared exactly.

A vector of length one is cut into parts, and each part is replaced by the number of the nearest of 256 centroids that were
fitted on a bounded sample; every row is coded. A query's similarities to all centroids are a small table, and a row's estimate
is the sum of one entry per part. The best of each task and query are merged to the candidates, which are joined to their
vectors. Rows without a direction (null and zero vectors) are kept without a code and are never found, as in the exact search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slatework.functions import vectors
from slatework.operators import vector_search
from slatework.scratch import materialize

#: Centroids of a part: a code is a byte.
CODES = 256
#: Queries whose tables are sent to every task at once, and code rows that are compared with them at once.
QUERY_BLOCK, ROW_BLOCK = 512, 2048


def fit(rows: np.ndarray, parts: int, rounds: int, seed: int) -> np.ndarray:
    """Centroids of every part, (parts, CODES or fewer, dimension / parts), by k-means."""
    rng, size = np.random.default_rng(seed), rows.shape[1] // parts
    books = []
    for part in range(parts):
        x = rows[:, part * size : (part + 1) * size]
        book = x[rng.permutation(len(x))[:CODES]]
        for _ in range(rounds):
            near = nearest(x, book)
            counts = np.bincount(near, minlength=len(book))
            sums = np.zeros_like(book)
            np.add.at(sums, near, x)
            book = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], book)
        books.append(book)
    return np.stack(books)


def nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The nearest centroid of every row, in slices."""
    half = (book**2).sum(1) / 2
    return np.concatenate([(half - x[at : at + ROW_BLOCK] @ book.T).argmin(1) for at in range(0, len(x), ROW_BLOCK)]) if len(x) else np.zeros(0, int)


def _unit(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of length one, which rows have a direction)."""
    length = np.linalg.norm(rows, axis=1)
    good = np.isfinite(length) & (length > 0)
    return rows[good] / length[good][:, None], good


class QuantisedIndex:
    """Codes and vectors below one folder: ``codes`` (key, code), ``vectors`` (key, vector, in key order) and ``books`` (the centroids)."""

    def __init__(self, spark: SparkSession, path: str, key: str = "vec_id", column: str = "embedding"):
        self.spark, self.path, self.key, self.column = spark, path.rstrip("/"), key, column
        books = spark.read.parquet(f"{self.path}/books").orderBy("part").toPandas()["book"]  # CODES centroids a part
        self.books = np.stack([np.array([list(c) for c in b]) for b in books])
        self.codes, self.vectors = spark.read.parquet(f"{self.path}/codes"), spark.read.parquet(f"{self.path}/vectors")

    @classmethod
    def build(cls, corpus: DataFrame, path: str, parts: int | None = None, key: str = "vec_id", column: str = "embedding", most_rows: int = 20_000, rounds: int = 12, seed: int = 7) -> QuantisedIndex:
        """Code every row; centroids are fitted on at most ``most_rows`` rows. ``parts`` (default: a quarter of the dimension) divides the dimension."""
        spark, path = corpus.sparkSession, path.rstrip("/")
        sample = corpus.where(F.size(column) > 0).select(column).orderBy(F.xxhash64(F.col(column), F.lit(seed))).limit(most_rows).toPandas()[column]
        rows = _unit(np.array([list(v) for v in sample], np.float64))[0] if len(sample) else np.zeros((0, 1))
        rows = rows if len(rows) else np.ones((1, rows.shape[1]))
        parts = parts or max(1, rows.shape[1] // 4)
        if rows.shape[1] % parts:
            raise ValueError(f"{parts} parts do not divide {rows.shape[1]} components")
        books = fit(rows, parts, rounds, seed)
        size, dimension = rows.shape[1] // parts, rows.shape[1]

        @F.pandas_udf("binary")
        def code(v: pd.Series) -> pd.Series:
            out = pd.Series([None] * len(v), index=v.index, dtype=object)
            held = [i for i, x in enumerate(v) if x is not None and len(x) == dimension]
            unit, good = _unit(np.array([v.iloc[i] for i in held], np.float64).reshape(len(held), dimension))
            codes = np.stack([nearest(unit[:, p * size : (p + 1) * size], books[p]) for p in range(parts)], axis=1).astype(np.uint8) if len(unit) else []
            for i, c in zip(np.array(held)[good] if held else [], codes):
                out.iloc[i] = c.tobytes()
            return out

        corpus.select(key, code(F.col(column)).alias("code")).write.mode("overwrite").parquet(f"{path}/codes")
        # In key order and small row groups, so that few candidates are found by Parquet's statistics.
        corpus.select(key, column).repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").option("parquet.block.size", 1 << 20).parquet(f"{path}/vectors")
        spark.createDataFrame([(p, b.tolist()) for p, b in enumerate(books)], "part int, book array<array<double>>").coalesce(1).write.mode("overwrite").parquet(f"{path}/books")
        return cls(spark, path, key, column)

    def candidates(self, queries: list[tuple[int, list[float]]], n: int) -> DataFrame:
        """query_id and key of the ``n`` rows of best estimate of every query; one scan of the codes."""
        key, parts, size = self.key, len(self.books), self.books.shape[2]
        ids = np.array([q[0] for q in queries], np.int64)
        asked = np.array([q[1] for q in queries], np.float64)
        asked /= np.maximum(np.linalg.norm(asked, axis=1, keepdims=True), 1e-300)
        tables = np.stack([asked[:, p * size : (p + 1) * size] @ self.books[p].T for p in range(parts)]).astype(np.float32)  # (parts, queries, codes)
        kind = self.codes.schema[key].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, ROW_BLOCK):
                    some = b.slice(at, ROW_BLOCK)
                    codes = np.frombuffer(b"".join(some.column(1).to_pylist()), np.uint8).reshape(-1, parts)
                    estimate = np.zeros((len(ids), len(codes)), np.float32)
                    for p in range(parts):
                        estimate += tables[p][:, codes[:, p]]
                    best = np.argpartition(-estimate, min(n, len(codes)) - 1, axis=1)[:, :n] if len(codes) else np.zeros((len(ids), 0), int)
                    rows, of = best.ravel(), np.repeat(np.arange(len(ids)), best.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[of]), some.column(0).take(pa.array(rows)), pa.array(estimate[of, rows])], ["query_id", key, "estimate"])

        found = self.codes.where("code IS NOT NULL").select(key, "code").mapInArrow(run, f"query_id long, {key} {kind}, estimate float")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("estimate"), key))
        return found.withColumn("place", place).where(F.col("place") <= n).select("query_id", key)

    def batch_top_k(self, queries: vector_search.Queries, k: int, candidates: int, digits: int = 4) -> DataFrame:
        """query_id, key, similarity, rank of the k best of each query's ``candidates``, compared exactly; queries (query_id, vector) in blocks.

        With as many candidates as rows this is the exact search.
        """
        found = None
        for block in vector_search.blocks_of(queries, column=self.column):
            for at in range(0, len(block), QUERY_BLOCK):
                some = block[at : at + QUERY_BLOCK]
                asked = self.spark.createDataFrame([(i, [float(x) for x in v]) for i, v in some], "query_id long, asked array<double>")
                near = materialize(self.candidates(some, candidates), "candidates")
                rows = near.join(self.vectors, self.key).join(F.broadcast(asked), "query_id")  # QUERY_BLOCK vectors
                part = rows.select("query_id", self.key, vectors.cosine(F.col(self.column), F.col("asked")).alias("similarity"))
                found = part if found is None else found.unionByName(part)
        if found is None:
            found = self.codes.select(F.lit(0).cast("long").alias("query_id"), self.key, F.lit(0.0).alias("similarity")).limit(0)
        return vector_search._ranked(found, "query_id", self.key, k, digits)

    def top_k(self, query: list[float], k: int, candidates: int | None = None, digits: int | None = 4) -> DataFrame:
        """key and similarity of the k best; the candidates' vectors are found by their keys, which Parquet's statistics narrow down."""
        near = [r[1] for r in self.candidates([(0, query)], candidates or 20 * k).collect()]  # as many rows as candidates
        return vector_search.top_k(self.vectors.where(F.col(self.key).isin(near)), query, k, self.key, None, self.column, digits).select(self.key, "similarity")

    def share_read(self, pairs: int) -> float:
        """Bytes of codes, and of ``pairs`` vectors, over those of all vectors."""
        rows, dimension = self.codes.count(), self.books.shape[0] * self.books.shape[2]
        return (rows * len(self.books) + pairs * 4 * dimension) / max(1, rows * 4 * dimension)
