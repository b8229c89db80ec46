"""Vector search: exact top-k for one or many queries, and an inverted-file index for large corpora."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slatework.functions import vectors
from slatework.scratch import materialize

#: Digits by which similarities are compared: what differs less is noise of the order of sums.
TIES = 10


def similarities(corpus: DataFrame, query: list[float], threshold: float | None = 0.0, column: str = "embedding") -> DataFrame:
    """``corpus`` with the cosine to one query, unrounded; zero vectors have none and are dropped with the threshold."""
    scored = corpus.withColumn("similarity", vectors.cosine(F.col(column), vectors.literal(query)))
    return scored if threshold is None else scored.where(F.col("similarity") >= threshold)


def top_k(corpus: DataFrame, query: list[float], k: int, key: str = "vec_id", threshold: float | None = 0.0, column: str = "embedding", digits: int | None = 4) -> DataFrame:
    """The k nearest by cosine (but for noise below TIES digits), ties by key; the similarity shown is rounded if there are ``digits``.

    One scan, k rows a task, one merge; no shuffle.
    """
    found = similarities(corpus, query, threshold, column).orderBy(F.desc(F.round("similarity", TIES)), F.asc(key)).limit(k)
    return found.withColumn("similarity", F.round("similarity", digits)) if digits else found


def top_k_per_group(corpus: DataFrame, query: list[float], k: int, group: str, key: str = "vec_id", column: str = "embedding", digits: int = 4) -> DataFrame:
    """The k nearest within each group; the rank filter becomes a group limit before the shuffle."""
    found = similarities(corpus, query, None, column).select(group, key, "similarity")
    return _ranked(found, group, key, k, digits)


def _ranked(found: DataFrame, group: str, key: str, k: int, digits: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(F.round("similarity", TIES)), F.asc(key)))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("similarity", F.round("similarity", digits))


#: Query vectors that are sent to every task at once; more go in blocks.
QUERY_BLOCK = 4096
#: Similarities that a task computes at once.
CELLS = 1 << 20

Queries = DataFrame | list[tuple[int, list[float]]]


def blocks_of(queries: Queries, key: str = "query_id", column: str = "embedding") -> Iterator[list[tuple[int, list[float]]]]:
    """The queries (a DataFrame or a list) in blocks of about QUERY_BLOCK, of which one at a time is held by the driver."""
    if isinstance(queries, list):
        yield from (queries[at : at + QUERY_BLOCK] for at in range(0, len(queries), QUERY_BLOCK))
        return
    blocks = -(-queries.count() // QUERY_BLOCK)
    for block in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == block) if blocks > 1 else queries
        yield [(r[0], list(r[1])) for r in rows.select(key, column).collect()]


def batch_top_k(corpus: DataFrame, queries: Queries, k: int, key: str = "vec_id", column: str = "embedding", digits: int = 4) -> DataFrame:
    """query_id, key, similarity, rank of the k nearest of a stated query set, against all rows.

    Slices of rows are multiplied with a block of queries, of which a task keeps the k best rows a query, so what is
    shuffled is k rows per query and task, not every pair, and memory does not depend on either table. ``queries`` is a list, or a DataFrame with query_id and embedding of
    any size: beyond one block each block's result is written before the next one is read.
    """
    found = None
    for block in blocks_of(queries):
        part = _nearest(corpus, block, k, key, column)
        # More queries than a block are dealt by hash to blocks of over half its size.
        part = materialize(part, "block-nearest") if not isinstance(queries, list) and len(block) > QUERY_BLOCK // 2 else part
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = corpus.select(F.lit(0).cast("long").alias("query_id"), key, F.lit(0.0).alias("similarity")).limit(0)
    return _ranked(found, "query_id", key, k, digits)


def _nearest(corpus: DataFrame, queries: list[tuple[int, list[float]]], k: int, key: str, column: str) -> DataFrame:
    """query_id, key, similarity: the k nearest per query and task, from slices of rows with CELLS similarities at most."""
    kind = corpus.schema[key].dataType.simpleString()
    ids = np.array([q[0] for q in queries], np.int64)
    matrix = np.array([q[1] for q in queries], np.float64)
    matrix = (matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, best, least = max(1, CELLS // len(ids)), None, np.full(len(ids), -np.inf)
        for b in (b.slice(at, size) for b in batches for at in range(0, b.num_rows, size)):
            rows = np.vstack(b.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
            length = np.linalg.norm(rows, axis=1)
            sims = np.divide(rows @ matrix, length[:, None], out=np.full((len(rows), len(ids)), -np.inf), where=length[:, None] > 0)
            sims[~np.isfinite(sims)] = -np.inf
            shown = np.round(sims, TIES)
            if len(rows) >= k and np.isneginf(least).any():  # k rows of this slice are as good
                least = np.maximum(least, np.partition(shown, len(rows) - k, axis=0)[len(rows) - k])
            at_row, at_query = np.nonzero((shown >= least) & (shown > -np.inf))
            found = pa.table([pa.array(at_query), b.column(0).take(pa.array(at_row)), pa.array(sims[at_row, at_query])], ["query", key, "similarity"])
            best = found if best is None else pa.concat_tables([best, found])
            if best.num_rows > 2 * k * len(ids) + CELLS // 4:
                best, least = _best(best, k, least)
        if best is not None:
            best = _best(best, k, least)[0].combine_chunks()
            query, keys, similarity = (best.column(i).combine_chunks() for i in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(ids[query.to_numpy()]), keys, similarity], ["query_id", key, "similarity"])

    return corpus.where(F.col(column).isNotNull()).select(key, column).mapInArrow(run, f"query_id long, {key} {kind}, similarity double")


def _best(found: pa.Table, k: int, least: np.ndarray) -> tuple[pa.Table, np.ndarray]:
    """The k best rows of every query, ties by key, and what a row must have to be one of them."""
    query, shown = found.column(0).to_numpy(), np.round(found.column(2).to_numpy(), TIES)
    rank = pa.compute.rank(found.column(1), sort_keys="ascending", null_placement="at_start", tiebreaker="first").to_numpy()
    order = np.lexsort((rank, -shown, query))
    counts = np.bincount(query, minlength=len(least))
    place = np.arange(len(order)) - np.repeat(np.cumsum(counts) - counts, counts)
    last = order[place == k - 1]
    least = least.copy()
    least[query[last]] = shown[last]
    return found.take(pa.array(order[place < k])), least


class InvertedFile:
    """IVF: rows are filed by their nearest centroid, a query probes the cells nearest to it.

    Centroids are fitted on a bounded sample (``most_rows``), every row is filed. The table is partitioned by
    cell, so a probe is a literal partition filter that prunes files; probing all cells is the exact search.
    """

    def __init__(self, centroids: np.ndarray, path: str, corpus: DataFrame):
        self.centroids, self.path, self.corpus = centroids, path, corpus

    @classmethod
    def build(cls, corpus: DataFrame, path: str, cells: int = 16, most_rows: int = 20_000, rounds: int = 10, column: str = "embedding", seed: int = 7) -> InvertedFile:
        spark = corpus.sparkSession
        sample = corpus.where(F.size(column) > 0).select(column).orderBy(F.xxhash64(F.col(column), F.lit(seed))).limit(most_rows).toPandas()[column]
        rows = np.vstack(sample.to_numpy()).astype(np.float64) if len(sample) else np.zeros((0, 1))
        rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)
        rng = np.random.default_rng(seed)
        centroids = rows[rng.permutation(len(rows))[: min(cells, len(rows))]]
        for _ in range(rounds if len(rows) else 0):
            near = (rows @ centroids.T).argmax(1)
            sums = np.array([rows[near == c].sum(0) if (near == c).any() else centroids[c] for c in range(len(centroids))])
            centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-300)

        @F.pandas_udf("int")
        def cell(v):
            import pandas as pd

            out = np.full(len(v), -1, np.int32)  # rows without a vector are in no cell
            good = [i for i, x in enumerate(v) if x is not None and len(x) == centroids.shape[1]] if len(centroids) else []
            if good:
                out[good] = (np.vstack([v.iloc[i] for i in good]).astype(np.float64) @ centroids.T).argmax(1)
            return pd.Series(out, index=v.index)

        filed = corpus.withColumn("cell", cell(F.col(column)))
        filed.write.partitionBy("cell").parquet(path)
        return cls(centroids, path, spark.read.schema(filed.schema).parquet(path))

    def probe(self, query: list[float], cells: int) -> list[int]:
        """The cells nearest to a query."""
        if not len(self.centroids):
            return []
        q = np.asarray(query, np.float64)
        return np.argsort(-(self.centroids @ q), kind="stable")[:cells].tolist()

    def top_k(self, query: list[float], k: int, probes: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
        """The k nearest of the probed cells."""
        return top_k(self.corpus.where(F.col("cell").isin(self.probe(query, probes))), query, k, key, None, column)

    def batch_top_k(self, queries: Queries, k: int, probes: int, key: str = "vec_id", column: str = "embedding", digits: int = 4) -> DataFrame:
        """query_id, key, similarity, rank of the k nearest of each query's probed cells: one batch per block and cell."""
        found = None
        for block in blocks_of(queries):
            by_cell: dict[int, list[tuple[int, list[float]]]] = {}
            for q in block:
                for c in self.probe(q[1], probes):
                    by_cell.setdefault(c, []).append(q)
            for c, some in sorted(by_cell.items()):
                part = _nearest(self.corpus.where(F.col("cell") == c), some, k, key, column)
                found = part if found is None else found.unionByName(part)
        return _ranked(found, "query_id", key, k, digits)
