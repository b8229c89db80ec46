"""Keyword search: BM25 over any terms, text rank over all terms, and an inverted index.

A single query needs no index and no shuffle: term frequencies are counted in the row, the corpus
statistics are one row of sums, and top-k keeps k rows a task. Batches of queries join the index.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatework.functions.text import count_term, let, term_counts, terms
from slatework.scratch import materialize

#: Common BM25 defaults.
K1, B = 1.2, 0.75
#: Text rank: weight of an unlabelled position, the sum of 1/n^2, and the distance beyond which words are unrelated.
WEIGHT, ZETA, FAR = 0.1, 1.64493406685, 100
#: Digits by which scores are compared: what differs less is noise of the order of sums.
TIES = 10
#: Queries of a batch that are sent to every task at once, and documents that are multiplied with them at once.
QUERY_BLOCK, DOC_BLOCK = 512, 512


def any_term(text: Column, wanted: list[str]) -> Column:
    """Whether any of the terms occurs."""
    return F.arrays_overlap(terms(text), F.array(*[F.lit(w) for w in wanted]))


def all_terms(text: Column, wanted: list[str]) -> Column:
    """Whether every term occurs."""
    return F.size(F.array_intersect(F.array(*[F.lit(w) for w in dict.fromkeys(wanted)]), terms(text))) == len(set(wanted))


def bm25(docs: DataFrame, wanted: list[str], text: str = "text", scope: DataFrame | None = None) -> DataFrame:
    """``docs`` rows with any of the terms, and their score; statistics are those of ``scope`` (default: docs).

    idf = ln(1 + (N - df + 0.5) / (df + 0.5)). A query without terms finds nothing.
    """
    wanted = list(dict.fromkeys(wanted))
    if not wanted:
        return docs.withColumn("score", F.lit(None).cast("double")).limit(0)
    found = (scope if scope is not None else docs).select(terms(F.col(text)).alias("t"))
    sums = [F.count("*").alias("n"), F.avg(F.size("t")).alias("mean_len")]
    sums += [F.count_if(F.array_contains("t", w)).alias(f"df{i}") for i, w in enumerate(wanted)]
    stats = found.agg(*sums)  # one row
    # One pass over a text's terms leaves its length and the few terms that were asked for.
    kept = let(terms(F.col(text)), lambda t: F.struct(F.size(t).alias("len"), F.filter(t, lambda x: x.isin(wanted)).alias("hits")))
    joined = docs.withColumn("__kept", kept).where(F.size("__kept.hits") > 0).crossJoin(F.broadcast(stats))
    score = F.lit(0.0)
    for i in range(len(wanted)):
        score = score + _part(count_term(F.col("__kept.hits"), wanted[i]), F.col(f"df{i}"), F.col("__kept.len"), F.col("mean_len"))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], score.alias("score"))


def positions(terms_: Column, term: str) -> Column:
    """1-based places of a term."""
    marked = F.transform(terms_, lambda t, i: F.when(t == term, i + 1))
    return F.filter(marked, lambda i: i.isNotNull())


def ts_rank(docs: DataFrame, wanted: list[str], text: str = "text") -> DataFrame:
    """``docs`` rows with every term, and their rank.

    One term: the sum of 0.1 / n^2 over its n-th occurrences, over pi^2 / 6. Several: one minus the product over all
    pairs of places of different terms of one minus 0.1 times the root of their closeness.
    """
    wanted = list(dict.fromkeys(wanted))
    if not wanted:
        return docs.withColumn("score", F.lit(None).cast("double")).limit(0)
    held = docs.withColumn("__t", terms(F.col(text))).where(F.forall(F.array(*[F.lit(w) for w in wanted]), lambda w: F.array_contains("__t", w)))
    for i, w in enumerate(wanted):
        held = held.withColumn(f"__p{i}", positions(F.col("__t"), w))
    score = rank_of_places([F.col(f"__p{i}") for i in range(len(wanted))])
    return held.select(*[F.col(f"`{c}`") for c in docs.columns], score.alias("score"))


def rank_of_places(places: list[Column]) -> Column:
    """The text rank of a document in which each term has some places."""
    if len(places) == 1:
        return F.aggregate(F.sequence(F.lit(1), F.size(places[0])), F.lit(0.0), lambda s, j: s + WEIGHT / (j * j)) / ZETA
    missed = F.lit(1.0)
    for i in range(len(places)):
        for k in range(i):
            missed = _miss_pairs(missed, places[i], places[k])
    return 1 - missed


def _closeness(distance: Column) -> Column:
    near = 1.0 / (1.005 + 0.05 * F.exp(distance / 1.5 - 2))
    return F.sqrt(WEIGHT * WEIGHT * F.when(distance > FAR, F.lit(1e-30)).otherwise(near))


def _miss_pairs(start: Column, a: Column, b: Column) -> Column:
    def outer(s, x):
        return F.aggregate(b, s, lambda r, y: r * (1 - _closeness(F.abs(x - y))))

    return F.aggregate(a, start, outer)


def top_k(scored: DataFrame, k: int, key: str, score: str = "score", digits: int = 4) -> DataFrame:
    """The k best by unrounded score (but for noise below TIES digits), ties by key: k rows a task, then one merge. The score shown is rounded."""
    found = scored.orderBy(F.desc(F.round(score, TIES)), F.asc(key)).limit(k)
    return found.withColumn(score, F.round(score, digits)) if digits else found


def bm25_top_k(docs: DataFrame, wanted: list[str], k: int, key: str = "doc_id", text: str | tuple[str, ...] = "text", digits: int | None = 4) -> DataFrame:
    """key, score of the k best documents by BM25, with one pass over the texts; of several columns (a name or its content) scores add up.

    The pass leaves a row of a few numbers per document (a field's terms and how often each asked term occurs in it);
    statistics and scores are taken from those. A query without terms finds nothing.
    """
    wanted, fields = list(dict.fromkeys(wanted)), (text,) if isinstance(text, str) else text
    kept = lambda c: let(terms(F.col(c)), lambda t: F.struct(F.size(t).alias("len"), F.filter(t, lambda x: x.isin(wanted)).alias("hits")))
    rows = docs.select(F.col(key), *[kept(c).alias(f"kept{f}") for f, c in enumerate(fields)])
    counts = lambda f: F.array(*[count_term(F.col(f"kept{f}.hits"), w) for w in wanted]) if wanted else F.array().cast("array<int>")
    rows = rows.select(F.col(key), *[x for f in range(len(fields)) for x in (F.col(f"kept{f}.len").alias(f"len{f}"), counts(f).alias(f"tf{f}"))])
    rows = materialize(rows, "term-counts")
    cells = [(f, i, F.get(f"tf{f}", i)) for f in range(len(fields)) for i in range(len(wanted))]
    means = [F.avg(f"len{f}").alias(f"mean_len{f}") for f in range(len(fields))]
    stats = rows.agg(F.count("*").alias("n"), *means, *[F.count_if(x > 0).alias(f"df{f}_{i}") for f, i, x in cells])
    some = F.lit(False)
    for f in range(len(fields)):
        some = some | F.exists(f"tf{f}", lambda x: x > 0)
    found, score = rows.where(some).crossJoin(F.broadcast(stats)), F.lit(0.0)
    for f, i, x in cells:
        score = score + F.when(x > 0, _part(x, F.col(f"df{f}_{i}"), F.col(f"len{f}"), F.col(f"mean_len{f}"))).otherwise(0.0)
    return top_k(found.select(key, score.alias("score")), k, key, digits=digits)


def _part(tf: Column, df: Column, length: Column, mean: Column) -> Column:
    """What one term adds to a score; n is a column."""
    idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The inverted index: term, key, tf, doc_len. Terms are counted in the row, so nothing is shuffled; writers partition by term."""
    # Counted in a projection of its own: beside a generator it would be evaluated again for every term.
    rows = docs.select(F.col(key), F.size(terms(F.col(text))).alias("doc_len"), term_counts(F.col(text)).alias("cs"))
    return rows.select(F.col(key), "doc_len", F.explode("cs").alias("c")).select("c.term", F.col(key), "c.tf", "doc_len")


def term_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """term, df (documents), cf (occurrences), max_tf: batches sum up their own terms first, then one shuffle of those sums."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(0)
            if not len(lists.flatten()):
                continue
            held = lists.flatten().dictionary_encode()
            n = len(held.dictionary)
            cell = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())) * n + held.indices.to_numpy()
            cell, tf = np.unique(cell, return_counts=True)  # a cell is a document and a term
            term = cell % n
            order = np.argsort(term, kind="stable")
            starts = np.flatnonzero(np.diff(term[order], prepend=-1))
            most = np.maximum.reduceat(tf[order], starts)
            yield pa.RecordBatch.from_arrays([held.dictionary, *map(pa.array, (np.bincount(term, minlength=n), np.add.reduceat(tf[order], starts), most))], ["term", "df", "cf", "max_tf"])

    sums = docs.select(terms(F.col(text)).alias("t")).mapInArrow(count, "term string, df long, cf long, max_tf long")
    return sums.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"), F.max("max_tf").alias("max_tf"))


def batch_bm25(docs: DataFrame, queries: DataFrame, k: int, key: str = "doc_id", query_key: str = "query_id", text: str = "text", digits: int = 4) -> DataFrame:
    """query_key, key, score, rank of the k best documents of many queries (``queries``: query_key, term, distinct).

    A stated query set against all documents, in blocks of about QUERY_BLOCK queries, of which one at a time is held by the
    driver. A pass over the texts leaves the asked terms' counts of every document; then each batch of
    documents is multiplied with the block's queries and cut to k rows a query, so what is shuffled is k rows per query and task.
    """
    blocks = -(-queries.select(query_key).distinct().count() // QUERY_BLOCK) or 1
    held = docs.select(F.col(key), terms(F.col(text)).alias("terms"))
    found = None
    for block in range(blocks):
        some = queries.where(F.pmod(F.xxhash64(query_key), F.lit(blocks)) == block) if blocks > 1 else queries
        part = _score_block(held, some.select(query_key, "term").toPandas(), k, key, query_key, queries.schema[query_key].dataType.simpleString())
        part = materialize(part, "block-scores") if blocks > 1 else part
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc(F.round("score", TIES)), key))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("score", F.round("score", digits))


def _score_block(held: DataFrame, asked: pd.DataFrame, k: int, key: str, query_key: str, query_type: str) -> DataFrame:
    """query_key, key, score: the k best rows per query and batch."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    words, ids = sorted(set(asked["term"])), asked[query_key].drop_duplicates().tolist()
    at, row = {w: i for i, w in enumerate(words)}, {q: i for i, q in enumerate(ids)}
    wants = np.zeros((len(words), len(ids)), bool)
    wants[[at[w] for w in asked["term"]], [row[q] for q in asked[query_key]]] = True
    key_type = held.schema[key].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(words, pa.string())
        for b in batches:
            lists = b.column(1)
            lengths = np.diff(lists.offsets.to_numpy())
            found = pa.compute.index_in(lists.flatten(), known)
            some = np.flatnonzero(np.asarray(found.is_valid()))
            cell = np.repeat(np.arange(len(lengths)), lengths)[some] * len(words) + found.drop_null().to_numpy()
            cell, tf = np.unique(cell, return_counts=True)
            cuts = np.searchsorted(cell // max(1, len(words)), np.arange(len(lengths) + 1)).astype(np.int32)
            term = pa.ListArray.from_arrays(cuts, pa.array((cell % max(1, len(words))).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lengths.astype(np.int32)), term, pa.ListArray.from_arrays(cuts, pa.array(tf.astype(np.int32)))], [key, "len", "term", "tf"])

    counted = materialize(held.mapInArrow(count, f"{key} {key_type}, len int, term array<int>, tf array<int>"), "asked-terms")
    n, mean = counted.agg(F.count("*"), F.avg("len")).first()
    seen = counted.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toPandas()  # at most the block's terms
    df = np.zeros(len(words))
    df[seen["term"]] = seen["df"]
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    kind = to_arrow_type(_parse_datatype_string(query_type))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, DOC_BLOCK):
                c = b.slice(at, DOC_BLOCK)
                c = c.take(pa.compute.array_sort_indices(c.column(0)))  # by key, so that stable sorts settle ties
                term, tf = (c.column(i).flatten().to_numpy() for i in (2, 3))
                doc = np.repeat(np.arange(c.num_rows), np.asarray(pa.compute.list_value_length(c.column(2))))
                length = c.column(1).to_numpy()[doc]
                some, column = np.unique(term, return_inverse=True)  # only the words that these documents have
                weights = np.zeros((c.num_rows, len(some)))
                weights[doc, column] = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
                total = weights @ wants[some].astype(np.float64)
                order = np.argsort(-np.round(total, TIES), axis=0, kind="stable")[:k]
                at_doc, at_query = order.ravel(), np.tile(np.arange(len(ids)), len(order))
                hit = total[at_doc, at_query] > 0
                at_doc, at_query = at_doc[hit], at_query[hit]
                names = pa.array(ids, kind).take(pa.array(at_query))
                yield pa.RecordBatch.from_arrays([names, c.column(0).take(pa.array(at_doc)), pa.array(total[at_doc, at_query])], [query_key, key, "score"])

    return counted.mapInArrow(score, f"{query_key} {query_type}, {key} {key_type}, score double")


def expected_idf(n: int, df: int) -> float:
    """The idf in plain Python, for tests."""
    return math.log(1 + (n - df + 0.5) / (df + 0.5))
