"""A stored inverted index: posting blocks by shard and term, whose bounds let a search pass over what cannot count.

Documents are dealt to shards by a route (their key, or the file they come from). A shard is a partition folder sorted by
term, with the postings of a term in blocks of falling weight, by key within a block. A search reads the blocks' headers of the asked
terms first, which tell how often each is found and give a score that k documents reach for certain; then only the
blocks that can reach it. Parquet's row group and page statistics on the sorted terms leave the others unread. Changing a
document rewrites its shard alone, by dynamic partition overwrite. Everything is a DataFrame; no lists pass the driver but
a few hundred numbers per asked term.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slatework.functions.english import ANALYSERS
from slatework.functions.text import terms
from slatework.operators import keyword

#: Postings of a block.
BLOCK = 128
#: Steps in which block bounds are counted; a bound is rounded down to one.
GRAIN = 256
#: No term: the row that counts a shard's documents, so that a shard without documents still has one.
TOTALS = ""
#: Documents of a shard in large and in small corpora, and shards of small ones.
MOST, FEW, AT_LEAST = 50_000, 250, 16
#: Bytes of text of a shard in large corpora: a shard is made by one task.
BYTES = 16 << 20
#: Words that a task analyses at once.
WORDS = 1 << 20
#: Blocks a shard from which on a search looks at the best blocks first.
MANY = 8


def _bound(tf: Column, length: Column, mean: float) -> Column:
    """The part of a score that does not depend on the term."""
    return tf * (keyword.K1 + 1) / (tf + keyword.K1 * (1 - keyword.B + keyword.B * length / mean))


def _chunks(analyser: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """shard, term, keys, lens, places, n, total: a row for every term of some documents of a shard, and one that counts them; from batches of (shard, key, terms, one).

    Terms are analysed once per slice of WORDS words, by its dictionary. Places count all terms, lengths those that are indexed.
    """
    names = ["shard", "term", "keys", "lens", "places", "n", "total"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = ANALYSERS[analyser]
        for whole in batches:
            slices = np.cumsum(np.diff(whole.column(2).offsets.to_numpy())) // WORDS
            cuts = np.append(np.flatnonzero(np.diff(slices, prepend=-1)), whole.num_rows)
            for b in (whole.slice(x, y - x) for x, y in zip(cuts[:-1], cuts[1:])):
                lengths = np.diff(b.column(2).offsets.to_numpy())
                held = b.column(2).flatten().dictionary_encode()
                words: dict[str, int] = {}
                number = np.array([-1 if (w := kept(t)) is None else words.setdefault(w, len(words)) for t in held.dictionary.to_pylist()], np.int64)
                doc = np.repeat(np.arange(b.num_rows), lengths)
                code = number[held.indices.to_numpy()] if len(number) else np.zeros(0, np.int64)
                at = np.arange(len(doc)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + 1
                some = code >= 0
                doc, code, at = doc[some], code[some], at[some]
                size = np.bincount(doc, minlength=b.num_rows).astype(np.int32)
                shard = b.column(0).to_numpy().astype(np.int64)
                group = shard[doc] * max(1, len(words)) + code
                order = np.argsort(group * b.num_rows + doc, kind="stable")  # places stay ascending
                doc, group, at = doc[order], group[order], at[order]
                starts = np.flatnonzero((np.diff(group, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
                places = pa.ListArray.from_arrays(pa.array(np.append(starts, len(doc)).astype(np.int32)), pa.array(at.astype(np.int32)))
                doc, group = doc[starts], group[starts]
                firsts = np.flatnonzero(np.diff(group, prepend=-1))
                ends, group = pa.array(np.append(firsts, len(doc)).astype(np.int32)), group[firsts]
                lists = [pa.ListArray.from_arrays(ends, x) for x in (b.column(1).take(pa.array(doc)), pa.array(size[doc]), places)]
                found, none = pa.array(list(words), pa.string()).take(pa.array(group % max(1, len(words)))), pa.array(np.zeros(len(firsts), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array((group // max(1, len(words))).astype(np.int32)), found, *lists, none, none], names)
                of, row = np.unique(shard, return_inverse=True)
                sums = [pa.array(np.bincount(row, x, len(of)).astype(np.int64)) for x in (b.column(3).to_numpy(), size)]
                empty = [pa.array([[]] * len(of), x.type) for x in lists]
                yield pa.RecordBatch.from_arrays([pa.array(of.astype(np.int32)), pa.array([TOTALS] * len(of), pa.string()), *empty, *sums], names)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posting blocks and totals from rows of ``_chunks`` in order of shard and term. What is kept from batch to batch is one term of one shard."""
    rest: pa.RecordBatch | None = None
    for b in batches:
        b = pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0] if rest is not None and b.num_rows else b if rest is None else rest
        if b.num_rows:
            last = np.flatnonzero(_new_terms(b))[-1]
            if last:
                yield from _blocks_of(b.slice(0, last))
            rest = b.slice(last)
    if rest is not None:
        yield from _blocks_of(rest)


def _new_terms(b: pa.RecordBatch) -> np.ndarray:
    """Which rows have another shard or term than the one before."""
    return (np.diff(b.column(0).to_numpy(), prepend=-1) != 0) | (np.diff(b.column(1).dictionary_encode().indices.to_numpy(), prepend=-1) != 0)


def _blocks_of(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The blocks of whole terms: by falling weight, ties by key; within a block by key."""
    names = ["shard", "term", "block", "n", "max_tf", "min_tf", "max_len", "min_len", "postings", "places"]
    new = _new_terms(b)
    term, first = np.cumsum(new) - 1, np.flatnonzero(new)
    term = np.repeat(term, pa.compute.list_value_length(b.column(2)).to_numpy())
    keys, lens, places = (b.column(i).flatten() for i in (2, 3, 4))
    tf, size = pa.compute.list_value_length(places).to_numpy(), lens.to_numpy()
    rank = pa.compute.rank(keys, sort_keys="ascending", null_placement="at_start", tiebreaker="first").to_numpy().astype(np.int64)
    order = np.lexsort((rank, -(tf / (tf + size)), term))
    counts = np.bincount(term, minlength=len(first))
    block = np.empty(len(order), np.int64)
    block[order] = (np.arange(len(order)) - np.repeat(np.cumsum(counts) - counts, counts)) // BLOCK
    order = np.lexsort((rank, block, term))
    term, block, tf, size = term[order], block[order], tf[order], size[order]
    starts = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
    ends, at = pa.array(np.append(starts, len(term)).astype(np.int32)), pa.array(order)
    postings = pa.StructArray.from_arrays([keys.take(at), pa.array(tf.astype(np.int32)), pa.array(size.astype(np.int32))], ["key", "tf", "len"])
    lists = [pa.ListArray.from_arrays(ends, postings), pa.ListArray.from_arrays(ends, places.take(at))]
    if len(starts):
        rows = pa.array(first[term[starts]])
        bounds = [pa.array(f.reduceat(x, starts).astype(kind)) for x, kind in ((tf, np.int32), (size, np.int64)) for f in (np.maximum, np.minimum)]
        yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(block[starts].astype(np.int32)), pa.array(np.diff(np.append(starts, len(term)))), *bounds, *lists], names)
    rows = first[counts == 0]  # no postings: totals
    if len(rows):
        n, total = (pa.array(np.add.reduceat(b.column(i).to_numpy(), first)[counts == 0]) for i in (5, 6))
        none, zero = pa.array(np.zeros(len(rows), np.int32)), pa.array(np.zeros(len(rows), np.int64))
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), b.column(1).take(pa.array(rows)), none, n, none, none, total, zero, *[pa.array([[]] * len(rows), x.type) for x in lists]], names)


class InvertedIndex:
    """The index below one folder; ``build`` makes it, ``refresh`` keeps it up, the others search."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.rows = spark.read.parquet(f"{self.path}/blocks")
        found = self.rows.where(F.col("term") == TOTALS).agg(F.count("*"), F.sum("n"), F.sum("max_len")).first()  # one row a shard
        self.shards, self.documents, self.terms = found[0], found[1] or 0, found[2] or 0
        self.analyser = spark.read.parquet(f"{self.path}/made").first()["analyser"]

    @staticmethod
    def exists(spark: SparkSession, path: str) -> bool:
        """Whether a build has come to its end there."""
        try:
            return not spark.read.parquet(f"{path.rstrip('/')}/made").isEmpty()
        except AnalysisException:
            return False

    @property
    def mean(self) -> float:
        """Terms of a document."""
        return self.terms / self.documents if self.documents and self.terms else 1.0

    @staticmethod
    def _shard(route: Column, shards: int) -> Column:
        """Where the documents of a route are."""
        return F.pmod(F.xxhash64(route), F.lit(shards)).cast("int")

    @staticmethod
    def _blocks(docs: DataFrame, shards: int, only: list[int] | None, key: str, text: str, route: str | None, analyser: str) -> DataFrame:
        """The rows of the shards (all, or some): posting blocks and totals. One shuffle, of the texts by shard; a task has one shard, whose terms are sorted once."""
        rows = docs.select(InvertedIndex._shard(F.col(route or key), shards).alias("shard"), F.col(key).alias("key"), F.col(text).alias("text"), F.lit(1).cast("long").alias("one"))
        kind = rows.schema["key"].dataType.simpleString()
        nobody = docs.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"), F.lit(None).cast(kind).alias("key"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("one"))
        rows = rows.unionByName(nobody)
        if only is not None:
            rows = rows.where(F.col("shard").isin(only))
        task = F.col("shard") if only is None else (F.array_position(F.lit(only), F.col("shard")) - 1).cast("int")
        rows = rows.repartitionById(shards if only is None else len(only), task)
        chunks = rows.select("shard", "key", terms(F.col("text")).alias("terms"), "one").mapInArrow(_chunks(analyser), f"shard int, term string, keys array<{kind}>, lens array<int>, places array<array<int>>, n long, total long")
        made = f"shard int, term string, block int, n long, max_tf int, min_tf int, max_len long, min_len long, postings array<struct<key: {kind}, tf: int, len: int>>, places array<array<int>>"
        return chunks.sortWithinPartitions("shard", "term").mapInArrow(_cut, made)

    @staticmethod
    def _write(rows: DataFrame, path: str, mode: str) -> None:
        """``dynamic`` overwrites the shards that the rows have and leaves others, ``static`` all."""
        # Small row groups and pages, so that a term's blocks are a small part of what a file has.
        out = rows.sortWithinPartitions("shard", "term", "block").write.mode("overwrite")
        options = {"partitionOverwriteMode": mode, "parquet.block.size": 1 << 20, "parquet.page.size": 1 << 15}
        out.partitionBy("shard").options(**options).parquet(path)

    @classmethod
    def build(cls, docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", route: str | None = None, shards: int | None = None, analyser: str = "simple") -> InvertedIndex:
        """Index all rows, their terms as they are or (``english``) stems without stop words. Keys are distinct; null and empty texts count as documents without terms. ``shards`` follows the rows and their bytes if it is not given, and is fixed from then on."""
        if shards is None:
            n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
            shards = max(1, min(AT_LEAST, -(-n // FEW)), -(-n // MOST), -(-size // BYTES))
        cls._write(cls._blocks(docs, shards, None, key, text, route, analyser), f"{path.rstrip('/')}/blocks", "static")
        docs.sparkSession.range(1).select(F.lit(shards).alias("shards"), F.lit(analyser).alias("analyser")).write.mode("overwrite").parquet(f"{path.rstrip('/')}/made")
        return cls(docs.sparkSession, path)

    def refresh(self, docs: DataFrame, touched: DataFrame, key: str = "doc_id", text: str = "text", route: str | None = None) -> InvertedIndex:
        """Bring the shards of some routes (``touched``: a column of the route's name) up to what ``docs``, all documents, now are; others are neither read nor written.

        A shard is made anew from its documents, so doing it again after a failure gives the same. Objects opened before list files that
        are gone; open the index again.
        """
        name = route or key
        found = touched.select(self._shard(F.col(name), self.shards).alias("shard")).distinct()
        only = [r.shard for r in found.collect()]  # at most the number of shards
        if only:
            self._write(self._blocks(docs, self.shards, only, key, text, route, self.analyser), f"{self.path}/blocks", "dynamic")
        return InvertedIndex(self.spark, self.path)

    def postings(self) -> DataFrame:
        """term, key, tf, len of every document and term."""
        return self.rows.where(F.col("term") != TOTALS).select("term", F.inline("postings"))

    def statistics(self) -> DataFrame:
        """term, df and cf of all terms: a block is summed up in its row, so what is shuffled are blocks' sums."""
        counts = F.aggregate("postings.tf", F.lit(0).cast("long"), lambda s, tf: s + tf)
        rows = self.rows.where(F.col("term") != TOTALS).select("term", "n", counts.alias("cf"))
        return rows.groupBy("term").agg(F.sum("n").alias("df"), F.sum("cf").alias("cf"))

    def asked(self, wanted: list[str]) -> list[str]:
        """The distinct terms of a query as they are indexed."""
        return list(dict.fromkeys(w for t in wanted if (w := ANALYSERS[self.analyser](t)) is not None))

    def _headers(self, wanted: list[str]) -> dict[str, tuple[int, float, dict[int, int]]]:
        """By term: documents, largest bound, and documents by the step that their block reaches for certain."""
        mean, found = self.mean, self.rows.where(F.col("term").isin(wanted))
        sure = F.floor(_bound(F.col("min_tf"), F.col("max_len"), mean) * GRAIN).cast("int")
        steps = found.groupBy("term", sure.alias("step")).agg(F.sum("n").alias("n"), F.max(_bound(F.col("max_tf"), F.col("min_len"), mean)).alias("most")).collect()  # a few hundred rows a term
        out: dict[str, tuple[int, float, dict[int, int]]] = {}
        for r in steps:
            n, most, by_step = out.get(r.term, (0, 0.0, {}))
            out[r.term] = (n + r.n, max(most, r.most), by_step | {r.step: r.n})
        return out

    def bounds(self, wanted: list[str], k: int) -> tuple[dict[str, float], dict[str, float]]:
        """(idf by term, the least bound of a block that can hold one of the k best, by term)."""
        headers = self._headers(wanted)
        idf = {t: math.log(1 + (self.documents - n + 0.5) / (n + 0.5)) for t, (n, _, _) in headers.items()}
        reached = 0.0
        for t, (_, _, by_step) in headers.items():
            seen = 0
            for step in sorted(by_step, reverse=True):
                seen += by_step[step]
                if seen >= k:  # so many documents score that much by this term alone
                    reached = max(reached, idf[t] * step / GRAIN)
                    break
        if len(headers) > 1 and sum(n for n, _, _ in headers.values()) > MANY * BLOCK * self.shards:
            # What documents of the first blocks score in those is no more than their whole score.
            first = self._scores(idf, F.col("block") == 0, "key").orderBy(F.desc("score")).limit(k)
            least = first.agg(F.count("*"), F.min("score")).first()
            reached = max(reached, least[1]) if least[0] == k else reached
        total = sum(idf[t] * most for t, (_, most, _) in headers.items())
        # Others can add their largest part at most. Scores are compared to TIES digits, which is far below the slack.
        return idf, {t: (reached - 1e-6 - total + idf[t] * most) / max(idf[t], 1e-300) for t, (_, most, _) in headers.items()}

    def _scores(self, idf: dict[str, float], blocks: Column, key: str) -> DataFrame:
        """key, score by some blocks of the terms."""
        weight = F.lit(0.0)
        for t in idf:
            weight = F.when(F.col("term") == t, F.lit(idf[t])).otherwise(weight)
        held = self.rows.where(F.col("term").isin(list(idf)) & blocks).select(weight.alias("idf"), F.inline("postings"))
        return held.groupBy(F.col("key").alias(key)).agg(F.sum(F.col("idf") * _bound(F.col("tf"), F.col("len"), self.mean)).alias("score"))

    def top_k(self, wanted: list[str], k: int, key: str = "doc_id", digits: int | None = 4) -> DataFrame:
        """key, score of the k best documents by BM25 over any of the terms; the same as ``keyword.bm25_top_k`` over all documents, by analysed terms."""
        wanted = self.asked(wanted)
        idf, least = self.bounds(wanted, k) if wanted else ({}, {})
        some = F.lit(False)
        for t in idf:  # a document of a block left out is not among the best, so what it lacks elsewhere does not matter
            some = some | ((F.col("term") == t) & (_bound(F.col("max_tf"), F.col("min_len"), self.mean) >= least[t]))
        return keyword.top_k(self._scores(idf, some, key), k, key, digits=digits)

    def top_k_all(self, wanted: list[str], k: int, key: str = "doc_id", digits: int | None = 4) -> DataFrame:
        """key, score of the k best documents with all of the terms by text rank; the same as ``keyword.ts_rank`` over all documents, by analysed terms."""
        wanted = self.asked(wanted)
        held = self.rows.where(F.col("term").isin(wanted)).select("term", F.explode(F.arrays_zip("postings", "places")).alias("e"))
        held = held.select("term", F.col("e.postings.key").alias(key), F.col("e.places").alias("places"))
        found = held.groupBy(key).agg(F.count("*").alias("n"), *[F.max(F.when(F.col("term") == t, F.col("places"))).alias(f"p{i}") for i, t in enumerate(wanted)])
        found = found.where(F.col("n") == len(wanted)) if wanted else found.limit(0)
        score = keyword.rank_of_places([F.col(f"p{i}") for i in range(len(wanted))])
        return keyword.top_k(found.select(key, score.alias("score")), k, key, digits=digits)
