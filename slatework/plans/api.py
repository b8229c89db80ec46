"""The tool-level surface: what a client asks for, answered with DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatework import schema
from slatework.functions import text as T
from slatework.functions.ids import stable_id
from slatework.operators import change, graph, symbols
from slatework.operators.inverted_index import InvertedIndex
from slatework.operators.vector_store import VectorStore
from slatework.plans import retrieve as R
from slatework.plans.config import SearchConfig
from slatework.plans.registry import Registry
from slatework.scratch import materialize
from slatework.sources.embedding import ExpressionProvider, Provider, mock_provider, vector_of


class NotFound(LookupError):
    """The codebase is unknown or has no indexed rows."""


class Engine:
    """Search and administration over one table store: corpus, nodes, edges and files (a part per codebase), codebases."""

    def __init__(self, spark: SparkSession, path: str, config: SearchConfig = SearchConfig(), provider: Provider | ExpressionProvider | None = None):
        self.spark, self.config, self.provider = spark, config, provider or mock_provider()
        self.store = change.TableStore(spark, path)
        self.registry = Registry(self.store)
        self.vectors = VectorStore(spark, f"{self.store.path}/vectors")

    def corpus(self, codebase: str) -> DataFrame:
        """The indexed rows of a codebase; only its part is read."""
        if self.registry.get(codebase).isEmpty():
            raise NotFound(f"codebase {codebase!r} is not registered")
        rows = self.store.read_parts("corpus", codebase)
        if rows is None or rows.isEmpty():
            raise NotFound(f"codebase {codebase!r} is not indexed")
        return rows

    def index_path(self, codebase: str) -> str:
        """Where the inverted index of a codebase is kept."""
        return f"{self.store.path}/{self.store.part('index', codebase)}"

    def index(self, codebase: str) -> InvertedIndex | None:
        """The inverted index of a codebase, which its builds keep up; none before the first one."""
        path = self.index_path(codebase)
        return InvertedIndex(self.spark, path) if InvertedIndex.exists(self.spark, path) else None

    def insert(self, codebase: str, rows: DataFrame) -> int:
        """Append snippets (columns of the corpus; file_path, name and content at least) beside those of the files, without looking for equal ones; how many.

        They are embedded and indexed like others, and stay until their file is built anew.
        """
        rows = rows.withColumn("codebase_name", F.lit(codebase))
        for c, v in (("start_line", F.lit(1)), ("id", stable_id("codebase_name", "file_path", "start_line", "name", "content"))):
            rows = rows if c in rows.columns else rows.withColumn(c, v)
        held = materialize(schema.with_columns(self.vectors.embed(rows, self.provider).drop("embed_error"), schema.CORPUS), "inserted")
        corpus = self.store.append(self.store.part("corpus", codebase), held)
        index = self.index(codebase)
        if index is None:
            InvertedIndex.build(corpus, self.index_path(codebase), "id", "content", "file_path", analyser=self.config.analysis)
        else:
            index.refresh(corpus, held.select("file_path"), "id", "content", "file_path")
        return held.count()

    def search_symbols(self, query: str, codebase: str, limit: int = 10) -> DataFrame:
        """Symbols by name or path with a preview; files of the graph if that is the backend, or if nothing is found and fallback is on."""
        if self.config.backend == "tables":
            found = symbols.search(self.corpus(codebase), query, limit)
            shown = found.select("name", "snippet_type", "file_path", "start_line", "end_line", "match_type", "match_priority", T.preview(F.col("content")).alias("preview"))
            if not self.config.fallback or not shown.isEmpty():
                return shown
        return graph.name_search(self._part("nodes", codebase), codebase, query, limit)

    def retrieve(self, query: str, codebase: str, limit: int = 5, alpha: float | None = None, mode: str = "all") -> DataFrame:
        """Hybrid retrieval; the keyword branch reads the asked terms' blocks of the index. ``alpha`` (an extension) weighs the branches, ``mode`` wants all terms or any."""
        if self.config.backend != "tables":
            raise ValueError("retrieval needs the tables backend")
        weights = None if alpha is None else {"vector": alpha, "keyword": 1 - alpha}
        vector = vector_of(self.spark, self.provider, query)
        return R.retrieve(self.corpus(codebase), query, vector, limit, mode=mode, hybrid=self.config.hybrid, weights=weights, index=self.index(codebase))

    def explore(self, name: str, codebase: str, relation: str = "all") -> DataFrame:
        """Callers, callees, methods and imports around a name (an extension)."""
        return graph.neighbours(self._part("nodes", codebase), self._part("edges", codebase), name, relation)

    def _part(self, table: str, codebase: str) -> DataFrame:
        rows = self.store.read_parts(table, codebase)
        if rows is None:
            raise NotFound(f"codebase {codebase!r} has no {table}")
        return rows

    def graph_status(self) -> DataFrame:
        """Whether there is a graph, and its nodes."""
        if not self.store.exists("nodes"):
            return self.spark.createDataFrame([(False, 0)], "available boolean, nodes long")
        return self.store.read_parts("nodes").agg(F.count("*").alias("nodes")).select(F.lit(True).alias("available"), "nodes")

    def config_frame(self) -> DataFrame:
        """The settings in force."""
        return self.config.frame(self.spark)

    def query(self, sql: str) -> DataFrame:
        """SQL over the views nodes, edges and corpus."""
        for name in ("nodes", "edges", "corpus"):
            if self.store.exists(name):
                self.store.read_parts(name).createOrReplaceTempView(name)
        return self.spark.sql(sql)

    def statistics(self, codebase: str) -> DataFrame:
        """files, snippets, embeddings, corpus_rows of a codebase in one pass."""
        rows = self.corpus(codebase)
        return rows.agg(F.countDistinct("file_path").alias("files"), F.count("*").alias("snippets"), F.count_if(F.size("embedding") > 0).alias("embeddings"), F.count("*").alias("corpus_rows"))
