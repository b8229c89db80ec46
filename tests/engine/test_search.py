"""Fusion, tokenising, ranking and retrieval semantics."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from slatework.functions import text as T
from slatework.functions import vectors
from slatework.operators import fusion, keyword, symbols, vector_search
from slatework.plans import retrieve


def ranked(spark, ids, **extra):
    return spark.createDataFrame([(i, n + 1, f"n{i}") for n, i in enumerate(ids)], "id long, rank int, name string")


def model(lists, k=60, weights=None, limit=10):
    score, first = {}, {}
    for name, ids in lists.items():
        for r, i in enumerate(ids, 1):
            score[i] = score.get(i, 0.0) + (weights or {}).get(name, 1.0) / (k + r)
            first.setdefault(i, len(first))
    return [(i, round(score[i], 6)) for i in sorted(score, key=lambda i: (-score[i], first[i]))][:limit]


def fused(spark, lists, **options):
    return [(r.id, r.rrf_score) for r in fusion.fuse({n: ranked(spark, ids) for n, ids in lists.items()}, "id", **options).collect()]


def test_fusion_facts(spark):
    assert {i for i, _ in fused(spark, {"bm25": [1, 2, 3], "vector": [3, 4, 1]})[:2]} == {1, 3}
    assert fused(spark, {"only": [7]}) == [(7, round(1 / 61, 6))]
    assert [i for i, _ in fused(spark, {"bm25": [1, 2], "vector": [2, 1]}, weights={"bm25": 2.0, "vector": 1.0})] == [1, 2]
    assert len(fused(spark, {"a": list(range(20))}, limit=5)) == 5
    assert fused(spark, {"src": []}) == []


@pytest.mark.parametrize("seed", range(4))
def test_fusion_random(spark, seed):
    rng = random.Random(seed)
    lists = {n: [rng.randrange(15) for _ in range(rng.randrange(12))] for n in ("a", "b", "c")}
    assert fused(spark, lists, limit=8) == model(lists, limit=8)


def test_fusion_keeps_first_source(spark):
    other = ranked(spark, [3, 1]).withColumn("name", F.lit("other"))
    rows = {r.id: r for r in fusion.fuse({"a": ranked(spark, [1, 2]), "b": other}, "id").collect()}
    assert (rows[1].name, rows[3].name, rows[1].sources) == ("n1", "other", "a+b")


def texts(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.x for r in df.select("i", f(F.col("t")).alias("x")).orderBy("i").collect()]


def test_identifier_parts(spark):
    values = ["add_embedding", "DatabaseManager", "HTMLParser", "pack.database", "my_module.DatabaseManager", "ab", "search", "def add_embedding(self, vec):", "FooBar foobar fooBar", None]
    got = texts(spark, values, T.with_identifier_parts)
    assert got[0] == "add_embedding\nadd embedding" and got[1].endswith("\ndatabase manager") and got[2].endswith("\nhtml parser")
    assert got[3].endswith("\npack database") and got[4].endswith("\nmy module database manager") and got[5] == "ab" and got[6] == "search"
    assert got[7].startswith(values[7]) and got[8].endswith("\nfoo bar") and got[9] is None


def test_sanitise_and_calls(spark):
    assert texts(spark, ["  a-b!c ", "!!"], T.sanitise) == ["a b c", ""]
    code = "def f(x):\n    # skip(this)\n    return g(h(x)) + obj.m(1)\n"
    calls = lambda literal: lambda c: T.calls(c, F.lit("python"), literal=literal)
    assert texts(spark, [code], calls(False)) == [["g", "h", "m"]] and texts(spark, [code], calls(True)) == [["f", "g", "m"]]
    assert texts(spark, ["x(1)"], lambda c: T.calls(c, F.lit("go"))) == [[]]


def test_mock_embedding(spark):
    value = int(hashlib.md5(b"abc").hexdigest(), 16)
    got = texts(spark, ["abc"], lambda c: vectors.mock_embedding(c, 200))[0]
    assert got == [(value >> i) % 2 - 0.5 if i < 128 else -0.5 for i in range(200)]


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, [-1.0, 0.0]), (5, None)], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in vector_search.top_k(df, [1.0, 0.0], 9).collect()] == [1, 2]
    assert [r.vec_id for r in vector_search.top_k(df, [1.0, 0.0], 9, threshold=0.5).collect()] == [1]
    near = spark.createDataFrame([(1, [1.0, 0.009]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in vector_search.top_k(near, [1.0, 0.0], 1).collect()] == [2]  # the exact match, though both show 1.0
    assert [(r.vec_id, r.similarity) for r in vector_search.batch_top_k(near, near.withColumnRenamed("vec_id", "query_id").where("query_id = 2"), 2).collect()] == [(2, 1.0), (1, 1.0)]
    batch = {(r.query_id, r.rank): r.vec_id for r in vector_search.batch_top_k(df, [(0, [1.0, 0.0]), (1, [0.0, 2.0])], 2).collect()}
    assert batch == {(0, 1): 1, (0, 2): 2, (1, 1): 2, (1, 2): 1}


def test_plans_stay_in_the_jvm(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    plan = keyword.top_k(keyword.bm25(docs, ["thing"]), 5, "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Python" not in plan and "SortMergeJoin" not in plan
    near = vector_search.top_k(spark.read.parquet(f"{sf}/embeddings.parquet"), [0.1] * 64, 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in near and "Python" not in near


def test_symbols(spark):
    rows = spark.createDataFrame([(1, "a/box.py", "open", "function"), (2, "b.py", "my_box", "class"), (3, "c.py", "myxbox", "function"), (4, "d.py", "MY_BOX", "import"), (5, None, None, "file")], "id long, file_path string, name string, snippet_type string")
    got = [(r.id, r.match_type, r.match_priority) for r in symbols.search(rows, "box", 9).collect()]
    assert got == [(1, "file", 1), (4, "content", 2), (2, "class", 2), (3, "function", 2)]
    assert [r.id for r in symbols.search(rows, "my_b", 9).collect()] == [4, 2] and symbols.search(rows, "%", 9).count() == 0


def test_retrieve(spark):
    rows = [(1, "alpha beta", [1.0, 0.0]), (2, "beta gamma", [0.9, 0.1]), (3, "delta", [0.0, 1.0])]
    corpus = spark.createDataFrame(rows, "id long, content string, embedding array<float>")
    found = retrieve.retrieve(corpus, "gamma", [1.0, 0.0], 3).collect()
    assert found[0].id == 2 and found[0].sources == "keyword+vector"
    assert [r.id for r in retrieve.retrieve(corpus, "nothing", [1.0, 0.0], 2).collect()] == [1, 2]
    assert [r.id for r in retrieve.retrieve(corpus, "gamma", [1.0, 0.0], 2, hybrid=False).collect()] == [1, 2]


def test_query_sets_in_blocks(spark, sf, monkeypatch):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    asked = rows.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    whole = {tuple(r) for r in vector_search.batch_top_k(rows, asked, 3).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    terms = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").cast("string").alias("query_id"), F.explode(T.query_terms(F.col("text"))).alias("term"))
    scored = {tuple(r) for r in keyword.batch_bm25(docs, terms, 2).collect()}
    monkeypatch.setattr(vector_search, "QUERY_BLOCK", 4)
    monkeypatch.setattr(keyword, "QUERY_BLOCK", 7)
    assert {tuple(r) for r in vector_search.batch_top_k(rows, asked, 3).collect()} == whole and len(whole) == 3 * asked.count()
    assert {tuple(r) for r in keyword.batch_bm25(docs, terms, 2).collect()} == scored


def test_nearest_keeps_a_bounded_part(spark):
    """Rows in many batches and slices, with ties, textual keys, zero and undefined vectors: the k best of a whole sort; a task passes on k rows a query."""
    rng = np.random.default_rng(3)
    rows = [(f"r{i:04d}", rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(900)] + [("zero", [0.0] * 4), ("nan", [float("nan")] * 4), ("none", None)]
    asked = [(q, rng.integers(1, 4, 4).astype(float).tolist()) for q in range(5)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        part = vector_search._nearest(df, asked, 7, "vec_id", "embedding").collect()
        got = {(r.query_id, r.rank): r.vec_id for r in vector_search.batch_top_k(df, asked, 7).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(part) == 3 * 7 * len(asked)
    cos = lambda a, b: round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 10)
    for q, v in asked:
        want = sorted((-cos(x, v), i) for i, x in rows if x is not None and np.isfinite(x).all() and any(x))[:7]
        assert [got[q, n + 1] for n in range(7)] == [i for _, i in want]
    best, least = vector_search._best(pa.table({"query": [0, 0, 1, 0], "k": ["b", "a", "c", "d"], "s": [0.5, 0.5, 0.1, 0.9]}), 2, np.full(2, -np.inf))
    assert best.to_pydict() == {"query": [0, 0, 1], "k": ["d", "a", "c"], "s": [0.9, 0.5, 0.1]} and least.tolist() == [0.5, -np.inf]
