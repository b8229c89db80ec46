"""Quantised vectors: recall over the stated queries, exactness with all candidates, rows without a direction, what is read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slatework.operators import vector_search
from slatework.operators.quantised import QuantisedIndex


@pytest.fixture(scope="module")
def rows(spark, sf):
    return spark.read.parquet(f"{sf.replace('0.001', '0.1')}/embeddings.parquet")


@pytest.fixture(scope="module")
def index(rows, tmp_path_factory):
    return QuantisedIndex.build(rows, f"file://{tmp_path_factory.mktemp('pq')}/i")


def test_recall_and_bytes(rows, index):
    asked = rows.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    exact = {(r.query_id, r.vec_id): r.similarity for r in vector_search.batch_top_k(rows, asked, 10).collect()}
    got = {(r.query_id, r.vec_id): r.similarity for r in index.batch_top_k(asked, 10, 20).collect()}
    assert len(exact) == 200 and len(set(exact) & set(got)) >= 180
    assert all(got[p] == exact[p] for p in set(exact) & set(got))  # what is found is compared exactly
    pairs = index.candidates([(r.query_id, list(r.embedding)) for r in asked.collect()], 20)
    assert index.share_read(pairs.select("vec_id").distinct().count()) <= 0.25 and index.share_read(20) <= 0.08
    every = index.batch_top_k(asked, 10, 2000)
    assert {(r.query_id, r.vec_id): r.similarity for r in every.collect()} == exact


def test_one_query(rows, index):
    q = list(rows.where("vec_id = 7").first()["embedding"])
    want = [r.vec_id for r in vector_search.top_k(rows, q, 10, threshold=None).collect()]
    found = index.top_k(q, 10)
    assert found.count() == 10 and found.first().vec_id == 7 and len({r.vec_id for r in found.collect()} & set(want)) >= 9
    assert "In(vec_id" in found._jdf.queryExecution().executedPlan().toString() or "InSet" in found._jdf.queryExecution().executedPlan().toString()


def test_rows_without_direction(spark, tmp_path):
    rng = np.random.default_rng(1)
    data = [(i, rng.normal(size=8).tolist()) for i in range(30)] + [(100, None), (101, [0.0] * 8), (102, []), (103, [float("nan")] * 8), (7, [1.0] * 8)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    index = QuantisedIndex.build(df, str(tmp_path / "i"), parts=4)
    assert index.codes.count() == len(data) and index.codes.where("code IS NULL").count() == 4
    found = index.batch_top_k([(5, data[5][1]), (6, data[6][1])], 3, 40).collect()
    assert [(r.query_id, r.vec_id) for r in found if r["rank"] == 1] == [(5, 5), (6, 6)] and not {r.vec_id for r in found} & {100, 101, 102, 103}
    empty = QuantisedIndex.build(df.limit(0), str(tmp_path / "none"))
    assert empty.batch_top_k([], 3, 5).count() == 0 and empty.codes.count() == 0
    with pytest.raises(ValueError):
        QuantisedIndex.build(df, str(tmp_path / "x"), parts=3)


def test_more_queries_than_a_block(rows, index, monkeypatch):
    monkeypatch.setattr("slatework.operators.quantised.QUERY_BLOCK", 7)
    asked = [(r.vec_id, list(r.embedding)) for r in rows.where("vec_id < 20").collect()]
    got = index.batch_top_k(asked, 1, 24)
    assert sorted((r.query_id, r.vec_id) for r in got.collect()) == [(i, i) for i in range(20)]
    assert got.where(F.col("rank") > 1).count() == 0


def test_inverted_file_without_vectors(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [])], "vec_id long, embedding array<float>")
    index = vector_search.InvertedFile.build(df, str(tmp_path / "ivf"), cells=2)
    assert index.corpus.count() == 4 and {r.vec_id for r in index.corpus.where("cell = -1").collect()} == {3, 4}
    assert [r.vec_id for r in index.top_k([1.0, 0.1], 1, 1).collect()] == [1]
    none = vector_search.InvertedFile.build(df.limit(0), str(tmp_path / "none"))
    assert none.corpus.count() == 0 and none.top_k([1.0, 0.1], 1, 1).count() == 0
