"""The jobs over input that grows, changes and fails, by their functions and by the command line."""

import logging
import os
import shutil
import subprocess
import sys
from glob import glob

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import embed_documents, queries, search_index
from jobs.common import settings
from slatework.operators import keyword
from slatework.operators.inverted_index import InvertedIndex
from slatework.operators.vector_store import VectorStore
from slatework.sources.embedding import mock_provider


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def row(i, text):
    return (i, text, "en", f"s{i % 2}", len(text or ""))


class Counting:
    """A provider that writes down what it is asked."""

    key = "counting"

    def __init__(self, folder, broken=False):
        self.folder, self.broken = str(folder), broken

    def embed_batch(self, texts):
        if self.broken and any("bad" in t for t in texts):
            raise ValueError("no")
        with open(f"{self.folder}/{os.getpid()}-{os.urandom(4).hex()}", "w") as f:
            f.write("\n".join(texts))
        return [[float(len(t)), 1.0] for t in texts]

    def asked(self):
        return sorted(line for f in glob(f"{self.folder}/*") for line in open(f).read().split("\n"))


@pytest.mark.parametrize("name", queries.QUERIES)
def test_queries_match_sql(name, spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    rel = con.sql(queries.ORACLES[name])
    df = queries.QUERIES[name](spark, sf)
    order = sorted(df.columns)
    assert sorted(rel.columns) == order
    assert sorted(repr([r[c] for c in order]) for r in df.collect()) == sorted(repr([r[rel.columns.index(c)] for c in order]) for r in rel.fetchall())


def test_embedding_takes_only_what_is_new(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO, "jobs")
    table, out, asked = str(tmp_path / "documents.parquet"), str(tmp_path / "out"), tmp_path / "asked"
    asked.mkdir()
    provider = Counting(asked)
    run = lambda: {r.doc_id: r for r in embed_documents.run(spark, table, out, provider=provider).collect()}
    documents(spark, [row(1, "one"), row(2, "two"), row(3, "one"), row(4, None), row(5, " \n")]).coalesce(1).write.parquet(table)
    first = run()
    assert provider.asked() == ["one", "two"] and set(first) == {1, 2, 3, 4, 5}
    assert first[1].embedding == first[3].embedding == [3.0, 1.0] and first[4].embedding is None and first[5].hash is None
    before = set(glob(f"{out}/*/**/*.parquet", recursive=True))
    assert run() == first and provider.asked() == ["one", "two"] and set(glob(f"{out}/*/**/*.parquet", recursive=True)) == before
    documents(spark, [row(6, "two"), row(7, "seven"), row(1, "one, again")]).coalesce(1).write.mode("append").parquet(table)
    second = run()
    assert provider.asked() == ["one", "one, again", "seven", "two"] and set(second) == set(first) | {6, 7}
    assert second[1].n_chars == 10 and second[6].hash == first[2].hash and second[2] == first[2]
    assert before < set(glob(f"{out}/*/**/*.parquet", recursive=True))
    said = [r.getMessage() for r in caplog.records]
    assert any("batch 0 has 5 documents, 2 texts" in s for s in said) and any("batch 1 has 3 documents, 2 texts" in s for s in said)


def test_embedding_fails_and_goes_on(spark, tmp_path):
    table, out, asked = str(tmp_path / "d.parquet"), str(tmp_path / "out"), tmp_path / "asked"
    asked.mkdir()
    documents(spark, [row(i, "bad one" if i == 8 else f"text {i}") for i in range(200)]).repartition(1).write.parquet(table)
    with pytest.raises(Exception, match="could not be embedded"):
        embed_documents.run(spark, table, out, provider=Counting(asked, broken=True))
    done = len(Counting(asked).asked())
    rows = embed_documents.run(spark, table, out, provider=Counting(asked)).collect()
    assert len(rows) == 200 and all(r.embedding for r in rows)
    assert 0 < done < 200 and len(Counting(asked).asked()) == 200  # what the first attempt had was not asked for again


def test_index_follows_the_documents(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO, "jobs")
    out = str(tmp_path / "out")
    rows = {i: f"alpha beta{i % 3} word{i}" for i in range(40)}
    chosen = search_index.DEFAULTS | {"shards": 8}

    def run(n):
        table = str(tmp_path / f"t{n}.parquet")
        documents(spark, [row(i, t) for i, t in sorted(rows.items())]).write.parquet(table)
        found = sorted(tuple(r) for r in search_index.run(spark, table, out, chosen).collect())
        docs = spark.read.parquet(table)
        assert found == sorted(tuple(r) for r in keyword.postings(docs).select("term", "doc_id", "tf", F.col("doc_len").cast("long")).collect())
        return docs, {f for f in glob(f"{out}/*/**/*.parquet", recursive=True)}

    _, first = run(0)
    _, again = run(1)
    assert again == first  # nothing new, nothing written
    rows[5], rows[100] = "alpha changed", None
    del rows[6]
    docs, third = run(2)
    kept = {f for f in first & third if "/shard=" in f}
    assert len({f.split("shard=")[1][0] for f in kept if "/blocks/" in f}) >= 5
    assert run(3)[1] == third
    index = InvertedIndex(spark, f"{out}/index")
    assert index.top_k(["alpha", "changed"], 3).collect() == keyword.bm25_top_k(docs, ["alpha", "changed"], 3).collect()
    said = [r.getMessage() for r in caplog.records]
    assert any("40 new" in s for s in said) and any("1 changed, 1 deleted, 1 new" in s for s in said) and sum("nothing new" in s for s in said) == 2
    rows.clear()
    rows[1] = "last"
    assert run(4)[1] and run(5)
    # A run that died before its manifest: the next one does the same again.
    shutil.rmtree(f"{out}/manifest")
    run(6)


def test_vectors_are_shared(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()
    store, provider = VectorStore(spark, str(tmp_path / "v"), width=5), Counting(asked)
    rows = spark.createDataFrame([(1, "same text"), (2, "same thing"), (3, "other"), (4, ""), (5, None)], "id long, content string")
    got = {r.id: r.embedding for r in store.embed(rows, provider).collect()}
    assert got == {1: [5.0, 1.0], 2: [5.0, 1.0], 3: [5.0, 1.0]} and provider.asked() == ["other", "same "]
    assert store.embed(rows, provider).count() == 3 and provider.asked() == ["other", "same "]
    other = store.embed(rows, mock_provider(4)).collect()  # another provider's vectors are its own
    assert {len(r.embedding) for r in other} == {4} and store.known(provider).count() == 2


def test_settings(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"shards": 4,\n "key": "id"}')
    assert settings(spark, str(tmp_path / "c.json"), search_index.DEFAULTS) == {"key": "id", "text": "text", "shards": 4}
    (tmp_path / "d.json").write_text('{"shard": 4}')
    with pytest.raises(ValueError, match="shard"):
        settings(spark, str(tmp_path / "d.json"), search_index.DEFAULTS)


@pytest.mark.parametrize("job", ["search_index", "embed_documents"])
def test_command_line(job, sf, tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = os.environ | {"PYTHONPATH": root, "PYSPARK_SUBMIT_ARGS": f"--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=4 --conf spark.checkpoint.dir=file://{tmp_path}/shared pyspark-shell"}
    done = subprocess.run([sys.executable, "-m", f"jobs.{job}", "--documents", f"{sf}/documents.parquet", "--output", f"{tmp_path}/out", "--config", f"{root}/jobs/{job}.json"], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "documents.parquet" in done.stderr and glob(f"{tmp_path}/out/*/**/*.parquet", recursive=True)
