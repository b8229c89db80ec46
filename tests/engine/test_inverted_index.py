"""The stored index against the scan, over random queries, edits, empty shards and builds of the engine."""

import random
from glob import glob

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from slatework import schema
from slatework.operators import inverted_index, keyword
from slatework.operators.inverted_index import BLOCK, TOTALS, InvertedIndex
from slatework.plans import retrieve
from slatework.plans.api import Engine
from slatework.plans.config import SearchConfig
from slatework.sources.embedding import mock_provider
from slatework.streaming import incremental


def local(path):
    return path.removeprefix("file://")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="module")
def index(docs, tmp_path_factory):
    return InvertedIndex.build(docs, f"file://{tmp_path_factory.mktemp('index')}/i", shards=3)


def test_equals_the_scan(spark, docs, index):
    terms = [r.term for r in keyword.term_statistics(docs).orderBy(F.desc("df"), "term").collect()]
    rng = random.Random(1)
    for n in range(50):
        wanted = rng.sample(terms[: rng.choice((5, 60, len(terms)))], rng.randint(1, 4)) + (["nosuchword"] if n % 9 == 0 else [])
        k = rng.choice((1, 3, 20))
        assert index.top_k(wanted, k).collect() == keyword.bm25_top_k(docs, wanted, k).collect(), wanted
        if n % 3 == 0:
            want = keyword.top_k(keyword.ts_rank(docs, wanted), k, "doc_id").select("doc_id", "score").collect()
            assert index.top_k_all(wanted, k).collect() == want, wanted
    assert index.top_k([], 5).count() == index.top_k_all([], 5).count() == index.top_k(["nosuchword"], 5).count() == 0


def test_blocks_pass_over_what_cannot_count(spark, tmp_path):
    """A common term whose early blocks decide: the later ones are below the bound, and the result is the same."""
    rows = [(i, "common " * (20 if i % 40 == 0 else 1) + " ".join(f"w{i % 7}" for _ in range(i % 11)) + (" rare" if i % 50 == 0 else "")) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = InvertedIndex.build(docs, str(tmp_path / "i"), shards=2)
    for wanted in (["common"], ["common", "rare"]):
        assert index.top_k(wanted, 10).collect() == keyword.bm25_top_k(docs, wanted, 10).collect()
    idf, least = index.bounds(["common"], 10)
    blocks = index.rows.where("term = 'common'").select("max_tf", "min_len").collect()
    passed = [b for b in blocks if b.max_tf * 2.2 / (b.max_tf + 1.2 * (0.25 + 0.75 * b.min_len / index.mean)) < least["common"]]
    assert len(blocks) > 30 and len(passed) >= 0.7 * len(blocks)


def read_share(path, wanted):
    """Bytes of the row groups that may hold the terms, over all."""
    some = every = 0
    for f in glob(f"{local(path)}/blocks/shard=*/*.parquet"):
        meta = pq.read_metadata(f)
        at = [i for i in range(meta.num_columns) if meta.schema.column(i).path == "term"][0]
        for g in range(meta.num_row_groups):
            s, size = meta.row_group(g).column(at).statistics, meta.row_group(g).total_byte_size
            every += size
            some += size * any(s.min <= w <= s.max for w in wanted)
    return some / every


def test_reads_a_small_part(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/documents.parquet")
    shares = []
    for n, part in enumerate((docs.where("doc_id % 4 = 0"), docs)):
        index = InvertedIndex.build(part, str(tmp_path / f"i{n}"), shards=1)
        plan = index.top_k(["thing"], 5)._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [In(term, [thing])" in plan or "EqualTo(term,thing)" in plan
        shares.append(read_share(str(tmp_path / f"i{n}"), ["thing"]))
    assert shares[1] < 0.25 and shares[1] < shares[0]


def test_refresh_rewrites_one_shard(spark, tmp_path):
    rows = {i: f"alpha beta{i % 5} gamma{i}" for i in range(60)}
    make = lambda: spark.createDataFrame(sorted(rows.items()), "doc_id long, text string")
    path = str(tmp_path / "i")
    index = InvertedIndex.build(make(), path, shards=6)
    files = lambda: {f for f in glob(f"{path}/blocks/shard=*/*.parquet")}
    before = files()
    rows[7], touched = "alpha new words", [7]
    del rows[8]
    touched.append(8)
    rows[900] = None
    touched.append(900)
    index = index.refresh(make(), spark.createDataFrame([(i,) for i in touched], "doc_id long"))
    gone = before - files()
    assert 0 < len({f.split("shard=")[1][0] for f in gone}) <= 3 and before & files()
    for wanted in (["new"], ["alpha", "beta2"], ["gamma8"], ["gamma7"]):
        assert index.top_k(wanted, 5).collect() == keyword.bm25_top_k(make(), wanted, 5).collect()
    held = sorted(index.postings().collect())
    again = index.refresh(make(), spark.createDataFrame([(7,)], "doc_id long"))
    assert sorted(again.postings().collect()) == held
    rows.clear()
    empty = again.refresh(make(), spark.createDataFrame([(i,) for i in range(60)], "doc_id long"))
    assert empty.documents <= 1 and empty.shards == 6


def test_blocks_of_several_batches(spark, tmp_path):
    """Terms whose documents come in many batches, textual keys and a null one: blocks by falling weight, by key within."""
    rows = [(f"d{i:04d}" if i else None, "common " * (1 + i % 3) + f"w{i % 5} " * (i % 2) + f"own{i}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        index = InvertedIndex.build(docs, str(tmp_path / "i"), shards=2)
        held = index.rows.where("term = 'common'").select("shard", "block", "n", "max_tf", "min_tf", "max_len", "min_len", "postings", "places").orderBy("shard", "block").collect()
        want = keyword.postings(docs).select("term", "doc_id", "tf", "doc_len").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(index.postings().collect(), key=str) == sorted(want, key=str) and (index.documents, index.terms) == (600, sum(len(t.split()) for _, t in rows))
    for shard in (0, 1):
        blocks = [r for r in held if r.shard == shard]
        assert [r.block for r in blocks] == list(range(len(blocks))) and {len(r.postings) for r in blocks[:-1]} == {BLOCK}
        for r in blocks:
            tf, size = [x.tf for x in r.postings], [x.len for x in r.postings]
            assert (r.n, r.max_tf, r.min_tf, r.max_len, r.min_len) == (len(tf), max(tf), min(tf), max(size), min(size))
            assert [x.key or "" for x in r.postings] == sorted(x.key or "" for x in r.postings) and [len(x) for x in r.places] == tf
        weight = [[(-x.tf / (x.tf + x.len), x.key or "") for x in r.postings] for r in blocks]
        assert all(max(a) < min(b) for a, b in zip(weight, weight[1:]))


def test_slices_of_a_batch(monkeypatch):
    """A batch of many words is analysed in slices, with the same blocks."""
    texts = [["a"] * (i % 4) + [f"w{i % 3}"] * 2 for i in range(40)] + [[]]
    batch = pa.RecordBatch.from_arrays([pa.array([0] * 20 + [1] * 21, pa.int32()), pa.array(range(41)), pa.array(texts), pa.array([1] * 41)], ["shard", "key", "terms", "one"])
    blocks = []
    for words in (1 << 20, 7):
        monkeypatch.setattr(inverted_index, "WORDS", words)
        rows = pa.Table.from_batches(list(inverted_index._chunks("simple")(iter([batch])))).sort_by([("shard", "ascending"), ("term", "ascending")])
        made = inverted_index._cut(iter(rows.combine_chunks().to_batches(max_chunksize=3)))
        blocks.append(sorted((r for b in made for r in b.to_pylist()), key=lambda r: (r["shard"], r["term"])))
    assert blocks[0] == blocks[1] and sum(r["n"] for r in blocks[0] if r["term"] == TOTALS) == 41


def test_a_shard_is_bounded_by_its_text(spark, tmp_path, monkeypatch):
    """Shards follow the bytes of the texts, and each is made by a task of its own."""
    monkeypatch.setattr(inverted_index, "BYTES", 1000)
    docs = spark.createDataFrame([(i, "word " * 20) for i in range(100)], "doc_id long, text string")
    index = InvertedIndex.build(docs, str(tmp_path / "i"))
    assert index.shards == 10
    made = InvertedIndex._blocks(docs, 10, None, "doc_id", "text", None, "simple")
    assert made.select("shard", F.spark_partition_id().alias("p")).distinct().groupBy("p").count().where("count > 1").isEmpty()
    some = InvertedIndex._blocks(docs, 10, [7, 2, 9], "doc_id", "text", None, "simple")
    assert {(r.shard, r.p) for r in some.select("shard", F.spark_partition_id().alias("p")).distinct().collect()} == {(7, 0), (2, 1), (9, 2)}


def test_empty_and_odd_texts(spark, tmp_path):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "!!"), (4, "Éa éA x_1")], "doc_id long, text string")
    index = InvertedIndex.build(docs, str(tmp_path / "i"))
    assert (index.documents, index.terms, index.shards) == (4, 3, 1)
    assert [tuple(r) for r in index.top_k(["éa"], 5).collect()] == [tuple(r) for r in keyword.bm25_top_k(docs, ["éa"], 5).collect()]
    none = InvertedIndex.build(docs.limit(0), str(tmp_path / "none"))
    assert none.documents == 0 and none.top_k(["x"], 3).count() == 0 and none.rows.where(F.col("term") == TOTALS).count() == 1
    assert InvertedIndex.exists(spark, str(tmp_path / "none")) and not InvertedIndex.exists(spark, str(tmp_path / "nowhere"))


def test_engine_keeps_it_up(spark, tmp_path):
    tree = tmp_path / "tree"
    tree.mkdir()
    for i in range(6):
        (tree / f"m{i}.py").write_text(f"def parse_{i}(value):\n    return value + {i}\n\n\ndef render_{i}(page):\n    return parse_{i}(page)\n")
    engine = Engine(spark, str(tmp_path / "store"), SearchConfig(analysis="simple"), mock_provider(16))
    engine.registry.register(spark.createDataFrame([("demo", "org/demo")], "name string, github_repo string"))
    incremental.build(engine, "demo", str(tree))

    def same(query):
        corpus = engine.corpus("demo")
        for mode in ("any", "all"):
            got = engine.retrieve(query, "demo", 4, mode=mode)
            assert "inverted" not in got.columns
            vector = list(spark.range(1).select(engine.provider.expression(F.lit(query)).alias("v")).first()["v"])
            want = retrieve.retrieve(corpus, query, vector, 4, mode=mode)
            assert [(r.id, r.rrf_score) for r in got.collect()] == [(r.id, r.rrf_score) for r in want.collect()]

    same("return parse_3 page")
    (tree / "m3.py").write_text("def parse_three(value):\n    return value\n")
    (tree / "m4.py").unlink()
    (tree / "new.py").write_text("def parse_3(other):\n    return other\n")
    incremental.build(engine, "demo", str(tree))
    same("return parse_3 page")
    same("value")
    before = engine.corpus("demo").count()
    assert engine.index("demo").documents == before
    more = spark.createDataFrame([("m1.py", "note", "zebra in the margin"), ("m1.py", "note", "zebra in the margin")], "file_path string, name string, content string")
    assert engine.insert("demo", more) == 2 and engine.index("demo").documents == engine.corpus("demo").count() == before + 2
    assert "note" in {r.name for r in engine.retrieve("zebra", "demo", 4).collect()} and engine.corpus("demo").where("name = 'note' AND size(embedding) = 16").count() == 2


def test_uniqueness(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "a")], "id long, name string")
    assert schema.assert_unique(df, "id", "name") is df
    with pytest.raises(schema.NotUnique, match="id"):
        schema.assert_unique(df, "id")


def test_english(spark, tmp_path):
    texts = ["The parser parses what is parsed", "parsing of a sentence", "nothing of the kind", "A parse, and the parsers"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    index = InvertedIndex.build(docs, str(tmp_path / "e"), shards=2, analyser="english")
    stems = spark.createDataFrame([(0, "parser pars pars"), (1, "pars sentenc"), (2, "noth kind"), (3, "pars parser")], "doc_id long, text string")
    for asked, same in ((["parsing", "the"], ["pars"]), (["parsers", "sentences"], ["parser", "sentenc"])):
        assert index.top_k(asked, 9).collect() == keyword.bm25_top_k(stems, same, 9).collect()
    assert index.top_k(["the", "of"], 3).count() == 0 and (index.documents, index.terms) == (4, 9)
    # Places count stop words, as those of the whole text do.
    assert index.rows.where("term = 'pars'").selectExpr("inline(arrays_zip(postings, places))").selectExpr("postings.key", "places").orderBy("key").collect() == [(0, [3, 6]), (1, [1]), (3, [2])]
    assert sorted(map(tuple, index.statistics().collect())) == [("kind", 1, 1), ("noth", 1, 1), ("pars", 3, 4), ("parser", 2, 2), ("sentenc", 1, 1)]
    plan = index.statistics()._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan  # blocks are summed up as rows
    want = index.top_k(["parse"], 9).collect()
    again = InvertedIndex(spark, str(tmp_path / "e")).refresh(docs, spark.createDataFrame([(1,)], "doc_id long"))
    assert again.analyser == "english" and again.top_k(["parses"], 9).collect() == want
