"""Sources, extraction, registry, incremental builds, graph and streaming."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from slatework.operators import change, extract, graph
from slatework.plans.api import Engine, NotFound
from slatework.plans.catalogue import QUERIES
from slatework.plans.config import SearchConfig
from slatework.plans.queries_graph import SOURCES as MARKED
from slatework.sources import embedding, files, repos
from slatework.streaming import incremental

SOURCES = {path: content.replace("§", "") for path, content in MARKED.items()}


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for path, content in {**SOURCES, "node_modules/x.js": "const a = 1", "lib/distance.py": "d = 1\n", "dist/out.py": "x = 1\n", ".hidden/y.py": "y = 1\n", "notes.md": "no"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(content)
    (root / "bad.py").write_bytes(b"x = '\xff'\n")
    return root


def test_scan(spark, tree):
    rows = {r.relative_path: r for r in files.scan(spark, str(tree)).collect()}
    assert set(rows) == {*SOURCES, "lib/distance.py", "bad.py"} and rows["lib/tool.rb"].language == "ruby"
    assert files.decode(files.scan(spark, str(tree))).where("relative_path = 'bad.py'").count() == 0
    assert files.decode(files.scan(spark, str(tree)), strict=False).where("relative_path = 'bad.py'").count() == 1


def snippets(source, kind):
    return {(s.snippet_type, s.name): s for s in kind(source)}


def test_python_rules():
    got = snippets(SOURCES["app/core.py"], extract.python_snippets)
    assert list(got) == [("import", ""), ("import", "app"), ("module_constant", "LIMIT"), ("function", "run"), ("function", "later"), ("function", "open"), ("function", "close"), ("class", "Box")]
    assert got[("function", "run")].start_line == 7 and got[("function", "run")].docstring == "Run it."
    box = got[("class", "Box")].content
    assert "# Methods:" in box and "def open(self):" in box and "return 1" not in box and "A box." in box
    assert snippets("class A: pass", extract.python_snippets)[("class", "A")].content == ""
    nested = [s.name for s in extract.python_all_functions("def a():\n    def b(): pass\nasync def c(): pass\n")]
    assert nested == ["a", "b"]


def test_script_and_ruby_rules():
    js = snippets(SOURCES["web/app.js"], extract.script_snippets)
    assert {("import", ""), ("function", "add"), ("module_constant", "RE"), ("function", "main"), ("function", "render"), ("class", "View")} == set(js)
    assert js[("function", "main")].end_line == 6 and "return x" not in js[("class", "View")].content
    rb = snippets(SOURCES["lib/tool.rb"], extract.ruby_snippets)
    assert {("import", "require"), ("module_constant", "LIMIT"), ("class", "Tools"), ("class", "Saw"), ("function", "cut"), ("function", "all"), ("function", "sql")} == set(rb)
    assert rb[("class", "Tools")].end_line == 14 and rb[("function", "cut")].end_line == 7


TSX = """import React, {useState} from "react";
// comment with { brace
interface Props<T> { a: string; b(): void }
export default class Panel extends React.Component<Props> {
  state = { open: false };
  private async load(id: string): Promise<void> {
    if (id) { for (const x of []) { call(x) } }
  }
  get value() { return 1 }
}
export const a = 1, b = (x: number): number => x + 1;
const c = function() { return 3 };
export function* gen() { yield 1 }
const Comp = async ({ id }) => {
  return <p>it's {id}</p>
}
module.exports = { a };
foo(function inner() { return 1 })
"""

RUBY = """class Foo < Bar
  include Baz
  def initialize(a) = @a = a
  def run(x)
    return 1 unless x
    while x do
      y = if x then 1 else 2 end
    end
    z = case x
        when 1 then 2
        end
    [1].map { |q| q }
  end
  class Inner
    def in; 1; end
  end
  private def self.make; new(1); end
end
def top(a)
  a.each do |x| puts x end
end
if VERSION
  def hidden; end
end
"""


def test_larger_sources():
    got = [(s.snippet_type, s.name, s.start_line, s.end_line) for s in extract.script_snippets(TSX)]
    assert got == [
        ("import", "", 1, 1), ("function", "load", 6, 8), ("function", "value", 9, 9), ("class", "Panel", 4, 10), ("module_constant", "a", 11, 11), ("function", "b", 11, 11),
        ("module_constant", "c", 12, 12), ("function", "gen", 13, 13), ("function", "Comp", 14, 16),
    ]
    got = [(s.snippet_type, s.name, s.start_line, s.end_line) for s in extract.ruby_snippets(RUBY)]
    assert got == [("function", "initialize", 3, 3), ("function", "run", 4, 13), ("function", "make", 17, 17), ("class", "Foo", 1, 18), ("function", "top", 19, 21)]


def test_extract_falls_back(spark):
    df = spark.createDataFrame([("a.py", "def ("), ("b.go", "package b"), ("c.py", None), ("d.py", " ")], "relative_path string, content string")
    got = {r.file_path: (r.snippet_type, r.name, r.error is not None) for r in extract.extract(df).collect()}
    assert got == {"a.py": ("file", "a", True), "b.go": ("file", "b", False)}


def test_registry(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"))
    r = engine.registry
    rows = spark.createDataFrame([("one", "org/one"), ("two", "org/two")], "name string, github_repo string")
    r.register(rows, enabled=False)
    assert r.set_enabled("one", True) and not r.set_enabled("none", True)
    r.set_commit("one", "a" * 40)
    r.register(spark.createDataFrame([("one", "org/moved")], "name string, github_repo string"), enabled=False)
    one = r.get("one").first()
    assert one.enabled and one.github_repo == "org/moved" and one.last_indexed_commit == "a" * 40 and one.main_branch_name == "main"
    assert r.record_error("two", "boom\nmore") and r.list().where("name = 'two'").first().sync_error == "boom"
    assert r.clear_error("two") and not r.clear_error("two")
    raw = repos.listing(spark, [json.dumps([{"name": "two", "full_name": "org/two"}, {"name": "new", "full_name": "org/new", "language": None}, {"name": "old", "archived": True}])])
    assert tuple(r.discover(repos.active_repos(raw), dry_run=True).first()) == (2, 1, 1) and r.get("new").isEmpty()
    r.discover(repos.active_repos(raw))
    assert not r.get("new").first().enabled and r.get("new").first().language == "mixed"
    assert {(x.name, x.found) for x in r.seed(["new", "absent"]).collect()} == {("new", True), ("absent", False)} and r.get("new").first().enabled
    assert r.delete("two") and not r.delete("two")


def test_build_and_search(spark, tree, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"))
    with pytest.raises(NotFound):
        engine.search_symbols("x", "demo")
    engine.registry.register(spark.createDataFrame([("demo", "org/demo")], "name string, github_repo string"))
    counts = lambda df: {r.status: r.files for r in df.collect()}
    assert counts(incremental.build(engine, "demo", str(tree), dry_run=True)) == {"new": 7} and not engine.store.exists("corpus")
    assert counts(incremental.build(engine, "demo", str(tree))) == {"new": 7}
    before = {r.id for r in engine.corpus("demo").collect()}
    assert counts(incremental.build(engine, "demo", str(tree))) == {"unchanged": 7} and {r.id for r in engine.corpus("demo").collect()} == before
    (tree / "app/util.py").write_text("def helper2(x):\n    return x\n")
    (tree / "main.go").unlink()
    assert counts(incremental.build(engine, "demo", str(tree))) == {"unchanged": 5, "changed": 1, "deleted": 1}
    names = {r.name for r in engine.corpus("demo").collect()}
    assert "helper2" in names and "helper" not in names and "main" in names
    assert engine.search_symbols("Box", "demo").first().match_type == "class"
    assert engine.search_symbols("core", "demo").first().match_type == "file"
    assert engine.retrieve("A box", "demo", 3).count() == 3 and engine.statistics("demo").first().files == 6
    assert {(r.relation, r.name) for r in engine.explore("open", "demo").collect()} == set()
    assert engine.graph_status().first().available and engine.query("SELECT count(*) AS n FROM edges WHERE type = 'IMPORTS'").first().n >= 1
    graph_engine = Engine(spark, str(tmp_path / "store"), SearchConfig(backend="graph"))
    assert graph_engine.search_symbols("saw", "demo").first().file == "lib/tool.rb"
    with pytest.raises(ValueError):
        graph_engine.retrieve("x", "demo")


class Flaky:
    """Fails for texts with a word until it is mended."""

    key = "flaky"

    def __init__(self, folder):
        self.folder = str(folder)

    def embed_batch(self, texts):
        import os

        if any("helper" in t for t in texts) and not os.path.exists(f"{self.folder}/mended"):
            raise ValueError("model is down")
        return [[1.0, float(len(t))] for t in texts]


def test_builds_write_only_what_changed(spark, tree, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"), provider=Flaky(tmp_path))
    for name in ("demo", "a/b c"):
        engine.registry.register(spark.createDataFrame([(name, f"org/{name}")], "name string, github_repo string"))
    counts = lambda df: {r.status: r.files for r in df.collect()}
    store, parts = engine.store, ("corpus", "nodes", "edges", "files")
    versions = lambda name: [store.versions(store.part(t, name)) for t in parts]
    first = counts(incremental.build(engine, "demo", str(tree)))
    assert first["new"] == 7 and first["failed"] >= 1
    failed = {r.relative_path: r.error for r in store.read_parts("failures").collect()}
    assert "app/util.py" in failed and "model is down" in failed["app/util.py"] and len(failed) == first["failed"]
    (tmp_path / "mended").write_text("")
    assert counts(incremental.build(engine, "demo", str(tree))) == {"unchanged": 7 - len(failed), "new": len(failed)}
    assert "helper" in {r.name for r in engine.corpus("demo").collect()} and store.read_parts("failures").count() == 0
    before = versions("demo")
    assert counts(incremental.build(engine, "demo", str(tree))) == {"unchanged": 7} and versions("demo") == before
    incremental.build(engine, "a/b c", str(tree))
    assert versions("demo") == before and engine.corpus("a/b c").count() == engine.corpus("demo").count()
    assert engine.graph_status().first().nodes == store.read_parts("nodes", "demo").count() + store.read_parts("nodes", "a/b c").count()
    for text in ("x = 1\n", "x = 2\n", "x = 3\n"):
        (tree / "app/util.py").write_text(text)
        incremental.build(engine, "demo", str(tree))
    assert [len(v) for v in versions("demo")] == [2] * 4


def test_live_build(spark, tree, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"))
    engine.registry.register(spark.createDataFrame([("demo", "org/demo")], "name string, github_repo string"))
    incremental.live(engine, "demo", str(tree), str(tmp_path / "ck")).awaitTermination()
    n = engine.corpus("demo").count()
    (tree / "app/more.py").write_text("def more():\n    return 1\n")
    incremental.live(engine, "demo", str(tree), str(tmp_path / "ck")).awaitTermination()
    assert engine.corpus("demo").count() == n + 1


def test_append(spark, tmp_path):
    store = change.TableStore(spark, str(tmp_path / "s"))
    rows = spark.range(3)
    assert store.append("t", rows).count() == 3 and store.append("t", rows).count() == 6 and store.append("t", spark.range(1)).count() == 7
    assert store.versions("t") == [1] and store.write("t", rows).count() == 3 and store.append("t", rows).count() == 6 and store.read("t", 1).count() == 7
    assert store.sweep("t", 1) == 1 and store.versions("t") == [2] and store.read("t").count() == 6


def test_http_provider(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            body = json.dumps({"embeddings": [[float(len(t)), 1.0] for t in asked["input"]]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    provider = embedding.provider_named("http", "m", {"SLATEWORK_EMBEDDING_URL": f"http://127.0.0.1:{server.server_port}"})
    rows = embedding.embed(spark.createDataFrame([(1, "abc"), (2, " "), (3, "abcdef")], "id int, content string"), provider).collect()
    server.shutdown()
    assert {(r.id, tuple(r.embedding), r.embed_error) for r in rows} == {(1, (3.0, 1.0), None), (3, (6.0, 1.0), None)}
    assert embedding.provider_named("mock").key == "mock-768" and len(embedding.vector_of(spark, embedding.mock_provider(5), "x")) == 5
    with pytest.raises(ValueError):
        embedding.provider_named("other")


def test_register_needs_a_repository(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"))
    with pytest.raises(ValueError):
        engine.registry.register(spark.createDataFrame([("x", " ")], "name string, github_repo string"))


def test_poll(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([(n, f"org/{n}") for n in ("fresh", "same", "down", "broken")], "name string, github_repo string")
    engine.registry.register(rows)
    engine.registry.set_commit("same", "c1")

    def sync(repo, name, branch):
        if name == "down":
            raise repos.SyncError("no route")
        return "c1", f"/w/{name}"

    run = lambda name, path: name != "broken"
    dry = incremental.poll(engine, sync, dry_run=True, build_one=run)
    assert dry["checked"] == 4 and engine.registry.get("down").first().last_sync_error is None
    assert incremental.poll(engine, sync, build_one=run) == {"checked": 4, "reindexed": 1, "skipped": 1, "failed": 2}
    state = {r.name: (r.last_indexed_commit, r.last_sync_error) for r in engine.registry.table().collect()}
    assert state == {"fresh": ("c1", None), "same": ("c1", None), "down": (None, "no route"), "broken": (None, None)}
    waits, before = [], len(engine.store.versions("codebases"))
    counts = list(incremental.keep_polling(engine, sync, 5.0, 2, waits.append, build_one=lambda name, path: True))
    assert [c["reindexed"] for c in counts] == [1, 0] and [c["failed"] for c in counts] == [1, 1] and waits == [5.0]
    assert len(engine.store.versions("codebases")) == before + 2  # a write per pass


def test_working_copy(tmp_path):
    git = lambda *a, cwd: subprocess.run(["git", "-c", "user.email=a@b", "-c", "user.name=n", *a], cwd=cwd, check=True, capture_output=True)
    origin = tmp_path / "origin"
    origin.mkdir()
    git("init", "-q", "-b", "main", cwd=origin)
    (origin / "a.txt").write_text("1")
    git("add", ".", cwd=origin)
    git("commit", "-qm", "one", cwd=origin)
    copy = str(tmp_path / "copies" / "one")
    first = repos.sync_working_copy(str(origin), copy)
    (tmp_path / "copies/one/a.txt").write_text("edited")
    (origin / "a.txt").write_text("2")
    git("commit", "-qam", "two", cwd=origin)
    second = repos.sync_working_copy(str(origin), copy)
    assert len(first) == 40 and first != second and (tmp_path / "copies/one/a.txt").read_text() == "2"
    with pytest.raises(repos.SyncError) as failed:
        repos.sync_working_copy(str(tmp_path / "nowhere"), str(tmp_path / "copies/two"), token="s3cret")
    assert "s3cret" not in str(failed.value) and repos.sync_working_copy(str(origin), copy, token="s3cret") == second
    assert "s3cret" not in "".join(f.read_text(errors="replace") for f in (tmp_path / "copies/one/.git").rglob("*") if f.is_file())


def test_listing_pages(spark, tmp_path):
    bodies = {"p1": ('[{"name": "a"}]', "p2"), "p2": ('[{"name": "b", "fork": true}]', None)}
    assert len(list(repos.pages(bodies.__getitem__, "p1"))) == 2
    assert repos.next_link('<https://x/2>; rel="next", <https://x/9>; rel="last"') == "https://x/2" and repos.next_link(None) is None
    asked = []
    answer = lambda url: (asked.append(url), (bodies["p1"][0], "next") if len(asked) == 1 else bodies["p2"])[1]
    assert [r.name for r in repos.list_organisation(spark, "an org", "t", fetch=answer).collect()] == ["a"]
    assert asked == ["https://api.github.com/orgs/an%20org/repos?per_page=100", "next"]
    (tmp_path / "pages.jsonl").write_text("\n".join(b for b, _ in bodies.values()))
    spark.dataSource.register(repos.ListingSource)
    assert repos.active_repos(spark.read.format("repo_listing").option("path", str(tmp_path / "pages.jsonl")).load()).count() == 1


def test_change_tables(spark, tmp_path):
    store = change.TableStore(spark, str(tmp_path / "s"))
    assert not store.exists("t")
    store.write("t", spark.createDataFrame([(1, "a", True), (2, "b", False)], "id long, v string, on boolean"))
    new = spark.createDataFrame([(2, "c", True), (3, None, True)], "id long, v string, on boolean")
    got = {tuple(r) for r in store.upsert("t", new, ["id"], preserve=["on"]).collect()}
    assert got == {(1, "a", True), (2, "c", False), (3, None, True)} and store.versions("t") == [1, 2] and store.read("t", 1).count() == 2
    assert change.update_where(store.read("t"), F.col("v") == "a", v=F.lit("z")).where("v = 'z'").count() == 1


def test_graph(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 5), (6, 7)], "src long, dst long")
    assert {tuple(r) for r in graph.mutual(links).collect()} == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3)} | {(5, 5)}
    assert {tuple(r) for r in graph.components(links).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 6), (7, 6)}
    assert {tuple(r) for r in graph.reachability(links, 2).collect()} == {(1, 2), (2, 3), (3, 1), (3, 4), (5, 5), (6, 7), (1, 3), (2, 1), (2, 4), (3, 2)}
    ring = spark.createDataFrame([(i, (i + 1) % 37) for i in range(37)] + [(36, 100), (100, 101)], "src long, dst long")
    assert graph.reachability(ring).count() == 37 * 37 + 37 * 2 + 1 and graph.mutual(ring).count() == 37 * 37
    assert graph.reachability(links.limit(0)).count() == 0 and graph.mutual(links.limit(0)).count() == 0
    assert graph.mutual(spark.createDataFrame([(i, i + 1) for i in range(12)], "src long, dst long")).count() == 0
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "src long, dst long")
    assert {r.component for r in graph.components(chain).collect()} == {0}


def test_config():
    env = {"SLATEWORK_BACKEND": "GRAPH", "SLATEWORK_HYBRID": "no", "SLATEWORK_FALLBACK": "True"}
    assert SearchConfig.from_env(env) == SearchConfig("graph", False, True) and SearchConfig.from_env({}) == SearchConfig()
    with pytest.raises(ValueError):
        SearchConfig("other")


def test_retries():
    calls, waits = [], []

    def flaky(texts):
        calls.append(1)
        if len(calls) < 3:
            raise TimeoutError
        return [[1.0]]

    assert embedding.with_retries(flaky, sleep=waits.append)(["x"]) == [[1.0]] and waits == [2.0, 4.0]
    with pytest.raises(KeyError):
        embedding.with_retries(lambda t: {}["x"])(["x"])


def test_stream(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    (root / "a.py").write_text("def a(): pass\n")
    seen = []

    def each(batch, number):
        seen.extend(r.name for r in extract.extract(batch.select(F.col("path").alias("relative_path"), F.col("content").cast("string").alias("content"))).collect())

    for extra in ("b", "c"):
        incremental.stream_files(spark, str(root), ".py", each, str(tmp_path / "ck")).awaitTermination()
        (root / f"{extra}.py").write_text(f"def {extra}(): pass\n")
    assert seen == ["a", "b"]


def test_index_metadata(spark, tmp_path):
    for name, values in (("b", {}), ("a", {"total_files_indexed": 3})):
        (tmp_path / f"{name}_metadata.json").write_text(json.dumps({"index_name": name, **values}))
    assert [(r.index_name, r.files_label) for r in files.index_metadata(spark, str(tmp_path)).collect()] == [("a", "3"), ("b", "N/A")]


def test_dimension_and_migration(spark):
    from slatework import schema

    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "id long, embedding array<float>")
    assert schema.assert_dimension(df, 2).count() == 2
    with pytest.raises(Exception, match="expected 3 components"):
        schema.assert_dimension(df, 3).collect()
    wide = schema.with_columns(df, "id int, note string, embedding array<double>")
    assert wide.dtypes == [("id", "int"), ("note", "string"), ("embedding", "array<double>")]


def test_percentiles_over_partitions(spark):
    import random

    from slatework.operators import analytics

    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), float(rng.randrange(60))) for _ in range(2000)] + [("c", None), ("d", 1.0)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.g: (r.p50, r.p99) for r in analytics.nearest_rank_by_count(spark.createDataFrame(rows, "g string, v double"), "g", "v", {"p50": 50, "p99": 99}).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g in ("a", "b", None, "d"):
        held = sorted(v for k, v in rows if k == g and v is not None)
        assert got[g] == tuple(held[min(int(len(held) * p / 100), len(held) - 1)] for p in (50, 99))
    assert len(got) == 4


def test_table_sizes(spark, tmp_path):
    spark.range(10).repartition(2).write.parquet(str(tmp_path / "t"))
    r = files.table_sizes(spark, {"t": str(tmp_path / "t")}).first()
    assert r.bytes > 500 and r.files >= 2


def test_load_report(spark):
    from slatework.operators import analytics

    rows = [(f"q{i}", float(i), 1.0, float(i), 2, i != 3) for i in range(1, 11)]
    r = analytics.load_report(spark.createDataFrame(rows, "query string, total_ms double, embed_ms double, search_ms double, result_count int, success boolean"), 2.0)
    one = r.first()
    good = sorted(x[1] for x in rows if x[5])
    assert (one.successful, one.failed, one.throughput_qps, one.error_rate) == (9, 1, 4.5, 0.1)
    assert one.total_p50_ms == good[min(int(9 * 50 / 100), 8)] and one.total_p99_ms == good[8]
    assert tuple(analytics.within_targets(r).first()) == (True, True, False)


def test_inverted_file_prunes(spark, sf, tmp_path):
    from slatework.operators import vector_search

    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    index = vector_search.InvertedFile.build(rows, str(tmp_path / "ivf"), cells=4)
    q = list(rows.first()["embedding"])
    assert index.corpus.count() == rows.count()
    exact = [r.vec_id for r in vector_search.top_k(rows, q, 5, threshold=None).collect()]
    assert [r.vec_id for r in index.top_k(q, 5, probes=4).collect()] == exact
    assert "PartitionFilters: [cell" in index.top_k(q, 5, probes=1)._jdf.queryExecution().executedPlan().toString().replace("isnotnull(cell#", "cell#")


def test_inverted_file_recall(spark, tmp_path):
    from slatework.operators import vector_search

    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    index = vector_search.InvertedFile.build(rows, str(tmp_path / "ivf"), cells=8)
    asked = [(r.vec_id, list(r.embedding)) for r in rows.where("vec_id % 100 = 0").collect()]
    exact = {(r.query_id, r.vec_id) for r in vector_search.batch_top_k(rows, asked, 10).collect()}
    recall = {}
    for probes in (4, 7, 8):
        found = {(r.query_id, r.vec_id) for r in index.batch_top_k(asked, 10, probes).collect()}
        recall[probes] = len(exact & found) / len(exact)
    assert len(exact) == 10 * len(asked) == 200 and recall[8] == 1 and recall[7] >= 0.9
    from slatework.plans.queries_search import ivf_recall

    assert tuple(ivf_recall(spark, "/root/testdata/sf0.1").first()) == (200, round(200 * recall[7]))


def test_sweep_and_scratch(spark):
    from slatework import scratch

    kept = scratch.materialize(spark.range(3), "probe")
    assert kept.count() == 3 and scratch.shared_dir(spark) in kept.inputFiles()[0].replace("file:///", "file:///")


def test_source_graph_parses_sources_once(spark, sf):
    """What the graph is made of is a table: no plan of it runs the extractor again."""
    found = QUERIES["source_graph"](spark, sf)
    assert "MapInPandas" not in found._jdf.queryExecution().optimizedPlan().toString() and found.count() > 0
