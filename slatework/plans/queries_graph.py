"""Queries: links, calls and imports, call graph, reachability, cycles, extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from slatework.functions import text as T
from slatework.operators import extract, graph, reach, strong
from slatework.plans.registered import Catalogue
from slatework.scratch import materialize
from slatework.session import table

CATALOGUE = Catalogue()
add = CATALOGUE.add

_HREF = 'href="([^"#]+)"'


@add(f"SELECT page_id, link, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '{_HREF}', 1)) AS link FROM pages) GROUP BY ALL")
def extract_links(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(_HREF), F.lit(1))).alias("link"))
    return rows.groupBy("page_id", "link").agg(F.count("*").alias("n"))


@add(f"""WITH l AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '{_HREF}', 1)) AS link FROM pages)
SELECT page_id AS src, link AS dst, n_pages FROM l JOIN (SELECT link, count(*) AS n_pages FROM l GROUP BY link) USING (link)""")
def link_edges(spark, sf_dir):
    """Edges from pages to what they link to, with how many pages do."""
    l = table(spark, sf_dir, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(_HREF), F.lit(1)))).alias("link"))  # noqa: E741
    return l.join(l.groupBy("link").agg(F.count("*").alias("n_pages")), "link").select(F.col("page_id").alias("src"), F.col("link").alias("dst"), "n_pages")


@add(r"""SELECT page_id, coalesce(string_agg(DISTINCT c, ',' ORDER BY c), '') AS calls FROM (SELECT page_id, unnest(CASE WHEN len(f) = 0 THEN [NULL] ELSE f END) AS c FROM (
SELECT page_id, list_filter(regexp_extract_all(regexp_extract(html, '<script>(.*?)</script>', 1), '(?:^|\s|\.|;|\()([a-zA-Z_$][a-zA-Z0-9_$]*)[ \t]*\(', 1), lambda x: x NOT IN ('if', 'for', 'while', 'return')) AS f FROM pages)) GROUP BY page_id""")
def call_extraction(spark, sf_dir):
    """Calls in the script of every page."""
    script = F.regexp_extract("html", "<script>(.*?)</script>", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(T.calls(script, F.lit("javascript")), ",").alias("calls"))


@add(r"""SELECT n_nationkey, 'os,pkg.mod' || CAST(n_nationkey AS VARCHAR) AS python_imports, './lib' || CAST(n_regionkey AS VARCHAR) AS script_imports FROM nation""")
def import_extraction(spark, sf_dir):
    k, r = F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")
    python = F.concat(F.lit("import os, sys\nfrom pkg.mod"), k, F.lit(" import x\n# import nothing\nimport os\n"))
    script = F.concat(F.lit("import {a} from './lib"), r, F.lit("'\nconst b = 1\n"))
    joined = lambda c, lang: F.array_join(T.imports(c, F.lit(lang)), ",")
    return table(spark, sf_dir, "nation").select("n_nationkey", joined(python, "python").alias("python_imports"), joined(script, "jsx").alias("script_imports"))


def _snippets(spark, sf_dir):
    """A code corpus made of parts: brand is the codebase, type the file, each part a function that calls two names."""
    k = F.col("p_partkey")
    name = F.concat(F.lit("f"), (k % 400).cast("string"))
    callees = [F.concat(F.lit("f"), ((k * m + 7) % 400).cast("string")) for m in (3, 5)]
    content = F.concat(F.lit("def "), name, F.lit("(x):\n    return "), callees[0], F.lit("("), callees[1], F.lit("(x))\n"))
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("codebase_name"), F.concat("p_type", F.lit(".py")).alias("file_path"), F.lit("function").alias("snippet_type"), name.alias("name"), content.alias("content"),
        F.lit("python").alias("language"), F.lit(None).cast("string").alias("docstring"),
    )


_FUNCTIONS = "fn AS (SELECT DISTINCT p_brand AS codebase, p_type || '.py' AS path, p_partkey % 400 AS k, (p_partkey * 3 + 7) % 400 AS c1, (p_partkey * 5 + 7) % 400 AS c2 FROM part)"
_CALLS = f"{_FUNCTIONS}, calls AS (SELECT codebase, path, k, c1 AS c FROM fn UNION SELECT codebase, path, k, c2 FROM fn), edges AS (SELECT DISTINCT a.codebase, a.path AS src_path, a.k AS src, b.path AS dst_path, b.k AS dst FROM calls a JOIN (SELECT DISTINCT codebase, path, k FROM fn) b ON a.codebase = b.codebase AND a.c = b.k)"


@add(f"WITH {_CALLS} SELECT src_path AS caller_path, 'f' || CAST(src AS VARCHAR) AS caller, dst_path AS callee_path, 'f' || CAST(dst AS VARCHAR) AS callee FROM edges WHERE codebase = 'Brand#2'")
def call_graph(spark, sf_dir):
    """Resolved calls of one codebase."""
    s = _snippets(spark, sf_dir)
    return graph.call_graph(graph.nodes(s), graph.call_edges(s), "Brand#2")


@add(f"WITH {_CALLS} SELECT relation, label, path, name FROM (SELECT DISTINCT 'callers' AS relation, 'Function' AS label, src_path AS path, 'f' || CAST(src AS VARCHAR) AS name, codebase FROM edges WHERE dst = 17 UNION SELECT DISTINCT 'callees', 'Function', dst_path, 'f' || CAST(dst AS VARCHAR), codebase FROM edges WHERE src = 17)")
def graph_callers_callees(spark, sf_dir):
    s = _snippets(spark, sf_dir)
    nodes, edges = graph.nodes(s), graph.call_edges(s)
    return graph.neighbours(nodes, edges, "f17", "callers").unionByName(graph.neighbours(nodes, edges, "f17", "callees"))


@add(f"""WITH {_FUNCTIONS} SELECT (SELECT count(DISTINCT path) FROM fn WHERE codebase = 'Brand#3') AS files, (SELECT count(*) FROM (SELECT DISTINCT path, k FROM fn WHERE codebase = 'Brand#3')) AS functions,
CAST(0 AS BIGINT) AS classes, (SELECT count(*) FROM (SELECT DISTINCT path, k FROM fn WHERE codebase = 'Brand#3')) AS relationships""")
def graph_statistics(spark, sf_dir):
    s = _snippets(spark, sf_dir)
    return graph.statistics(graph.nodes(s), graph.edges(s), "Brand#3")


@add(f"""WITH {_FUNCTIONS}, f AS (SELECT path, list_sort(list(DISTINCT 'f' || CAST(k AS VARCHAR))) AS names FROM fn WHERE codebase = 'Brand#2' GROUP BY path)
SELECT path AS file, array_to_string(list_filter(names, lambda x: contains(x, 'f11')), ',') AS matched, array_to_string(names, ',') AS all_functions FROM f WHERE len(list_filter(names, lambda x: contains(x, 'f11'))) > 0 ORDER BY path LIMIT 10""")
def graph_name_search(spark, sf_dir):
    found = graph.name_search(graph.nodes(_snippets(spark, sf_dir)), "Brand#2", "F11", 10)
    return found.select("file", F.array_join(F.transform("matched_functions", lambda x: x["name"]), ",").alias("matched"), F.array_join("all_functions", ",").alias("all_functions"))


def _ring(spark, sf_dir):
    """A digraph over nations: each points to two others."""
    n = F.col("n_nationkey").cast("long")
    rows = table(spark, sf_dir, "nation")
    first = rows.select(n.alias("src"), ((n * 2 + 1) % 29).alias("dst"))
    return first.unionByName(rows.where("n_nationkey % 3 = 0").select(n.alias("src"), ((n + 6) % 31).alias("dst"))).where("dst < 25")


_LINKS = "links AS (SELECT * FROM (SELECT CAST(n_nationkey AS BIGINT) AS src, CAST((n_nationkey * 2 + 1) % 29 AS BIGINT) AS dst FROM nation UNION SELECT CAST(n_nationkey AS BIGINT), CAST((n_nationkey + 6) % 31 AS BIGINT) FROM nation WHERE n_nationkey % 3 = 0) WHERE dst < 25)"
_CLOSURE = f"{_LINKS}, closure AS (SELECT src, dst FROM links UNION SELECT c.src, l.dst FROM closure c JOIN links l ON c.dst = l.src)"


@add(f"WITH RECURSIVE {_CLOSURE} SELECT src, dst FROM closure")
def graph_reachability(spark, sf_dir):
    return graph.reachability(_ring(spark, sf_dir))


@add(f"WITH RECURSIVE {_CLOSURE} SELECT a.src, a.dst FROM closure a JOIN closure b ON a.src = b.dst AND a.dst = b.src")
def graph_cycles(spark, sf_dir):
    """Nodes that reach each other: circular imports."""
    return graph.mutual(_ring(spark, sf_dir))


_NAMES = f"{_FUNCTIONS}, links AS (SELECT DISTINCT codebase, k AS src, c1 AS dst FROM fn UNION SELECT DISTINCT codebase, k, c2 FROM fn WHERE k % 3 > 0)"


def _calls_between_names(spark, sf_dir):
    """Which name calls which in a codebase made of parts: a name is a number beyond its codebase's."""
    k, brand = F.col("p_partkey").cast("long"), F.regexp_extract("p_brand", r"\d+", 0).cast("long") * 1000
    rows = table(spark, sf_dir, "part").withColumn("to", F.explode(F.array((k * 3 + 7) % 400, F.when(k % 400 % 3 > 0, (k * 5 + 7) % 400)))).where("to IS NOT NULL")
    return rows.select((brand + k % 400).alias("src"), (brand + F.col("to")).alias("dst")).distinct()


@add(f"""WITH RECURSIVE {_NAMES}, closure AS (SELECT codebase, src, dst FROM links UNION SELECT c.codebase, c.src, l.dst FROM closure c JOIN links l ON c.codebase = l.codebase AND c.dst = l.src),
nodes AS (SELECT codebase, src AS k FROM links UNION SELECT codebase, dst FROM links), circles AS (SELECT a.codebase, a.src AS k, min(a.dst) AS least FROM closure a JOIN closure b ON a.codebase = b.codebase AND a.src = b.dst AND a.dst = b.src GROUP BY ALL),
named AS (SELECT n.codebase, CAST(replace(n.codebase, 'Brand#', '') AS BIGINT) * 1000 AS base, n.k, coalesce(least(c.least, n.k), n.k) AS least FROM nodes n LEFT JOIN circles c ON n.codebase = c.codebase AND n.k = c.k),
inside AS (SELECT a.codebase, a.least, count(*) AS n_links FROM links l JOIN named a ON l.codebase = a.codebase AND l.src = a.k JOIN named b ON l.codebase = b.codebase AND l.dst = b.k AND a.least = b.least GROUP BY ALL)
SELECT base + n.least AS component, count(*) AS n_nodes, coalesce(any_value(i.n_links), 0) AS n_links FROM named n LEFT JOIN inside i USING (codebase, least) GROUP BY codebase, base, n.least""")
def graph_strong_classes(spark, sf_dir):
    """Strongly connected classes of calls, with their links."""
    return strong.classes(_calls_between_names(spark, sf_dir))


@add(f"""WITH RECURSIVE {_NAMES}, closure AS (SELECT codebase, src, dst FROM links UNION SELECT c.codebase, c.src, l.dst FROM closure c JOIN links l ON c.codebase = l.codebase AND c.dst = l.src),
asked AS (SELECT DISTINCT codebase, src, (src * 7 + 3) % 400 AS dst FROM links)
SELECT CAST(replace(codebase, 'Brand#', '') AS BIGINT) * 1000 + src AS src, CAST(replace(codebase, 'Brand#', '') AS BIGINT) * 1000 + dst AS dst, EXISTS (SELECT 1 FROM closure c WHERE c.codebase = asked.codebase AND c.src = asked.src AND c.dst = asked.dst) AS reachable FROM asked""")
def graph_reach_pairs(spark, sf_dir):
    """Whether a name leads to another by calls, by labels: one pair for every caller."""
    links = _calls_between_names(spark, sf_dir)
    base = F.floor(F.col("src") / 1000) * 1000
    asked = links.select("src", (base + ((F.col("src") - base) * 7 + 3) % 400).alias("dst"))
    return reach.Reach.build(links).pairs(asked)


@add(f"WITH RECURSIVE {_LINKS}, u AS (SELECT src, dst FROM links UNION SELECT dst, src FROM links), reach AS (SELECT src, dst FROM u UNION SELECT r.src, u.dst FROM reach r JOIN u ON r.dst = u.src) SELECT src AS node, least(src, min(dst)) AS component FROM reach GROUP BY src")
def graph_components(spark, sf_dir):
    return graph.components(_ring(spark, sf_dir))


@add("""SELECT r_name, n_name, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey GROUP BY ALL""")
def containment_path(spark, sf_dir):
    """A path of four inner joins."""
    r, n, c, o = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    joined = r.join(n, r.r_regionkey == n.n_regionkey).join(c, n.n_nationkey == c.c_nationkey).join(o, c.c_custkey == o.o_custkey)
    return joined.groupBy("r_name", "n_name").agg(F.countDistinct("c_custkey").alias("customers"), F.count("o_orderkey").alias("orders"))


#: The sources of one codebase for the extractor queries; every supplier is one, whose key stands for the mark.
SOURCES = {
    "app/core.py": 'import os\nfrom app import util\n\nLIMIT = 3\n\n\n@cached\ndef run§(x):\n    """Run it."""\n    return helper§(x)\n\n\nasync def later():\n    pass\n\n\nclass Box§:\n    """A box."""\n\n    def open(self):\n        return 1\n\n    def close(self):\n        return 2\n',
    "app/broken.py": "def nope(:\n",
    "app/util.py": "def helper§(x):\n    return x\n",
    "web/app.js": "import {a} from './lib'\nexport const add = (x, y) => x + y\nconst RE§ = /[{\"'\\/]/g\nfunction main§() {\n  if (a) { return `}${[1].map(x => `{${x}`)}` }\n}\nclass View§ extends Base {\n  render(x) {\n    return x.replace(/{/, '}')\n  }\n}\n",
    "lib/tool.rb": "require 'json'\nLIMIT = 5\nmodule Tools§\n  class Saw\n    def cut§(x)\n      x if x =~ /end if/\n    end\n  end\n  def self.all\n    [].each do |i|\n      %w[if end]\n    end\n  end\nend\n=begin\ndef no\n=end\ndef sql§\n  x = <<~SQL\n    select end from if\n  SQL\n  x\nend\n",
    "main.go": "package main\n",
}


def _sources(spark, sf_dir, suffix=""):
    """codebase_name, relative_path and content: the sources of every supplier."""
    files = F.explode(F.array(*[F.struct(F.lit(p).alias("path"), F.lit(c).alias("content")) for p, c in SOURCES.items() if p.endswith(suffix)]))
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("codebase_name"), files.alias("f"))
    return rows.select("codebase_name", F.concat("codebase_name", F.lit("/"), "f.path").alias("relative_path"), F.replace("f.content", F.lit("§"), F.col("codebase_name")).alias("content"))


def _spans(rows: str, failed: str = "") -> str:
    """SQL for the snippets of every supplier, read off SOURCES by hand."""
    columns = "file_path, snippet_type, name, start_line, end_line" + (", failed" if failed else "")
    return f"""SELECT CAST(s_suppkey AS VARCHAR) || '/' || file_path AS file_path, snippet_type, replace(name, '§', CAST(s_suppkey AS VARCHAR)) AS name, CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line{", failed" if failed else ""}
FROM supplier, (VALUES {rows}) AS t({columns})"""


_SHOWN = ["file_path", "snippet_type", "name", "start_line", "end_line"]


@add(_spans("""('app/broken.py', 'file', 'broken', 1, 2, TRUE), ('app/core.py', 'import', '', 1, 1, FALSE), ('app/core.py', 'import', 'app', 2, 2, FALSE), ('app/core.py', 'module_constant', 'LIMIT', 4, 4, FALSE), ('app/core.py', 'function', 'run§', 7, 10, FALSE),
('app/core.py', 'function', 'later', 13, 14, FALSE), ('app/core.py', 'function', 'open', 20, 21, FALSE), ('app/core.py', 'function', 'close', 23, 24, FALSE), ('app/core.py', 'class', 'Box§', 17, 17, FALSE), ('app/util.py', 'function', 'helper§', 1, 2, FALSE)""", "failed"))  # fmt: skip
def python_snippets(spark, sf_dir):
    return extract.extract(_sources(spark, sf_dir, ".py")).select(*_SHOWN, F.col("error").isNotNull().alias("failed"))


@add(_spans("('web/app.js', 'import', '', 1, 1), ('web/app.js', 'function', 'add', 2, 2), ('web/app.js', 'module_constant', 'RE§', 3, 3), ('web/app.js', 'function', 'main§', 4, 6), ('web/app.js', 'function', 'render', 8, 10), ('web/app.js', 'class', 'View§', 7, 11)"))
def script_snippets(spark, sf_dir):
    """Regular expressions and nested templates that hold brackets and quotes are no code."""
    return extract.extract(_sources(spark, sf_dir, ".js")).select(*_SHOWN)


@add(_spans("('lib/tool.rb', 'import', 'require', 1, 1), ('lib/tool.rb', 'module_constant', 'LIMIT', 2, 2), ('lib/tool.rb', 'class', 'Tools§', 3, 14), ('lib/tool.rb', 'class', 'Saw', 4, 8), ('lib/tool.rb', 'function', 'cut§', 5, 7), ('lib/tool.rb', 'function', 'all', 9, 13), ('lib/tool.rb', 'function', 'sql§', 18, 23)"))
def ruby_snippets(spark, sf_dir):
    """Heredocs, percent literals, regular expressions and =begin parts that hold keywords are no code."""
    return extract.extract(_sources(spark, sf_dir, ".rb")).select(*_SHOWN)


@add("SELECT CAST(s_suppkey AS VARCHAR) AS codebase_name, type, CAST(n AS BIGINT) AS n FROM supplier, (VALUES ('CONTAINS_FILE', 6), ('CONTAINS_FUNCTION', 11), ('CONTAINS_CLASS', 4), ('IMPORTS', 1), ('CALLS', 1)) AS t(type, n)")
def source_graph(spark, sf_dir):
    """Extraction to graph: edges by type of every supplier's sources."""
    sources = _sources(spark, sf_dir)
    rows = extract.extract(sources).withColumn("codebase_name", F.substring_index("file_path", "/", 1)).withColumn("file_path", F.expr("substring(file_path, instr(file_path, '/') + 1)"))
    rows = materialize(rows, "snippets")  # nodes and edges read them many times; sources are parsed once
    nodes = graph.nodes(rows).select(F.col("id").alias("src"), F.col("codebase").alias("codebase_name"))
    return graph.edges(rows).join(nodes, "src").groupBy("codebase_name", "type").agg(F.count("*").alias("n"))
