"""Code graph as node and edge tables: building, call graphs, reachability, cycles, statistics, name search.

Nodes are keyed by (codebase, path) and (codebase, path, name), so equal paths in two codebases stay apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatework.functions import text as T
from slatework.functions.ids import stable_id
from slatework.operators import strong
from slatework.scratch import materialize


def last_write_wins(rows: DataFrame, keys: list[str], version: str | None = None) -> DataFrame:
    """One row per key, the one with the largest version (else the largest row): a node merge."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max(F.struct(*([F.col(version).alias("__version")] if version else []), *rest)).alias("b")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"b.{c}").alias(c) for c in rest])


def nodes(snippets: DataFrame) -> DataFrame:
    """id, label, codebase, path, name, language, signature, docstring from snippet rows.

    ``snippets``: codebase_name, file_path, snippet_type, name, content, language, docstring. One scan gives all labels.
    """
    base = [F.col("codebase_name").alias("codebase"), F.col("file_path").alias("path")]
    empty = F.lit(None).cast("string")
    files = snippets.select(F.lit("CodeFile").alias("label"), *base, empty.alias("name"), "language", empty.alias("signature"), empty.alias("docstring"))
    code = snippets.where(F.col("snippet_type").isin("function", "class")).select(
        F.when(F.col("snippet_type") == "function", "Function").otherwise("Class").alias("label"), *base, "name", "language",
        T.first_line(F.col("content"), 200).alias("signature"), F.substring("docstring", 1, 500).alias("docstring"),
    )
    roots = snippets.select(F.lit("Codebase").alias("label"), F.col("codebase_name").alias("codebase"), empty.alias("path"), empty.alias("name"), empty.alias("language"), empty.alias("signature"), empty.alias("docstring"))
    keys = ["label", "codebase", "path", "name"]
    merged = last_write_wins(files.unionByName(code).unionByName(roots), keys)
    return merged.select(stable_id(*[F.coalesce(F.col(k), F.lit("")) for k in keys]).alias("id"), *merged.columns)


def _id(label: str, codebase: Column, path: Column | None = None, name: Column | None = None) -> Column:
    blank = F.lit("")
    parts = [F.lit(label), codebase, path if path is not None else blank, name if name is not None else blank]
    return stable_id(*[F.coalesce(p, blank) for p in parts])


def containment(snippets: DataFrame) -> DataFrame:
    """CONTAINS_FILE, CONTAINS_FUNCTION and CONTAINS_CLASS edges (src, dst, type, module)."""
    c, p, n = F.col("codebase_name"), F.col("file_path"), F.col("name")
    none = F.lit(None).cast("string").alias("module")
    files = snippets.select(_id("Codebase", c).alias("src"), _id("CodeFile", c, p).alias("dst"), F.lit("CONTAINS_FILE").alias("type"), none)
    functions = snippets.where("snippet_type = 'function'").select(_id("CodeFile", c, p).alias("src"), _id("Function", c, p, n).alias("dst"), F.lit("CONTAINS_FUNCTION").alias("type"), none)
    classes = snippets.where("snippet_type = 'class'").select(_id("CodeFile", c, p).alias("src"), _id("Class", c, p, n).alias("dst"), F.lit("CONTAINS_CLASS").alias("type"), none)
    return files.unionByName(functions).unionByName(classes).distinct()


def call_edges(snippets: DataFrame, scope: str = "codebase", literal: bool = False) -> DataFrame:
    """CALLS edges: called names resolved to functions by bare name, in the codebase or (``global``) anywhere."""
    functions = snippets.where("snippet_type = 'function'")
    calls = functions.select(F.col("codebase_name").alias("codebase"), "file_path", "name", F.explode(T.calls(F.col("content"), F.col("language"), F.col("name"), literal)).alias("callee"))
    target = functions.select(F.col("codebase_name").alias("to_codebase"), F.col("file_path").alias("to_path"), F.col("name").alias("callee")).distinct()
    joined = calls.join(target, "callee")
    if scope == "codebase":
        joined = joined.where(F.col("codebase") == F.col("to_codebase"))
    src = _id("Function", F.col("codebase"), F.col("file_path"), F.col("name"))
    dst = _id("Function", F.col("to_codebase"), F.col("to_path"), F.col("callee"))
    return joined.select(src.alias("src"), dst.alias("dst"), F.lit("CALLS").alias("type"), F.lit(None).cast("string").alias("module")).distinct()


def import_edges(snippets: DataFrame) -> DataFrame:
    """IMPORTS edges between files of a codebase: a module is resolved to the file whose path it spells.

    Dotted modules are matched to path endings (with or without a package file), script modules to their last part, names that
    are imported from a package to its modules. A file imports files of its own language; all script languages are one.
    """
    kind = F.when(F.col("language").isin(*T.SCRIPT_LANGUAGES), "script").otherwise(F.col("language")).alias("kind")
    modules = F.array_union(T.imports(F.col("content"), F.col("language")), T.imported_names(F.col("content"), F.col("language")))
    found = snippets.where("snippet_type = 'import'").select(F.col("codebase_name").alias("codebase"), F.col("file_path").alias("path"), kind, F.explode(modules).alias("module"))
    files = snippets.select(F.col("codebase_name").alias("codebase"), F.col("file_path").alias("to_path"), kind).distinct()
    bare = F.regexp_replace(F.regexp_replace("to_path", r"\.[^./]+$", ""), r"/(__init__|index)$", "")
    parts = F.split(bare, "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    spelled = files.select("codebase", "kind", "to_path", F.explode(ends).alias("spelling"))
    spelling = F.regexp_replace(F.regexp_replace("module", r"^[./]+", ""), "/", ".")
    joined = found.withColumn("spelling", spelling).join(spelled, ["codebase", "kind", "spelling"]).where("path != to_path")
    c = F.col("codebase")
    return joined.select(_id("CodeFile", c, F.col("path")).alias("src"), _id("CodeFile", c, F.col("to_path")).alias("dst"), F.lit("IMPORTS").alias("type"), "module").distinct()


def edges(snippets: DataFrame, scope: str = "codebase") -> DataFrame:
    """All edges of a corpus."""
    return containment(snippets).unionByName(call_edges(snippets, scope)).unionByName(import_edges(snippets))


def of_codebase(nodes_: DataFrame, codebase: str) -> DataFrame:
    """The nodes of one codebase."""
    return nodes_.where(F.col("codebase") == codebase)


def clear(nodes_: DataFrame, edges_: DataFrame, codebase: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without a codebase; edges that touch it go too."""
    gone = of_codebase(nodes_, codebase).select("id")
    kept = nodes_.join(gone, "id", "left_anti")
    left = edges_.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return kept, left


def call_graph(nodes_: DataFrame, edges_: DataFrame, codebase: str) -> DataFrame:
    """caller_path, caller, callee_path, callee of one codebase's functions; callees may be anywhere."""
    caller = of_codebase(nodes_, codebase).select(F.col("id").alias("src"), F.col("path").alias("caller_path"), F.col("name").alias("caller"))
    callee = nodes_.select(F.col("id").alias("dst"), F.col("path").alias("callee_path"), F.col("name").alias("callee"))
    return edges_.where("type = 'CALLS'").join(caller, "src").join(callee, "dst").select("caller_path", "caller", "callee_path", "callee")


def neighbours(nodes_: DataFrame, edges_: DataFrame, name: str, relation: str = "all") -> DataFrame:
    """relation, label, path, name around the nodes of a name: callers, callees, methods, imports or all."""
    start = nodes_.where((F.col("name") == name) | (F.col("path") == name)).select("id")
    other = nodes_.select(F.col("id").alias("other"), "label", "path", "name")
    ways = {
        "callers": ("CALLS", "dst", "src"),
        "callees": ("CALLS", "src", "dst"),
        "methods": ("CONTAINS_FUNCTION", "src", "dst"),
        "imports": ("IMPORTS", "src", "dst"),
    }
    out = None
    for way, (kind, here, there) in ways.items():
        if relation in (way, "all"):
            rows = edges_.where(F.col("type") == kind).join(start, F.col(here) == start["id"], "left_semi").select(F.col(there).alias("other")).distinct()
            rows = rows.join(other, "other").select(F.lit(way).alias("relation"), "label", "path", "name")
            out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError(f"unknown relation {relation}")
    return out


def reachability(links: DataFrame, most_steps: int | None = None) -> DataFrame:
    """All pairs (src, dst) with a path of one step or more, or of ``most_steps`` at most.

    Semi-naive: each round extends only the pairs found last, by all known paths, so paths double in length; with a
    bound on steps by one step a round.
    """
    links = known = fresh = materialize(links.select("src", "dst").distinct(), "closure")
    rounds = 1
    while not fresh.isEmpty() and (most_steps is None or rounds < most_steps):
        onwards = known if most_steps is None else links
        step = fresh.select("src", F.col("dst").alias("mid")).join(onwards.select(F.col("src").alias("mid"), F.col("dst")), "mid").select("src", "dst").distinct()
        fresh = materialize(step.join(known, ["src", "dst"], "left_anti"), "closure")
        known = known.unionByName(fresh)
        rounds += 1
    return known


def mutual(links: DataFrame) -> DataFrame:
    """Distinct pairs that reach each other: circular imports. Includes (a, a) where a lies on a cycle.

    The pairs of every strongly connected class, of which a class of n nodes has n * n; ``strong.classes`` has the classes alone.
    """
    found = strong.components(links)
    circles = strong.classes(links, found).where("n_links > 0").select("component")
    inside = materialize(found.join(circles, "component", "left_semi"), "circles")
    return inside.select(F.col("node").alias("src"), "component").join(inside.select(F.col("node").alias("dst"), "component"), "component").select("src", "dst")


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest node reachable in either direction): linear in the edges where closure is quadratic."""
    both = links.select(F.col("src").alias("u"), F.col("dst").alias("v")).unionByName(links.select(F.col("dst").alias("u"), F.col("src").alias("v"))).distinct()
    both = materialize(both, "links")
    labels = materialize(both.select(F.col("u").alias("node")).distinct().withColumn("component", F.col("node")), "components")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), F.col("component").alias("c")), "v").groupBy(F.col("u").alias("node")).agg(F.min("c").alias("c"))
        moved = labels.join(near, "node").select("node", "component", F.least("component", "c").alias("c"))
        # Follow the new label one step, so long chains shrink by halves.
        jump = moved.select(F.col("node").alias("c"), F.col("c").alias("cc"))
        nxt = moved.join(jump, "c", "left").select("node", F.col("component").alias("old"), F.least("c", F.coalesce("cc", "c")).alias("component"))
        nxt = materialize(nxt, "components")
        if nxt.where("old != component").isEmpty():
            return nxt.select("node", "component")
        labels = nxt.select("node", "component")


def statistics(nodes_: DataFrame, edges_: DataFrame, codebase: str) -> DataFrame:
    """files, functions, classes, and outgoing relationships of the files, in one row."""
    own = of_codebase(nodes_, codebase)
    counts = own.agg(*[F.count_if(F.col("label") == label).alias(name) for label, name in (("CodeFile", "files"), ("Function", "functions"), ("Class", "classes"))])
    out = edges_.join(own.where("label = 'CodeFile'").select(F.col("id").alias("src")), "src", "left_semi").agg(F.count("*").alias("relationships"))
    return counts.crossJoin(out)


def name_search(nodes_: DataFrame, codebase: str, term: str, limit: int) -> DataFrame:
    """Files whose path, functions or classes have the term: matched and all names, ordered by path."""
    own = of_codebase(nodes_, codebase).where("label IN ('CodeFile', 'Function', 'Class')")
    item = F.struct("name", "signature", "docstring")
    files = own.groupBy("path").agg(
        F.array_sort(F.collect_set(F.when(F.col("label") == "Function", item))).alias("functions"), F.array_sort(F.collect_set(F.when(F.col("label") == "Class", item))).alias("classes")
    )
    hit = lambda x: F.coalesce(F.lower(x["name"]).contains(term.lower()), F.lit(False))
    found = files.where(F.lower("path").contains(term.lower()) | F.exists("functions", hit) | F.exists("classes", hit))
    names = lambda c: F.transform(c, lambda x: x["name"])
    return found.select(
        F.col("path").alias("file"), F.filter("functions", hit).alias("matched_functions"), F.filter("classes", hit).alias("matched_classes"), names("functions").alias("all_functions"), names("classes").alias("all_classes")
    ).orderBy("file").limit(limit)
