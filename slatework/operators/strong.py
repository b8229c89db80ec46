"""Strongly connected components of large digraphs, as joins over edge tables.

A round takes off what has no way in or no way out, draws paths of nodes with one way in and one way out together (by
doubling, so a chain or a ring of any length takes its logarithm), and colours the rest: forward, a node's colour is the
largest node that leads to it, backward, within a colour, the largest one that it leads to. Where both are the same node the
class of that node is found; edges between colours cannot lie on a cycle and go. Colours follow their own colours, which doubles
the reach of a step, and sizes of nodes are dealt anew by hash in every round. Only counts and emptiness tests reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatework.scratch import materialize

#: How often the ends are taken off in a round before paths are drawn together.
TRIMS = 2


def _with_ways(edges: DataFrame) -> DataFrame:
    """node, n_in, n_out, p and n (a node before and after it) of every node of the edges; loops count neither way."""
    out = edges.where("src != dst").select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o"), F.lit(None).cast("long").alias("p"), F.col("dst").alias("n"))
    into = edges.where("src != dst").select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o"), F.col("src").alias("p"), F.lit(None).cast("long").alias("n"))
    return out.unionByName(into).groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"), F.min("p").alias("p"), F.min("n").alias("n"))


def _trim(edges: DataFrame) -> DataFrame:
    """The edges whose ends both have a way in and a way out."""
    firsts, lasts = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
    return materialize(edges.join(firsts, "src", "left_semi").join(lasts, "dst", "left_semi").select("src", "dst"), "scc-core")


def paths(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges without inner nodes, the others with the ends p and n of their path, its first node and how far they are from p, node with the smallest of its lone ring).

    An inner node has one way in and one way out. It is in a class with others only if both ends of its path are.
    """
    inner = _with_ways(edges).where("n_in = 1 AND n_out = 1").select("node", "p", "n", F.least("node", "p").alias("least"), F.col("node").alias("first"), F.lit(1).cast("long").alias("far"))
    inner = materialize(inner, "scc-inner")
    steps = inner.count().bit_length() + 1  # the reach is then longer than any path, and its end has been seen
    at = inner.withColumn("open", F.lit(True))
    for _ in range(steps):
        before = at.select(F.col("node").alias("p"), F.col("p").alias("pp"), F.col("least").alias("least_p"), F.col("first").alias("first_p"), F.col("far").alias("far_p"))
        after = at.select(F.col("node").alias("n"), F.col("n").alias("nn"))
        at = at.drop("open").join(before, "p", "left").join(after, "n", "left")
        at = at.select(
            "node", F.coalesce("pp", "p").alias("p"), F.coalesce("nn", "n").alias("n"), F.least("least", F.coalesce("least_p", "least")).alias("least"), F.coalesce("first_p", "first").alias("first"),
            (F.col("far") + F.coalesce("far_p", F.lit(0))).alias("far"), (F.col("pp").isNotNull() | F.col("nn").isNotNull()).alias("open"),
        )
        at = materialize(at, "scc-paths")
        if at.where("open").isEmpty():
            break
    # What still leads to an inner node after so many doublings goes round.
    drawn = at.where(~F.col("open")).select("node", "p", "n", "first", "far")
    rings = at.where("open").select("node", F.col("least").alias("component"))
    names = inner.select("node")
    left = edges.join(names.withColumnRenamed("node", "src"), "src", "left_anti").join(names.withColumnRenamed("node", "dst"), "dst", "left_anti")
    bridges = drawn.select(F.col("p").alias("src"), F.col("n").alias("dst")).distinct()
    return materialize(left.select("src", "dst").unionByName(bridges).distinct(), "scc-core"), drawn, rings


def _largest(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, size, top: the largest (size, node) that leads to a node along the edges, itself included."""
    tops = materialize(nodes.select("node", "size", F.struct("size", "node").alias("top")), "scc-tops")
    while True:
        come = edges.join(tops.select(F.col("node").alias("src"), F.col("top").alias("t")), "src").groupBy(F.col("dst").alias("node")).agg(F.max("t").alias("t"))
        moved = tops.join(come, "node", "left").select("node", "size", F.col("top").alias("old"), F.greatest("top", F.coalesce("t", "top")).alias("t"))
        # What leads to the one that leads here leads here too.
        jump = tops.select(F.col("node").alias("at"), F.col("top").alias("tt"))
        moved = moved.join(jump, F.col("t.node") == F.col("at"), "left").select("node", "size", "old", F.greatest("t", F.coalesce("tt", "t")).alias("top"))
        moved = materialize(moved, "scc-tops")
        if moved.where("old != top").isEmpty():
            return moved.select("node", "size", "top")
        tops = moved.select("node", "size", "top")


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node of its class) of every node of the links (src, dst: long); loops and repeated links may be among them.

    A link with a null end is left out. Long paths and rings take rounds by the logarithm of their length; what is neither takes
    rounds by how deep its classes lie behind each other, which colours of random size cut in parts.
    """
    links = links.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL")
    every = materialize(links.select(F.col("src").alias("node")).unionByName(links.select(F.col("dst").alias("node"))).distinct(), "scc-nodes")
    edges = materialize(links.where("src != dst").distinct(), "scc-core")
    found: DataFrame | None = None
    drawn: list[DataFrame] = []
    round_ = 0

    def add(rows: DataFrame) -> None:
        nonlocal found
        found = rows if found is None else found.unionByName(rows)

    while not edges.isEmpty():
        for _ in range(TRIMS):
            edges = _trim(edges)
        edges, lines, rings = paths(edges)
        drawn.append(lines)
        add(rings)
        edges = materialize(edges.where("src != dst"), "scc-core")  # a path from a node to itself is a loop
        if edges.isEmpty():
            break
        nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
        nodes = materialize(nodes.select("node", F.xxhash64("node", F.lit(round_)).alias("size")), "scc-nodes")
        to = _largest(nodes, edges).select("node", F.col("top").alias("colour"))
        inside = edges.join(to.select(F.col("node").alias("src"), F.col("colour").alias("a")), "src").join(to.select(F.col("node").alias("dst"), F.col("colour").alias("b")), "dst").where("a = b").select("src", "dst")
        inside = materialize(inside, "scc-core")
        back = _largest(nodes, inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).select("node", "top")
        both = materialize(to.join(back, "node"), "scc-colours")
        done = both.where("colour = top").select("node", F.col("colour.node").alias("class"))
        least = done.groupBy("class").agg(F.min("node").alias("component"))
        add(done.join(least, "class").select("node", "component"))
        rest = both.where("colour != top").select("node", F.struct("colour", "top").alias("part"))
        left = inside.join(rest.select(F.col("node").alias("src"), F.col("part").alias("a")), "src").join(rest.select(F.col("node").alias("dst"), F.col("part").alias("b")), "dst")
        edges = materialize(left.where("a = b").select("src", "dst"), "scc-core")
        round_ += 1
    # Inner nodes of paths, the last drawn first: in the class of both ends if that is one.
    known = materialize(every.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "scc-known") if found is not None else every.withColumn("component", F.col("node"))
    for lines in reversed(drawn):
        ends = lines.join(known.select(F.col("node").alias("p"), F.col("component").alias("a")), "p").join(known.select(F.col("node").alias("n"), F.col("component").alias("b")), "n")
        # The ends are of one class, or one node; a path that leads back to its start is on a cycle with it.
        joins = ends.where("a = b").select("node", F.col("a").alias("to"))
        known = materialize(known.join(joins, "node", "left").select("node", F.coalesce("to", "component").alias("component")), "scc-known")
    # A class is named after its smallest node, which may have been an inner one.
    least = known.groupBy("component").agg(F.min("node").alias("least"))
    return materialize(known.join(least, "component").select("node", F.col("least").alias("component")), "scc")


def classes(links: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """component, n_nodes, n_links (distinct links inside): a class is a circle of imports if it has a link."""
    found = components(links) if found is None else found
    inside = links.select("src", "dst").distinct().join(found.select(F.col("node").alias("src"), "component"), "src").join(found.select(F.col("node").alias("dst"), F.col("component").alias("other")), "dst")
    inside = inside.where("component = other").groupBy("component").agg(F.count("*").alias("n_links"))
    sizes = found.groupBy("component").agg(F.count("*").alias("n_nodes"))
    return sizes.join(inside, "component", "left").select("component", "n_nodes", F.coalesce("n_links", F.lit(0)).alias("n_links"))
