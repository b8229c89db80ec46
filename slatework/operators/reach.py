"""Who reaches whom in a digraph, without the closure: labels of a fixed size a node, and a search that they keep short.

Classes of nodes that reach each other are one node, and nodes with one way in and one way out are places on a path between two
others. What is left gets labels: under each of a few random orders the least node that is reached, and the least one that
leads here. A node reaches another only if it has labels as low downwards, and the other has labels as low upwards, so most
pairs are answered by their labels; for the others a search goes along the edges through nodes that the labels allow.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatework.operators import strong
from slatework.scratch import materialize

#: Random orders: numbers of a node's label, each way.
ORDERS = 3


def _least(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, label: the least number, itself included, that a node reaches along the edges, under each order."""
    orders = nodes.select("node", F.explode(F.sequence(F.lit(0), F.lit(ORDERS - 1))).alias("i"))
    best = materialize(orders.select("node", "i", F.struct(F.xxhash64("node", "i").alias("h"), F.col("node").alias("n")).alias("best")), "reach-labels")
    while True:
        come = edges.join(best.select(F.col("node").alias("dst"), "i", F.col("best").alias("b")), "dst").groupBy(F.col("src").alias("node"), "i").agg(F.min("b").alias("b"))
        moved = best.join(come, ["node", "i"], "left").select("node", "i", F.col("best").alias("old"), F.least("best", F.coalesce("b", "best")).alias("b"))
        # What the least one reaches is reached too.
        jump = best.select(F.col("node").alias("at"), F.col("i").alias("j"), F.col("best").alias("bb"))
        moved = moved.join(jump, (F.col("b.n") == F.col("at")) & (F.col("i") == F.col("j")), "left").select("node", "i", "old", F.least("b", F.coalesce("bb", "b")).alias("best"))
        moved = materialize(moved, "reach-labels")
        if moved.where("old != best").isEmpty():
            break
        best = moved.select("node", "i", "best")
    label = F.transform(F.array_sort(F.collect_list(F.struct("i", F.col("best.h").alias("h")))), lambda x: x["h"])
    return moved.groupBy("node").agg(label.alias("label"))


def _at_most(a: Column, b: Column) -> Column:
    return F.forall(F.zip_with(a, b, lambda x, y: x <= y), lambda x: x)


@dataclass(frozen=True)
class Reach:
    """node, component, loops (its class has a link), place: where a component stands (p, n, first, far on a path), core: the other edges, labels: node, down, up."""

    components: DataFrame
    places: DataFrame
    core: DataFrame
    labels: DataFrame

    @staticmethod
    def build(links: DataFrame) -> Reach:
        """Labels of all nodes of the links (src, dst: long); links with a null end are left out."""
        links = links.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL")
        found = strong.components(links)
        loops = strong.classes(links, found).select("component", (F.col("n_links") > 0).alias("loops"))
        components = materialize(found.join(loops, "component"), "reach-components")
        a, b = found.select(F.col("node").alias("src"), F.col("component").alias("a")), found.select(F.col("node").alias("dst"), F.col("component").alias("b"))
        dag = materialize(links.join(a, "src").join(b, "dst").where("a != b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct(), "reach-dag")
        core, drawn, _ = strong.paths(dag)  # no ring is left
        nodes = materialize(core.select(F.col("src").alias("node")).unionByName(core.select(F.col("dst").alias("node"))).distinct(), "reach-nodes")
        down = _least(nodes, core).withColumnRenamed("label", "down")
        up = _least(nodes, core.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumnRenamed("label", "up")
        return Reach(components, drawn, core, materialize(down.join(up, "node"), "reach-labels"))

    def pairs(self, asked: DataFrame) -> DataFrame:
        """src, dst, reachable of the distinct pairs asked: whether there is a path of one step or more. Unknown nodes reach nothing."""
        asked = materialize(asked.select("src", "dst").distinct(), "reach-asked")
        of = lambda c, name: self.components.select(F.col("node").alias(c), F.col("component").alias(name), F.col("loops").alias(f"{name}_loops"))
        place = lambda name, *columns: self.places.select(F.col("node").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in columns])
        rows = asked.join(of("src", "s"), "src").join(of("dst", "t"), "dst")
        rows = rows.join(place("s", "n", "first", "far"), "s", "left").join(place("t", "p", "first", "far"), "t", "left")
        on_path = F.col("s_first") == F.col("t_first")
        begin, end = F.coalesce("s_n", "s"), F.coalesce("t_p", "t")
        known = F.when(F.col("s") == F.col("t"), F.col("s_loops")).when(on_path, F.col("s_far") < F.col("t_far")).when(begin == end, True)
        rows = rows.select("src", "dst", begin.alias("at"), end.alias("goal"), known.alias("known"))
        # On one path against its direction: around is no way, for nothing leads from a path's end to its begin.
        rows = materialize(rows, "reach-asked")
        found = rows.where("known").select("src", "dst")
        todo = materialize(rows.where("known IS NULL").select("at", "goal").distinct(), "reach-search")
        hits = self._search(todo)
        found = found.unionByName(rows.where("known IS NULL").join(hits, ["at", "goal"], "left_semi").select("src", "dst"))
        return asked.join(found.withColumn("hit", F.lit(True)), ["src", "dst"], "left").select("src", "dst", F.coalesce("hit", F.lit(False)).alias("reachable"))

    def _allowed(self, rows: DataFrame) -> DataFrame:
        """The rows (here, goal) whose labels let ``here`` reach ``goal``."""
        here = self.labels.select(F.col("node").alias("here"), F.col("down").alias("hd"), F.col("up").alias("hu"))
        goal = self.labels.select(F.col("node").alias("goal"), F.col("down").alias("gd"), F.col("up").alias("gu"))
        held = rows.join(here, "here").join(goal, "goal")
        return held.where(_at_most(F.col("hd"), F.col("gd")) & _at_most(F.col("gu"), F.col("hu"))).drop("hd", "hu", "gd", "gu")

    def _search(self, todo: DataFrame) -> DataFrame:
        """at, goal of the pairs in the core with a path."""
        front = materialize(self._allowed(todo.select("at", "goal", F.col("at").alias("here"))), "reach-front")
        seen, hits = front, front.select("at", "goal").limit(0)
        while not front.isEmpty():
            step = front.join(self.core.withColumnRenamed("src", "here"), "here").select("at", "goal", F.col("dst").alias("here")).distinct()
            step = materialize(self._allowed(step).join(seen, ["at", "goal", "here"], "left_anti").select("at", "goal", "here"), "reach-front")
            new = step.where("here = goal").select("at", "goal")
            hits = materialize(hits.unionByName(new), "reach-hits")
            front = materialize(step.join(hits, ["at", "goal"], "left_anti"), "reach-front")
            seen = seen.select("at", "goal", "here").unionByName(front)
        return hits

    def descendants(self, starts: DataFrame) -> DataFrame:
        """start, node of all that the starts (a column node) reach by one step or more: a search over components, spread to their nodes at the end."""
        starts = starts.select(F.col("node").alias("start")).distinct().join(self.components.withColumnRenamed("node", "start"), "start")
        first = starts.join(self.places.withColumnRenamed("node", "component"), "component", "left")
        later = first.select("start", "first", "far").join(self.places.select(F.col("node").alias("here"), "first", F.col("far").alias("f")), "first").where("f > far").select("start", "here")
        own = starts.where("loops").select("start", F.col("component").alias("here"))
        front = materialize(first.select("start", F.coalesce("n", "component").alias("here"), F.col("n").isNotNull().alias("counts")), "reach-front")
        seen, reached = front.select("start", "here"), front.where("counts").select("start", "here")
        while not front.isEmpty():
            step = front.join(self.core.withColumnRenamed("src", "here"), "here").select("start", F.col("dst").alias("here")).distinct()
            front = materialize(step.join(seen, ["start", "here"], "left_anti"), "reach-front")
            seen, reached = seen.unionByName(front), reached.unionByName(front)
        # Places of a path are reached if the node before it is: itself a start, or reached.
        sources = first.where("n IS NULL").select("start", F.col("component").alias("p")).unionByName(reached.withColumnRenamed("here", "p"))
        inner = sources.join(self.places.select("p", F.col("node").alias("here")), "p").select("start", "here")
        every = reached.unionByName(inner).unionByName(later).unionByName(own).distinct()
        return every.join(self.components.select("node", F.col("component").alias("here")), "here").select("start", "node")
