"""Merkle manifest of a dataset: a digest per row, a tree per group of rows, one root, and a proof for every row.

The tree is known from counts alone: a group's leaves in order of their key are node runs of eight (the last one
may be shorter), each becomes the digest of its members, until one node is left; the groups' nodes, in order of the group,
are the leaves of a tree of the same kind. So any set of nodes can be merged with any other: ``settle`` takes nodes keyed by
tree, level and index, replaces every run whose known number of members is present by its parent, and leaves the others as
they are. That is an associative operation on sparse forests. Partitions of rows in order leave a few open nodes at their
edges. ``build`` merges fragments of neighbouring partitions as a tree, a fixed number at a time, until the root is left,
and ``prove`` goes the same way back down and hands every fragment the siblings on the way from its open nodes to the root.
No task holds more than one partition of rows or the open nodes of a few fragments, and the driver sees counts and the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slatework.scratch import materialize

#: Children of a node.
ARITY = 8
#: Rows of a partition, and fragments that are merged at once.
LEAVES, FAN = 1 << 18, 16
#: The tree over the groups' roots; other trees have the rank of their group as their number.
TOP = -1
#: The level under which a group's root is recorded beside the open nodes.
_DONE = -1
_NODES = "part long, tree long, level int, idx long, digest binary, total long"
_PATHS = "part long, tree long, level int, idx long, path binary"

Node = tuple[int, int, int]


def hashed(parts: Iterable[bytes]) -> bytes:
    """The digest of inputs one after the other, as lower-case hexadecimal text."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def row_digest(*fields: Column) -> Column:
    """A row's leaf: ``-`` for a null field, else its length in UTF-8 bytes, a colon and the value; integers in decimal."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text]), 256)


def width(total: int, level: int) -> int:
    """Nodes on a level of a tree with so many leaves."""
    for _ in range(level):
        total = -(-total // ARITY)
    return total


def height(total: int) -> int:
    """Levels above the leaves."""
    level = 0
    while width(total, level) > 1:
        level += 1
    return level


def settle(nodes: Iterable[tuple[int, int, int, bytes]], totals: dict[int, int]) -> tuple[dict[Node, bytes], dict[Node, list[bytes]], dict[int, bytes]]:
    """(open nodes, complete runs by tree, level and index of their parent, roots of groups) of a forest of (tree, level, index, digest)."""
    todo, still, waiting, runs, roots = list(nodes), {}, {}, {}, {}
    widths: dict[tuple[int, int], int] = {}
    while todo:
        tree, level, at, digest = todo.pop()
        count = widths.get((tree, level))
        if count is None:
            count = widths[tree, level] = width(totals[tree], level)
        if count == 1 and tree == TOP:
            still[tree, level, at] = digest
        elif count == 1:
            roots[tree] = digest
            todo.append((TOP, 0, tree, digest))
        else:
            up = at // ARITY
            run = waiting.setdefault((tree, level, up), {})
            run[at] = digest
            if len(run) == min(ARITY, count - ARITY * up):
                del waiting[tree, level, up]
                runs[tree, level, up] = members = [run[i] for i in sorted(run)]
                todo.append((tree, level + 1, up, hashed(members)))
    for (tree, level, _), run in waiting.items():
        still |= {(tree, level, at): digest for at, digest in run.items()}
    return still, runs, roots


@dataclass(frozen=True)
class Step:
    """The siblings of a node in its run, before and after it, as hexadecimal text."""

    before: bytes
    after: bytes


def pack(steps: Iterable[Step]) -> bytes:
    """Steps as bytes: the number of siblings before and after, and 32 bytes of each."""
    return b"".join(bytes([len(s.before) // 64, len(s.after) // 64]) + bytes.fromhex((s.before + s.after).decode()) for s in steps)


def unpack(path: bytes) -> list[Step]:
    """The steps that ``pack`` wrote."""
    steps, at = [], 0
    while at < len(path):
        before, after = path[at], path[at + 1]
        digests = path[at + 2 : at + 2 + 32 * (before + after)].hex().encode()
        steps.append(Step(digests[: 64 * before], digests[64 * before :]))
        at += 2 + 32 * (before + after)
    return steps


def fold(leaf: bytes, steps: Iterable[Step]) -> bytes:
    """The root that a leaf and its siblings give."""
    for s in steps:
        leaf = hashed((s.before, leaf, s.after))
    return leaf


class _Ways:
    """The steps from nodes up to the root: by the runs of a forest as far as they go, then by the known steps of its open nodes."""

    def __init__(self, runs: dict[Node, list[bytes]], known: dict[Node, list[Step]], totals: dict[int, int]) -> None:
        self.runs, self.known, self.totals = runs, known, totals
        self.last: dict[tuple[int, int], tuple[int, list[Step]]] = {}

    def step(self, tree: int, level: int, at: int) -> Step:
        run, place = self.runs[tree, level, at // ARITY], at % ARITY
        return Step(b"".join(run[:place]), b"".join(run[place + 1 :]))

    def of(self, tree: int, level: int, at: int) -> list[Step]:
        if (tree, level, at) in self.known:
            return self.known[tree, level, at]
        held = self.last.get((tree, level))  # nodes come in order, so the last one of a level is asked for again
        if held and held[0] == at:
            return held[1]
        if width(self.totals[tree], level) > 1:
            way = [self.step(tree, level, at), *self.of(tree, level + 1, at // ARITY)]
        else:
            way = [] if tree == TOP else self.of(TOP, 0, tree)
        self.last[tree, level] = at, way
        return way


def _hex(column: pa.ChunkedArray) -> list[bytes]:
    return [x.hex().encode() for x in column.to_pylist()]


def _nodes(table: pa.Table, groups: int) -> tuple[list[tuple[int, int, int, bytes]], dict[int, int]]:
    trees = table["tree"].to_pylist()
    totals = dict(zip(trees, table["total"].to_pylist())) | {TOP: groups}
    return list(zip(trees, table["level"].to_pylist(), table["idx"].to_pylist(), _hex(table["digest"]))), totals


@dataclass(frozen=True)
class Manifest:
    """The root, the numbered leaves (part, tree, idx, total and the columns given), and the open nodes of every round of merging."""

    root: str | None
    n_groups: int
    leaves: DataFrame
    groups: DataFrame
    rounds: tuple[DataFrame, ...]

    def subroots(self) -> DataFrame:
        """grp, n_leaves and subroot of every group; compare two manifests by them to find the groups that changed."""
        found = None
        for r in self.rounds[1:]:
            some = r.where(F.col("level") == _DONE).select("tree", F.lower(F.hex("digest")).alias("subroot"))
            found = some if found is None else found.unionByName(some)
        names = self.groups.where("start = 0").select(F.col("tree"), "grp", F.col("total").alias("n_leaves"))
        return names.join(found, "tree").select("grp", "n_leaves", "subroot")


def _numbered(rows: DataFrame, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(rows with part, tree, idx and total; start of every group in every part). Range partitions hold rows in order."""
    rows = materialize(rows.withColumn("salt", F.monotonically_increasing_id()), "manifest-rows")
    parts = max(-(-rows.count() // LEAVES), spark.sparkContext.defaultParallelism)
    order = ["grp", "key", "leaf", "salt"]  # the salt parts equal rows, which may stand in any order
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = rows.select("grp", "key", "leaf", "claim", F.spark_partition_id().cast("long").alias("part"), F.monotonically_increasing_id().alias("pos"))
    rows = materialize(rows, "manifest-sorted")
    counts = rows.groupBy("part", "grp").agg(F.count("*").alias("n"), F.min("pos").alias("pos0"))
    of_group = Window.partitionBy("grp")
    counts = counts.withColumn("start", F.sum("n").over(of_group.orderBy("part")) - F.col("n")).withColumn("total", F.sum("n").over(of_group))
    # A row per part and group, which are in one order: the groups that have begun give a group its number.
    begun = F.sum((F.col("start") == 0).cast("long")).over(Window.orderBy("pos0").rowsBetween(Window.unboundedPreceding, 0))
    groups = materialize(counts.withColumn("tree", begun - 1), "manifest-groups")
    info = groups.select(F.col("part").alias("p"), F.col("grp").alias("g"), "tree", "start", "total", "pos0")
    rows = rows.join(info, (rows["part"] == F.col("p")) & rows["grp"].eqNullSafe(F.col("g")))
    return rows.select("part", "tree", (F.col("start") + F.col("pos") - F.col("pos0")).alias("idx"), "total", "key", "leaf", "claim"), groups


def build(docs: DataFrame, leaf: Column, group: str, key: str, claim: Column | None = None) -> Manifest:
    """The manifest of all rows; ``leaf`` is the digest of a row as hexadecimal text, ``claim`` one that is to be checked (default: the leaf).

    Rows of a group are ordered by key, null first, then by leaf; equal rows are leaves of their own. A null group is a group, and the
    first. An empty table has no root (None) and no leaves. Texts are read once; beyond that only digests and keys are moved.
    Neither a group nor a key that holds most rows makes a larger task: partitions are ranges of (group, key, leaf, number).
    """
    spark = docs.sparkSession
    claim = leaf if claim is None else claim
    light = docs.select(F.col(group).alias("grp"), F.col(key).alias("key"), F.unhex(leaf).alias("leaf"), F.unhex(claim).alias("claim"))
    leaves, groups = _numbered(light, spark)
    last = groups.agg(F.max("tree"), F.max("part")).first()
    if last[0] is None:
        return Manifest(None, 0, leaves, groups, ())
    n_groups, parts = last[0] + 1, last[1] + 1

    def up(table: pa.Table) -> pa.Table:
        nodes, totals = _nodes(table, n_groups)
        still, _, roots = settle([n for n in nodes if n[1] != _DONE], totals)
        rows = [(t, lv, at, d) for (t, lv, at), d in still.items()] + [(t, _DONE, 0, d) for t, d in roots.items()]
        part = table["part"][0].as_py()
        columns = [[part] * len(rows), [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [bytes.fromhex(r[3].decode()) for r in rows], [totals[r[0]] for r in rows]]
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64()))], names=[f.split()[0] for f in _NODES.split(", ")])

    first = leaves.select("part", "tree", F.lit(0).alias("level"), "idx", F.col("leaf").alias("digest"), "total")
    rounds = [first, materialize(first.groupBy("part").applyInArrow(up, _NODES), "manifest-open")]
    while parts > 1:
        some = rounds[-1].where(F.col("level") != _DONE).withColumn("part", F.floor(F.col("part") / FAN))
        rounds.append(materialize(some.groupBy("part").applyInArrow(up, _NODES), "manifest-open"))
        parts = -(-parts // FAN)
    root = rounds[-1].where((F.col("tree") == TOP) & (F.col("level") != _DONE)).select(F.lower(F.hex("digest"))).collect()  # one row
    return Manifest(root[0][0], n_groups, leaves, groups, tuple(rounds))


def prove(manifest: Manifest, paths: bool = False) -> DataFrame:
    """key, leaf, subroot, root, proof (the digest of all siblings), folded (the root that the claim gives) and, if asked, path of every row.

    ``path`` are the packed steps, which ``unpack`` and ``fold`` check without the dataset. A group of one leaf has it as its
    root, and a lone group's root is the root: such ways have no steps, and the proof is the digest of nothing.
    """
    n_groups, root = manifest.n_groups, manifest.root
    kind = manifest.leaves.schema["key"].dataType.simpleString()
    schema = f"key {kind}, leaf string, subroot string, root string, proof string, folded string" + (", path binary" if paths else "")
    spark = manifest.leaves.sparkSession
    if root is None:
        return spark.createDataFrame([], schema)

    def known(table: pa.Table) -> dict[Node, list[Step]]:
        names = zip(table["tree"].to_pylist(), table["level"].to_pylist(), table["idx"].to_pylist())
        return {n: unpack(p) for n, p in zip(names, table["path"].to_pylist())}

    def down(nodes: pa.Table, above: pa.Table) -> pa.Table:
        found, totals = _nodes(nodes, n_groups)
        ways = _Ways(settle(found, totals)[1], known(above), totals)
        columns = [nodes["part"], nodes["tree"], nodes["level"], nodes["idx"], pa.array([pack(ways.of(*n[:3])) for n in found], pa.binary())]
        return pa.table(columns, names=[f.split()[0] for f in _PATHS.split(", ")])

    def proofs(rows: pa.Table, above: pa.Table) -> pa.Table:
        order = np.lexsort((rows["idx"].to_numpy(), rows["tree"].to_numpy()))
        rows = rows.take(pa.array(order))
        trees, places, leaves, claims = rows["tree"].to_pylist(), rows["idx"].to_pylist(), _hex(rows["leaf"]), _hex(rows["claim"])
        totals = dict(zip(trees, rows["total"].to_pylist())) | {TOP: n_groups}
        ways = _Ways(settle(((t, 0, i, d) for t, i, d in zip(trees, places, leaves)), totals)[1], known(above), totals)
        out: list[list] = [[] for _ in range(5 if paths else 4)]
        tops: dict[int, bytes] = {}
        rest, tail, of = [], b"", None
        for tree, at, leaf, claim in zip(trees, places, leaves, claims):
            if (tree, 0, at) in ways.known or totals[tree] == 1:
                steps, of = ways.of(tree, 0, at), None
                siblings = b"".join(s.before + s.after for s in steps)
            else:
                if of != (tree, at // ARITY):  # what is above a run is put together once for its members
                    of, rest = (tree, at // ARITY), ways.of(tree, 1, at // ARITY)
                    tail = b"".join(s.before + s.after for s in rest)
                here = ways.step(tree, 0, at)
                steps, siblings = [here, *rest], here.before + here.after + tail
            if tree not in tops:
                tops[tree] = fold(leaf, steps[: height(totals[tree])])
            for c, v in zip(out, (tops[tree], root, hashlib.sha256(siblings).hexdigest(), fold(claim, steps), *([pack(steps)] if paths else []))):
                c.append(v if c is out[-1] and paths else v.decode() if isinstance(v, bytes) else v)
        texts = [pa.array(c, pa.string()) for c in ([x.decode() for x in leaves], *out[:4])]
        return pa.table([rows["key"], *texts, *([pa.array(out[4], pa.binary())] if paths else [])], names=[f.split()[0] for f in schema.split(", ")])

    above = spark.createDataFrame([(0, TOP, height(n_groups), 0, b"")], _PATHS)
    for r in reversed(manifest.rounds[1:-1]):
        nodes = r.where(F.col("level") != _DONE)
        grouped = nodes.groupBy(F.floor(F.col("part") / FAN).alias("to"))
        above = materialize(grouped.cogroup(above.groupBy("part")).applyInArrow(down, _PATHS), "manifest-paths")
    return manifest.leaves.groupBy("part").cogroup(above.groupBy("part")).applyInArrow(proofs, schema)
