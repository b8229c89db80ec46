"""Reachability by labels against the closure, on random digraphs, long paths and unknown nodes."""

import random

import pytest

from slatework.operators.reach import ORDERS, Reach


def closure(edges):
    to = {}
    for a, b in edges:
        to.setdefault(a, set()).add(b)

    def reach(v):
        seen, todo = set(), [v]
        while todo:
            for w in to.get(todo.pop(), set()) - seen:
                seen.add(w)
                todo.append(w)
        return seen

    return {v: reach(v) for v in {x for e in edges for x in e}}


def test_fifty_digraphs_beside_each_other(spark):
    rng, edges = random.Random(3), []
    for g in range(50):
        n = rng.randint(2, 14)
        some = [(rng.randrange(n), rng.randrange(n)) for _ in range(int(n * rng.choice((0.8, 1.1, 1.5, 2.0))))]
        if g % 3 == 0:
            some = [(min(e), max(e)) for e in some]  # few cycles
        edges += [(100 * g + a, 100 * g + b) for a, b in some]
    want = closure(edges)
    reach = Reach.build(spark.createDataFrame(edges, "src long, dst long"))
    asked = [(a, 100 * (a // 100) + b) for a in want for b in range(14)] + [(a, rng.choice(list(want))) for a in want]
    got = {(r.src, r.dst): r.reachable for r in reach.pairs(spark.createDataFrame(asked, "src long, dst long")).collect()}
    assert got == {(a, b): b in want[a] for a, b in asked}
    starts = rng.sample(sorted(want), 60)
    found = {}
    for r in reach.descendants(spark.createDataFrame([(s,) for s in starts], "node long")).collect():
        assert r.node not in found.setdefault(r.start, set())
        found[r.start].add(r.node)
    assert {s: found.get(s, set()) for s in starts} == {s: want[s] for s in starts}
    # A label is 2 * ORDERS numbers a node, whatever the closure.
    sizes = reach.labels.selectExpr("max(size(down)) AS d", "max(size(up)) AS u", "count(*) AS n").first()
    assert (sizes.d, sizes.u) == (ORDERS, ORDERS) and sizes.n <= len(want)


@pytest.mark.parametrize("seed", range(2))
def test_one_larger_digraph(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(95)]
    want = closure(edges)
    reach = Reach.build(spark.createDataFrame(edges, "src long, dst long"))
    asked = [(a, b) for a in want for b in want]
    got = {(r.src, r.dst) for r in reach.pairs(spark.createDataFrame(asked, "src long, dst long")).collect() if r.reachable}
    assert got == {(a, b) for a in want for b in want[a]}


def test_long_path_and_ring(spark):
    edges = [(i, i + 1) for i in range(5000)] + [(10_000 + i, 10_000 + (i + 1) % 3000) for i in range(3000)] + [(2500, 10_000)]
    reach = Reach.build(spark.createDataFrame(edges, "src long, dst long"))
    asked = {(0, 5000): True, (5000, 0): False, (100, 10_500): True, (2501, 10_500): False, (10_500, 10_500): True, (10_500, 4000): False, (7, 7): False, (3, 4): True, (4, 3): False, (1, 99_999): False, (2500, 2501): True}
    got = {(r.src, r.dst): r.reachable for r in reach.pairs(spark.createDataFrame(list(asked), "src long, dst long")).collect()}
    assert got == asked
    assert reach.descendants(spark.createDataFrame([(4000,), (10_007,), (2400,)], "node long")).groupBy("start").count().collect().__len__() == 3
    assert {r.start: r["count"] for r in reach.descendants(spark.createDataFrame([(4000,), (10_007,), (2400,)], "node long")).groupBy("start").count().collect()} == {4000: 1000, 10_007: 3000, 2400: 2600 + 3000}


def test_empty(spark):
    reach = Reach.build(spark.createDataFrame([(None, 1)], "src long, dst long"))
    assert [tuple(r) for r in reach.pairs(spark.createDataFrame([(1, 2)], "src long, dst long")).collect()] == [(1, 2, False)]
    assert reach.descendants(spark.createDataFrame([(1,)], "node long")).count() == 0
