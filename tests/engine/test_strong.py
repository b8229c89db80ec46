"""Strongly connected classes against a plain depth-first search, on random digraphs, long chains and rings."""

import random

import pytest

from slatework.operators import graph, strong


def plain(edges):
    """Smallest node of every node's class, by two searches from each node."""
    to = {}
    for a, b in edges:
        to.setdefault(a, set()).add(b)
        to.setdefault(b, set())

    def reach(v):
        seen, todo = {v}, [v]
        while todo:
            for w in to[todo.pop()] - seen:
                seen.add(w)
                todo.append(w)
        return seen

    all_ = {v: reach(v) for v in to}
    return {v: min(w for w in all_[v] if v in all_[w]) for v in to}


def found(spark, edges):
    return {r.node: r.component for r in strong.components(spark.createDataFrame(edges, "src long, dst long")).collect()}


@pytest.mark.parametrize("seed", range(5))
def test_random_digraphs(spark, seed):
    rng = random.Random(seed)
    n = rng.choice((6, 25, 60))
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(int(n * rng.choice((0.8, 1.1, 1.6))))]
    assert found(spark, edges) == plain(edges)


def test_many_small_graphs_at_once(spark):
    """Fifty digraphs beside each other cost no more rounds than the hardest of them."""
    rng, edges = random.Random(9), []
    for g in range(50):
        n = rng.randint(2, 12)
        edges += [(100 * g + rng.randrange(n), 100 * g + rng.randrange(n)) for _ in range(rng.randint(1, 2 * n))]
    assert found(spark, edges) == plain(edges)


def test_chain_and_ring_of_ten_thousand(spark, monkeypatch):
    written = []
    write = strong.materialize
    monkeypatch.setattr(strong, "materialize", lambda df, label: written.append(label) or write(df, label))
    chain = [(i, i + 1) for i in range(10_000)]
    ring = [(20_000 + i, 20_000 + (i + 1) % 10_000) for i in range(10_000)]
    got = found(spark, chain + ring)
    assert all(got[i] == i for i in range(10_001)) and {got[20_000 + i] for i in range(10_000)} == {20_000}
    assert len(written) < 60


def test_classes_and_pairs(spark):
    edges = [(1, 2), (2, 3), (3, 1), (1, 2), (3, 4), (5, 5), (6, 7), (None, 8), (9, None)]
    links = spark.createDataFrame(edges, "src long, dst long")
    assert {tuple(r) for r in strong.classes(links).collect()} == {(1, 3, 3), (4, 1, 0), (5, 1, 1), (6, 1, 0), (7, 1, 0)}
    assert {tuple(r) for r in graph.mutual(links).collect()} == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3)} | {(5, 5)}
    assert strong.components(links.limit(0)).count() == 0 and strong.classes(links.limit(0)).count() == 0
