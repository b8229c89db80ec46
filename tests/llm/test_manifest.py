"""The manifest against a plain tree, on edge rows, many groups and partitions cut anywhere."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from slatework.llm import manifest
from slatework.llm import queries as Q
from tests.llm import brute
from tests.llm.test_edges import CLASH, ROWS

FIELDS = ("doc_id", "source", "lang", "text")


def built(df, claim=None):
    return manifest.build(df, manifest.row_digest(*[F.col(c) for c in FIELDS]), "lang", "doc_id", claim)


def wanted(rows):
    """rows: dicts with FIELDS. Sorted (doc_id, leaf, subroot, root, proof)."""
    out, root = brute.merkle([(r["lang"], r["doc_id"], brute.leaf([r[c] for c in FIELDS])) for r in rows])
    return sorted(repr((key, leaf, sub, root, brute.sha(way))) for _, key, leaf, sub, way in out)


def same(df, rows):
    got = manifest.prove(built(df), paths=True).collect()
    assert sorted(repr(tuple(r)[:5]) for r in got) == wanted(rows)
    for r in got:
        assert r.folded == r.root == manifest.fold(r.leaf.encode(), manifest.unpack(bytes(r.path))).decode()


def test_edge_rows(spark):
    names = [c.split("`")[1] for c in CLASH.split(", ")]
    df = spark.createDataFrame([(*r, *["x"] * len(names)) for r in ROWS], f"doc_id long, text string, lang string, source string, {CLASH}")
    same(df.withColumns({c: F.lit("y") for c in ("part", "tree", "idx", "grp", "leaf", "claim", "pos", "salt", "digest")}), [dict(zip(("doc_id", "text", "lang", "source"), r)) for r in ROWS])
    empty = built(df.limit(0))
    assert empty.root is None and manifest.prove(empty).count() == 0 and manifest.prove(empty, paths=True).columns[-1] == "path"
    one = df.where("doc_id = 1")
    row = manifest.prove(built(one)).first()
    assert row.leaf == row.subroot == row.root and row.proof == brute.sha([])


@pytest.mark.parametrize("n, langs, leaves", [(9, ["a"], 4), (700, ["a", None, "é", "z", "b"], 33), (2000, [str(i) for i in range(300)], 100), (1500, ["a"], 1 << 18)])
def test_random_forests(spark, monkeypatch, n, langs, leaves):
    monkeypatch.setattr(manifest, "LEAVES", leaves)
    monkeypatch.setattr(manifest, "FAN", 3)
    rng = random.Random(n)
    rows = [{"doc_id": rng.choice([None, 5, rng.randrange(n)]), "source": rng.choice(["s", None]), "lang": rng.choice(langs), "text": rng.choice(["x", "", None, str(rng.random())])} for _ in range(n)]
    df = spark.createDataFrame([tuple(r[c] for c in FIELDS) for r in rows], "doc_id long, source string, lang string, text string")
    same(df, rows)
    order = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    found = {r.grp: (r.n_leaves, r.subroot) for r in built(df).subroots().collect()}
    out, _ = brute.merkle([(r["lang"], r["doc_id"], brute.leaf([r[c] for c in FIELDS])) for r in rows])
    subroots = {g: sub for g, _, _, sub, _ in out}
    assert found == {g: (sum(r["lang"] == g for r in rows), subroots[g]) for g in order}


def test_merging_is_associative():
    rng = random.Random(2)
    totals = {0: 100, 1: 1, 2: 17, manifest.TOP: 3}
    leaves = [(t, 0, i, manifest.hashed([f"{t}/{i}".encode()])) for t in (0, 1, 2) for i in range(totals[t])]
    whole = manifest.settle(leaves, totals)[0]
    assert list(whole) == [(manifest.TOP, 1, 0)]
    for _ in range(20):
        rng.shuffle(leaves)
        cuts = sorted(rng.sample(range(len(leaves)), 6))
        parts = [leaves[a:b] for a, b in zip([0, *cuts], [*cuts, None])]
        while len(parts) > 1:
            at = rng.randrange(len(parts) - 1)
            still = manifest.settle(parts[at] + parts.pop(at + 1), totals)[0]
            parts[at] = [(*k, d) for k, d in still.items()]
        assert {p[:3]: p[3] for p in parts[0]} == whole


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    out, root = brute.merkle([(r.lang, r.doc_id, brute.leaf([r.doc_id, r.source, r.lang, r.n_chars, r.text])) for r in docs])
    want = {(key, leaf, sub, root, brute.sha(way)) for _, key, leaf, sub, way in out}
    got = Q.op12_manifest(spark, sf).collect()
    assert len(got) == len(docs) and {tuple(r)[:5] for r in got} == want
    text = {r.doc_id: r.text for r in docs}
    for r in got:
        same_text = zlib.crc32(str(r.doc_id).encode()) % 3 or text[r.doc_id].translate(brute.UP) == text[r.doc_id]
        assert r.verified == (r.folded_root == root) == bool(same_text)
