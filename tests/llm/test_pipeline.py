"""Each stage of the pipeline against brute force on its own input."""

import math
import textwrap
from collections import Counter

import corpus_pipeline as P
from slatework.llm import fertility, licences
from slatework.llm.queries import PIECE_VOCABULARY, op3_warc, op6_toxicity, op10_licences
from tests.llm import brute


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    columns = docs.columns
    for at, (name, stage) in enumerate(P.STAGES):
        before = [r.asDict() for r in docs.collect()]
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = [r.asDict() for r in docs.collect()]
        if at < 4:
            assert docs.columns == columns
            whole = {r["doc_id"]: r for r in before}
            assert all(whole[r["doc_id"]] == r for r in after)
        ids = sorted(r["doc_id"] for r in after)
        if name == "quality":
            bands, sp = fertility.DEFAULT.bands, fertility._model(PIECE_VOCABULARY)[0]
            want = []
            for r in before:
                n, _, _, _, repeated = brute.base_quality(r["text"])
                tokens, chars, share, entropy, marks = brute.token_measures(sp, r["text"])
                band = bands[r["lang"]]
                good = band.least_chars <= chars <= band.most_chars and share <= band.most_bytes and marks <= band.most_marks
                if n >= 50 and 100 * repeated <= 50 * n and good and entropy >= band.least_entropy * math.log2(max(2, min(tokens, 1024))):
                    want.append(r["doc_id"])
            assert ids == sorted(want) and 0 < len(ids) < len(before)
        if name == "near_duplicates":
            want = brute.components([(r["doc_id"], brute.simhash(r["text"])) for r in before])
            assert ids == sorted({c for _, _, c in want}) and len(ids) < len(before)
        if name == "benchmark_leaks":
            assert ids == sorted(r["doc_id"] for r in before if not brute.hits(r["text"], items)[1])
        if name == "mix_sources":
            assert max(Counter(ids).values()) <= 3
            size, total, taken, longest = {r["doc_id"]: len(brute.space_words(r["text"])) for r in before}, Counter(), Counter(), Counter()
            for r in before:
                total[r["source"]] += size[r["doc_id"]]
                longest[r["source"]] = max(longest[r["source"]], size[r["doc_id"]])
            for r in after:
                taken[r["source"]] += size[r["doc_id"]]
            assert all(abs(taken[s] - t) <= 3 * longest[s] for s, t in brute.targets(total).items())
        if name == "token_files":
            assert ids == sorted(r["doc_id"] for r in before)
            rows = sorted(after, key=lambda r: r["start"])
            assert [r["start"] for r in rows] == [sum(x["n_tokens"] for x in rows[:i]) for i in range(len(rows))]
            assert [r["doc_id"] for r in rows] == ids
    assert {r.doc_id for r in P.run(spark, sf).collect()} == {r["doc_id"] for r in after}


def test_licences(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: set(filter(None, r.families.split(","))) for r in op10_licences(spark, sf).collect()}
    assert got == {i: brute.declared(t, licences.TEMPLATES) for i, t in texts.items()}
    model = licences.train()
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "x\n\n" + licences.TEMPLATES["mit"][0] + " tail " * 90), (4, "licence of the version")], "doc_id long, text string")
    found = {r.key: [(x.line, x.family) for x in r.licences] for r in licences.scan(odd, model).collect()}
    assert found[1] == [] and found[2] == [] and (2, "mit") in found[None] and not {f for _, f in found[4]} - {"unknown"}


def test_warc(spark, sf):
    import base64
    import hashlib

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    first = {}
    for i in sorted(pages):
        first.setdefault(pages[i], i)
    want = set()
    for i, h in pages.items():
        raw = (h or "").encode()
        own = first[h] == i
        want.add((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if own else "revisit", None if own else first[h]))
    assert {tuple(r) for r in op3_warc(spark, sf).collect()} == want


def test_toxicity(spark):
    rows = op6_toxicity(spark, "/root/testdata/sf0.1").where("held_out").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").collect()
    right = sum(r.predicted == r.toxic for r in rows) / len(rows)
    caught = sum(r.predicted for r in rows if r.toxic == 1) / sum(r.toxic for r in rows)
    alarms = sum(r.predicted for r in rows if r.toxic == 0) / sum(1 - r.toxic for r in rows)
    assert right > 0.95 and caught > 0.7 and alarms < 0.02


def _found(texts):
    model = licences.train()
    return [[(line, family) for line, family, *_ in licences.findings(t, model, model.bounds())] for t in texts]


def test_wrapped_licences():
    cases = [(f, t, mark, width) for f, some in licences.TEMPLATES.items() for t in some for mark in ("", "# ", " * ", "// ") for width in (80, 70, 60, 40)]
    texts = [f"int x;\n{m.rstrip()}\n" + "\n".join(m + x for x in textwrap.wrap(t, width)) + f"\n{m.rstrip()}\nother words" for _, t, m, width in cases]
    assert [(c, x) for c, x in zip(cases, _found(texts)) if x != [(2, c[0])]] == []


def test_several_licences_on_a_line():
    short = {f: t[-1] for f, t in licences.TEMPLATES.items() if len(t[-1].split()) < 14}
    pairs = [(f, g) for f in short for g in short if f != g]
    found = _found([f"{short[f]} {short[g]}" for f, g in pairs])
    assert [(p, x) for p, x in zip(pairs, found) if x != [(0, f) for f in sorted(p)]] == []
    apart = [f"{short[f]}\n{short[g]}" for f, g in pairs]
    assert [(p, x) for p, x in zip(pairs, _found(apart)) if sorted(x) != [(0, p[0]), (1, p[1])]] == []


def test_unknown_licences():
    names = ["Acme Widget", "Zorblax", "Open Toaster Community"]
    declared = [f"some words before\n\n{t.format(n)}\n\nand after" for t in licences.OTHERS for n in names]
    found = _found(declared)
    assert sum(x == [(2, "unknown")] for x in found) > 0.9 * len(found) and not any(f != "unknown" for x in found for _, f in x)
    clean = ["the version of the software was released in may", "a copy of the notice is for the public", "the work is free and the public likes it", "license plates and driving licenses are sold here"] * 2
    assert not any(_found(clean))


def test_licences_in_long_and_repeated_texts(spark):
    filler = "plain words go on without end and say nothing of it\n" * 20_000
    long = filler + licences.TEMPLATES["apache"][0] + "\n" + filler + licences.TEMPLATES["mit"][2]
    rows = [(1, long), (1, long), (2, licences.TEMPLATES["gpl"][2] + "\n\n" + licences.TEMPLATES["gpl"][2]), (None, licences.TEMPLATES["mpl"][1])]
    got = sorted((r.key or 0, [(x.line, x.family) for x in r.licences]) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, [(0, "mpl")]), (1, [(20_000, "apache"), (40_001, "mit")]), (1, [(20_000, "apache"), (40_001, "mit")]), (2, [(0, "gpl"), (2, "gpl")])]
