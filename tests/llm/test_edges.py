"""Nulls, empty and very long texts, repeated rows, empty tables and extra columns with clashing names, operator by operator."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from slatework.llm import decontaminate, fertility, licences, linededup, mixing, simhash, tokenbin, toxicity, warc
from slatework.llm.queries import PIECE_VOCABULARY, WORD_VOCABULARY
from slatework.llm.text import count_words
from tests.llm import brute

LONG = "many words follow each other here. " * 3000
ROWS = [
    (1, "a b c d e", "en", "s1"), (2, "A B C D E", None, "s1"), (3, None, "en", None), (4, "", "en", "s2"), (5, " \n\t ", "fr", "s2"), (6, LONG, "en", "s1"),
    (None, "a b c d e", "en", "s2"), (None, None, None, None), (7, "same same", "en", "s1"), (7, "same same", "en", "s1"), (7, "other words", "en", "s3"), (8, "b", "xx", "s3"),
    (9, "the fox\x1fé ü 1\x002", "de", "s3"),
]
# Names that the operators use inside.
CLASH = ", ".join(f"`{c}` string" for c in "key th fp row size target rank n_words kept words slot payload page items code line first level component copies source_size text2 __text".split())


@pytest.fixture(scope="module")
def docs(spark):
    names = [c.split("`")[1] for c in CLASH.split(", ")]
    return spark.createDataFrame([(*r, *["x"] * len(names)) for r in ROWS], f"doc_id long, text string, lang string, source string, {CLASH}")


def test_simhash(spark, docs):
    got = sorted((repr((r.key, r.fp & (2**64 - 1), r.component)) for r in simhash.classes(docs).collect()))
    assert got == sorted(map(repr, brute.components([(r[0], brute.simhash(r[1])) for r in ROWS])))
    assert simhash.classes(docs.limit(0)).count() == 0
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == len({c for *_, c in brute.components([(r[0], brute.simhash(r[1])) for r in ROWS])})


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(60)] + [(5, 5)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame([e for e in edges if e[0] != e[1]], "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[200 + i] for i in range(60)} == {100}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_lose_nothing(spark):
    rng = random.Random(1)
    points = {rng.getrandbits(64) for _ in range(60)}
    for p in list(points):
        for flips in (1, 2, 3, 4):
            q = p
            for bit in rng.sample(range(64), flips):
                q ^= 1 << bit
            points.add(q)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(p),) for p in points], "fp long")
    got = {frozenset((r.a, r.b)) for r in simhash.links(df).collect()}
    assert got == {frozenset((signed(a), signed(b))) for a in points for b in points if a < b and bin(a ^ b).count("1") <= 3}


def test_decontaminate(spark, docs):
    bench = spark.createDataFrame([(1, "c d"), (None, "fox"), (3, None), (4, "!!"), (5, "follow each other here many words follow each other here many"), (1, "C, d")], "item_id long, text string")
    items = [(r.item_id, r.text) for r in bench.collect() if r.item_id is not None] + [("", "fox")]
    got = sorted(repr((r.key, r.n_words, r.n_hit)) for r in decontaminate.hits(docs, bench).collect())
    assert got == sorted(repr((r[0], *brute.hits(r[1], items)[:2])) for r in ROWS)
    found = {r.key: r for r in decontaminate.hits(docs, bench).collect()}
    assert found[1]["items"] == ["1"] and found[9]["items"] == [] and found[9].n_hit == 1
    assert [tuple(s) for s in found[1].spans] == [(2, 3)] and len(found[6].spans) >= 1
    clean = decontaminate.remove_documents(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect() if r.doc_id} == {3, 4, 5, 7, 8}
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(docs, bench).collect()}
    assert cut[1] == "a b e" and cut[3] is None and cut[8] == "b"
    assert decontaminate.hits(docs.limit(0), bench).count() == 0 and decontaminate.hits(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    blocks = decontaminate.hits(docs, bench, block=1)
    assert "Broadcast" not in blocks._jdf.queryExecution().executedPlan().toString()  # each block was a job of its own
    assert sorted(repr((r.key, r.n_words, r.n_hit)) for r in blocks.collect()) == got


def test_fertility(spark, docs):
    rows = fertility.score(docs, PIECE_VOCABULARY).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute.base_quality(r.row.text)
    assert fertility.score(docs.limit(0), PIECE_VOCABULARY).count() == 0
    assert fertility.script_of("привет мир") == "other" and fertility.script_of(None) == "latin"


def test_mixing(spark, docs):
    rows = mixing.mix(docs, count_words(docs["text"])).collect()
    assert len(rows) == len(ROWS) and {r.copies for r in rows} <= {0, 1, 2, 3}
    sizes = {}
    for r in ROWS:
        sizes[r[3]] = sizes.get(r[3], 0) + len(brute.space_words(r[1]))
    want = brute.targets(sizes)
    assert all(abs(r.target - want[r.row.source]) < 1e-6 for r in rows)
    out = mixing.emit(mixing.mix(docs, count_words(docs["text"])))
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in rows)
    assert mixing.mix(docs.limit(0), count_words(docs["text"])).count() == 0


def test_tokens(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD_VOCABULARY)
    got = tokenbin.digest(tokenbin.write(docs, WORD_VOCABULARY)).orderBy("start").collect()
    at = 0
    hashed = {(r.doc_id, r.text): r.h for r in docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    for r, (k, text, *_) in zip(got, sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, hashed[r[:2]]))):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.key, r.start, r.n_tokens, r.ids_crc32) == (k, at, len(ids), brute.crc(ids))
        at += len(ids)
    assert tokenbin.digest(tokenbin.write(docs.limit(0), WORD_VOCABULARY)).count() == 0


def test_tokens_of_every_letter():
    """Words, and words with a mark behind, against the library: letters that decompose, have odd cases or are beyond the BMP."""
    e = tokenbin.Encoder(WORD_VOCABULARY, tokenbin._by_word(WORD_VOCABULARY))
    letters = [chr(c) for c in range(0x80, 0x20000) if not 0xD800 <= c < 0xE000]
    for form in ("{}", "{}.", "a{}", "x{}y!", "{0}{0},", "{}?x", "BELED{}YES{}.".replace("{}", "{0}")):
        for at in range(0, len(letters), 500):
            words = [form.format(c) for c in letters[at : at + 500]]
            want = [x.ids for x in e.tokenizer.encode_batch(words, add_special_tokens=False)]
            assert [np.frombuffer(e.encode(w), e.type).tolist() for w in words] == want
    for text in ("ALİ.", "BELEDİYESİ.", "ΑΣ. Σ", "ŉ! ß?"):
        assert np.frombuffer(e.encode(text), e.type).tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_tokens_by_ranges(spark, docs):
    """Files that cannot be mapped are read by ranges; both ways give the same."""
    tokens = tokenbin.write(docs, WORD_VOCABULARY)
    n = 0
    for r in tokens.manifest.collect():
        parts = [[(k, at, ids.tolist()) for k, at, ids in tokenbin.documents(tokens.path, r.stem, r.width, mapped, size)] for mapped, size in ((True, 0), (False, 1), (False, 7), (False, 1 << 20))]
        assert parts[0] == parts[1] == parts[2] == parts[3] and len(parts[0]) == r.n_docs
        n += r.n_docs
    assert n == len(ROWS)


def test_tokens_of_one_key(spark):
    """Rows that share a key, or have none, are dealt by text too."""
    df = spark.createDataFrame([(None if i % 2 else 1, f"word{i} tail") for i in range(400)], "doc_id long, text string")
    tokens = tokenbin.write(df, WORD_VOCABULARY)
    rows = tokenbin.digest(tokens).collect()
    assert len(rows) == 400 and max(r.n_docs for r in tokens.manifest.collect()) < 350
    ends = sorted((r.start, r.start + r.n_tokens) for r in rows)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    assert [r.key for r in sorted(rows, key=lambda r: r.start)] == [None] * 200 + [1] * 200


def test_warc(spark):
    rows = [(1, "http://a", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u\r\nX: y", None), (4, "u", ""), (5, "v", "x" * 3_000_000), (None, "w", "<p>é</p>"), (1, "http://a", "<p>é</p>"), (6, "r\r\n\r\n", "\r\n\r\nbody")]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, payload string, slot string")
    got = warc.resolve(warc.write(pages)).collect()
    assert len(got) == len(rows)
    assert sorted((r.page, r.type, r.refers_to) for r in got if r.payload_bytes == 9)[:1] == [("1", "response", None)]
    assert sum(r.type == "response" for r in got) == 4 and {r.payload_bytes for r in got} == {9, 0, 3_000_000, 8}
    assert [sum(r.type == "response" for r in warc.resolve(warc.write(pages, least=n)).collect()) for n in (9, 10)] == [5, 8]
    archive = warc.write(pages)
    some = warc.read(archive, archive.index.where("url = 'http://a' AND type = 'response'")).collect()
    assert [r.payload.decode() for r in some] == ["<p>é</p>"] and warc.resolve(warc.write(pages.limit(0))).count() == 0


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([(1, 1), (2, 1), (8, 0), (None, 1), (9, None), (7, 0), (1, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.key in (3, 4, 5)}) == 1
    empty = toxicity.train(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, empty).collect()} == {0.5}


def test_long_text_in_pieces(monkeypatch):
    words = " ".join(f"w{i}" for i in range(70_000))
    assert simhash.fingerprint(words) == brute.simhash(words)
    assert len(toxicity.features(words)) > 100_000
    sp, *tools = fertility._model(PIECE_VOCABULARY)
    assert tools[-1]  # so pieces are used
    rng = random.Random(2)
    parts = ["the", "of", "Über", "naïve", "x1", "  ", "\n", "\t", "日本", "привет", "😀", "a▁b", "▁", "...", "é", "\u00a0", "\u3000", "ﬁ"]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", " ", "", " ", "\n"]) for _ in range(rng.randint(1, 120))) for _ in range(400)]
    for size, some in ((40, texts), (1 << 16, [words * 3, "x" * 200_000, "y\n" * 100_000, " ".join(texts) * 40])):
        monkeypatch.setattr(fertility, "PIECE", size)
        for t in some:
            assert [i for p in fertility._pieces(t, True) for i in sp.encode(p)] == sp.encode(t)
    assert len(list(fertility._pieces(words, True))) > 5


def test_licences_and_lines(spark, docs):
    assert licences.scan(docs).count() == len(ROWS) and licences.scan(docs.limit(0)).count() == 0
    assert linededup.remove_lines(docs).count() == len(ROWS)


def test_pipeline_stages_keep_columns(spark, docs, sf):
    for name, stage in P.STAGES[:4]:
        assert stage(spark, docs, sf).columns == docs.columns, name
        assert stage(spark, docs.limit(0), sf).count() == 0
    name, stage = P.STAGES[4]
    rows = stage(spark, docs, sf).collect()
    assert sorted(repr(r.doc_id) for r in rows) == sorted(repr(r[0]) for r in ROWS) and stage(spark, docs.limit(0), sf).count() == 0
    assert sum(r.n_tokens == 1 for r in rows) == sum(not (r[1] or "").strip() for r in ROWS)


def test_remove_spans_keeps_case(spark):
    import re

    rng = random.Random(4)
    words = ["I", "A", "NASA", "saw", "go", "to", "the", "Moon", "x9", "Ünï", "ÉTÉ", "b"]
    texts = ["I saw NASA go to the Moon", "(A) B, C! saw NASA go.", "  NASA\nGO TO THE MOON", "[A]_B^the MOON", "to the Moon"]
    texts += ["".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "_", " [", "^"]) for _ in range(30)) for _ in range(60)]
    items = [(1, "go TO the"), (2, "nasa"), (3, "a b")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for i, t in enumerate(texts):
        w, hit = brute.alnum_words(t), set()
        for _, item in items:
            g = brute.alnum_words(item)
            hit |= {j + k for j in range(len(w)) if w[j : j + len(g)] == g for k in range(len(g))}
        spots = [m.start() for m in re.finditer("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t)] + [len(t)]
        want[i] = t[: spots[0]] + "".join(t[a:b] for j, (a, b) in enumerate(zip(spots, spots[1:])) if j not in hit)
    assert want[0] == "I saw Moon"
    assert {r.doc_id: r.text for r in decontaminate.remove_spans(df, bench).collect()} == want


def test_windows_that_many_items_have(spark):
    """A window of every item is sent in shares; blocks change nothing."""
    bench = spark.createDataFrame([(i, "the very same words") for i in range(300)] + [(1000, "other words here")], "item_id long, text string")
    df = spark.createDataFrame([(1, "x the very same words y"), (2, "other words here"), (3, "nothing")], "doc_id long, text string")
    want = {1: (4, sorted(map(str, range(300)))), 2: (3, ["1000"]), 3: (0, [])}
    for block in (10, 200_000):
        assert {r.key: (r.n_hit, r["items"]) for r in decontaminate.hits(df, bench, block=block).collect()} == want
    assert decontaminate.windows_of(bench).agg(F.max(F.size("items"))).first()[0] < 20


def test_mixing_rows_of_one_key(spark):
    rows = [(None, f"word {i}", "a") for i in range(300)] + [(7, f"word {i}", "b") for i in range(300)] + [(8, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first, again = (sorted(repr((r.row, r.copies)) for r in mixing.mix(d, count_words(d["text"])).collect()) for d in (df, df.repartition(5)))
    assert first == again and len(first) == 601
    totals = {"a": 600, "b": 600, None: 0}
    taken = dict.fromkeys(totals, 0)
    for r in mixing.mix(df, count_words(df["text"])).collect():
        taken[r.row.source] += r.size * r.copies
    assert all(abs(taken[s] - t) <= 4 for s, t in brute.targets(totals).items())


def test_training_is_bounded(spark, monkeypatch):
    """Rows of one labelled key and long texts stay within the bounds; equal rows count once."""
    rows = [(1, f"bad words {i}") for i in range(50)] + [(2, "good words")] * 50 + [(3, "long " * 10_000), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 0)], "doc_id long, toxic int")
    plain = toxicity.train(df, labels, most_bytes=2000)
    assert plain.score("bad words") > plain.score("good words") and (plain.at >= 0).all()
    assert len(toxicity.train(df, labels, most_rows=1).at) <= len(plain.at)
    assert not len(toxicity.train(df, labels, most_bytes=0).at)


def test_ftrl():
    """Against one coordinate at a time, in plain Python."""
    import math

    rng = random.Random(6)
    rows = []
    for _ in range(200):
        y = rng.random() < 0.4
        x = sorted({rng.randrange(30) + (30 if y and rng.random() < 0.7 else 0) for _ in range(rng.randint(0, 9))})
        rows.append((x, int(y)))
    alpha, beta, l1, l2 = 0.7, 1.0, 0.8, 0.1
    z, n, bias, bias_n = {}, {}, 0.0, 0.0

    def weight(i):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(3):
        for x, y in rows:
            w = {i: weight(i) for i in x}
            g = 1 / (1 + math.exp(-(sum(w.values()) + bias))) - y
            for i in x:
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
                z[i], n[i] = z.get(i, 0.0) + g - sigma * w[i], n.get(i, 0.0) + g * g
            bias_n += g * g
            bias -= alpha * g / (beta + math.sqrt(bias_n))
    import numpy as np

    found, intercept = toxicity.ftrl([(np.array(x, np.int32), y) for x, y in rows], 3, alpha, beta, l1, l2)
    assert intercept == pytest.approx(bias) and np.flatnonzero(found).tolist() == [i for i in sorted(z) if weight(i)]
    assert found[:60].tolist() == pytest.approx([weight(i) for i in range(60)])


def test_every_query_is_registered():
    import __spark_entry__ as entry

    wanted = {f"op{i}_" for i in range(1, 13)}
    assert {q.split("_")[0] + "_" for q in entry.queries() if q.startswith("op")} == wanted and "pipeline" in entry.queries()
