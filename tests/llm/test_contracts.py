"""The registered queries against brute force over whole small tables."""

import math
import random
from collections import defaultdict

import pytest
from tokenizers import Tokenizer

from slatework.llm import fertility
from slatework.llm import queries as Q
from tests.llm import brute


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").collect()


def test_simhash(spark, sf, docs):
    want = brute.components([(r.doc_id, brute.simhash(r.text)) for r in docs])
    got = {(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in Q.op2_simhash(spark, sf).collect()}
    assert got == set(want)


def test_decontaminate(spark, sf, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in Q.op4_decontaminate(spark, sf).collect()}
    assert len(got) == len(docs)
    for r in docs:
        want = brute.hits(r.text, items)
        assert got[r.doc_id] == (*want, want[1] > 0)
    assert sum(v[-1] for v in got.values()) > 0


def test_quality(spark, sf, docs):
    rows = {r.doc_id: r for r in Q.op5_fertility(spark, sf).collect()}
    for r in docs:
        g, want = rows[r.doc_id], brute.base_quality(r.text)
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want
        assert g.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (g.base_failed and g.kept)
    sp = fertility._model(Q.PIECE_VOCABULARY)[0]
    measured = fertility.score(spark.read.parquet(f"{sf}/documents.parquet"), Q.PIECE_VOCABULARY).collect()
    for m in measured:
        want = brute.token_measures(sp, m.row.text)
        assert m.n_tokens == want[0] and [m.chars_per_token, m.byte_share, m.entropy, m.mark_share] == pytest.approx(want[1:], abs=1e-9)
        band = fertility.DEFAULT.bands[m.row.lang]
        good = band.least_chars <= want[1] <= band.most_chars and want[2] <= band.most_bytes and want[4] <= band.most_marks
        assert m.kept == (not m.base_failed and good and want[3] >= band.least_entropy * math.log2(max(2, min(want[0], 1024))))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [rows[i].kept for i, q in labels.items() if q == 1 and not rows[i].base_failed]
    bad = [rows[i].kept for i, q in labels.items() if q == 0]
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.1


def test_mixing(spark, sf, docs):
    rows = Q.op7_mixing(spark, sf).collect()
    size = {r.doc_id: len(brute.space_words(r.text)) for r in docs}
    source = {r.doc_id: r.source for r in docs}
    total, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for d, s in source.items():
        total[s] += size[d]
        largest[s] = max(largest[s], size[d])
    want = brute.targets(total)
    assert len(rows) == len(docs)
    for r in rows:
        s = source[r.doc_id]
        assert r["size"] == size[r.doc_id] and r.source_size == total[s] and math.isclose(r.target, want[s])
        assert r.taken in [k * r["size"] for k in range(4)]
        taken[s] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 3 * largest[s]
    again = {(r.doc_id, r.taken) for r in Q.op7_mixing(spark, sf).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}


def test_tokens(spark, sf, docs):
    t, at = Tokenizer.from_file(Q.WORD_VOCABULARY), 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in Q.op9_tokenbin(spark, sf).collect()}
    for r in sorted(docs, key=lambda r: r.doc_id):
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 2]
        assert got[r.doc_id] == (at, len(ids), brute.crc(ids))
        at += len(ids)


def test_token_measures_reject_junk(spark, docs):
    other_marks = str.maketrans("#*$%&|<>", "@~^=+/{}")
    model = fertility._model(Q.PIECE_VOCABULARY)

    def kept(text, lang):
        return fertility.verdict(fertility.measure(text, *model), fertility.DEFAULT.bands[lang], fertility.DEFAULT)

    prose, junk = [], []
    for r in docs:
        if not kept(r.text, r.lang)[0]:
            (junk if brute.base_quality(r.text)[2] > 0.2 * len(brute.space_words(r.text)) else prose).append(r)
    assert len(junk) > 5 and all(kept(r.text, r.lang)[1] for r in prose)
    assert not any(kept(r.text.translate(other_marks), r.lang)[1] for r in junk)
    rng = random.Random(1)
    few = [(" ".join(rng.choices(r.text.split()[:20], k=300)), r.lang) for r in prose]
    assert not any(kept(*x)[1] for x in few) and not all(kept(*x)[0] for x in few)
    numbers = "\n".join(" ".join(f"{rng.randrange(9999)}.{rng.randrange(99)}" for _ in range(6)) for _ in range(40))
    assert not any(kept(numbers, lang)[1] for lang in fertility.DEFAULT.bands)
    loud = [kept(r.text.upper(), r.lang)[1] for r in prose if r.lang in ("de", "es")]
    assert len(loud) > 5 and sum(loud) <= 0.05 * len(loud)
