"""Line deduplication against all pairs of lines."""

import hashlib
import random

import numpy as np
import pyarrow as pa

from slatework.llm import linededup
from slatework.llm.queries import op8_linededup
from tests.llm import brute


#: Lines beyond which the sort key of a batch once had no room.
FAR = 1 << 20


def removed(rows):
    """rows: (key, text). Line numbers each text loses."""
    seen, out = [], {}
    for k, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        gone = []
        for i, line in enumerate([] if t is None else t.split("\n")):
            s = frozenset(brute.space_words(line.translate(brute.UP)))
            if s:
                if any(5 * len(s & x) >= 4 * len(s | x) for x in seen):
                    gone.append(i)
                seen.append(s)
        out[k] = gone
    return out


def test_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {k: (len(v), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for k, v in removed(docs).items()}
    got = {r.doc_id: (r.n_removed, r.removed_sha256) for r in op8_linededup(spark, sf).collect()}
    assert got == want and sum(v[0] for v in want.values()) > 0


def test_many_variants_and_nulls(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join(base[:j] + [f"x{rng.randrange(40)}"] + base[j + 1 :])) for i, j in enumerate(rng.choices(range(12), k=120))]
    rows += [(200, None), (201, ""), (202, " \n\n"), (None, "w0 w1\nlone"), (203, "A b\na B c\nc b a\n\na b c d e"), (204, "a b c d")]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, line int")
    got = {r.key: r.removed for r in linededup.removals(df).collect()}
    assert {k: v for k, v in removed(rows).items() if v} == got
    texts = {r.row.doc_id: r.text for r in linededup.remove_lines(df).collect()}
    assert len(texts) == len(rows) and texts[200] is None and texts[202] == " \n\n" and texts[203] == "A b\na B c\n\na b c d e"
    assert linededup.removals(df.limit(0)).count() == 0


def test_more_lines_than_a_sort_key_holds(spark):
    def lines(apart):
        words = [" ".join(f"{c}{i}" for i in range(10)) for c in "xy"]
        return words[0] + "\n" * apart + words[1]

    for texts in ([lines(FAR)], ["", lines(1000), None, lines(2 * FAR), lines(3)]):
        hashes, line, _ = linededup._hashed(pa.array(texts))
        h, at = linededup._sets(hashes, line, np.zeros(1 << linededup.RARITY, np.uint8))
        found, n = np.unique(at, return_counts=True)
        assert (np.diff(at) >= 0).all() and sorted(found) == sorted(set(line.tolist())) and set(n.tolist()) == {10}
        assert all(set(h[at == x]) == set(hashes[line == x]) for x in found)
    # y0 is clean: it shares its number modulo FAR with the first line, whose fragments must not count.
    rows = [(1, lines(FAR) + "\nx0"), (2, "y9 z\n" + lines(5))]
    got = {r.key: r.removed for r in linededup.removals(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {2: [1, 6]}


def _crowded():
    """Near copies of a line whose words are all common, so that words and pairs of words have too many lines for one block."""
    rng = random.Random(11)
    base, other = [f"w{i}" for i in range(12)], [f"z{i}" for i in range(400)]
    lines = []
    for i in range(2100):
        if i % 7:
            words = list(base)
            for j in rng.sample(range(12), rng.choice([1, 1, 1, 2])):
                words[j] = rng.choice(other)
        else:
            words = rng.sample(other, 9) + rng.sample(base, 2)
        lines.append(" ".join(words))
    return [(i // 3, "\n".join(lines[i : i + 3])) for i in range(0, len(lines), 3)]


def test_common_words_are_split(spark, monkeypatch):
    rows = _crowded()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = {k: v for k, v in removed(rows).items() if v}
    seen = []
    kept = linededup.Deal.of
    monkeypatch.setattr(linededup.Deal, "of", staticmethod(lambda *a: seen.append(kept(*a)) or seen[-1]))
    assert {r.key: r.removed for r in linededup.removals(df).collect()} == want
    assert len(seen) == 2 and max(seen[0].blocks) > 2 and len(seen[1].words) > 1 and len(seen[1].slots) > 0
    # Fewer slots may be split, and seekers' slots may be too many to be sent: other ways, the same result.
    monkeypatch.setattr(linededup, "MOST_BROADCAST", 1)
    assert {r.key: r.removed for r in linededup.removals(df).collect()} == want and len(seen[2].slots) == 1
    monkeypatch.setattr(linededup, "MOST_BROADCAST", 0)
    monkeypatch.setattr(linededup, "FIRST", 1)
    monkeypatch.setattr(linededup, "AGAIN", 2)
    monkeypatch.setattr(linededup, "TREE", 1)
    monkeypatch.setattr(linededup, "input_bytes", lambda docs: 3 * linededup.SPLIT)
    assert {r.key: r.removed for r in linededup.removals(df).collect()} == want


def test_two_words_of_a_line_in_one_slot():
    """Equal halves of word hashes put a line into a slot twice; it is no partner of itself."""
    meta = np.array([(5 << 32) | linededup.SEEK | linededup.BASE | p for p in (0, 1)], np.int64)
    none = np.zeros(2, np.int64)
    later, earlier, more = linededup._pairs_in_groups(np.array([7, 7]), np.array([3, 3]), meta, none, none, 4, 5, 4)
    assert not any(map(len, later)) and not any(map(len, earlier)) and not any(map(len, more))


def test_a_line_of_many_documents(spark):
    """One line makes half of all rows, so its places are found by broadcast."""
    rows = [(i, f"the same words everywhere here\nown{i} line{i // 2} of{i} number{i}") for i in range(120)] + [(500, "the same words everywhere")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.key: r.removed for r in linededup.removals(df).collect()} == {k: v for k, v in removed(rows).items() if v}
