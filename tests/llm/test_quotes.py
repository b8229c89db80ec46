"""Quotation linking on a small planted conversation, and the SQL twin on the same rows."""

import random
import re
import textwrap
from collections import Counter, defaultdict

import duckdb

from slatework.llm import quotes
from slatework.llm.queries import ORACLES, op1_quotes

ROWS = [
    (1, 0, "user", "Hello there\nHow are you?", 5),
    (1, 1, "assistant", "> How  are YOU?\nFine.\nAnd you?", 5),
    (1, 2, "user", ">> How are you?\n> Fine.\nGood", 5),
    (1, 3, "user", "> Hello there\nlate answer", 5),
    (2, 0, "user", "> And you?\nfrom elsewhere", 5),
    (2, 1, "assistant", None, 5),
    (2, 2, "user", "", 5),
    (2, 4, "user", "> nobody wrote this", 5),
    (None, 0, "user", "> Fine.\nlost", 5),
    (3, None, "user", "no turn", 5),
]


def test_links_and_threads(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string, level int")
    got = {(r.row.conv_id, r.row.turn): r for r in quotes.conversations(df).collect()}
    assert len(got) == len(ROWS)
    to = lambda k: (got[k].to_conv, got[k].to_turn)
    assert to((1, 0)) == (None, None) and to((1, 1)) == (1, 0) and to((1, 2)) == (1, 1) and to((1, 3)) == (1, 0)
    assert to((2, 0)) == (1, 1) and (got[(2, 0)].root_conv, got[(2, 0)].root_turn, got[(2, 0)].depth) == (1, 0, 2)
    assert got[(1, 2)].n_linked == 2 and got[(2, 4)].n_quoted == 1 and got[(2, 4)].n_linked == 0
    assert got[(1, 1)].body == "Fine.\nAnd you?" and got[(2, 4)].body == "" and got[(2, 1)].body is None
    assert to((2, 4)) == (None, None) and got[(2, 4)].depth == 0 and got[(None, 0)].depth is None
    spans = {(r.conv, r.turn, r.passage): (r.level, r.content) for r in quotes.passages(df).collect()}
    assert spans[(1, 2, 0)] == (2, "How are you?") and spans[(1, 2, 1)] == (1, "Fine.") and spans[(1, 2, 2)] == (0, "Good")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    spark_rows = op1_quotes(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    rel = con.sql(ORACLES["op1_quotes"])
    want = sorted(map(repr, rel.fetchall()))
    assert sorted(repr(tuple(r[c] for c in rel.columns)) for r in spark_rows.collect()) == want


def test_empty_and_circles(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert quotes.conversations(df).count() == 0
    ring = spark.createDataFrame([(1, 0, "a", "one\n> two"), (2, 0, "b", "two\n> one")], "conv_id long, turn long, role string, text string")
    assert sorted((r.root_conv, r.depth) for r in quotes.conversations(ring).collect()) == [(1, 0), (2, 0)]


def test_author_in_another_conversation(spark):
    rows = [
        (1, 0, "hi"), (1, 1, "> L"), (1, 2, "L"), (2, 1, "L"), (2, 0, "L"), (3, 0, "L"), (4, 5, "> L"), (None, 0, "L\nM"), (2, None, "L\nN"),
        (5, 0, "> M\n> N"), (6, 0, "> O"), (6, 1, "O"), (6, 2, "> O\n> L"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    got = {(r.conv, r.turn): (r.to_conv, r.to_turn) for r in quotes.link(df).collect()}
    assert got == {(1, 1): (2, 0), (4, 5): (1, 2), (5, 0): (None, 0), (6, 0): (None, None), (6, 2): (6, 1)}
    answers = {(r.conv, r.turn): (r.n_linked, r.to_conv, r.to_turn) for r in quotes.parents(df).collect()}
    assert answers[(1, 1)] == (1, 2, 0)
    others = spark.createDataFrame([(1, 0, "> shared line"), (1, 1, "shared line"), (2, 0, "shared line")], "conv_id long, turn long, text string")
    assert [(r.to_conv, r.to_turn) for r in quotes.link(others).collect()] == [(2, 0)]


def _norm(text):
    return " ".join(re.sub(MARKS, "", text).lower().split())


MARKS = r"^((?:[ \t]*>)+)[ \t]?"


def _runs(text):
    out = []
    for raw in text.split("\n"):
        m = re.match(MARKS, raw)
        level = m[1].count(">") if m else 0
        bare = raw[m.end() :] if m else raw
        if out and out[-1][0] == level:
            out[-1][1].append(bare)
        else:
            out.append((level, [bare]))
    return [(level, "\n".join(lines)) for level, lines in out]


def _units(content):
    parts = [(0, content), *((1, x) for x in re.split("\n[\x09-\x0d ]*\n", content)), *((2, x) for x in content.split("\n"))]
    return [(g, _norm(x)) for g, x in parts if _norm(x)]


def brute_force(rows):
    """rows: (conv, turn, text). By (conv, turn): n_quoted, n_linked, parent, root, depth, place, written from the docstrings."""
    distinct = set(rows)
    first = {}
    for c, t, x in distinct:
        for level, content in _runs(x) if x is not None and t is not None else []:
            for _, u in _units(content) if level == 0 else []:
                by = first.setdefault(u, {})
                by[c] = min(t, by.get(c, t))

    def author(c, t, u):
        by = first.get(u, {})
        if c is not None and t is not None and c in by and by[c] < t:
            return c, by[c]
        rest = sorted((x for x in by if x != c), key=lambda x: (x is None, x))
        return (rest[0], by[rest[0]]) if rest else None

    later = lambda to, c: (to[0] != c, -to[1], to[0] is None, to[0])
    ids = {(c, t) for c, t, _ in rows if c is not None and t is not None}
    quoted, linked, votes = Counter(), Counter(), defaultdict(Counter)
    for c, t, x in distinct:
        for level, content in _runs(x or ""):
            units = _units(content) if level else []
            quoted[c, t] += bool(units)
            for g in range(3):
                sums = Counter()
                for grain, u in units:
                    if grain == g and author(c, t, u):
                        sums[author(c, t, u)] += len(u.split())
                if sums:
                    to = min(sums, key=lambda k: (-sums[k], *later(k, c)))
                    linked[c, t] += 1
                    if level == 1 and to[0] is not None:
                        votes[c, t][to] += sums[to]
                    break
    parent = {}
    for c, t in ids:
        v = votes[c, t]
        parent[c, t] = min(v, key=lambda k: (-v[k], -k[1], k[0])) if v else (c, t - 1) if (c, t - 1) in ids else None
    out, children = {}, defaultdict(list)
    for m in sorted(ids):
        seen, at = [m], m
        while parent[at] and parent[at] not in seen:
            at = parent[at]
            seen.append(at)
        circle = parent[at] is not None
        if circle:  # leads into a circle: members and all that hang on it are roots
            out[m] = [m, 0, 0]
        else:
            out[m] = [at, len(seen) - 1, None]
            if parent[m]:
                children[parent[m]].append(m)
    for m in ids:
        if out[m][2] is None and out[m][1] == 0:
            stack, place = [m], 0
            while stack:
                x = stack.pop()
                out[x][2] = place
                place += 1
                stack += sorted(children[x], reverse=True)
    return {m: (quoted[m], linked[m], parent[m], *out[m]) for m in ids}


def check(spark, rows, kind):
    df = spark.createDataFrame([(c, t, x, "z") for c, t, x in rows], f"conv_id {kind}, turn long, text string, place string")
    want = brute_force(rows)
    got = quotes.conversations(df).collect()
    assert len(got) == len(rows)
    for r in got:
        m = (r.row.conv_id, r.row.turn)
        if m not in want:
            assert (r.n_quoted, r.root_conv, r.depth, r.place) == (0, None, None, None)
            continue
        to = None if r.to_conv is None else (r.to_conv, r.to_turn)
        assert (r.n_quoted, r.n_linked, to, (r.root_conv, r.root_turn), r.depth, r.place) == want[m], m
    return want


def test_brute_force(spark):
    rng = random.Random(9)
    said = [" ".join(rng.choice(["ja", "No", "maybe", "ship", "it", "why", "not", "later", "über"]) for _ in range(rng.randint(1, 7))) for _ in range(40)]
    rows, written = [], []
    for c in range(12):
        for t in range(rng.randint(1, 14)):
            if rng.random() < 0.1:
                continue
            lines = []
            for _ in range(rng.randint(0, 3)):
                kind = rng.random()
                if written and kind < 0.5:  # quote some message, perhaps in part, perhaps wrapped anew
                    some = rng.choice(written).split("\n")
                    some = some[: rng.randint(1, len(some))]
                    if rng.random() < 0.3:
                        some = textwrap.wrap(" ".join(some), 12) or [""]
                    lines += [rng.choice(["> ", ">", ">> "]) + x for x in some]
                elif kind < 0.6:
                    lines.append("")
                else:
                    lines += rng.choices(said, k=rng.randint(1, 3))
            text = rng.choice([None, ""]) if rng.random() < 0.05 else "\n".join(lines)
            rows += [(c, t, text)] * (2 if rng.random() < 0.1 else 1)
            if rng.random() < 0.1:
                rows.append((c, t, "another text\n> " + rng.choice(said)))
            if text:
                written.append(text)
    rows += [(None, 1, "> maybe\nnobody"), (3, None, "ja\nlost turn"), (None, None, None), (50, 0, "> nobody"), (51, 0, "> lost turn")]
    want = check(spark, rows, "long")
    assert sum(v[1] for v in want.values()) > 25 and max(v[4] for v in want.values()) > 5 and any(v[2] and v[2][0] != m[0] for m, v in want.items())
    assert any(v[4] != v[5] for v in want.values())
    check(spark, [(None if c is None else f"c{c}", t, x) for c, t, x in rows], "string")


def test_long_texts_and_many_answers(spark):
    long = "\n".join(f"line {i} of a long text" for i in range(20_000))
    rows = [(1, 0, long), (1, 1, "\n".join("> " + x for x in long.split("\n")) + "\nmine"), (2, 0, "the question that all answer")]
    rows += [(2, 1 + i, f"> the question that all answer\nanswer {i}") for i in range(300)]
    rows += [(3, i, f"> answer {i}\n> the question that all answer") for i in range(0, 300, 7)]
    want = check(spark, rows, "int")
    assert want[1, 1][2] == (1, 0) and want[2, 300][5] == 300 and want[3, 294][2] == (2, 0)
