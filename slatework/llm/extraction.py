"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A block's features are the elements above it with the words of their names, its own shape (words, links, marks), and how
it stands in the page: the share of the page's prose in its container, headings passed. Steps between blocks are weighed by
how near two blocks are in the tree, so a run of comments stays one. The field is trained on labelled pages, by default
those of ``layouts`` made from the prose of a bounded sample and the sample itself, and decoded by Viterbi, page by page.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatework.llm import layouts
from slatework.llm.dom import Block, Element, blocks
from slatework.llm.text import arrow_batches

#: Elements whose nesting in each other is a feature.
_PARTS = frozenset("article main section header footer nav aside form table".split())
_PLAIN = frozenset(("", "html", "body", "head"))
_CUES = re.compile(
    r"cookie|newsletter|subscri|abonn|suscr|boletín|sign in|log in|anmeld|connecter|sesión|comment|kommentar|coment|repl|antwort|répond|respond|share|teilen|partag|compart|advert|anzeige|publicit|publicid|sponsor|"
    r"related|popular|recommend|mehr zum|lire aussi|relacionad|rights reserved|rechte vorbehalten|droits réservés|derechos reservados|privacy|datenschutz|privacidad|terms of|impressum|legal|copyright|©",
    re.I,
)
_BYLINE = re.compile(r"^(?:by|von|par|por|posted by|written by|last updated) |\bago$", re.I)
_COMMENTS = re.compile(r"comment|kommentar|coment|discussion|leave a reply", re.I)
_STOP = tuple(".!?…:;\"”»“)")
_LEVELS = np.array([2, 3, 5, 9, 16, 31, 61])
_SHARES = (0.02, 0.1, 0.3, 0.6)
#: Labels, and kinds of steps between blocks: same container, container of the other's container, other.
LABELS, STEPS = 2, 3


def _bucket(n: float, bounds) -> int:
    for i, b in enumerate(bounds):
        if n < b:
            return i
    return len(bounds)


def _lineage(e: Element, known, owner: object) -> tuple[frozenset[int], tuple[str, ...]]:
    """(features of an element and those above it, its enclosing parts), kept in the elements for their owner. ``known`` maps a name to a number or None."""
    chain = []
    while e is not None and (e.held is None or e.held[0] is not owner):
        chain.append(e)
        e = e.above
    held = (frozenset(), ()) if e is None else e.held[1]
    for x in reversed(chain):
        names = [f"in:{x.tag}"] if x.tag not in _PLAIN else []
        names += [f"name:{w}" for w in x.names[:16]]
        parts = held[1]
        if x.tag in _PARTS:
            names += [f"{p}>{x.tag}" for p in parts]
            parts = parts if x.tag in parts else (*parts, x.tag)
        new = {i for n in names if (i := known(n)) is not None} - held[0]
        held = (held[0] | new if new else held[0], parts)
        x.held = (owner, held)
    return held


def features(found: list[Block], known) -> tuple[list[list[int]], list[int]]:
    """(features of every block, kind of step into every block)."""
    owner = object()
    words = [b.text.count(" ") + 1 for b in found]
    shares = [b.linked / len(b.text) for b in found]
    plain = [w * (1 - s) for w, s in zip(words, shares)]
    total = sum(plain) or 1.0
    held: dict[int, float] = {}
    counts: dict[int, int] = {}
    weight: dict[int, float] = {}
    for b, w, s, p in zip(found, words, shares, plain):
        up = b.element.above or b.element
        for e in {id(b.element), id(up)}:
            held[e] = held.get(e, 0.0) + p
            counts[e] = counts.get(e, 0) + 1
        if w >= 8 and s < 0.4:
            weight[id(b.element)] = weight.get(id(b.element), 0.0) + p * (b.element.tag not in ("p", "li", "h1", "h2"))
            weight[id(up)] = weight.get(id(up), 0.0) + p
    best = max(weight, key=weight.get) if weight else None
    inside: dict[int, bool] = {}
    out, steps, h1, talk, headings = [], [], False, False, 0
    n = len(found)
    for i, (b, w, s) in enumerate(zip(found, words, shares)):
        e, up = b.element, b.element.above or b.element
        chain, x = [], e
        while x is not None and id(x) not in inside:
            chain.append(x)
            if id(x) == best:
                break
            x = x.above
        is_in = x is not None and (id(x) == best or inside.get(id(x), False))
        for x in chain:
            inside[id(x)] = is_in
        size, link = _bucket(w, _LEVELS), _bucket(s, (0.01, 0.3, 0.7))
        last = b.text[-1]
        names = [f"tag:{e.tag}", f"tag:{e.tag}/{up.tag}", f"words:{size}", f"links:{link}", f"words:{size}/links:{link}", f"tag:{e.tag}/words:{size}", f"tag:{e.tag}/{up.tag}/words:{min(size, 3)}", f"stop:{last in _STOP}/{size}", f"best:{is_in}", f"best:{is_in}/words:{size}"]
        names += [f"own:{_bucket(held[id(e)] / total, _SHARES)}", f"up:{_bucket(held[id(up)] / total, _SHARES)}", f"up:{_bucket(held[id(up)] / total, _SHARES)}/{_bucket(counts[id(up)], (2, 5, 12))}"]
        names += [f"h1:{h1}", f"talk:{talk}", f"place:{5 * i // n}"]
        if w <= 40:
            names += [f"cue:{c.lower()}" for c in dict.fromkeys(_CUES.findall(b.text))]
        if w <= 10 and last not in ".!?" and _BYLINE.search(b.text):
            names.append("byline")
        if link and any(c in b.text for c in "|·»›") and w <= 40:
            names.append(f"marks/links:{link}")
        if w <= 12 and sum(c.isdigit() for c in b.text) * 4 > len(b.text):
            names.append("digits")
        above, parts = _lineage(e, known, owner)
        around = "/".join(parts)
        names += [f"parts:{around}", f"parts:{around}/{e.tag}", f"parts:{around}/{e.tag}/links:{link}"]
        ids = set(above)
        ids.update(j for x in names if (j := known(x)) is not None)
        out.append(list(ids))
        if i == 0:
            steps.append(STEPS - 1)
        else:
            before = found[i - 1].element
            above = before.above or before
            steps.append(0 if above is up or before is e else 1 if above.above is up or up.above is above or before is up or e is above else 2)
        h1 = h1 or e.tag == "h1"
        talk = talk or w <= 6 and bool(_COMMENTS.search(b.text))
    return out, steps


@dataclass(frozen=True)
class Model:
    """Weights by feature for the label "article", weights of steps by kind and labels, and of the first block's labels."""

    weights: dict[str, float]
    steps: np.ndarray
    first: np.ndarray

    def decode(self, found: list[Block]) -> list[bool]:
        """The most likely labels, by Viterbi."""
        if not found:
            return []
        value: list[float] = []
        names: dict[str, int] = {}

        def known(name: str) -> int | None:
            w = self.weights.get(name)
            if w is None:
                return None
            if name not in names:
                names[name] = len(value)
                value.append(w)
            return names[name]

        ids, kinds = features(found, known)
        t = self.steps.tolist()
        other, mine = float(self.first[0]), float(self.first[1]) + sum(value[j] for j in ids[0])
        back = []
        for row, k in zip(ids[1:], kinds[1:]):
            step = t[k]
            a, b = other + step[0][0], mine + step[1][0]
            c, d = other + step[0][1], mine + step[1][1]
            back.append((b > a, d >= c))
            other, mine = max(a, b), max(c, d) + sum(value[j] for j in row)
        label = mine > other
        out = [label]
        for from_other, from_mine in reversed(back):
            label = from_mine if label else from_other
            out.append(label)
        return out[::-1]

    def text(self, page: str | None) -> str:
        """The article's blocks, two line feeds between them."""
        found = blocks(page)
        return "\n\n".join(b.text for b, mine in zip(found, self.decode(found)) if mine)


def fit(pages: list[tuple[list[list[int]], list[int], list[bool]]], n_features: int, rounds: int, l2: float, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Penalised maximum likelihood over (features, steps, labels) of pages: all gradients by forward-backward, steps by Adam."""
    pages = [p for p in pages if p[0]]
    w, steps, first = np.zeros(n_features), np.zeros((STEPS, LABELS, LABELS)), np.zeros(LABELS)
    if not pages:
        return w, steps, first
    lengths = np.array([len(p[0]) for p in pages])
    pages = [pages[i] for i in np.argsort(-lengths, kind="stable")]  # longest first: pages that last to a step are the first ones
    lengths = np.sort(lengths)[::-1]
    n_blocks, longest, n = int(lengths.sum()), int(lengths[0]), len(pages)
    ids = np.fromiter((j for p in pages for row in p[0] for j in row), np.int64)
    owner = np.repeat(np.arange(n_blocks), [len(row) for p in pages for row in p[0]])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    kinds = np.concatenate([np.array(p[1]) for p in pages])
    labels = np.concatenate([np.array(p[2], int) for p in pages])
    alive = [int((lengths > t).sum()) for t in range(longest)]
    follows = np.ones(n_blocks, bool)
    follows[starts] = False
    seen_steps = np.zeros_like(steps)
    np.add.at(seen_steps, (kinds[follows], labels[np.nonzero(follows)[0] - 1], labels[follows]), 1)
    seen_first = np.bincount(labels[starts], minlength=LABELS)
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in (w, steps, first)]
    for it in range(1, rounds + 1):
        score = np.zeros((n_blocks, LABELS))
        score[:, 1] = np.bincount(owner, w[ids], n_blocks)
        alpha, beta = np.zeros((n_blocks, LABELS)), np.zeros((n_blocks, LABELS))
        alpha[starts] = score[starts] + first
        for t in range(1, longest):
            at = starts[: alive[t]] + t
            alpha[at] = np.logaddexp.reduce(alpha[at - 1][:, :, None] + steps[kinds[at]], axis=1) + score[at]
        for t in range(longest - 2, -1, -1):
            at = starts[: alive[t + 1]] + t
            beta[at] = np.logaddexp.reduce(steps[kinds[at + 1]] + (score[at + 1] + beta[at + 1])[:, None, :], axis=2)
        norm = np.repeat(np.logaddexp.reduce(alpha[starts + lengths - 1], axis=1), lengths)
        marginal = np.exp(alpha + beta - norm[:, None])
        at = np.nonzero(follows)[0]
        pair = np.exp(alpha[at - 1][:, :, None] + steps[kinds[at]] + (score[at] + beta[at])[:, None, :] - norm[at][:, None, None])
        expected = np.zeros_like(steps)
        np.add.at(expected, kinds[at], pair)
        away = labels - marginal[:, 1]
        slopes = (np.bincount(ids, away[owner], n_features) / n - l2 * w, (seen_steps - expected) / n - l2 * steps, (seen_first - marginal[starts].sum(axis=0)) / n - l2 * first)
        for x, g, (m, v) in zip((w, steps, first), slopes, moments):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += rate * (m / (1 - 0.9**it)) / (np.sqrt(v / (1 - 0.99**it)) + 1e-8)
    return w, steps, first


def silver(page: str) -> tuple[list[Block], list[bool]] | None:
    """The blocks of a page that has one article element, and whether they are in it and in no part of another kind; None for other pages."""
    found, articles, labels = blocks(page), set(), []
    for b in found:
        e, mine = b.element, None
        while e is not None:
            if e.tag == "article":
                articles.add(id(e))
                mine = True if mine is None else mine
            elif e.tag in ("nav", "aside", "footer", "form"):
                mine = False
            e = e.above
        labels.append(bool(mine))
    return (found, labels) if len(articles) == 1 else None


def training_pages(sample: list[str], per_page: int, least: int = 0, seed: int = 0) -> Iterator[tuple[list[Block], list[bool]]]:
    """Labelled pages from a sample: the pages that mark their article, and ``per_page`` layouts with the prose of each, ``least`` or so in all."""
    articles, own = [], []
    for page in sample:
        marked = silver(page)
        if marked is not None and any(marked[1]):
            own.append(marked)
            articles.append([b.text for b, mine in zip(*marked) if mine])
        else:
            articles.append([b.text for b in blocks(page) if b.text.count(" ") >= 8 and b.linked == 0])
    for _ in range(1 + max(1, least // (3 * max(1, len(sample))))):  # so often that they are about a third
        yield from own
    rng = random.Random(seed)
    articles = [a for a in articles if a] or [layouts.stand_in(rng) for _ in range(60)]
    pool = [p for a in articles for p in a[1:]] or articles[0]
    for article in articles:
        for _ in range(max(per_page, least // len(articles))):
            at = rng.randrange(max(1, len(article) - 24))
            title = " ".join(article[0].split()[: rng.choice((1, 2, 2, 3, 4, 6, 8, 10, 14))])
            some = [title, *article[max(1, at) : at + rng.randint(2, 24)]]
            if rng.random() < 0.1:  # an article of one short paragraph
                some = [title, " ".join(article[-1].split()[: rng.randint(2, 9)])]
            found = blocks(layouts.labelled(rng, some, pool))
            labels = [layouts.MARK in b.text for b in found]
            for b in found:
                b.text = b.text.replace(layouts.MARK, "").strip() or "."
            yield found, labels


def train(
    pages: DataFrame,
    labelled: DataFrame | None = None,
    most_rows: int = 400,
    most_bytes: int = 1 << 16,
    per_page: int = 4,
    least: int = 1200,
    most_features: int = 20000,
    rounds: int = 120,
    l2: float = 0.001,
    rate: float = 0.08,
    page: str = "page_id",
    html: str = "html",
) -> Model:
    """Fit on at most ``most_rows`` pages of up to ``most_bytes`` each, those with the smallest hash of id and html, in one task.

    ``labelled`` (html, and main: the texts of the article's blocks) are pages labelled by hand; they come in addition, under the
    same bounds. Null and empty pages are left out; without any page the layouts get words that stand for some. Equal pages count once.
    """
    spark = pages.sparkSession
    fits = (F.octet_length("html") <= most_bytes) & (F.length("html") > 0)
    light = pages.select(F.col(html).alias("html"), F.xxhash64(page, html).alias("h"), F.lit(None).cast("array<string>").alias("main")).where(fits)
    chosen = light.orderBy("h").limit(most_rows)
    if labelled is not None:
        more = labelled.select("html", F.xxhash64("html").alias("h"), "main").where(fits & F.col("main").isNotNull())
        chosen = chosen.unionByName(more.orderBy("h").limit(most_rows))
    # An empty row, so that there is a model of an empty table.
    chosen = chosen.unionByName(spark.range(1).select(F.lit(None).cast("string").alias("html"), F.lit(0).cast("long").alias("h"), F.lit(None).cast("array<string>").alias("main")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = {(r.html, None if r.main is None else tuple(r.main)) for b in batches for r in b.itertuples() if r.html is not None}
        rows = sorted(rows, key=lambda r: (zlib.crc32(r[0].encode("utf-8", "replace")), r[0], r[1] or ()))
        found = list(training_pages([h for h, main in rows if main is None], per_page, least))
        for h, main in rows:
            if main is not None:
                some, mine = blocks(h), {" ".join(x.split()) for x in main}
                found.append((some, [b.text in mine for b in some]))
        counts: dict[str, int] = {}
        for some, _ in found:
            names: dict[str, int] = {}
            features(some, lambda name, names=names: names.setdefault(name, len(names)))
            for x in names:
                counts[x] = counts.get(x, 0) + 1
        kept = sorted((x for x, c in counts.items() if c >= 3), key=lambda x: (-counts[x], x))[:most_features]
        number = {x: i for i, x in enumerate(kept)}
        data = [(*features(some, number.get), labels) for some, labels in found]
        w, steps, first = fit(data, len(kept), rounds, l2, rate)
        names = [*kept, *[f"\x00step:{i}" for i in range(steps.size)], *[f"\x00first:{i}" for i in range(LABELS)]]
        yield pd.DataFrame({"name": names, "w": np.concatenate([w, steps.ravel(), first])})

    found = chosen.repartition(1).mapInPandas(run, "name string, w double").toPandas()  # most_features rows and a few
    weights = dict(zip(found["name"], found["w"]))
    steps = np.array([weights.pop(f"\x00step:{i}") for i in range(STEPS * LABELS**2)]).reshape(STEPS, LABELS, LABELS)
    return Model(weights, steps, np.array([weights.pop(f"\x00first:{i}") for i in range(LABELS)]))


def extract(pages: DataFrame, model: Model, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page, url, text and n_chars of every row, in place: whole pages, nothing shuffled.

    Null and empty pages, and pages without a block of the article, have an empty text. Repeated rows and null ids and urls
    stay as they are; other columns are left out. A very long page is read in one pass, its features take a few numbers a block.
    """
    rows = pages.select(F.col(page).alias("page"), F.col(url).alias("url"), F.col(html).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [model.text(p.as_py()) for p in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    with arrow_batches(pages.sparkSession, 256):
        return rows.mapInArrow(run, f"page {kinds['page']}, url {kinds['url']}, text string, n_chars long")
