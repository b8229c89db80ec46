"""Plain Python versions of the corpus operators, written from their contracts."""

import hashlib
import math
import re
import unicodedata
import zlib
from collections import Counter

import xxhash

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def space_words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def simhash(text):
    w = space_words((text or "").translate(UP))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def components(rows, most=3):
    """rows: (doc_id, fp). Smallest doc_id reachable, by doc row."""
    fps = list({f for _, f in rows})
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin(a ^ b).count("1") <= most:
                parent[find(a)] = find(b)
    least = {}
    for d, f in rows:
        if d is not None:
            least[find(f)] = min(least.get(find(f), d), d)
    return [(d, f, least.get(find(f))) for d, f in rows]


def alnum_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(UP))


def hits(text, items, width=10):
    w = alnum_words(text)
    hit, found = set(), set()
    for item, t in items:
        iw = alnum_words(t)
        if not iw:
            continue
        k = min(width, len(iw))
        grams = {tuple(iw[i : i + k]) for i in range(len(iw) - k + 1)}
        for i in range(len(w) - k + 1):
            if tuple(w[i : i + k]) in grams:
                hit |= set(range(i, i + k))
                found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def base_quality(text):
    w = space_words(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    rep = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if space_words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(rep)


def crc(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


def targets(sizes, weights=(1, 2, 3), cap=3):
    """sizes: {source: words}, shared again and again as the contract says."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed, rest = {}, set(order)
    while True:
        left = sum(sizes.values()) - sum(fixed.values())
        level = left / sum(weight[s] for s in rest) if rest else 0
        over = {s for s in rest if level * weight[s] > cap * sizes[s]}
        if not over:
            return fixed | {s: level * weight[s] for s in rest}
        fixed |= {s: cap * sizes[s] for s in over}
        rest -= over


def token_measures(sp, text):
    """Tokens, characters per token, share of bytes, entropy and share of tokens of marks only, from one encode of the whole text."""
    ids = sp.encode(text or "")
    n, chars = len(ids), sum(map(len, space_words(text)))
    if not n:
        return 0, 0.0, 0.0, 0.0, 0.0
    counts = Counter(ids)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())

    def marks(i):
        p = sp.id_to_piece(i).replace("\u2581", "").strip()
        return bool(p) and not sp.is_byte(i) and i > 2 and all(unicodedata.category(c)[0] not in "LNM" for c in p)

    return n, chars / n, sum(c for i, c in counts.items() if sp.is_byte(i)) / n, entropy, sum(c for i, c in counts.items() if marks(i)) / n


def declared(text, templates):
    """Families whose short declarations stand in a text word for word."""
    plain = " ".join(re.findall("[a-z0-9]+", (text or "").lower()))
    short = {f: " ".join(re.findall("[a-z0-9]+", t[-1].lower())) for f, t in templates.items()}
    return {f for f, t in short.items() if f" {t} " in f" {plain} "}


def sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(fields):
    return sha("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields)


def _tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def _way(levels, at):
    for level in levels[:-1]:
        first = at // 8 * 8
        yield from (h for i, h in enumerate(level[first : first + 8], first) if i != at)
        at //= 8


def merkle(rows):
    """rows: (group, key, leaf). ([(group, key, leaf, subroot, siblings up to the root)], root)."""
    groups = {}
    for g, key, h in rows:
        groups.setdefault(g, []).append((key is not None, key or 0, h))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [_tree([h for *_, h in sorted(groups[g])]) for g in order]
    top = _tree([t[-1][0] for t in trees])
    out = []
    for at, g in enumerate(order):
        for i, (has, key, h) in enumerate(sorted(groups[g])):
            out.append((g, key if has else None, h, trees[at][-1][0], [*_way(trees[at], i), *_way(top, at)]))
    return out, top[-1][0]
