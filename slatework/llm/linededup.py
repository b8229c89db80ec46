"""Line deduplication by an exact set-similarity join.

A line is the set of its lower-cased words. Words are ordered by rarity, a line's prefix is what a
partner of the wanted Jaccard similarity must share a word with, and pairs that share a prefix word
pass the length filter, the positional filter and a bit-parity bound before their Jaccard is verified on the
whole sets. A line is removed if an earlier line (by document key, then line number) is similar to it;
lines without words stay.

1. Words are counted in 2**RARITY hash buckets over all texts: a table of fixed size that is broadcast. Any
   order of words is right; rarity only keeps the prefixes selective, and a word counted once has no partner.
2. Equal sets collapse; a distinct set keeps its first place, size, parity bits and prefix.
3. Prefix words are dealt by word, many rows in a blob. Within a word's lines, in order of first place, each line is paired
   with the nearest FIRST earlier lines that pass the filters, and is marked if there are more. Lines of a word of more than
   2 * BLOCK lines look within their block of it, and are marked too.
4. Pairs are verified. Marked lines that found no similar earlier line look again, with a cap AGAIN times as high, until none
   is marked and without one. Then words of many lines are dealt by pairs of words, and of a pair of many lines all blocks
   meet all that look. So caps and blocks lose nothing: they only keep a group of many variants from making all its
   pairs, or from meeting in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatework.llm.text import arrow_batches, input_bytes
from slatework.scratch import materialize

RARITY, FIRST = 24, 4
#: Buckets are summed in pieces of this many, and over so many tasks at first.
PIECE, TREE = 1 << 16, 512
#: Bytes of a file that a task is taken to read.
SPLIT = 128 << 20
#: Slots that are broadcast, and half as many lines to read again; beyond it they are joined by a shuffle, or slots stay whole.
MOST_BROADCAST = 400_000
#: A slot of twice as many rows is split into blocks of about so many; rows a bucket (held by a task) and a blob have.
BLOCK, BUCKET, BLOB = 512, 1 << 16, 1 << 14
#: Marks of a row, beside a word's position: it looks for earlier sets, it can be found, its slot is split.
SEEK, BASE, PART, PLACE = 1 << 30, 1 << 29, 1 << 28, (1 << 28) - 1
#: How many times as many pairs as before a set gets when it looks again.
AGAIN = 1024
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Lines sorted at once: what a sort key has room for.
LINES = 1 << 20
#: The lowest bytes of a number.
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)
#: Bytes of a word that are hashed eight at a time, with all others of the batch; longer words have their own call.
LONG = 4096


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, one text after the other, and where each begins (and the last ends)."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    held = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(offsets) else np.zeros(0, np.uint8)
    return held, offsets - (offsets[0] if len(offsets) else 0)


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit numbers, well mixed."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of every word of the texts: its lower-cased bytes, eight at a time, for all words at once."""
    from xxhash import xxh64_intdigest

    n = len(data)
    low = np.frombuffer(data.tobytes().translate(_LOWER) + bytes(8), np.uint8)
    inside = (data != 32) & ((data - np.uint8(9)) > 4)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    first = offsets[:-1][offsets[:-1] < n]  # a text's first byte begins a word even if the text before ends in one
    before[first] = False
    after[first[first > 0] - 1] = False
    starts, ends = np.flatnonzero(inside > before), np.flatnonzero(inside > after) + 1
    size = ends - starts
    eight = np.ndarray((n + 1,), "<u8", low, strides=(1,))  # the eight bytes from each place on
    hashes = _mix((eight[starts] & _MASK[np.minimum(size, 8)]) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    at, left = 8, np.flatnonzero(size > 8)
    while len(left) and at < LONG:
        hashes[left] = _mix(hashes[left] ^ (eight[starts[left] + at] & _MASK[np.minimum(size[left] - at, 8)]))
        at += 8
        left = left[size[left] > at]
    for i in left:
        hashes[i] = xxh64_intdigest(low[starts[i] : ends[i]].tobytes())
    return hashes, starts


def _hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, the running number of the line each stands in, and the lines of each text (none of a null)."""
    data, offsets = _bytes_of(column)
    hashes, starts = _word_hashes(data, offsets)
    breaks = np.flatnonzero(data == 10)
    valid = np.asarray(column.is_valid())
    lines = np.where(valid, np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1]) + 1, 0)
    text = np.searchsorted(offsets, starts, "right") - 1
    first = np.concatenate(([0], np.cumsum(lines)))[:-1]
    in_text = np.searchsorted(breaks, starts) - np.searchsorted(breaks, offsets[:-1])[text]
    return hashes, first[text] + in_text, lines


def rarity(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Rarity level (0 for words counted once at most, to 127) per hash bucket, over all texts; 2**RARITY bytes whatever the corpus.

    Tasks send their non-zero buckets in sorted pieces; pieces are summed where they meet.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << RARITY, np.int32)
        for b in batches:
            hashes, _ = _word_hashes(*_bytes_of(b.column(0)))
            np.add.at(total, (hashes >> np.uint64(64 - RARITY)).astype(np.intp), np.int32(1))
        at = np.flatnonzero(total).astype(np.int32)
        bounds = np.searchsorted(at, np.arange(0, (1 << RARITY) + 1, PIECE))
        for piece, (x, y) in enumerate(zip(bounds, bounds[1:])):
            if y > x:
                where, n = (at[x:y] % PIECE).astype("<u2").tobytes(), np.minimum(total[at[x:y]], 65535).astype("<u2").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([where]), pa.array([n])], ["piece", "at", "n"])

    def add(width: str, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for b in batches:
                for piece, where, n in zip(*(c.to_pylist() for c in b.columns)):
                    held = sums.setdefault(piece, np.zeros(PIECE, np.int64))
                    held[np.frombuffer(where, "<u2")] += np.frombuffer(n, width)
            for piece, held in sums.items():
                at = np.flatnonzero(held)
                out = np.minimum(127, np.ceil(4 * np.log2(held[at]))).astype(np.uint8) if last else np.minimum(held[at], (1 << 32) - 1).astype("<u4")
                yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([at.astype("<u2").tobytes()]), pa.array([out.tobytes()])], ["piece", "at", "n"])

        return run

    schema, width = "piece int, at binary, n binary", "<u2"
    parts = docs.select(F.col(text).alias("text")).mapInArrow(count, schema)
    tasks = -(-input_bytes(docs) // SPLIT)
    if tasks > TREE:  # sums of TREE tasks first, so that no task reads what all tasks counted
        groups = -(-tasks // TREE)
        parts = parts.repartition(min(groups * ((1 << RARITY) // PIECE), 20_000), "piece", F.spark_partition_id() % groups).mapInArrow(add("<u2", False), schema)
        width = "<u4"
    levels = np.zeros(1 << RARITY, np.uint8)
    with arrow_batches(docs.sparkSession, 512):
        sums = parts.repartition("piece").mapInArrow(add(width, True), schema).collect()  # 2**RARITY bytes and places at most
    for r in sums:
        levels[r.piece * PIECE : (r.piece + 1) * PIECE][np.frombuffer(r.at, "<u2")] = np.frombuffer(r.n, np.uint8)
    return levels


def _sets(hashes: np.ndarray, line: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashes, their lines), by line, then rarity level, then hash. Lines come in ascending order, LINES of them are sorted at once."""
    if not len(line) or line[-1] < LINES:
        return _sorted_sets(hashes, line, level)
    cuts = np.searchsorted(line, np.arange(0, int(line[-1]) + LINES + 1, LINES))
    parts = [(_sorted_sets(hashes[x:y], line[x:y] - i * LINES, level), i * LINES) for i, (x, y) in enumerate(zip(cuts, cuts[1:])) if y > x]
    return np.concatenate([h for (h, _), _ in parts]), np.concatenate([at + base for (_, at), base in parts])


def _sorted_sets(hashes: np.ndarray, line: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``_sets``, for line numbers below LINES."""
    bits = (level[(hashes >> np.uint64(64 - RARITY)).astype(np.int64)]).astype(np.uint64)
    # Level and the hash's upper bits in one number sort fast; full ties of other hashes are put right below.
    key = (line.astype(np.uint64) << np.uint64(44)) | (bits << np.uint64(37)) | (hashes >> np.uint64(27))
    order = np.argsort(key)
    key, hashes, line = key[order], hashes[order], line[order]
    same = key[1:] == key[:-1]
    if (hashes[1:][same] != hashes[:-1][same]).any():
        order = np.lexsort((hashes, key))
        hashes, line = hashes[order], line[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (line[1:] != line[:-1])
    return hashes[new], line[new]


def _least_overlap(total, num: int, den: int):
    """Common words that sets with ``total`` words together need: ceil(t / (1 + t) * total)."""
    return -((-num * total) // (num + den))


def _prefix(size, num: int, den: int):
    """Words of a set's prefix: similar sets share one of them at least, and two of one word more."""
    return size - (-(-num * size // den)) + 1


def occurrences(docs: DataFrame, level: np.ndarray, t: Fraction, key: str, text: str) -> DataFrame:
    """key, th, line, a, b (128-bit digest of the set), size, parity, prefix of every line with words."""
    num, den = t.numerator, t.denominator
    spread = docs.sparkSession.sparkContext.broadcast(level)
    often = int(4 * np.log2(2 * BLOCK))
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for b in batches:
            hashes, line, lines = _hashed(b.column(2))
            if not len(hashes):
                continue
            level = spread.value
            h, at = _sets(hashes, line, level)
            starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            sizes = np.diff(np.append(starts, len(h)))
            raw = h.astype("<u8").tobytes()
            ends = (starts + sizes) * 8
            digests = np.frombuffer(b"".join([xxh3_128_digest(raw[s:e]) for s, e in zip((starts * 8).tolist(), ends.tolist())]), "<i8").reshape(-1, 2)
            # 128 parity bits in two words: which one a word counts in is another bit of its hash.
            bit, side = np.uint64(1) << (h & np.uint64(63)), (h & np.uint64(64)) > 0
            parity, parity2 = (np.bitwise_xor.reduceat(np.where(side == s, bit, np.uint64(0)), starts).view(np.int64) for s in (False, True))
            length = _prefix(sizes, num, den)
            within = np.arange(len(h)) - np.repeat(starts, sizes)
            # A word counted once has no partner, and comes first; equal halves of other words only add candidates.
            levels = level[(h >> np.uint64(64 - RARITY)).astype(np.int64)]
            shared = (within < np.repeat(length + 1, sizes)) & (levels > 0)
            prefix = ((h[shared] & ~np.uint64(1)) | (levels[shared] > often)).astype("<u4").tobytes()
            cuts = np.concatenate(([0], np.cumsum(np.add.reduceat(shared.astype(np.int64), starts)))) * 4
            prefixes = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(prefix)])
            number = at[starts]  # of the line in the batch
            doc_of = np.repeat(np.arange(len(lines)), lines)
            first_of = np.concatenate(([0], np.cumsum(lines)))[:-1]
            doc = doc_of[number]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(doc)), b.column(1).take(pa.array(doc)), pa.array((number - first_of[doc]).astype(np.int32)),
                    pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()), pa.array(sizes.astype(np.int32)), pa.array(parity), pa.array(parity2),
                    prefixes,
                ],
                ["key", "th", "line", "a", "b", "size", "parity", "parity2", "prefix"],
            )

    return rows.mapInArrow(run, f"key {kind}, th long, line int, a long, b long, size int, parity long, parity2 long, prefix binary")


def _place(key: Column | str, line: Column | str, th: Column | str) -> Column:
    """Order of lines: null keys last, then key, text hash (of repeated keys) and line number."""
    return F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col(th).alias("th"), F.col(line).alias("line"))


def _pairs_in_groups(slot, ids, meta, parity, parity2, num: int, den: int, most: int) -> tuple[list, list, list]:
    """Pairs (later, earlier) and marked lines among rows sorted by slot and id; groups are whole.

    All rows that look step back through their groups together, one place at a time; a row that has ``most`` pairs and
    finds another is marked and stops. Rows of a slot that was split are marked at the end: other parts were not seen.
    The parity, length and positional filters keep every pair of the wanted similarity.
    """
    size = (meta >> 32).astype(np.int32)
    room = size - (meta & PLACE).astype(np.int32)
    apart = size * np.int32(den - num)  # words that are not shared, as a bound
    base = (meta & BASE) != 0
    parity, parity2 = parity.view(np.uint64), parity2.view(np.uint64)
    later, earlier, more = [], [], []
    begins = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
    within = (np.arange(len(slot)) - np.repeat(begins, np.diff(np.append(begins, len(slot))))).astype(np.int32)
    active = np.flatnonzero((within > 0) & ((meta & SEEK) != 0))
    given, full = np.zeros(len(slot), np.int32), np.zeros(len(slot), bool)
    d = 1
    while len(active):
        back = active - d
        odd = np.bitwise_count(parity[active] ^ parity[back]) + np.bitwise_count(parity2[active] ^ parity2[back])
        x = active[odd * np.int32(num + den) <= apart[active] + apart[back]]
        if len(x):
            y = x - d
            total, least = size[x] + size[y], np.minimum(size[x], size[y])
            ok = (den * least >= num * (total - least)) & (np.minimum(room[x], room[y]) * (num + den) >= num * total)
            x = x[ok & base[y] & (ids[y] != ids[x])]
            over = given[x] == most
            full[x[over]] = True
            x = x[~over]
            given[x] += 1
            later.append(ids[x])
            earlier.append(ids[x - d])
        d += 1
        active = active[(within[active] >= d) & ~full[active]]
    more.append(ids[full | ((meta & PART) != 0)])
    return later, earlier, more


def _slots(prefixes: pa.Array, size: np.ndarray, hot: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, position, frequent) of the prefix words of some sets of ``size`` words.

    A word is a slot. A hot word (sorted in ``hot``) is a slot per later word of the set's prefix, which is one word longer
    for that: similar sets share two words or more, and the first shared one is in both prefixes, another in both longer ones.
    """
    n = np.asarray(pa.compute.binary_length(prefixes)).astype(np.int64) // 4
    word = np.frombuffer(b"".join(prefixes.to_pylist()), "<u4")
    row, ends = np.repeat(np.arange(len(n)), n), np.cumsum(n)
    length = _prefix(size.astype(np.int64), num, den)
    # Words counted once come first and are left out.
    pos = np.arange(len(word)) - np.repeat(ends - np.minimum(length + 1, size), n)
    own, often = pos < length[row], (word & 1) != 0
    split = np.zeros(len(word), bool)
    if len(hot):
        some = np.flatnonzero(own & often)
        split[some] = hot[np.minimum(np.searchsorted(hot, word[some]), len(hot) - 1)] == word[some]
    plain, hit = np.flatnonzero(own & ~split), np.flatnonzero(split)
    one, number = _copied(ends[row[hit]] - hit - 1)
    one = hit[one]
    both = _mix((word[one].astype(np.uint64) << np.uint64(32)) | word[one + 1 + number]) | np.uint64(1 << 63)
    at = np.concatenate([plain, one])
    return row[at], np.concatenate([word[plain].astype(np.uint64), both]), pos[at], often[at]


def _copied(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, number) of n[i] copies of each i."""
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)


def _counted(sets: DataFrame, hot: np.ndarray, t: Fraction, frequent: bool, label: str) -> DataFrame:
    """slot, n: rows per slot of ``sets``; of frequent words alone, or of all slots. Also slot -1 with the rows of all slots."""
    num, den = t.numerator, t.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, slot, _, often = _slots(b.column(1), b.column(0).to_numpy(), hot, num, den)
            found, n = np.unique(slot[often] if frequent else slot, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(found.view(np.int64), -1)), pa.array(np.append(n, len(slot)).astype(np.int64))], ["slot", "n"])

    return materialize(sets.select("size", "prefix").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")), label)


@dataclass(frozen=True)
class Deal:
    """How prefix words are dealt: hot words (by pairs of words), slots of many rows with the numbers of their blocks, buckets."""

    words: np.ndarray
    slots: np.ndarray
    blocks: np.ndarray
    buckets: int

    @staticmethod
    def of(sets: DataFrame, t: Fraction, hot: Deal | None = None) -> Deal:
        """Counted over all sets: by words, or with the words that ``hot`` splits by pairs of words.

        Which slots are split changes the work, not the result: of more than MOST_BROADCAST the rest stays whole.
        """
        words = np.zeros(0, np.uint32) if hot is None else hot.slots.astype(np.uint32)
        counted = _counted(sets, words, t, True, "line-frequent")
        total = counted.where("slot = -1").agg(F.sum("n")).first()[0] or 0
        rows = counted.where((F.col("slot") != -1) & (F.col("n") > 2 * BLOCK)).orderBy(F.col("n").desc(), "slot").limit(MOST_BROADCAST).toPandas()
        slots, n = rows["slot"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)
        order = np.argsort(slots)
        return Deal(words, slots[order], -(-n[order] // BLOCK), max(1, -(-total // BUCKET)))

    def large(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose slot is split, and its place in ``slots``."""
        if not len(self.slots):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.slots, slot), len(self.slots) - 1)
        some = np.flatnonzero(self.slots[at] == slot)
        return some, at[some]


def _dealt(sets: DataFrame, deal: Deal, t: Fraction, asked: tuple[np.ndarray, np.ndarray, bool] | None) -> DataFrame:
    """bucket, blob: the rows of all slots, many in a blob (five columns of eight bytes).

    A slot of many rows is split into blocks. At first (no ``asked``) every row looks within its block. With ``asked`` (sorted
    slots that are looked in, their numbers of seekers, and whether these are all such slots) rows with ``seek`` look in all blocks:
    a block meets BLOCK seekers at a time.
    """
    num, den = t.numerator, t.denominator
    sent = sets.sparkSession.sparkContext.broadcast((deal, asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal, asked = sent.value
        for b in batches:
            row, slot, pos, _ = _slots(b.column(4), b.column(1).to_numpy(), deal.words, num, den)
            pos = np.minimum(pos, PLACE)
            flags = np.full(len(row), SEEK | BASE, np.int64)
            if asked is not None:
                flags = np.where(b.column(5).to_numpy(zero_copy_only=False)[row], SEEK | BASE, BASE)
                if asked[2]:
                    keep = np.isin(slot, asked[0])
                    row, slot, pos, flags = row[keep], slot[keep], pos[keep], flags[keep]
            ids = b.column(0).to_numpy()[row]
            some, at = deal.large(slot)
            if len(some):
                mixed = _mix(ids[some].view(np.uint64))
                block = mixed % deal.blocks[at].astype(np.uint64)
                if asked is None:
                    slot[some] = _mix(slot[some] + block * np.uint64(0x9E3779B97F4A7C15))
                    flags[some] |= PART
                else:
                    slots, n = (np.append(x, x.dtype.type(0)) for x in asked[:2])
                    where = np.searchsorted(asked[0], slot[some])
                    parts = np.where(slots[where] == slot[some], -(-n[where] // BLOCK), 0)  # of seekers
                    own = mixed // np.uint64(1 << 32) % np.maximum(parts, 1).astype(np.uint64)
                    b_at, b_part = _copied(parts)
                    looks = (flags[some] & SEEK) != 0
                    s_at, s_block = _copied(np.where(looks, deal.blocks[at], 0))
                    src = np.concatenate([some[b_at], some[s_at]])
                    part = np.concatenate([b_part.astype(np.uint64), own[s_at]])
                    block = np.concatenate([block[b_at], s_block.astype(np.uint64)])
                    cell = _mix(_mix(slot[src] + block * np.uint64(0x9E3779B97F4A7C15)) + part)
                    role = np.concatenate([np.full(len(b_at), BASE), np.full(len(s_at), SEEK)])
                    whole = np.ones(len(row), bool)
                    whole[some] = False
                    row, ids, pos = (np.concatenate([x[whole], x[src]]) for x in (row, ids, pos))
                    slot, flags = np.concatenate([slot[whole], cell]), np.concatenate([flags[whole], role])
            meta = (b.column(1).to_numpy()[row].astype(np.int64) << 32) | flags | pos
            bucket = (_mix(slot) % np.uint64(deal.buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            columns = [x[order].view(np.int64) for x in (slot, ids, meta, b.column(2).to_numpy()[row], b.column(3).to_numpy()[row])]
            bucket = bucket[order]
            cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
            cuts = np.unique(np.concatenate([cuts, np.arange(0, len(bucket), BLOB)])).astype(np.int64)
            spans = list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)]))
            for i in range(0, len(spans), 64):
                blobs = [b"".join(c[x:y].tobytes() for c in columns) for x, y in spans[i : i + 64]]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[i : i + 64]]), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    names = ["id", "size", "parity", "parity2", "prefix", *(["seek"] if asked is not None else [])]
    return sets.select(*names).mapInArrow(run, "bucket long, blob binary")


def candidates(sets: DataFrame, t: Fraction, deal: Deal, most: int, seekers: DataFrame | None = None) -> DataFrame:
    """x, y: ids of a set and an earlier one that pass the filters, ``most`` a set and task; y null: there may be more than were given.

    With ``seekers`` (column id), only those look, and they look everywhere.
    """
    num, den, asked = t.numerator, t.denominator, None
    if seekers is not None:
        sets = sets.join(seekers.withColumn("looks", F.lit(True)), "id", "left").withColumn("seek", F.coalesce("looks", F.lit(False)))
        counted = _counted(sets.where("seek"), deal.words, t, False, "line-asked").where("slot != -1")
        few = counted.count() <= MOST_BROADCAST
        if not few:  # all rows are dealt again; only split slots need their numbers of seekers
            split = sets.sparkSession.createDataFrame([(int(x),) for x in deal.slots.view(np.int64)], "slot long")
            counted = counted.join(F.broadcast(split), "slot", "left_semi")
        rows = counted.toPandas()
        slot = rows["slot"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(slot)
        asked = slot[order], rows["n"].to_numpy(np.int64)[order], few

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def take() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*held)]
            order = np.lexsort((columns[1], columns[0]))
            later, earlier, more = _pairs_in_groups(*(c[order] for c in columns), num, den, most)
            x = np.concatenate([*later, *more])
            y = np.concatenate(earlier) if earlier else np.zeros(0, np.int64)
            none = np.zeros(len(x), bool)
            none[len(y) :] = True
            y = np.concatenate([y, np.zeros(len(x) - len(y), np.int64)])
            return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y, mask=none)], ["x", "y"])

        for b in batches:
            for bucket, blob in zip(b.column(0).to_pylist(), b.column(1)):
                if bucket != now and held:
                    yield take()
                    held = []
                now = bucket
                held.append(np.frombuffer(blob.as_buffer(), np.int64).reshape(5, -1))
        if held:
            yield take()

    with arrow_batches(sets.sparkSession, 1 << 16):
        rows = _dealt(sets, deal, t, asked).repartition("bucket").sortWithinPartitions("bucket")
        return materialize(rows.mapInArrow(run, "x long, y long").distinct(), "line-pairs")


def verify(docs: DataFrame, sets: DataFrame, pairs: DataFrame, t: Fraction, key: str, text: str) -> DataFrame:
    """The pairs (x, y) whose sets have the wanted Jaccard similarity, on whole sets (of 64-bit word hashes) read from the text again."""
    num, den = t.numerator, t.denominator
    wanted = pairs.select(F.col("x").alias("id")).union(pairs.select(F.col("y").alias("id"))).distinct()
    places = materialize(sets.join(wanted, "id").select("id", "place.key", "place.th", "place.line"), "line-wanted")
    per_doc = places.groupBy("key", "th").agg(F.collect_list(F.struct("line", "id")).alias("want"))  # lines of one text
    held = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    per_doc = materialize(per_doc, "line-places")
    few = places.count() <= MOST_BROADCAST // 2
    rows = held.join(F.broadcast(per_doc) if few else per_doc, per_doc["key"].eqNullSafe(held["k"]) & (per_doc["th"] == held["h"])).select("want", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for b in batches:
            ids, words = [], []
            for want, t in zip(b.column(0), b.column(1)):
                lines = t.as_py().encode("utf-8", "replace").translate(_LOWER).split(b"\n")
                for w in want.as_py():
                    ids.append(w["id"])
                    words.append(np.fromiter(map(xxh64_intdigest, set(lines[w["line"]].split())), np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.list_(pa.int64()))], ["id", "words"])

    with arrow_batches(docs.sparkSession, 512):
        content = materialize(rows.mapInArrow(run, "id long, words array<bigint>").dropDuplicates(["id"]), "line-words")
    x = content.select(F.col("id").alias("x"), F.col("words").alias("wx"))
    y = content.select(F.col("id").alias("y"), F.col("words").alias("wy"))
    both = pairs.join(x, "x").join(y, "y")
    common = F.size(F.array_intersect("wx", "wy"))
    return both.where(common * den >= num * (F.size("wx") + F.size("wy") - common)).select("x", "y")


def similar_lines(docs: DataFrame, similarity: Fraction = Fraction(4, 5), key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, th, line, first (the set's first place), similar (an earlier, different set is similar) of lines with words that occur again or are similar.

    ``similarity`` must be above one half.
    """
    if 2 * similarity <= 1:
        raise ValueError("similarity must be above one half")
    level = rarity(docs, text)
    with arrow_batches(docs.sparkSession, 512):
        lines = materialize(occurrences(docs, level, similarity, key, text), "lines")
    sets = lines.groupBy("a", "b").agg(F.min(_place("key", "line", "th")).alias("place"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("size", "parity", "parity2", "prefix")])
    # Ids in the order of first places: range partitions are numbered in order, rows within them too.
    sets = materialize(sets.orderBy("place").withColumn("id", F.monotonically_increasing_id()), "line-sets")
    deal, most = Deal.of(sets, similarity), FIRST
    found = candidates(sets, similarity, deal, most)
    done = materialize(verify(docs, sets, found.where("y IS NOT NULL"), similarity, key, text).select(F.col("x").alias("id")).distinct(), "line-similar")
    open_ = found
    while True:
        open_ = materialize(open_.where("y IS NULL").select(F.col("x").alias("id")).distinct().join(done, "id", "left_anti"), "line-marked")
        if open_.isEmpty():
            break
        if most == FIRST and len(deal.slots):
            deal = Deal.of(sets, similarity, deal)
        most *= AGAIN
        open_ = candidates(sets, similarity, deal, most, open_)
        again = verify(docs, sets, open_.where("y IS NOT NULL"), similarity, key, text).select(F.col("x").alias("id"))
        done = materialize(done.union(again).distinct(), "line-similar")
    outcome = sets.select("id", "a", "b", "place", "n").join(done.withColumn("similar", F.lit(True)), "id", "left").withColumn("similar", F.coalesce("similar", F.lit(False)))
    outcome = materialize(outcome.where("n > 1 OR similar").drop("id"), "line-outcome")
    spots = lines.select("a", "b", "key", "th", "line")
    total, largest = outcome.agg(F.sum("n"), F.max("n")).first()
    if largest and largest * 1000 > total:
        # Sets of a thousandth of these lines each: there are fewer than a thousand. They are broadcast, so no key has many rows in the other join.
        wide = F.col("n") * 1000 > total
        hot = F.broadcast(outcome.where(wide))
        rest = spots.join(hot.select("a", "b"), ["a", "b"], "left_anti").join(outcome.where(~wide), ["a", "b"])
        joined = spots.join(hot, ["a", "b"]).unionByName(rest)
    else:
        joined = spots.join(outcome, ["a", "b"])
    return joined.select("key", "th", "line", _place("key", "line", "th").eqNullSafe(F.col("place")).alias("first"), "similar")


def removals(docs: DataFrame, similarity: Fraction = Fraction(4, 5), key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, th, removed (ascending line numbers) of every text that loses lines.

    A null key counts as the largest. Null and empty texts, and lines without words, lose nothing. Rows with equal
    key and text are one text to the order of lines and share the outcome; equal keys with other texts are
    ordered by text hash. Extra columns are ignored.
    """
    gone = similar_lines(docs, similarity, key, text).where(F.col("similar") | ~F.col("first"))
    return gone.groupBy("key", "th").agg(F.array_sort(F.collect_set("line")).alias("removed"))


def remove_lines(docs: DataFrame, similarity: Fraction = Fraction(4, 5), key: str = "doc_id", text: str = "text") -> DataFrame:
    """row (the input's columns), text (without removed lines), n_lines, removed of every input row."""
    gone = removals(docs, similarity, key, text)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).alias("k"), F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    joined = held.join(gone, held["k"].eqNullSafe(gone["key"]) & (held["h"] == gone["th"]), "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    lines = F.split("t", "\n")
    left = F.filter(lines, lambda _, i: ~F.array_contains(removed, i))
    kept = F.when(F.size(removed) == 0, F.col("t")).otherwise(F.array_join(left, "\n"))
    return joined.select("row", kept.alias("text"), F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"), removed.alias("removed"))
