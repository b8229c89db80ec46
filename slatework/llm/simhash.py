"""SimHash near-duplicates through a segment-popcount embedding and a grid range-join.

Each whole text is lower-cased (A-Z), split at white space and cut into word shingles; the 64-bit
fingerprint has a bit where over half of the shingles' XXH64 values have it.

Embedding: a fingerprint becomes 32 coordinates, the bit counts (0 to 2) of its two-bit segments.
The Manhattan distance of two embeddings never exceeds the Hamming distance of the fingerprints.
A coordinate is held in unary (00, 01, 11), so an embedding is one long, and the Manhattan distance
is the bit count of an XOR.

Grid: the coordinates form two halves of 16. Of two points at distance 3 or less, one half is at
distance 1 or less. So each point is filed in the cell of either half, and looks into its own cell
and the cells one step away; points at distance exactly 1 differ in the parity of their coordinate
sum, so only the even ones look. That is 2 filed rows and some 26 lookups a distinct fingerprint,
whatever the corpus. Candidates pass the Manhattan bound over all 32 coordinates, then the exact
Hamming distance, inside the join.

Copies with equal fingerprints collapse before the join. Components come from min-label contraction
over tables in the shared folder; nothing is collected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatework.scratch import materialize

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Shingles hashed at once: bounds a worker's memory on very long texts.
CHUNK = 1 << 15
LOW = 0x5555555555555555
HALF = (1 << 32) - 1


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned 64-bit fingerprint; a text without words (null included) has 0."""
    from xxhash import xxh64_intdigest

    words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not words:
        return 0
    if len(words) < shingle:
        return xxh64_intdigest(b" ".join(words), 42)
    counts, total = np.zeros(64, np.int64), len(words) - shingle + 1
    for at in range(0, total, CHUNK):
        some = words[at : min(at + CHUNK, total) + shingle - 1]
        grams = map(b" ".join, zip(*(some[i:] for i in range(shingle))))
        hashes = np.fromiter((xxh64_intdigest(g, 42) for g in grams), np.uint64)
        counts += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << int(i) for i in np.nonzero(2 * counts > total)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """key, th (hash of the text) and fp (signed long) per row; nothing is shuffled."""
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in b.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found)], ["key", "th", "fp"])

    return rows.mapInArrow(run, f"key {kind}, th long, fp long")


def embed(fp: Column) -> Column:
    """The 32 segment bit counts in unary, two bits each, as one long."""
    up = F.shiftrightunsigned(fp, 1)
    some, both = fp.bitwiseOR(up).bitwiseAND(F.lit(LOW)), fp.bitwiseAND(up).bitwiseAND(F.lit(LOW))
    return some.bitwiseOR(F.shiftleft(both, 1))


def _cells(point: Column) -> list[Column]:
    """The cell of either half: 32 bits of the embedding, with the half's number above them."""
    return [point.bitwiseAND(F.lit(HALF)), F.shiftrightunsigned(point, 32).bitwiseOR(F.lit(1 << 32))]


def _around(cell: Column) -> Column:
    """The cells one step away from an even cell, and none for an odd one."""
    moves = F.transform(F.array(*[F.lit(1 << i) for i in range(32)]), lambda bit: cell.bitwiseXOR(bit))
    # A high bit without its low bit is no count.
    valid = lambda c: c.bitwiseAND(F.lit(0xAAAAAAAA)).bitwiseAND(F.bitwise_not(F.shiftleft(c, 1))) == 0
    return F.when(F.bit_count(cell.bitwiseAND(F.lit(HALF))) % 2 == 0, F.filter(moves, valid)).otherwise(F.array().cast("array<bigint>"))


def links(points: DataFrame, most: int = 3) -> DataFrame:
    """Pairs (a, b) of the distinct longs in ``fp`` at a Hamming distance of at most ``most``, which is 3 or less."""
    if not 0 <= most <= 3:
        raise ValueError("two halves and one step serve distances of 3 or less")
    lower, upper = _cells(embed(F.col("fp")))
    filed = points.select(F.col("fp").alias("b"), F.explode(F.array(lower, upper)).alias("cell"))
    seek = F.concat(F.array(lower, upper), _around(lower), _around(upper))
    looks = points.select(F.col("fp").alias("a"), F.explode(seek).alias("cell"))
    a, b = looks["a"], filed["b"]
    near = F.bit_count(embed(a).bitwiseXOR(embed(b))) <= most
    exact = F.bit_count(a.bitwiseXOR(b)) <= most
    return looks.join(filed, (looks["cell"] == filed["cell"]) & (a != b) & near & exact).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node reachable) for all nodes of the edges (a, b).

    Each round every node takes its smallest neighbour or itself, one pointer jump follows, and the edges
    are contracted: the nodes with edges at least halve. Sums per node are combined before the
    shuffle, so one node may have any number of edges. Only the emptiness test reaches the driver.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    now = materialize(both.distinct(), "edges")
    roots = None
    while not now.isEmpty():
        hook = now.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p"))
        hook = materialize(hook, "hooks")
        up = hook.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        jump = materialize(hook.join(up, "p").select("u", "pp"), "jumps")
        if roots is None:
            roots = jump.select(F.col("u").alias("node"), F.col("pp").alias("root"))
        else:
            moved = jump.select(F.col("u").alias("root"), "pp")
            roots = roots.join(moved, "root", "left").select("node", F.coalesce("pp", "root").alias("root"))
            roots = materialize(roots, "roots")
        left = jump.select("u", F.col("pp").alias("x"))
        right = jump.select(F.col("u").alias("v"), F.col("pp").alias("y"))
        moved = now.join(left, "u").join(right, "v").where("x != y")
        now = materialize(moved.select(F.col("x").alias("u"), F.col("y").alias("v")).distinct(), "edges")
    if roots is None:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    return roots


def classes(docs: DataFrame, most: int = 3, shingle: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, th, fp, component (smallest key of the class) per input row.

    Null and empty texts have fingerprint 0 and link like any other. Rows with a null key belong to their
    class without naming it; a class of null keys only has a null component. Repeated rows are members
    each. Extra columns are ignored, an empty table gives no rows.
    """
    found = materialize(fingerprints(docs, key, text, shingle), "fingerprints")
    distinct = found.groupBy("fp").agg(F.min("key").alias("least"))
    distinct = materialize(distinct, "distinct-fingerprints")
    roots = components(links(distinct.select("fp"), most))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = materialize(named, "classes")
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    named = named.join(least, "root").select("fp", "component")
    return found.join(named, "fp").select("key", "th", "fp", "component")


def deduplicate(docs: DataFrame, most: int = 3, shingle: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per class, all its columns as they were: the row with the smallest key.

    Of a class of null keys, or of several rows with the smallest key, the row with the smallest text hash stays.
    """
    found = materialize(classes(docs, most, shingle, key, text), "members")
    first = found.groupBy("component", F.when(F.col("component").isNull(), F.col("fp")).alias("odd"))
    first = first.agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "th")).alias("m")).select(F.col("m.key").alias("k"), F.col("m.th").alias("h"))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).alias("rk"), F.xxhash64(text).alias("rh"))
    stay = held.join(first, held["rk"].eqNullSafe(first["k"]) & (held["rh"] == first["h"]), "left_semi")
    return stay.dropDuplicates(["rk", "rh"]).select("row.*")
