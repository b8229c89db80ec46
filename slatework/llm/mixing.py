"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every source gets a target number of words; a document's expected number of copies is target over
source size. The expected copies are prefix-summed within the source, one random offset is added,
and a document is emitted once for each integer boundary that its interval crosses.

The order of the prefix sum is by size level, hash sub-bucket, size and id, so a source's copies are
spread over short and long documents alike and the words taken stay near the target. The sum needs
no task with all rows of a source: rows are counted per (source, level, sub-bucket), those counts
(at most LEVELS x SUBS rows a source) are prefix-summed, and ranks within a bucket are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatework.scratch import materialize

#: Size levels per doubling, and hash sub-buckets per level: a bucket of one source in 2e10 rows stays a task's work.
LEVELS_PER_OCTAVE, SUBS = 4, 256
#: Offsets are multiples of 2**-20, so that rank times an integral rate stays exact.
OFFSET_STEPS = 1 << 20


def allocate(sources: DataFrame, weights: tuple[int, ...], cap: float) -> DataFrame:
    """Targets by source, as water-filling: ``sources`` has source and source_size.

    Sources in code point order, null last, weigh ``weights`` in turn and share the sum of all sizes.
    No target is above ``cap`` times its source's size; the excess is shared again by weight.
    With the cap-to-weight ratios sorted, the common level is fixed by the first source that is
    not capped, so no loop is needed. One row a source: this table is small whatever the corpus.
    """
    everything = Window.partitionBy()
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    rows = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    rows = rows.withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    level = (F.sum("source_size").over(everything) - F.col("capped")) / F.col("open")
    rows = rows.withColumn("level", level)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    rows = rows.withColumn("common", F.max(fits).over(everything))
    target = F.least(F.col("cap"), F.coalesce(F.col("common") * F.col("weight"), F.col("cap")))
    return rows.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    size: Column,
    weights: tuple[int, ...] = (1, 2, 3),
    cap: float = 3.0,
    seed: int = 17,
    source: str = "source",
    key: str = "doc_id",
) -> DataFrame:
    """One row per input row: row (the input's columns as a struct), size, source_size, target, copies.

    Any input columns may exist; they travel in ``row``. A null source is a source of its own. Rows of
    size 0 are ranked like any other and take no words. Rows without a key, or of one key, are dealt by their other columns. Equal rows are separate rows, each with its own
    copies; which of them gets more is arbitrary but indistinguishable. An empty table gives no rows.
    The same rows give the same copies in every run and partitioning.
    """
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(source).cast("string").alias("source"),
        F.col(key).alias("key"),
        size.cast("long").alias("size"),
        F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]).alias("rest"),
    )
    bucketed = keyed.select(
        "*",
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("skey"),
        F.floor(F.log2(F.col("size") + 1) * LEVELS_PER_OCTAVE).cast("int").alias("band"),
        F.pmod(F.xxhash64("key", "rest", F.lit(seed)), F.lit(SUBS)).cast("int").alias("sub"),
    )
    counts = bucketed.groupBy("source", "skey", "band", "sub").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    counts = materialize(counts, "mix-counts")
    totals = counts.groupBy("source", "skey").agg(F.sum("words").alias("source_size"))
    names = totals.select("source", "skey")
    targets = allocate(totals.select("source", "source_size"), weights, cap)
    targets = targets.join(names, targets["source"].eqNullSafe(names["source"])).select("skey", "source_size", "target")
    upto = Window.partitionBy("skey").orderBy("band", "sub").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("skey", "band", "sub", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    bases = bases.join(targets, "skey")
    within = Window.partitionBy("skey", "band", "sub").orderBy("size", F.xxhash64("key", "rest", F.lit(seed + 1)), "key", "rest")
    ranked = bucketed.withColumn("rank", F.row_number().over(within)).join(bases, ["skey", "band", "sub"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rate = F.when(F.abs(rate - F.round(rate)) < 1e-12, F.round(rate)).otherwise(rate)
    offset = F.pmod(F.xxhash64("skey", F.lit(seed)), F.lit(OFFSET_STEPS)) / F.lit(float(OFFSET_STEPS))
    upper = F.floor(offset + (F.col("base") + F.col("rank")) * rate)
    lower = F.floor(offset + (F.col("base") + F.col("rank") - 1) * rate)
    return ranked.select("row", "size", "source_size", "target", (upper - lower).alias("copies"))


def emit(mixed: DataFrame) -> DataFrame:
    """The mixed corpus itself: the input's columns, each row as often as it was taken."""
    taken = mixed.where(F.col("copies") > 0)
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")
