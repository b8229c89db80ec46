"""Reciprocal rank fusion of ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(scored: DataFrame, key: str, score: str, query: str | None = None) -> DataFrame:
    """Add the 1-based rank by score (but for noise below ten digits), ties by key, within the query if there is one."""
    window = Window.partitionBy(query) if query else Window.partitionBy()
    return scored.withColumn("rank", F.row_number().over(window.orderBy(F.desc(F.round(score, 10)), F.asc(key))))


def fuse(
    lists: dict[str, DataFrame],
    key: str,
    k: int = 60,
    weights: dict[str, float] | None = None,
    limit: int | None = 10,
    query: str | None = None,
) -> DataFrame:
    """One row per key: rrf_score, the sources it came from, and the columns of its first source.

    score = sum of weight / (k + rank); a key that a list repeats adds up; a list without a weight counts 1. Order is
    by unrounded score, then the source's place in ``lists``, then rank: what a stable sort of first-seen keys gives.
    Lists need ``rank`` and ``key``; other columns are taken from the first source that has the key. Empty
    lists add nothing. With ``query`` all of this is per query.
    """
    by = [query, key] if query else [key]
    others = [c for c in dict.fromkeys(c for df in lists.values() for c in df.columns) if c not in (*by, "rank")]
    kinds = {f.name: f.dataType for df in reversed(lists.values()) for f in df.schema}
    union = None
    for at, (name, df) in enumerate(lists.items()):
        weight = (weights or {}).get(name, 1.0)
        payload = F.struct(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in others] or [F.lit(0).alias("none")])
        rows = df.select(*by, F.lit(at).alias("at"), F.lit(name).alias("source"), F.col("rank"), (F.lit(float(weight)) / (k + F.col("rank"))).alias("part"), payload.alias("payload"))
        union = rows if union is None else union.unionByName(rows)
    place = F.struct("at", "rank")
    # Parts are added in list order, so the sum does not depend on how rows were dealt.
    parts = F.array_sort(F.collect_list(F.struct("at", "rank", "part")))
    fused = union.groupBy(*by).agg(
        F.aggregate(parts, F.lit(0.0), lambda s, p: s + p["part"]).alias("raw"),
        F.min(place).alias("first"), F.min_by("payload", place).alias("payload"), F.array_join(F.array_sort(F.collect_set("source")), "+").alias("sources"),
    )
    order = [F.desc("raw"), F.asc("first.at"), F.asc("first.rank")]
    score = F.round("raw", 6).alias("rrf_score")
    if query:
        rank = F.row_number().over(Window.partitionBy(query).orderBy(*order))
        fused = fused.withColumn("place", rank)
        fused = fused.where(F.col("place") <= limit) if limit else fused
    else:
        fused = fused.orderBy(*order)
        fused = fused.limit(limit) if limit else fused
    extra = ["payload.*"] if others else []
    return fused.select(*by, *(["place"] if query else []), score, "sources", *extra)
