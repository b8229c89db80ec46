"""The joins between snippets, files, embeddings and the registry, and how listings are ordered and counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_parents(rows: DataFrame, parents: DataFrame, on: dict[str, str], *columns: str) -> DataFrame:
    """``rows`` whose parent exists (row column: parent column), with some of its columns: snippets with their files, files with their codebase."""
    held = parents.select(*[F.col(p).alias(f"__{p}") for p in on.values()], *[F.col(c) for c in columns if c not in rows.columns])
    same = None
    for child, parent in on.items():
        both = rows[child] == held[f"__{parent}"]
        same = both if same is None else same & both
    return rows.join(held, same).drop(*[f"__{p}" for p in on.values()])


def absent(found: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows of ``found`` whose key ``known`` lacks: what is newly discovered."""
    return found.join(known.select(key).distinct(), key, "left_anti")


def present(wanted: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """``wanted`` with found: whether ``known`` has the key."""
    there = known.select(key).distinct().withColumn("found", F.lit(True))
    return wanted.join(there, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def newest_first(rows: DataFrame, time: str, key: str) -> DataFrame:
    """The order of listings: the latest first, ties by key."""
    return rows.orderBy(F.desc(time), F.asc(key))


def run_counters(rows: DataFrame, **conditions: Column) -> DataFrame:
    """One row: checked (all rows), and how many meet each condition."""
    return rows.agg(F.count("*").alias("checked"), *[F.count_if(c).alias(name) for name, c in conditions.items()])


def json_fields(text: str | Column, schema: str) -> Column:
    """Parsed JSON; what does not parse is null."""
    return F.from_json(text, schema)
