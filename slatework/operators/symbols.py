"""Symbol search: a literal, case-insensitive substring in path or name, with match type and priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def has(column: Column, term: str) -> Column:
    """Substring test without wildcards: underscores and percent signs stand for themselves."""
    return F.coalesce(F.lower(column).contains(term.lower()), F.lit(False))


def search(snippets: DataFrame, term: str, limit: int, path: str = "file_path", name: str = "name", kind: str = "snippet_type", key: str = "id") -> DataFrame:
    """Rows whose path or name has the term: match_type (file, function, class, content) and match_priority (1 path, 2 name).

    Ordered by priority, name and key. A name hit that is neither function nor class is labelled content.
    """
    in_path, in_name = has(F.col(path), term), has(F.col(name), term)
    kind_of = F.when(in_path, "file").when(in_name & (F.col(kind) == "function"), "function").when(in_name & (F.col(kind) == "class"), "class").otherwise("content")
    priority = F.when(in_path, 1).when(in_name, 2).otherwise(3)
    found = snippets.where(in_path | in_name).withColumn("match_type", kind_of).withColumn("match_priority", priority)
    return found.orderBy("match_priority", name, key).limit(limit)
