"""Schemas of the engine's tables, and checks that Parquet does not make."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CODEBASES = (
    "id long, name string, path string, description string, language string, created_at timestamp, updated_at timestamp, enabled boolean, "
    "github_repo string, main_branch_name string, last_indexed_commit string, last_sync_error string, last_sync_error_at timestamp"
)
CORPUS = (
    "codebase_name string, id long, file_path string, snippet_type string, name string, content string, start_line long, end_line long, language string, docstring string, error string, "
    "embedding array<float>"
)

FILES = "codebase_name string, relative_path string, content_hash string, file_size long, memo string"
NODES = "id long, label string, codebase string, path string, name string, language string, signature string, docstring string"
EDGES = "src long, dst long, type string, module string"
FAILURES = "codebase_name string, relative_path string, error string, rows long"


class NotUnique(ValueError):
    """Rows that should be one by their key are several."""


def assert_unique(df: DataFrame, *keys: str) -> DataFrame:
    """``df``, if no two rows have the same keys (nulls alike); else an error that names some of the keys."""
    several = df.groupBy(*keys).count().where("count > 1").limit(3).collect()
    if several:
        raise NotUnique(f"several rows with {', '.join(keys)}: {[tuple(r)[:-1] for r in several]}")
    return df


def with_columns(df: DataFrame, schema: str) -> DataFrame:
    """``df`` in the shape of ``schema``: missing columns are null, others are cast, extra ones dropped: an additive migration."""
    wanted = df.sparkSession.createDataFrame([], schema).schema
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])


def assert_dimension(df: DataFrame, dimension: int, column: str = "embedding") -> DataFrame:
    """Fail the job at the first vector of another length."""
    bad = F.raise_error(F.concat(F.lit(f"expected {dimension} components, got "), F.size(column).cast("string")))
    return df.withColumn(column, F.when(F.col(column).isNull() | (F.size(column) == dimension), F.col(column)).otherwise(bad.cast(df.schema[column].dataType)))
