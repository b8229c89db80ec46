"""Source trees and documents as DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slatework.functions.ids import content_hash
from slatework.functions.text import LANGUAGES, language_of

#: Path patterns that are never indexed.
EXCLUDED = (".*/**", "__pycache__/**", "node_modules/**", ".venv/**", "venv/**", "dist/**", "build/**", "*.egg-info/**")


def glob_to_regex(pattern: str) -> str:
    """A glob over relative paths as a regular expression: ** crosses directories, * and ? do not; a directory may be anywhere."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return f"(?:^|/){out}$"


def excluded(path: Column, patterns: tuple[str, ...] = EXCLUDED) -> Column:
    """Whether any pattern matches; whole path components, so ``dist`` leaves ``distance.py`` alone."""
    met = F.lit(False)
    for p in patterns:
        met = met | path.rlike(glob_to_regex(p))
    return met


def excluded_by_substring(path: Column, parts: tuple[str, ...]) -> Column:
    """The older rule: any part anywhere in the path."""
    met = F.lit(False)
    for p in parts:
        met = met | path.contains(p)
    return met


def scan(spark: SparkSession, root: str, suffixes: tuple[str, ...] = tuple(LANGUAGES), exclude: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """relative_path, bytes, file_size, content_hash, language of a tree's files; suffixes are filtered before contents are read."""
    glob = "*{" + ",".join(suffixes) + "}"
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    base = re.sub(r"^[a-z]+:/*", "/", root).rstrip("/") + "/"
    relative = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + re.escape(base), "")
    rows = rows.select(relative.alias("relative_path"), F.col("content").alias("bytes"), F.col("length").alias("file_size"))
    rows = rows.where(~excluded(F.col("relative_path"), exclude))
    return rows.withColumn("content_hash", content_hash(F.col("bytes"))).withColumn("language", language_of(F.col("relative_path")))


def decode(files: DataFrame, strict: bool = True) -> DataFrame:
    """Add content. ``strict`` leaves out files that are not UTF-8; otherwise bad bytes become replacement marks."""
    if strict:
        text = F.try_validate_utf8(F.col("bytes").cast("string"))
        return files.withColumn("content", text).where(F.col("content").isNotNull())
    return files.withColumn("content", F.make_valid_utf8(F.col("bytes").cast("string")))


def index_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Index description files (``*_metadata.json``), sorted; keys that a file lacks are null, shown as N/A."""
    schema = "index_name string, codebase_path string, embedding_provider string, embedding_model string, total_files_indexed long, total_snippets long, total_embeddings long, indexed_at string"
    rows = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*_metadata.json").json(folder)
    return rows.withColumn("files_label", F.coalesce(F.col("total_files_indexed").cast("string"), F.lit("N/A"))).orderBy("index_name")


def write_index_metadata(spark: SparkSession, folder: str, index_name: str, **values: object) -> None:
    """One description file, through Spark so that any file system serves; a folder per index."""
    row = spark.createDataFrame([(index_name, *map(str, values.values()))], ", ".join(f"{c} string" for c in ("index_name", *values)))
    row.coalesce(1).write.mode("overwrite").json(f"{folder}/{index_name}")


def table_sizes(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """table, files, bytes on storage of some tables' folders; only names and lengths are read."""
    out = None
    for name, folder in folders.items():
        held = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("length")
        row = held.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).select(F.lit(name).alias("table"), "files", "bytes")
        out = row if out is None else out.unionByName(row)
    return out


def table_statistics(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """table, rows, columns of some tables."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows", F.lit(len(df.columns)).alias("columns"))
        out = row if out is None else out.unionByName(row)
    return out
