"""Word and case rules shared by the corpus operators, as native column expressions."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: White space that separates words.
SPACE = r"[\x20\x09-\x0D]+"
#: What separates words of letters and digits: all other ASCII.
NON_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Characters that lower() leaves alone; texts with any other non-ASCII character take the slow way.
_LOWER_IS_SAFE = r"^[\x00-\x7Fß-öø-ÿ¡-¿‐-›]*$"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` is several times as fast as ``translate`` and does the same for most texts."""
    return F.when(text.rlike(_LOWER_IS_SAFE), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def split_words(text: Column, separators: str) -> Column:
    """The words between separators as an array; null has no words."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def count_words(text: Column) -> Column:
    """How many runs of non-space a text has, as a long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def arrow_batches(spark: SparkSession, rows: int, size: int = 16 << 20) -> Iterator[None]:
    """Arrow batches of at most so many rows and about so many bytes, for the actions and plans made inside."""
    before = {k: spark.conf.get(k, None) for k in (_ROWS, _BYTES)}
    spark.conf.set(_ROWS, str(rows))
    spark.conf.set(_BYTES, str(size))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def input_bytes(docs: DataFrame) -> int:
    """Bytes of the files that a DataFrame reads, as Spark knows them without running it; what it does not know counts nothing."""
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 60)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
