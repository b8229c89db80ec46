"""Hashes and stable ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(content: Column) -> Column:
    """SHA-256 in hex, over the bytes."""
    return F.sha2(content.cast("binary"), 256)


def short_hash(text: Column) -> Column:
    """The first 16 hex digits of the SHA-256."""
    return F.substring(content_hash(text), 1, 16)


def stable_id(*columns: Column | str) -> Column:
    """A 64-bit id that depends on the values only, so rewriting a row never renumbers it."""
    return F.xxhash64(*columns)
