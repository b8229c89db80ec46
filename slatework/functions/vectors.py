"""Vector expressions in double precision, and a deterministic stand-in for an embedding model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slatework.functions.text import let


def literal(vector: list[float]) -> Column:
    """A query vector as a constant."""
    return F.array(*[F.lit(float(x)) for x in vector])


def dot(a: Column, b: Column) -> Column:
    """Inner product, null where lengths differ."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total)


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a zero vector or other lengths, which every threshold then drops."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def euclidean(a: Column, b: Column) -> Column:
    """Euclidean distance, null where lengths differ."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.when(F.size(a) == F.size(b), F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)))


def mock_embedding(text: Column, dimension: int = 768) -> Column:
    """From the text's MD5 as a number: component i is bit i minus a half; beyond bit 127 all are -0.5."""
    # Bit i of the number is bit i % 4 of the hex digit at 32 - i // 4. The digits are bound, as a lambda's body is evaluated for every component.
    digit = lambda digits, i: F.conv(F.substring(digits, 32 - F.floor(i / 4).cast("int"), F.lit(1)), 16, 10).cast("int")
    bit = lambda digits, i: F.floor(digit(digits, i) / F.pow(F.lit(2.0), i % 4)).cast("int") % 2
    places = F.sequence(F.lit(0), F.lit(min(dimension, 128) - 1))
    low = let(F.md5(text.cast("binary")), lambda digits: F.transform(places, lambda i: (bit(digits, i) - F.lit(0.5)).cast("float")))
    return F.concat(low, F.array_repeat(F.lit(-0.5).cast("float"), dimension - 128)) if dimension > 128 else low
