"""Vector expressions over arrays of numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import tokens


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0.0 for empty vectors, unequal lengths or a zero norm."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (n > 0), dot(a, b) / n).otherwise(0.0)


def of_dimension(a: Column, dimension: int) -> Column:
    """The vector; one of another length, or a null one, is an error."""
    said = F.concat(F.lit(f"a vector of {dimension} was expected, not of "), F.coalesce(F.size(a).cast("string"), F.lit("none")))
    return F.when(F.coalesce(F.size(a), F.lit(-1)) == dimension, a).otherwise(F.raise_error(said))


def hashed(text: Column, dimension: int = 64) -> Column:
    """The encoder that stands in where no model is given: how many tokens of the text fall into each of so many
    buckets, by their CRC-32, of unit length; zeros for a text without tokens."""
    buckets = F.transform(tokens(F.coalesce(text, F.lit(""))), lambda w: (F.crc32(w.cast("binary")) % dimension).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.size(F.filter(buckets, lambda b: b == i)).cast("double"))
    return normalized(counts)


def embedded(chunks: DataFrame, dimension: int = 64, encode: Callable[[Column], Column] | None = None, text: str = "text", provider: str = "hashed") -> DataFrame:
    """chunks with vector, of unit length and of that dimension (an encoder that gives another is an error), and
    provider; chunks with a blank text have neither."""
    made = of_dimension(normalized(encode(F.col(text))) if encode else hashed(F.col(text), dimension), dimension)
    said = F.coalesce(F.col(text).rlike(r"(?U)\S"), F.lit(False))
    return chunks.withColumns({"vector": F.when(said, made), "provider": F.when(said, F.lit(provider))})
