"""Vector expressions: products, norms and a deterministic text embedding, all in Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talkmill.functions.fixed_values import EMBEDDING_CHARS, EMBEDDING_WIDTH


def dot(a: Column, b: Column) -> Column:
    """Null where the lengths differ or a part is null."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), product)


def unit(v: Column) -> Column:
    """``v`` over its length; a zero vector stays as it is."""
    both = F.struct(v.alias("v"), F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))).alias("norm"))
    scaled = lambda p: F.transform(p["v"], lambda x: F.when(p["norm"] > 0, x.cast("double") / p["norm"]).otherwise(x.cast("double")))
    return F.element_at(F.transform(F.array(both), scaled), 1)


def embed(text: Column) -> Column:
    """Counts of hashed character triples, as a unit vector of EMBEDDING_WIDTH parts.

    Every triple of the first EMBEDDING_CHARS characters falls into part (31 a + 131 b + 977 c) mod width.
    """
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)  # noqa: E731  computed once for each row
    codes = F.transform(F.split(F.substring(F.coalesce(text, F.lit("")), 1, EMBEDDING_CHARS), ""), lambda c: F.ascii(c))

    def hashed(c: Column) -> Column:
        part = lambda i: F.pmod(c[i] * 31 + c[i + 1] * 131 + c[i + 2] * 977, F.lit(EMBEDDING_WIDTH))
        return F.when(F.size(c) >= 3, F.transform(F.sequence(F.lit(0), F.size(c) - 3), part)).otherwise(F.array().cast("array<int>"))

    def counted(parts: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(EMBEDDING_WIDTH - 1)), lambda k: F.size(F.filter(parts, lambda p: p == k)).cast("double"))

    counts = let(let(codes, hashed), counted)
    return unit(counts)
