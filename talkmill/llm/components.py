"""Connected components by alternating large and small stars, with min aggregates and joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.llm.common import discard, durable


def _state(edges: DataFrame) -> tuple:
    """Two tables of distinct edges with the same state are the same but for a chance of some 2 ** -160."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))), F.bit_xor(h), F.bit_xor(F.xxhash64(F.lit(1), "v", "u"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id that each id of ``edges`` reaches; ids without an edge are absent.

    A node with very many edges is no hot group: its smallest neighbour is a partial aggregate, and
    the join that spreads it is one that Spark can split. Loops, repeated edges and nulls don't matter.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct()
    now = durable(now, "edges")
    seen = _state(now)
    while seen[0]:
        # Large star: what is above u goes to the smallest around u.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        # Small star: what is below u, and u, go to the smallest below u.
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = large.join(low, F.col("u") == F.col("k")).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        earlier, now = now, durable(small.filter("u != v").distinct(), "edges")
        discard(earlier)
        before, seen = seen, _state(now)
        if seen == before:
            break
    ids = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ids.unionByName(ids.select(F.col("component").alias("id"), "component")).distinct()
