"""Mixing sources to target weights: whole epochs, then a bounded knapsack over document lengths."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkmill.llm.common import durable, table

MAX_COPIES = 3
SEED = 17
#: Remaining budget, in words, that the knapsack's table spans.
KNAPSACK_WORDS = 1 << 16
#: Documents of one source and length are ranked in this many parts, by hash.
PARTS = 256


def targets(sizes: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, target): sources by code point, null last, weigh 1, 2, 3, repeating, and share the total.

    A target stops at ``max_copies`` times its source's size; the excess goes to the others by weight.
    With sources in order of cap over weight, the capped ones lead; the level of the rest is what is
    left over their weights. One row per source is ordered, never one per document.
    """
    whole = Window.partitionBy(F.lit(0))
    named = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = named.withColumn("weight", (F.row_number().over(whole.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    cap = F.lit(max_copies) * F.col("source_size")
    rising = whole.orderBy((cap / F.col("weight")), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    weights = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levels = ranked.withColumns({"level": left / weights, "place": F.row_number().over(rising)})
    levels = levels.withColumn("free", cap / F.col("weight") > F.col("level"))
    stop = F.min_by("level", F.when(F.col("free"), F.col("place"))).over(whole)
    target = F.least(cap.cast("double"), F.coalesce(stop, F.lit(float("inf"))) * F.col("weight"))
    return levels.select("source", "source_size", target.alias("target"))


def choose(lengths: np.ndarray, counts: np.ndarray, budget: int, spare: int = 0) -> np.ndarray:
    """How many documents of each length (> 0) to take so that their lengths sum to ``budget`` or as little below as can be found.

    In proportion first, for all but ``spare`` words of the budget, then one more of some lengths, then a
    bounded knapsack over what is left. It is exact for a budget of at most KNAPSACK_WORDS that is all spare.
    """
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    taken = (counts.astype(object) * max(0, budget - spare) // total).astype(np.int64)
    left = budget - int((lengths * taken).sum())
    share = counts * (budget / total) - taken
    for i in np.argsort(-share, kind="stable").tolist():
        if left <= KNAPSACK_WORDS:
            break
        if taken[i] < counts[i] and lengths[i] <= left:
            taken[i] += 1
            left -= int(lengths[i])
    for i in np.argsort(-lengths, kind="stable").tolist():
        if left > KNAPSACK_WORDS:
            n = min(int(counts[i] - taken[i]), (left - KNAPSACK_WORDS) // int(lengths[i]))
            taken[i] += n
            left -= n * int(lengths[i])
    # Bit s of ``sums`` is set if some choice sums to s; what was reachable before each step leads back.
    mask, sums, steps = (1 << (left + 1)) - 1, 1, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        size, rest, n = int(lengths[i]), int(min(counts[i] - taken[i], left // int(lengths[i]))), 1
        while rest > 0 and not sums >> left & 1:
            n = min(n, rest)
            steps.append((i, n, sums))
            sums |= sums << (size * n) & mask
            rest, n = rest - n, 2 * n
    at = sums.bit_length() - 1
    for i, n, before in reversed(steps):
        if not before >> at & 1:
            taken[i] += n
            at -= n * int(lengths[i])
    return taken


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED, carry: tuple = ()) -> DataFrame:
    """(doc_id, size, source, source_size, target, copies, and the columns ``carry``) for each row of ``docs``.

    Size is the number of words (runs without ASCII white space), 0 for a null text. A source's target
    is met by whole epochs over its documents and, for the rest, by some documents once more: how many
    of each length a bounded knapsack says, which ones a seeded hash of doc_id. Where that leaves words
    of the target untaken, lengths may come more or less often than by epochs. No document is taken
    more than MAX_COPIES times, and empty ones never. Reruns agree. Repeated rows are documents of
    their own; a null doc_id is hashed as null. Rows of one doc_id, source and size are taken in the order
    of ``carry``. Other columns are not read; an empty table gives an empty result.
    """
    words = F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    h = F.xxhash64(F.lit(seed), F.col(key))
    sized = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), words.alias("size"), h.alias("h"), *carry)
    sized = durable(sized.withColumn("part", F.pmod("h", F.lit(PARTS)).cast("int")), "sizes")
    goals = targets(sized)
    parts = durable(sized.filter("size > 0").groupBy("source", "size", "part").agg(F.count("*").alias("n")), "lengths")
    by_length = parts.groupBy("source", "size").agg(F.sum("n").alias("n"))
    plan_in = by_length.join(goals, by_length["source"].eqNullSafe(goals["source"])).select(by_length["source"], "size", "n", "source_size", "target")

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        whole, goal = int(pdf["source_size"].iloc[0]), int(round(pdf["target"].iloc[0]))
        lengths, counts = pdf["size"].to_numpy(), pdf["n"].to_numpy()
        epochs = min(MAX_COPIES, goal // whole)
        taken = epochs * counts + (choose(lengths, counts, goal - epochs * whole) if epochs < MAX_COPIES else 0)
        if (short := goal - int((lengths * taken).sum())) > 0:
            # No choice of whole epochs and one more fits: let any document come up to MAX_COPIES times.
            other = choose(lengths, MAX_COPIES * counts, goal, KNAPSACK_WORDS)
            taken = other if goal - int((lengths * other).sum()) < short else taken
        return pd.DataFrame({"source": pdf["source"], "size": pdf["size"], "epochs": taken // counts, "more": taken % counts})

    chosen = plan_in.groupBy("source").applyInPandas(plan, "source string, size long, epochs long, more long")
    earlier = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    c, p = chosen.alias("c"), placed.alias("p")
    same = F.col("p.source").eqNullSafe(F.col("c.source")) & (F.col("p.size") == F.col("c.size"))
    quota = p.join(c, same).select(
        F.col("p.source").alias("q_source"), F.col("p.size").alias("q_size"), F.col("part").alias("q_part"), "epochs",
        F.greatest(F.lit(0), F.least("n", F.col("more") - F.col("before"))).alias("quota"), "n",
    )
    quota = durable(quota, "quotas")
    match = sized["source"].eqNullSafe(quota["q_source"]) & (sized["size"] == quota["q_size"]) & (sized["part"] == quota["q_part"])
    told = sized.join(quota, match, "left").select("doc_id", "source", "size", "h", "part", "epochs", "quota", "n", *carry)
    split = F.coalesce((F.col("quota") > 0) & (F.col("quota") < F.col("n")), F.lit(False))
    plain = told.filter(~split).withColumn("copies", F.coalesce(F.col("epochs") + F.when(F.col("quota") > 0, 1).otherwise(0), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("h", "doc_id", *carry))
    ranked = told.filter(split).withColumn("copies", F.col("epochs") + F.when(rank <= F.col("quota"), 1).otherwise(0))
    columns = ["doc_id", "source", "size", "copies", *carry]
    taken = plain.select(columns).unionByName(ranked.select(columns)).alias("t")
    g = goals.alias("g")
    return taken.join(g, F.col("t.source").eqNullSafe(F.col("g.source"))).select("doc_id", "size", "t.source", "source_size", "target", "copies", *carry)


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
