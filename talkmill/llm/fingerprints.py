"""Document fingerprints (SimHash) and permuted block tables, in DataFrame operations only."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkmill.llm.common import SPACES, durable, table

BITS = 64
LANES = 0x0000000100000001
#: Rows that share a bucket are ordered by one task; about this many rows make a bucket.
ROWS_PER_BUCKET = 512
MAX_WEIGHT = 16
#: Ranges of equal numbers of rows, in COARSE groups, that ids are cut into before each range is cut evenly.
RANGES, COARSE = 1024, 32
#: Tasks that the rows of one fingerprint are dealt to.
PARTS = 32


def simhash(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, fp long): SimHash of the rows' words, one row per key that has words.

    Terms are words (runs without ASCII white space); each occurrence votes with the square of its
    length in code points, at most MAX_WEIGHT ** 2, so that short function words weigh little. A bit
    is set if the votes for it are more than half of all weight. Two bits, j and j + 32, are counted
    in the halves of one long. Rows without words (null, empty, white space) give no row: take 0.
    """
    words = texts.select(*keys, F.explode(F.split(text, SPACES)).alias("w")).filter(F.length("w") > 0)
    size = F.least(F.length("w"), F.lit(MAX_WEIGHT)).cast("long")
    votes = words.select(*keys, F.xxhash64("w").alias("h"), (size * size).alias("weight"))
    sums = votes.groupBy(*keys).agg(
        F.sum("weight").alias("total"),
        *[F.sum(F.shiftright("h", j).bitwiseAND(F.lit(LANES)) * F.col("weight")).alias(f"v{j}") for j in range(32)],
    )
    low = [F.when(F.col(f"v{j}").bitwiseAND(F.lit(0xFFFFFFFF)) * 2 > F.col("total"), F.lit(1 << j)).otherwise(F.lit(0).cast("long")) for j in range(32)]
    high = [
        F.when(F.shiftrightunsigned(f"v{j}", 32) * 2 > F.col("total"), F.lit((1 << (j + 32)) if j < 31 else -(1 << 63))).otherwise(F.lit(0).cast("long"))
        for j in range(32)
    ]
    fp = low[0]
    for bit in [*low[1:], *high]:
        fp = fp.bitwiseOR(bit)
    return sums.select(*keys, fp.alias("fp"))


def likeness(a, b):
    """Share of equal bits, 0 to 1."""
    return (BITS - F.bit_count(a.bitwiseXOR(b))) / F.lit(float(BITS))


def permuted_tables(blocks: int, radius: int) -> list[list[tuple[int, int]]]:
    """For each table the (offset, width) of the blocks that lead: all but ``radius`` of them."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    cuts = [(edges[i], edges[i + 1] - edges[i]) for i in range(blocks)]
    return [[cuts[i] for i in chosen] for chosen in combinations(range(blocks), blocks - radius)]


def within_radius(fingerprints: DataFrame, fp: str = "fp", radius: int = 3, blocks: int = 5) -> DataFrame:
    """(fp_a, fp_b, distance), fp_a < fp_b: all pairs of different fingerprints at most ``radius`` bits apart.

    Cut into ``blocks`` blocks, a pair within the radius agrees in all but ``radius`` of them, so it
    meets in a table led by those. It is given by the first such table alone. Equal fingerprints are
    one: copies never make pairs. Nulls take no part; an empty table gives an empty result.
    """
    one = fingerprints.select(F.col(fp).alias("fp")).dropna().distinct()
    tables = permuted_tables(blocks, radius)

    def leading(col, cuts):
        mask = sum(((1 << width) - 1) << at for at, width in cuts)
        return col.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))

    led = one.select("fp", F.posexplode(F.array(*[leading(F.col("fp"), cuts) for cuts in tables])).alias("t", "lead"))
    a, b = led.withColumnRenamed("fp", "fp_a"), led.withColumnRenamed("fp", "fp_b")
    both = F.col("fp_a").bitwiseXOR(F.col("fp_b"))
    first = F.coalesce(*[F.when(leading(both, cuts) == 0, F.lit(i)) for i, cuts in enumerate(tables)])
    return (
        a.join(b, ["t", "lead"])
        .filter((F.col("fp_a") < F.col("fp_b")) & (F.bit_count(both) <= radius) & (first == F.col("t")))
        .select("fp_a", "fp_b", F.bit_count(both).alias("distance"))
    )


def numbered(docs: DataFrame, order: str) -> DataFrame:
    """``docs`` with _bucket, not decreasing in ``order`` (integers); null ids come last.

    Quantiles cut the ids into at most RANGES ranges of about as many rows, so one outlier, or any run of them, fills no
    more than a range; each range is cut evenly into parts of about ROWS_PER_BUCKET rows. Distances are
    doubles, which can't overflow; rounding never turns the order round. Rows of one id share a bucket.
    """
    n = docs.count()
    ranges = min(RANGES, max(2, n // ROWS_PER_BUCKET))
    known = docs.agg(F.min(order).alias("lo"), F.max(order).alias("hi"), F.percentile_approx(order, [i / ranges for i in range(1, ranges)]).alias("cuts")).first()
    cuts = sorted(set(known.cuts or []))
    edges = [known.lo or 0, *cuts, known.hi or 0]
    parts = max(1, n // (ranges * ROWS_PER_BUCKET))
    step = -(-max(1, len(cuts)) // COARSE)
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    literal = lambda xs: F.lit(list(xs)).cast("array<bigint>") if xs else F.array().cast("array<bigint>")
    below = lambda xs, x: F.size(F.filter(xs, lambda c: c <= x))
    x = F.col(order).cast("long")
    group = below(literal([g[0] for g in groups]), x)
    fine = F.array(literal([]), *[literal(g) for g in groups])
    place = F.greatest(group - 1, F.lit(0)) * step + F.when(group > 0, below(F.element_at(fine, group + 1), x)).otherwise(0)
    low, high = F.element_at(literal(edges[:-1]), F.col("_range") + 1).cast("double"), F.element_at(literal(edges[1:]), F.col("_range") + 1).cast("double")
    part = F.least(F.lit(parts - 1), F.floor((x.cast("double") - low) / F.greatest(high - low, F.lit(1.0)) * parts))
    bucket = F.shiftleft(F.col("_range").cast("long"), 32) + F.greatest(part, F.lit(0)).cast("long")
    return docs.withColumn("_range", place.cast("int")).withColumn("_bucket", F.when(F.col(order).isNull(), F.lit(1 << 60)).otherwise(bucket)).drop("_range")


def following(rows: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """``rows`` with _rn, its place in the bucket, ``out``: ``value`` of the next row by (_bucket, order), and that row's bucket and place, _to and _at; the last row's next is the first.

    Each bucket is ordered by itself; only a bucket's first row is carried over to the bucket before.
    Which bucket that is, is found in two levels, so one task sees one row for every 2 ** 10 buckets.
    """
    w = Window.partitionBy("_bucket").orderBy(*[F.col(c).asc_nulls_last() for c in order])
    seen = rows.withColumns({out: F.lead(value).over(w), "_rn": F.row_number().over(w), "_last": F.lead(F.lit(1)).over(w).isNull()})
    firsts = seen.filter("_rn = 1").select("_bucket", F.col(value).alias("_head"))
    ids = rows.select("_bucket").distinct().withColumn("_super", F.shiftright("_bucket", 10))
    supers = ids.groupBy("_super").agg(F.min("_bucket").alias("lowest"))
    whole = Window.partitionBy(F.lit(0)).orderBy("_super")
    start = F.min("lowest").over(Window.partitionBy(F.lit(0)))
    supers = supers.select("_super", F.coalesce(F.lead("lowest").over(whole), start).alias("after_super"))
    inner = Window.partitionBy("_super").orderBy("_bucket")
    links = ids.withColumn("after", F.lead("_bucket").over(inner)).join(supers, "_super")
    links = links.select(F.col("_bucket").alias("_before"), F.coalesce("after", "after_super").alias("_bucket"))
    heads = links.join(firsts, "_bucket").select(F.col("_before").alias("_bucket"), F.col("_bucket").alias("_to"), "_head")
    inside = seen.filter(~F.col("_last")).drop("_last").withColumns({"_to": F.col("_bucket"), "_at": F.col("_rn") + 1})
    borders = seen.filter("_last").drop("_last", out).join(heads, "_bucket").withColumnRenamed("_head", out).withColumn("_at", F.lit(1))
    return inside.unionByName(borders)


def blocks_for(rows: int, radius: int) -> int:
    """Blocks for which the bits that lead a table are a few more than the bits that number the rows, so that buckets stay small."""
    blocks = radius + 2
    while blocks < 10 and BITS * (blocks - radius) // blocks < math.log2(max(2, rows)) + 4:
        blocks += 1
    return blocks


def fingerprint_documents(docs: DataFrame, radius: int = 3) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_close.

    ``docs`` needs doc_id and text; other columns are not read. A null text is an empty one. The
    edited text has its last floor(n / 4) code points replaced by the first as many of the next
    document's (by doc_id, null last, ties by text; after the last the first). Without words a
    fingerprint is 0. Ids may be any longs, sparse or extreme. ``n_close`` counts the other fingerprints of the table within ``radius`` bits.
    Repeated rows stay repeated; an empty table gives an empty result.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pairs = following(numbered(rows, "doc_id"), ["doc_id", "text"], "text", "after")
    n = F.length("text")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 4) as int))"), F.expr("substring(after, 1, cast(floor(length(text) / 4) as int))"))
    both = pairs.select("_bucket", "_rn", "_to", "_at", "doc_id", "text", n.cast("long").alias("n_chars"), edited.alias("edited"))
    sides = both.select("_bucket", "_rn", F.posexplode(F.array("text", "edited")).alias("side", "text"))
    prints = simhash(sides, ["_bucket", "_rn", "side"]).groupBy("_bucket", "_rn").agg(
        F.max(F.when(F.col("side") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("side") == 1, F.col("fp"))).alias("edited_fp")
    )
    facts = both.select("_bucket", "_rn", "_to", "_at", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"))
    zero = F.lit(0).cast("long")
    known = durable(facts.join(prints, ["_bucket", "_rn"], "left").fillna(0, ["fp", "edited_fp"]), "fingerprints")
    after = known.select(F.col("_bucket").alias("_to"), F.col("_rn").alias("_at"), F.col("fp").alias("next_fp"))
    near = within_radius(known, "fp", radius, blocks_for(known.count(), radius))
    ends = near.select(F.explode(F.array("fp_a", "fp_b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_close"))
    hexed = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    # A frequent fingerprint's rows are dealt to PARTS tasks.
    part = F.pmod(F.xxhash64("_bucket", "_rn"), F.lit(PARTS)).cast("int")
    ends = ends.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return known.join(after, ["_to", "_at"]).withColumn("_part", part).join(ends, ["fp", "_part"], "left").select(
        "doc_id", "n_chars", "edited_sha256", hexed("fp").alias("fingerprint"), hexed("edited_fp").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        F.coalesce("n_close", zero).alias("n_close"),
    )


def op2_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
