"""Source divergence audit: how far each source's words are from those of the other sources of its language, and which words set it apart.

A pair of sources is summed over all kept terms by inclusion and exclusion over their supports, so a term that neither
has is never looked at: a constant covers the terms that both lack, a histogram of each source's counts prices what it has
as if the other lacked it, and a join of postings, of the terms that both have, corrects the overlap.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkmill.llm.common import ASCII_LOWER, ASCII_UPPER, durable, free_caches, table

#: Documents of a language that hold a kept term, at least.
MIN_DOCS = 10
#: Terms reported for each source.
TOP_TERMS = 10
#: Sources of a language whose pairs one join key gives; with more of them the pairs are dealt to blocks.
SOURCES_PER_BLOCK = 64
#: Entries and bytes of terms that a task gathers before it sends them on.
FLUSH_TERMS, FLUSH_BYTES = 600_000, 32 << 20
#: More than the occurrences of a term that a task gathers before it sends them on.
DOC = 1 << 40
#: Bytes of a text whose terms are listed at once.
PIECE = 1 << 20

_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_GAP = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")


def terms_of(text: bytes) -> Counter:
    """How often each term is in a lower-cased text; a long text is cut between terms."""
    found, at = Counter(), 0
    while len(text) - at > PIECE:
        gap = _GAP.search(text, at + PIECE)
        cut = gap.start() if gap else len(text)
        found.update(_TERM.findall(text, at, cut))
        at = cut
    found.update(_TERM.findall(text, at))
    return found


def as_text(terms: list[bytes | None]) -> pa.Array:
    try:
        return pa.array(terms, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:  # bytes that are no UTF-8
        return pa.array([t if t is None else t.decode("utf-8", "replace") for t in terms], pa.string())


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d): occurrences and documents, summed by each task as far as FLUSH_TERMS go; a row with a null term for each source met."""

    def run(batches):
        free_caches()
        # For each source and term: documents times DOC and occurrences, in one number.
        met: dict[tuple[str, str], dict[bytes, int]] = defaultdict(dict)
        size, entries = 0, 0

        def flush():
            for (lang, source), counts in met.items():
                told, n = np.fromiter(counts.values(), np.int64, len(counts)), len(counts) + 1
                columns = [as_text([None, *counts]), np.append(0, told % DOC), np.append(0, told // DOC)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n), pa.array([source] * n), *map(pa.array, columns)], ["lang", "source", "term", "n", "d"])
            met.clear()

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, found = met[lang, source], terms_of(text.lower())
                before, get = len(own), own.get
                for term, n in found.items():
                    own[term] = get(term, 0) + n + DOC
                if more := len(own) - before:
                    entries += more
                    size += sum(map(len, found)) * more // len(found)
                if entries > FLUSH_TERMS or size > FLUSH_BYTES:
                    yield from flush()
                    size, entries = 0, 0
        yield from flush()

    plain = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return plain.mapInArrow(run, "lang string, source string, term string, n long, d long")


def share(count: str, total: str):
    """1 + floor(10 ** 9 * (count + 2) / (total + 2 * v)), exact for any counts; null if nothing is kept."""
    return F.expr(f"if(v = 0, cast(null as long), 1 + (cast({count} + 2 as decimal(20,0)) * cast(1000000000 as decimal(10,0))) div cast({total} + 2 * v as decimal(20,0)))")


def apart(p: str, q: str) -> str:
    return f"((({p} - {q}) * ({p} - {q})) div ({p} + {q}))"


def in_blocks(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """``left`` joined to ``right`` on ``on`` where left.source < right.source; both have blocks, right's columns end in _b.

    A left row goes to the block of its source, a right row to all: no key has more than SOURCES_PER_BLOCK left rows or so.
    """
    a = left.withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    b = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    b = b.select(*[F.col(c).alias(c if c in (*on, "block") else f"{c}_b") for c in b.columns])
    return a.join(b, [*on, "block"]).filter("source < source_b")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) for every source of every language.

    Part "pair": each other source of the language, by the sum over the language's kept terms of f(p, q), where p and q are the
    two sources' smoothed shares of a term in billionths and f is (p - q) squared over p + q, rounded down. Part "term":
    the ``top`` terms that the source has more of than its language, by f of their shares. A term is kept if at least ``min_docs``
    documents of the language hold it. Ranks go by value, largest first, then by item.

    Null texts, languages and sources are empty ones; rows are documents, repeated ones too. A source without a kept term
    has all shares alike; in a language without kept terms all pairs are 0. Other columns are not read; an empty
    table gives an empty result.
    """
    own = Window.partitionBy("lang", "term")
    counted = term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    marked = counted.select(
        "lang", "source", "term", "n", F.sum("n").over(own).alias("lang_n"), F.sum("d").over(own).alias("lang_d"),
        (F.row_number().over(own.orderBy("source")) == 1).cast("long").alias("first"),
    )
    known = durable(marked.filter(F.col("term").isNull() | (F.col("lang_d") >= min_docs)), "terms")
    of_group = known.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = known.groupBy("lang").agg(
        F.coalesce(F.sum(F.when(F.col("term").isNotNull(), F.col("first"))), F.lit(0)).alias("v"), F.sum("n").alias("lang_total"),
        F.greatest(F.lit(1), F.ceil(F.sum(F.col("term").isNull().cast("long")) / SOURCES_PER_BLOCK)).cast("int").alias("blocks"),
    )
    groups = of_group.join(of_lang, "lang").select("lang", "source", "total", "v", "lang_total", "blocks", share("0", "total").alias("p0"))
    groups = durable(groups, "groups")
    postings = known.filter("term is not null").join(groups, ["lang", "source"])
    postings = durable(postings.select("lang", "source", "term", share("n", "total").alias("p"), share("lang_n", "lang_total").alias("q"), "p0", "blocks"), "postings")

    both = in_blocks(groups.select("lang", "source", "p0", "v", "blocks"), groups.select("lang", "source", "p0", "blocks"), ["lang"])
    none = F.expr(apart("p0", "p0_b"))
    constant = both.select("lang", "source", F.col("source_b").alias("item"), F.expr(f"coalesce(v * {apart('p0', 'p0_b')}, 0L)").alias("value"))
    steps = postings.groupBy("lang", "source", "p").agg(F.count("*").alias("terms"))
    sides = both.filter("v > 0").select(
        "lang", F.col("source").alias("low"), F.col("source_b").alias("high"), F.explode(F.array(F.struct(F.col("source").alias("source"), F.col("p0_b").alias("other")), F.struct(F.col("source_b").alias("source"), F.col("p0").alias("other")))).alias("side"), none.alias("none"),
    ).select("lang", "low", "high", "side.source", "side.other", "none")
    one_sided = sides.join(steps, ["lang", "source"]).select("lang", F.col("low").alias("source"), F.col("high").alias("item"), F.expr(f"terms * ({apart('p', 'other')} - none)").alias("value"))
    cut = postings.select("lang", "source", "term", "p", "p0", "blocks")
    overlap = in_blocks(cut, cut, ["lang", "term"]).select(
        "lang", "source", F.col("source_b").alias("item"), F.expr(f"{apart('p', 'p_b')} - {apart('p', 'p0_b')} - {apart('p0', 'p_b')} + {apart('p0', 'p0_b')}").alias("value")
    )
    pairs = constant.unionByName(one_sided).unionByName(overlap).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("way")
    pairs = pairs.select("lang", ways, "value").select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value")
    terms = postings.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(apart("p", "q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    return pairs.select("*", rank).unionByName(terms.select("*", rank).filter(F.col("rank") <= top))


OP13_SQL = rf"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
words AS MATERIALIZED (SELECT k, lang, source, unnest(w) AS term FROM docs),
kept AS MATERIALIZED (SELECT lang, term, count(*)::HUGEINT AS n FROM words GROUP BY lang, term HAVING count(DISTINCT k) >= 10),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
sources AS MATERIALIZED (SELECT DISTINCT lang, source FROM docs),
counts AS MATERIALIZED (SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS n FROM words w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM counts GROUP BY ALL),
shares AS MATERIALIZED (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (coalesce(t.total, 0) + 2 * l.v) AS p,
  1 + (1000000000 * (k.n + 2)) // (l.total + 2 * l.v) AS q
  FROM sources s JOIN kept k ON k.lang = s.lang JOIN langs l ON l.lang = s.lang LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
  LEFT JOIN totals t ON t.lang = s.lang AND t.source = s.source),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM shares WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM found) WHERE part = 'pair' OR rank <= 10
"""


def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))
