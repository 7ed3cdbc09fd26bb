"""Ranked session search: BM25 over messages, session-level AND with OR fallback, metadata and semantic hits."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkmill.functions.fixed_values import BM25_B, BM25_K1, META_WEIGHT
from talkmill.functions.text import excerpt, index_terms, segment, term_counts
from talkmill.sources.shared import written

HAN = re.compile(r"[㐀-䶿一-鿿豈-﫿]")
RUN = re.compile(r"[㐀-䶿一-鿿豈-﫿]+|[a-z0-9_][a-z0-9_./\-]*")
TERM = re.compile(r"[㐀-䶿一-鿿豈-﫿]|[a-z0-9]+")


def parse_query(query: str) -> list[list[str]]:
    """Units of a query, each a list of index terms that must stand side by side.

    Quoted parts come first, one unit each. Of the rest every identifier is a unit, and so is every
    run of Han characters; a single Han character counts only where there is nothing else.
    """
    text = re.sub(r"\s+", " ", "".join(chr(ord(c) - 0xFEE0) if 0xFF01 <= ord(c) <= 0xFF5E else c for c in query).replace("　", " ")).lower()
    quoted = re.findall(r'"([^"]+)"', text)
    units = [TERM.findall(q) for q in quoted]
    runs = RUN.findall(re.sub(r'"[^"]+"', " ", text))
    longer = [r for r in runs if not (HAN.match(r) and len(r) == 1)]
    return [u for u in [*units, *(TERM.findall(r) for r in longer or runs)] if u]


@dataclass(frozen=True)
class Corpus:
    """Statistics over the whole table, whatever is searched later: rows, mean length, rows that hold each unit."""

    rows: int
    mean: float
    holding: tuple


def counted(docs: DataFrame, text: str, units: list[list[str]]) -> tuple[DataFrame, Corpus]:
    """``docs`` with _len and _tf0, _tf1, ..., and the statistics, by one aggregate of a single row.

    The counts come out of a generator of one row, through which no filter is pushed, so each is computed once.
    """
    with_tf = docs.select("*", F.inline(F.array(term_counts(F.col(text), units))))
    row = with_tf.agg(F.count("*"), F.avg("_len"), *[F.count(F.when(F.col(f"_tf{i}") > 0, 1)) for i in range(len(units))]).first()
    return with_tf, Corpus(row[0], row[1] or 1.0, tuple(row[2:]))


def bm25(tf: Column, length: Column, corpus: Corpus, holding: int) -> Column:
    """Null where the unit doesn't occur. The inverse document frequency is 1e-6 where it would be 0 or less."""
    idf = math.log((corpus.rows - holding + 0.5) / (holding + 0.5))
    idf = idf if idf > 0 else 1e-6
    weight = tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * length / F.lit(corpus.mean or 1.0)))
    return F.when(tf > 0, F.lit(idf) * weight)


def top_documents(docs: DataFrame, query: str, key: str = "doc_id", text: str = "text", limit: int = 10) -> DataFrame:
    """(key, score): documents that hold every unit, by summed BM25, ties to the smaller key."""
    units = parse_query(query)
    with_tf, corpus = counted(docs, text, units)
    scores = [bm25(F.col(f"_tf{i}"), F.col("_len"), corpus, n) for i, n in enumerate(corpus.holding)]
    return with_tf.select(key, reduce(lambda a, b: a + b, scores).alias("score")).filter("score is not null").orderBy(F.desc("score"), key).limit(limit)


def best_of_messages(messages: DataFrame, sessions: DataFrame, units: list[list[str]], where: Column | None = None) -> DataFrame:
    """(session_id, b0, b1, ...): for each unit the best message, struct(s, m, text) of its score, minus its seq and its text; by a scan of all messages.

    Sessions that ``where`` leaves out are left out; statistics span all messages, whatever it says.
    """
    with_tf, corpus = counted(messages, "content", units)
    scored = with_tf.withColumns({f"_s{i}": bm25(F.col(f"_tf{i}"), F.col("_len"), corpus, n) for i, n in enumerate(corpus.holding)})
    some = reduce(lambda a, b: a | b, [F.col(f"_s{i}").isNotNull() for i in range(len(units))])
    kept = scored.filter(some).join(sessions.filter(where if where is not None else F.lit(True)).select("session_id"), "session_id", "left_semi")
    best = lambda i: F.max(F.struct(F.col(f"_s{i}").alias("s"), (-F.col("seq_num")).alias("m"), F.col("content").alias("text")))
    return written(kept.groupBy("session_id").agg(*[best(i).alias(f"b{i}") for i in range(len(units))]), "session-bests")


def resolved(per: DataFrame, units: int) -> tuple[DataFrame, bool]:
    """((session_id, score, coverage, lead, required), whether some session is required) from each session's best messages b0, b1, ...

    A session's score is the sum of its units' best ones. ``lead`` is the best message for the first unit that it hits. ``required``: all
    units from the first that any session hits are hit. One aggregate of a single row decides that.
    """
    hit = [F.col(f"b{i}.s").isNotNull() for i in range(units)]
    from_there = [reduce(lambda a, b: a & b, hit[i:]) for i in range(units)]
    told = per.agg(*[F.count(F.when(h, 1)) for h in hit], *[F.max(x.cast("int")) for x in from_there]).first()
    first = next((i for i in range(units) if told[i]), 0)
    hits = per.select(
        "session_id",
        reduce(lambda a, b: a + b, [F.coalesce(f"b{i}.s", F.lit(0.0)) for i in range(units)]).alias("score"),
        (reduce(lambda a, b: a + b, [h.cast("int") for h in hit]) / F.lit(float(units))).alias("coverage"),
        F.coalesce(*[F.when(h, F.col(f"b{i}")) for i, h in enumerate(hit)]).alias("lead"),
        from_there[first].alias("required"),
    )
    return hits, told[units + first] == 1


def with_meta(hits: DataFrame, every: bool, named: DataFrame, columns: list[str]) -> DataFrame:
    """Body hits, and after them ``named`` (session_id, score): sessions that only their metadata names, at half the score."""
    body = hits.filter("required") if every else hits
    body = body.select("session_id", "score", "coverage", *columns, F.lit("body").alias("via"))
    covered = hits.select(F.col("session_id").alias("_id"), F.col("coverage").alias("_coverage"))
    meta = named.join(body.select("session_id"), "session_id", "left_anti").join(covered, F.col("session_id") == F.col("_id"), "left")
    blank = [F.lit("" if c == "snippet" else 0).cast(hits.schema[c].dataType).alias(c) for c in columns]
    return body.unionByName(meta.select("session_id", (F.col("score") * META_WEIGHT).alias("score"), F.coalesce("_coverage", F.lit(0.0)).alias("coverage"), *blank, F.lit("meta").alias("via")))


def body_and_meta_hits(messages: DataFrame, sessions: DataFrame, query: str, where: Column | None = None) -> tuple[DataFrame, bool]:
    """((session_id, score, coverage, seq, snippet, via) of all hits, without limit or order; whether some session covers all units)."""
    units = parse_query(query)
    hits, every = resolved(best_of_messages(messages, sessions, units, where), len(units))
    hits = hits.withColumns({"seq": (-F.col("lead.m")).cast("long"), "snippet": excerpt(F.col("lead.text"), F.lit("".join(units[0])))})
    named, corpus = counted(sessions, "meta_text", units)
    scores = [F.coalesce(bm25(F.col(f"_tf{i}"), F.col("_len"), corpus, n), F.lit(0.0)) for i, n in enumerate(corpus.holding)]
    meta = named.filter(where if where is not None else F.lit(True))
    meta = meta.select("session_id", F.greatest(*scores, F.lit(0.0)).alias("score")).filter("score > 0")
    return with_meta(hits, every, meta, ["seq", "snippet"]), every


def ordered(found: DataFrame, every: bool, limit: int) -> DataFrame:
    """The first ``limit`` hits, with their position from 1; ``_late`` ones come after all others."""
    order = ["score", "coverage"] if every else ["coverage", "score"]
    keys = [F.col("_late"), *[F.when(F.col("_late") == 1, F.col("score")).otherwise(F.col(c)).desc() for c in order], F.col("session_id")]
    # At most ``limit`` rows are numbered.
    return found.orderBy(*keys).limit(limit).withColumn("position", F.row_number().over(Window.orderBy(*keys))).drop("_late")


def with_semantic(hits: DataFrame, semantic: DataFrame | None, sessions: DataFrame) -> DataFrame:
    """``hits`` and then, marked ``_late``, the ``semantic`` (session_id, score) ones that are not there yet, with their title for a snippet."""
    found = hits.withColumn("_late", F.lit(0))
    if semantic is None:
        return found
    extra = semantic.join(found.select("session_id"), "session_id", "left_anti").join(sessions.select("session_id", "title"), "session_id", "left")
    extra = extra.select(
        "session_id", "score", F.lit(0.0).alias("coverage"), F.lit(0).cast("long").alias("seq"), F.coalesce("title", F.lit("")).alias("snippet"),
        F.lit("semantic").alias("via"), F.lit(1).alias("_late"),
    )
    return found.unionByName(extra)


def search_sessions(
    messages: DataFrame, sessions: DataFrame, query: str, where: Column | None = None, limit: int = 20, semantic: DataFrame | None = None
) -> DataFrame:
    """(position, session_id, score, coverage, seq, snippet, via): ranked sessions.

    Sessions that cover all units lead; if there are none, all that cover one (best coverage first).
    Then sessions that only their meta_text names, at half the score, in the same ranking; then
    ``semantic`` (session_id, score) hits that are not there yet, after all others. ``limit`` 0 gives none.
    """
    if not parse_query(query) or limit == 0:
        return sessions.selectExpr(
            "cast(0 as int) position", "session_id", "0d score", "0d coverage", "0L seq", "'' snippet", "'' via"
        ).limit(0)
    if limit < 0:
        raise ValueError("limit must not be negative")
    hits, every = body_and_meta_hits(messages, sessions, query, where)
    return ordered(with_semantic(hits, semantic, sessions), every, limit)


def meta_text(title: Column, topics: Column, decisions: Column | None = None, tags: Column | None = None, summary: Column | None = None) -> Column:
    """What a session's metadata is searched by: tokens of title, topics, each decision's first 30 characters, tags and summary."""
    none = F.array().cast("array<string>")
    texts = [F.array(F.coalesce(title, F.lit(""))), F.coalesce(topics, none)]
    if decisions is not None:
        texts.append(F.coalesce(F.transform(decisions, lambda x: F.substring(x["text"], 1, 30)), none))
    texts += [F.coalesce(tags, none)] if tags is not None else []
    texts += [F.array(summary)] if summary is not None else []
    return F.array_join(segment(F.array_join(F.concat(*texts), " ")), " ")


def with_briefs(hits: DataFrame, sessions: DataFrame) -> DataFrame:
    """``hits`` with title, source, created_at and state of their sessions, by one join; unknown sessions keep their hit."""
    brief = sessions.select("session_id", "title", "source", "created_at", "state")
    return hits.withColumn("score", F.round("score", 3)).join(brief, "session_id", "left")


def hint(sessions: DataFrame, call: Column | None, hits: int, enough: int = 3) -> DataFrame:
    """(hits, matching, more): whether a call with few hits has matching sessions that the scope keeps out. ``enough`` hits need no hint."""
    matching = sessions.filter(call if call is not None else F.lit(True)).agg(F.count("*").alias("matching"))
    return matching.select(F.lit(hits).cast("long").alias("hits"), "matching", ((F.lit(hits) < enough) & (F.col("matching") > hits)).alias("more"))


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(term, key, position from 0): the inverted index, for tables that are searched again and again."""
    return docs.select(F.col(key), F.posexplode(index_terms(F.col(text))).alias("position", "term")).select("term", key, "position")


def phrase_in_postings(index: DataFrame, key: str, unit: list[str]) -> DataFrame:
    """(key, n): how often the terms stand side by side; joins only the postings of those terms."""
    wanted = index.sparkSession.createDataFrame([(t, i) for i, t in enumerate(unit)], "term string, place int")
    hits = index.join(F.broadcast(wanted), "term").withColumn("start", F.col("position") - F.col("place"))
    whole = hits.groupBy(key, "start").agg(F.countDistinct("place").alias("k")).filter(F.col("k") == len(unit))
    return whole.groupBy(key).agg(F.count("*").alias("n"))


def file_query(path: str) -> str:
    """A quoted search for a path, with forward slashes."""
    return '"' + path.replace("\\", "/").replace('"', "") + '"'


def file_history(messages: DataFrame, sessions: DataFrame, path: str, where: Column | None = None, limit: int = 20) -> DataFrame:
    """Sessions that name a file."""
    return search_sessions(messages, sessions, file_query(path), where, limit)
