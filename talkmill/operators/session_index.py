"""Session search over kept indexes: message bodies by (session_id, seq_num), metadata by session_id; texts are read for the answer alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.functions.text import excerpt
from talkmill.operators.search import ordered, parse_query, resolved, with_meta
from talkmill.operators.text_index import TextIndex, View
from talkmill.sources.shared import written

#: Sessions whose texts are looked up by their ids in a filter that reaches the scan; beyond, by a join.
LOOKED_UP = 1000


@dataclass(frozen=True)
class SessionIndex:
    """``meta`` may be None for searches of bodies alone."""

    body: TextIndex | None
    meta: TextIndex | None

    def add(self, messages: DataFrame, sessions: DataFrame) -> None:
        """New messages, and the metadata of ``sessions``, new or changed."""
        self.add_messages(messages)
        self.add_sessions(sessions)

    def add_messages(self, messages: DataFrame) -> None:
        self.body.add(messages, "session_id", "content", "seq_num")

    def add_sessions(self, sessions: DataFrame) -> None:
        self.meta.replace(sessions, "session_id", "meta_text")

    def remove(self, sessions: DataFrame) -> None:
        self.body.remove(sessions, "session_id")
        self.meta.remove(sessions, "session_id")


def best_of_index(body: View, sessions: DataFrame, units: list[list[str]], where: Column | None) -> DataFrame:
    """(session_id, b0, b1, ...): for each unit the best message, struct(s, m) of its score and minus its seq; only the units' files are read."""
    hits = body.hits(units)
    if any(len(u) > 1 for u in units):
        hits = written(hits, "phrase-hits")  # positions are compared once, though hits are counted, weighed and ranked
    scored = body.scored(hits, body.holding(hits, len(units)))
    if where is not None:
        scored = scored.join(sessions.filter(where).select(F.col("session_id").alias("key")), "key", "left_semi")
    per = scored.groupBy(F.col("key").alias("session_id")).agg(*[F.max(F.when(F.col("unit") == i, F.col("best"))).alias(f"b{i}") for i in range(len(units))])
    return written(per, "session-bests")  # sessions are filtered and joined once, though their hits are counted and ranked


def named_in(meta: View, sessions: DataFrame, units: list[list[str]], where: Column | None) -> DataFrame:
    """(session_id, score): sessions whose metadata hold a unit, by the best one."""
    hits = meta.hits(units)
    scored = meta.scored(hits, meta.holding(hits, len(units)))
    if where is not None:
        scored = scored.join(sessions.filter(where).select(F.col("session_id").alias("key")), "key", "left_semi")
    return scored.groupBy(F.col("key").alias("session_id")).agg(F.max("best.s").alias("score")).filter("score > 0")


def hits(index: SessionIndex, sessions: DataFrame, query: str, where: Column | None = None, metadata: bool = True) -> tuple[DataFrame, bool]:
    """((session_id, score, coverage, seq, via) of all hits, without limit or order; whether some session covers all units).

    Without ``metadata`` only bodies are searched."""
    units = parse_query(query)
    found, every = resolved(best_of_index(index.body.view(), sessions, units, where), len(units))
    found = found.withColumn("seq", (-F.col("lead.m")).cast("long"))
    named = named_in(index.meta.view(), sessions, units, where) if metadata else found.select("session_id", "score").limit(0)
    return with_meta(found, every, named, ["seq"]), every


def search(index: SessionIndex, messages: DataFrame, sessions: DataFrame, query: str, where: Column | None = None, limit: int = 20, semantic: DataFrame | None = None, metadata: bool = True) -> DataFrame:
    """(position, session_id, score, coverage, seq, snippet, via): what ``search.search_sessions`` gives, without a scan of the messages.

    The index holds what was committed to it; the snippets come from ``messages``, of the ``limit`` sessions found.
    """
    units = parse_query(query)
    if limit < 0:
        raise ValueError("limit must not be negative")
    if not units or limit == 0:
        return sessions.selectExpr("cast(0 as int) position", "session_id", "0d score", "0d coverage", "0L seq", "'' snippet", "'' via").limit(0)
    found, every = hits(index, sessions, query, where, metadata)
    found = found.withColumn("_late", F.lit(0))
    if semantic is not None:
        extra = semantic.join(found.select("session_id"), "session_id", "left_anti").select("session_id", "score", F.lit(0.0).alias("coverage"), F.lit(0).cast("long").alias("seq"), F.lit("semantic").alias("via"), F.lit(1).alias("_late"))
        found = found.unionByName(extra)
    top = ordered(found, every, limit)
    texts = messages.select("session_id", F.col("seq_num").cast("long").alias("seq"), "content")
    titles = sessions.select("session_id", "title")
    if limit <= LOOKED_UP:
        rows = top.collect()
        top = sessions.sparkSession.createDataFrame(rows, top.schema)
        texts, titles = (t.filter(F.col("session_id").isin([r.session_id for r in rows])) if rows else t.limit(0) for t in (texts, titles))
    said = top.join(texts, ["session_id", "seq"], "left").join(titles, "session_id", "left")
    snippet = F.when(F.col("via") == "body", excerpt(F.col("content"), F.lit("".join(units[0])))).when(F.col("via") == "semantic", F.coalesce("title", F.lit(""))).otherwise("")
    return said.select("position", "session_id", "score", "coverage", "seq", snippet.alias("snippet"), "via")
