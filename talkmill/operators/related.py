"""Vector search over sessions and recommendation of related ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkmill.functions.fixed_values import EMBEDDING_CHARS, RELATED_CAP, SEMANTIC_THRESHOLD, SEMANTIC_TOP
from talkmill.functions.text import segment
from talkmill.functions.vectors import dot, embed


def vector_search(vectors: DataFrame, query: list[float], allowed: DataFrame | None = None, threshold: float = SEMANTIC_THRESHOLD, top: int = SEMANTIC_TOP) -> DataFrame:
    """(session_id, score): the ``top`` vectors with a product of ``threshold`` or more; other lengths are passed over.

    One scan, a partial top-k in every task. ``allowed`` (session_id), if given, restricts the sessions.
    """
    if allowed is not None:
        vectors = vectors.join(allowed.select("session_id"), "session_id", "left_semi")
    scored = vectors.select("session_id", dot(F.col("vec"), F.array(*[F.lit(float(x)) for x in query])).alias("score"))
    return scored.filter(F.col("score") >= threshold).orderBy(F.desc("score"), "session_id").limit(top)


def text_search(vectors: DataFrame, query: str, allowed: DataFrame | None = None, threshold: float = SEMANTIC_THRESHOLD, top: int = SEMANTIC_TOP) -> DataFrame:
    """``vector_search`` for a text, embedded by the library's own expression."""
    spark = vectors.sparkSession
    row = spark.range(1).select(embed(F.lit(query)).alias("v")).first()
    return vector_search(vectors, list(row.v), allowed, threshold, top)


def backlog(sessions: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """Confirmed sessions without a vector of ``model``."""
    return sessions.filter("state = 'confirmed'").join(vectors.filter(F.col("model") == model).select("session_id"), "session_id", "left_anti")


def embedding_inputs(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """(session_id, input): title and the first 30 messages' first 200 characters, in order."""
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("seq_num"))
    first = messages.withColumn("place", place).filter("place <= 30").groupBy("session_id").agg(
        F.array_sort(F.collect_list(F.struct("place", F.substring("content", 1, 200).alias("t")))).alias("parts")
    )
    body = F.array_join(F.transform("parts", lambda p: p["t"]), " ")
    return sessions.join(first, "session_id", "left").select(
        "session_id", F.substring(F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce(body, F.lit(""))), 1, 1200).alias("input")
    )


def digest(sessions: DataFrame, messages: DataFrame, vectors: DataFrame, model: str, limit: int = 20, skip: DataFrame | None = None) -> DataFrame:
    """New vectors (session_id, model, dim, vec) for up to ``limit`` confirmed sessions, newest first; ``skip`` never uses up the limit."""
    waiting = backlog(sessions, vectors, model)
    if skip is not None:
        waiting = waiting.join(skip.select("session_id"), "session_id", "left_anti")
    chosen = waiting.orderBy(F.desc("created_at"), "session_id").limit(limit)
    inputs = embedding_inputs(chosen, messages.join(chosen.select("session_id"), "session_id", "left_semi"))
    vec = inputs.select("session_id", F.lit(model).alias("model"), embed(F.col("input")).alias("vec"))
    return vec.select("session_id", "model", F.size("vec").alias("dim"), "vec")


def overlap(sessions: DataFrame, anchor_id: str) -> DataFrame:
    """(session_id, score, reason) of the other sessions that share something with the anchor.

    3 for each shared topic, 2 for each tag, 1 for each file and title word, up to 3 of either. The
    anchor is one row, looked up once and compared as constants.
    """
    words = F.array_distinct(F.filter(segment(F.coalesce(F.col("title"), F.lit(""))), lambda t: F.length(t) >= 2))
    rows = sessions.select("session_id", "topics", "user_tags", "files_mentioned", words.alias("words"))
    anchor = rows.filter(F.col("session_id") == anchor_id).first()
    if anchor is None:
        return sessions.selectExpr("session_id", "0L score", "'' reason").limit(0)

    def shared(column: str) -> Column:
        mine = F.array(*[F.lit(x) for x in getattr(anchor, column) or []]).cast("array<string>")
        return F.coalesce(F.array_intersect(mine, F.col(column)), F.array().cast("array<string>"))

    t, g, f, w = (shared(c) for c in ("topics", "user_tags", "files_mentioned", "words"))
    score = F.size(t) * 3 + F.size(g) * 2 + F.least(F.size(f), F.lit(3)) + F.least(F.size(w), F.lit(3))
    part = lambda name, x, n: F.when(F.size(x) > 0, F.concat(F.lit(name), F.array_join(F.slice(x, 1, n), "、")))
    named = F.filter(F.array(part("共享话题：", t, 3), part("共享标签：", g, 3), part("共享文件：", f, 2)), lambda p: p.isNotNull())
    reason = F.when(F.size(named) > 0, F.array_join(F.slice(named, 1, 2), " · ")).otherwise(F.coalesce(part("标题相关：", w, 3), F.lit("")))
    return rows.filter(F.col("session_id") != anchor_id).select("session_id", score.cast("long").alias("score"), reason.alias("reason")).filter("score > 0")


def upsert_vectors(stored: DataFrame, new: DataFrame) -> DataFrame:
    """One vector a session: a new one replaces the old, whatever its model; of a repeated new one the latest counts."""
    rest = [c for c in stored.columns if c not in ("session_id", "embedded_at")]
    once = new.groupBy("session_id").agg(F.max(F.struct("embedded_at", *rest)).alias("r")).select("session_id", "r.*").select(stored.columns)
    return stored.join(once.select("session_id"), "session_id", "left_anti").select(stored.columns).unionByName(once)


def semantic_hits(vectors: DataFrame | None, query: str, allowed: DataFrame | None = None) -> DataFrame | None:
    """Hits for ``search_sessions``: None where there are no vectors to search, and search goes by text alone."""
    return None if vectors is None else text_search(vectors, query, allowed)


def side_by_side(text_hits: DataFrame, fused_hits: DataFrame) -> DataFrame:
    """(session_id, text_position, fused_position): two searches' results beside each other."""
    a = text_hits.select("session_id", F.col("position").alias("text_position"))
    return a.join(fused_hits.select("session_id", F.col("position").alias("fused_position")), "session_id", "full_outer")


def related(
    sessions: DataFrame, vectors: DataFrame, anchor_id: str, limit: int = 5, threshold: float = SEMANTIC_THRESHOLD, messages: DataFrame | None = None
) -> DataFrame:
    """(position, session_id, score, reason, via): near vectors of confirmed sessions first, then overlap, up to 1 to 10 rows.

    An anchor without a vector is embedded from its title and, if ``messages`` are given, its first user message. An unknown anchor gives no rows.
    """
    limit = min(max(1, limit), RELATED_CAP)
    confirmed = sessions.filter((F.col("state") == "confirmed") & (F.col("session_id") != anchor_id))
    own = vectors.filter(F.col("session_id") == anchor_id).first()
    if own:
        query = list(own.vec)
    else:
        anchor = sessions.filter(F.col("session_id") == anchor_id).select("session_id", F.coalesce("title", F.lit("")).alias("title"))
        if messages is not None:
            said = messages.filter((F.col("session_id") == anchor_id) & (F.col("role") == "user")).groupBy("session_id").agg(F.min_by("content", "seq_num").alias("said"))
            anchor = anchor.join(said, "session_id", "left")
        else:
            anchor = anchor.withColumn("said", F.lit(None).cast("string"))
        text = F.substring(F.concat("title", F.lit("\n"), F.coalesce("said", F.lit(""))), 1, EMBEDDING_CHARS)
        row = anchor.select(embed(text).alias("v")).first()
        if row is None:
            return sessions.selectExpr("session_id", "0d score", "'' reason", "'' via", "0 position").limit(0)
        query = list(row.v)
    near = vector_search(vectors, query, confirmed, threshold, limit).select(
        "session_id", F.round("score", 3).alias("score"), F.concat(F.lit("向量相似 "), F.format_number("score", 2)).alias("reason"), F.lit("vector").alias("via")
    )
    shared = overlap(sessions, anchor_id).join(near.select("session_id"), "session_id", "left_anti")
    rest = shared.orderBy(F.desc("score"), "session_id").limit(limit).select("session_id", F.col("score").cast("double").alias("score"), "reason", F.lit("overlap").alias("via"))
    both = near.unionByName(rest)
    order = [F.when(F.col("via") == "vector", 0).otherwise(1), F.desc("score"), F.col("session_id")]
    top = both.orderBy(*order).limit(limit)
    return top.withColumn("position", F.row_number().over(Window.orderBy(*order)))
