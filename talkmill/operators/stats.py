"""Counts, growth, team and project figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_by(rows: DataFrame, *columns: str, sums: dict[str, str] | None = None) -> DataFrame:
    """(columns, n): rows by some columns; ``sums`` maps names to columns that are added up, to two decimals."""
    added = [F.round(F.sum(c), 2).cast("double").alias(name) for name, c in (sums or {}).items()]
    return rows.groupBy(*columns).agg(F.count("*").alias("n"), *added)


def project_summary(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("project_id").agg(
        F.coalesce(F.sum("message_count"), F.lit(0)).alias("message_total"), F.max("last_event_at").alias("last_event_at"), F.count("*").alias("sessions")
    )


def overview(sessions: DataFrame) -> DataFrame:
    """One card per project and one with the totals (project null)."""
    active = F.count(F.when(F.col("state") == "active", 1))
    return sessions.rollup("project_id").agg(
        F.count("*").alias("sessions"), active.alias("active"), F.sum("message_count").alias("messages"), F.max("last_event_at").alias("last_event_at")
    )


def growth(messages: DataFrame, sessions: DataFrame, since: str, project: str | None = None) -> DataFrame:
    """(day, msgs, sess): messages by their day and sessions by their last day, from ``since`` on, absent sides 0; of one project if it is named."""
    if project is not None:
        sessions = sessions.filter(F.col("project_id") == project)
        messages = messages.join(sessions.select("session_id"), "session_id", "left_semi")
    msgs = messages.filter(F.col("created_at").isNotNull()).groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("msgs"))
    last = F.to_date(F.coalesce("last_event_at", "created_at"))
    sess = sessions.filter(F.col("last_event_at").isNotNull()).groupBy(last.alias("day")).agg(F.count("*").alias("sess"))
    both = msgs.join(sess, "day", "full_outer").filter(F.col("day") >= F.lit(since).cast("date"))
    return both.select(F.col("day").cast("string").alias("day"), F.coalesce("msgs", F.lit(0)).alias("msgs"), F.coalesce("sess", F.lit(0)).alias("sess"))


def team(sessions: DataFrame) -> DataFrame:
    """(kind, name, n): sessions by origin (native is every origin but imported), author and importer."""
    origin = F.when(F.col("origin") == "imported", "imported").otherwise("native")
    kinds = {"origin": origin, "author": F.coalesce("author", "imported_from", F.lit("（未署名）")), "importer": F.coalesce("imported_from", F.lit("（本地捕获）"))}
    rows = sessions.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("name")) for k, c in kinds.items()])).alias("x"))
    return rows.groupBy("x.kind", "x.name").agg(F.count("*").alias("n"))


def packages(transfers: DataFrame) -> DataFrame:
    return transfers.filter("type = 'import'").agg(F.countDistinct("file_path").alias("packages"))


def topic_map(sessions: DataFrame) -> DataFrame:
    """(topic, session_id, n): each session of each topic, and how many the topic has; no topic's sessions are gathered."""
    pairs = sessions.select(F.explode("topics").alias("topic"), "session_id").distinct()
    return pairs.join(pairs.groupBy("topic").agg(F.count("*").alias("n")), "topic")


def envelope(sessions: DataFrame) -> DataFrame:
    """(sources, first, last, sessions, messages): what an export holds."""
    last = F.max(F.coalesce("last_event_at", "created_at"))
    return sessions.agg(
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.min("created_at").alias("first"), last.alias("last"),
        F.count("*").alias("sessions"), F.coalesce(F.sum("message_count"), F.lit(0)).alias("messages"),
    )


def top_files(sessions: DataFrame, top: int = 15) -> DataFrame:
    named = sessions.select(F.explode("files_mentioned").alias("file"))
    return named.groupBy("file").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "file").limit(top)


def vector_signature(vectors: DataFrame) -> DataFrame:
    """(model, signature): count and last change of each model's vectors."""
    return vectors.groupBy("model").agg(F.concat_ws(":", F.count("*"), F.max("embedded_at")).alias("signature"))


def counters(events: DataFrame, name: str) -> DataFrame:
    return events.groupBy(name).agg(F.count("*").alias("n"))
