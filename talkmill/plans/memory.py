"""Sessions, messages, links, vectors and events seen in the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.functions.text import collapse
from talkmill.plans.registry import table

ISO = "yyyy-MM-dd'T'HH:mm:ss"


def messages(spark, sf_dir: str) -> DataFrame:
    """Conversations as messages: one day per conversation of a month, one minute per turn."""
    c = table(spark, sf_dir, "conversations")
    at = F.expr("timestamp'2024-01-01' + make_dt_interval(cast(conv_id % 30 as int), cast(conv_id % 24 as int), cast(turn as int))")
    return c.select(
        F.col("conv_id").cast("string").alias("session_id"), "role", F.col("text").alias("content"), (F.col("turn") + 1).alias("seq_num"),
        F.date_format(at, ISO).alias("created_at"), "conv_id",
    )


def sessions(spark, sf_dir: str) -> DataFrame:
    """One row per conversation; what the tables lack is derived from its number."""
    m = messages(spark, sf_dir)
    base = m.groupBy("session_id", "conv_id").agg(
        F.min_by(F.when(F.col("role") == "user", F.col("content")), F.when(F.col("role") == "user", F.col("seq_num"))).alias("first_user"),
        F.min("created_at").alias("created_at"), F.max("created_at").alias("last_event_at"), F.count("*").alias("message_count"),
    )
    n = F.col("conv_id")
    state = F.when(n % 5 == 0, "active").when(n % 5 == 1, "pending_end").otherwise("confirmed")
    text = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in p])
    none = F.array().cast("array<string>")
    return base.select(
        "session_id", text("s", n % 4).alias("source"), text("k", n).alias("source_session_id"), text("p", n % 3).alias("project_id"),
        F.when(n % 10 == 7, "imported").when(n % 10 == 9, "workflow").otherwise("native").alias("origin"), state.alias("state"),
        F.substring(collapse(F.col("first_user")), 1, 60).alias("title"), "created_at", "last_event_at",
        F.when(n % 5 == 1, F.col("last_event_at")).alias("pending_at"), F.lit(None).cast("string").alias("confirmed_at"), "message_count",
        F.array_distinct(F.array(text("t", n % 7), text("t", n % 4))).alias("topics"), F.when(n % 6 == 0, F.array(F.lit("sensitive"))).when(n % 11 == 0, F.array(F.lit("保留"))).otherwise(none).alias("user_tags"),
        F.array(text("src/m", n % 5, ".ts"), text("lib/x", n % 3, ".py")).alias("files_mentioned"),
        F.when(n % 8 != 0, text("u", n % 8)).alias("author"), F.when(n % 10 == 7, text("team", n % 2)).alias("imported_from"),
        F.lit(None).cast("string").alias("cleanup_at"), F.lit(None).cast("long").alias("original_message_count"), F.lit(None).cast("string").alias("summary_rule"), "conv_id",
    )


def links(spark, sf_dir: str) -> DataFrame:
    """Each conversation continues into the next; every third is pinned to the one five on."""
    s = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    next_ = s.select(F.col("conv_id").cast("string").alias("session_id"), (F.col("conv_id") + 1).cast("string").alias("linked_session_id"), F.lit("continues").alias("kind"))
    pins = s.filter("conv_id % 3 = 0").select(F.col("conv_id").cast("string").alias("session_id"), (F.col("conv_id") + 5).cast("string").alias("linked_session_id"), F.lit("pinned").alias("kind"))
    return next_.unionByName(pins)


def vectors(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").cast("string").alias("session_id"), F.when(F.col("vec_id") % 4 == 0, "old").otherwise("new").alias("model"),
        F.size("embedding").alias("dim"), F.col("embedding").alias("vec"), F.col("label").cast("string").alias("embedded_at"), "label",
    )


#: The same tables as common table expressions; queries go on with ", name AS (...) SELECT ...".
MEMORY_SQL = """WITH messages AS (SELECT conv_id::VARCHAR AS session_id, role, text AS content, turn + 1 AS seq_num,
  strftime(TIMESTAMP '2024-01-01' + to_days((conv_id % 30)::INT) + to_hours(conv_id % 24) + to_minutes(turn), '%Y-%m-%dT%H:%M:%S') AS created_at, conv_id FROM conversations),
base AS (SELECT session_id, conv_id, min_by(content, seq_num) FILTER (role = 'user') AS first_user, min(created_at) AS created_at,
  max(created_at) AS last_event_at, count(*) AS message_count FROM messages GROUP BY ALL),
sessions AS (SELECT session_id, 's' || conv_id % 4 AS source, 'k' || conv_id AS source_session_id, 'p' || conv_id % 3 AS project_id,
  CASE conv_id % 10 WHEN 7 THEN 'imported' WHEN 9 THEN 'workflow' ELSE 'native' END AS origin,
  CASE conv_id % 5 WHEN 0 THEN 'active' WHEN 1 THEN 'pending_end' ELSE 'confirmed' END AS state,
  substr(trim(regexp_replace(first_user, '\\s+', ' ', 'g')), 1, 60) AS title, created_at, last_event_at,
  CASE WHEN conv_id % 5 = 1 THEN last_event_at END AS pending_at, message_count, CASE WHEN conv_id % 7 = conv_id % 4 THEN ['t' || conv_id % 7] ELSE ['t' || conv_id % 7, 't' || conv_id % 4] END AS topics,
  CASE WHEN conv_id % 6 = 0 THEN ['sensitive'] WHEN conv_id % 11 = 0 THEN ['保留'] ELSE []::VARCHAR[] END AS user_tags,
  ['src/m' || conv_id % 5 || '.ts', 'lib/x' || conv_id % 3 || '.py'] AS files_mentioned,
  CASE WHEN conv_id % 8 != 0 THEN 'u' || conv_id % 8 END AS author, CASE WHEN conv_id % 10 = 7 THEN 'team' || conv_id % 2 END AS imported_from, conv_id FROM base)"""
