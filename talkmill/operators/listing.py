"""Lists, pages, lookups and reading windows over sessions and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkmill.functions.text import clip, collapse, literal_snippet


def list_sessions(sessions: DataFrame, where: Column | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """Most recently active first, ties by id; one page."""
    rows = sessions.filter(where) if where is not None else sessions
    return rows.orderBy(F.desc(F.coalesce("last_event_at", "created_at")), "session_id").offset(offset).limit(limit)


def page_with_more(sessions: DataFrame, page: int, size: int = 20, where: Column | None = None) -> DataFrame:
    """One page (from 1) and ``has_more``: whether a row follows it. One row more than the page is read."""
    rows = list_sessions(sessions, where, size + 1, (page - 1) * size)
    order = Window.orderBy(F.desc(F.coalesce("last_event_at", "created_at")), "session_id")
    seen = rows.withColumns({"_rn": F.row_number().over(order), "_n": F.count("*").over(Window.partitionBy(F.lit(0)))})
    return seen.filter(F.col("_rn") <= size).withColumn("has_more", F.col("_n") > size).drop("_rn", "_n")


def by_prefix(sessions: DataFrame, prefix: str) -> DataFrame:
    """The session whose id starts with ``prefix``, ignoring case; of several the most recent."""
    return list_sessions(sessions, F.lower("session_id").startswith(prefix.lower()), 1)


def resolve(sessions: DataFrame, ref: str) -> DataFrame:
    """(session_id, how, matches): by exact id, else by prefix (the first 10), else by the source's own id.

    ``matches`` over 1 marks an ambiguous prefix, which callers reject.
    """
    how = F.when(F.col("session_id") == ref, 1).when(F.lower("session_id").startswith(ref.lower()), 2).when(F.col("source_session_id") == ref, 3)
    found = sessions.withColumn("how", how).filter("how is not null")
    best = found.agg(F.min("how")).first()[0]
    kept = found.filter(F.col("how") == (best or 0))
    n = kept.count()
    return kept.orderBy("session_id").limit(10).select("session_id", F.element_at(F.array(*map(F.lit, ("id", "prefix", "source id"))), F.col("how")).alias("how"), F.lit(n).cast("long").alias("matches"))


def message_range(messages: DataFrame, session_id: str, start: int, end: int, role: str | None = None) -> DataFrame:
    rows = messages.filter((F.col("session_id") == session_id) & F.col("seq_num").between(start, end))
    return rows.filter(F.col("role") == role) if role else rows


def find_in_sessions(messages: DataFrame, needle: str, limit: int = 200) -> DataFrame:
    """(session_id, seq_num, role, snippet, total): messages that hold ``needle`` literally, ignoring ASCII case; the first ``limit`` of a session."""
    by = Window.partitionBy("session_id")
    found = messages.filter(F.lower("content").contains(needle.lower()))
    placed = found.withColumns({"place": F.row_number().over(by.orderBy("seq_num")), "total": F.count("*").over(by)})
    return placed.filter(F.col("place") <= limit).select("session_id", "seq_num", "role", collapse(literal_snippet(F.col("content"), needle)).alias("snippet"), "total")


def reading_window(messages: DataFrame, most_bytes: int = 50_000, most_chars: int = 1000) -> DataFrame:
    """Clipped messages of each session, in order, up to the first that would pass ``most_bytes`` of UTF-8; it and all after it go."""
    text = clip(F.col("content"), most_chars)
    running = F.sum(F.octet_length("body")).over(Window.partitionBy("session_id").orderBy("seq_num").rowsBetween(Window.unboundedPreceding, 0))
    rows = messages.withColumn("body", text).withColumn("bytes_so_far", running)
    return rows.filter(F.col("bytes_so_far") <= most_bytes).select("session_id", "seq_num", "role", "body", "bytes_so_far", F.round(F.col("bytes_so_far") / 3).cast("long").alias("tokens_so_far"))


def message_page(messages: DataFrame, start: int = 1, size: int = 50, most_chars: int = 4000) -> DataFrame:
    """Messages ``start`` to ``start + size - 1`` of each session by rank, so that gaps in seq_num hide none."""
    placed = messages.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy("seq_num")))
    first = max(1, start)
    return placed.filter(F.col("place").between(first, first + size - 1)).withColumn("content", clip(F.col("content"), most_chars))


def first_user_titles(messages: DataFrame) -> DataFrame:
    """(session_id, title): the first user message with words, white space collapsed, 60 characters."""
    said = messages.filter("role = 'user'").withColumn("t", collapse(F.col("content"))).filter("t != ''")
    return said.groupBy("session_id").agg(F.substring(F.min_by("t", "seq_num"), 1, 60).alias("title"))


def listed_decisions(sessions: DataFrame, topic: str | None = None, source: str | None = None) -> DataFrame:
    """(at, source, session_id, title, text, seq): all decisions, oldest first; program-made sessions are left out."""
    rows = sessions.filter(F.col("decisions").isNotNull() & (F.coalesce("origin", F.lit("")) != "workflow"))
    if source:
        rows = rows.filter(F.col("source") == source)
    if topic:
        rows = rows.filter(F.coalesce(F.array_contains("topics", topic), F.lit(False)) | F.coalesce(F.contains("title", F.lit(topic)), F.lit(False)))
    each = rows.select("source", "session_id", "title", "created_at", F.explode("decisions").alias("d"))
    return each.select(F.coalesce("d.at", "created_at").alias("at"), "source", "session_id", "title", "d.text", "d.seq").orderBy("at", "session_id", "seq")


def listed_unresolved(sessions: DataFrame, limit: int = 20, since: str | None = None) -> DataFrame:
    """Open questions, newest session first; the same question (first 40 characters without white space) once."""
    rows = sessions.filter(F.col("key_questions").isNotNull() & (F.coalesce("origin", F.lit("")) != "workflow"))
    each = rows.select("source", "session_id", "title", "created_at", F.posexplode("key_questions").alias("i", "q")).filter("q.unresolved")
    key = F.substring(F.regexp_replace("q.q", r"(?U)\s+", ""), 1, 40)
    newest = Window.partitionBy("key").orderBy(F.desc("created_at"), "session_id", "i")
    once = each.withColumn("key", key).withColumn("rn", F.row_number().over(newest)).filter("rn = 1 or key = ''")
    out = once.select("q.q", F.coalesce("q.at", "created_at").alias("at"), "source", "session_id", "title", "created_at", "i")
    if since:
        out = out.filter(F.col("at") >= since)
    return out.orderBy(F.desc("created_at"), "session_id", "i").limit(limit).drop("created_at", "i")


def on_day(sessions: DataFrame, day: str) -> DataFrame:
    """Sessions whose last (or first) event falls on a day, most recent first."""
    last = F.coalesce("last_event_at", "created_at")
    return sessions.filter(F.to_date(last) == F.lit(day).cast("date")).orderBy(F.desc(last), "session_id")


def by_kind(sessions: DataFrame) -> DataFrame:
    """``sessions`` with is_note: notes are listed apart from conversations."""
    return sessions.withColumn("is_note", F.col("source") == "note")


def latest_decisions(sessions: DataFrame, n: int = 10, topic: str | None = None, source: str | None = None) -> DataFrame:
    """The ``n`` latest decisions, newest first."""
    return listed_decisions(sessions, topic, source).orderBy(F.desc("at"), F.desc("session_id"), F.desc("seq")).limit(n)


DECISION = "array<struct<text:string,seq:long,at:string>>"
QUESTION = "array<struct<q:string,seq:long,at:string,unresolved:boolean>>"


def decoded(rows: DataFrame) -> DataFrame:
    """Rows whose lists are JSON text, with the lists: null and broken text give empty lists, a null count 0."""
    of = lambda c, kind: F.coalesce(F.from_json(c, kind), F.array().cast(kind)).alias(c)
    kinds = {"files_mentioned": "array<string>", "topics": "array<string>", "user_tags": "array<string>", "decisions": DECISION, "key_questions": QUESTION}
    plain = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c) if c == "message_count" else F.col(c)
    return rows.select(*[of(c, kinds[c]) if c in kinds else plain(c) for c in rows.columns])


def with_age(sessions: DataFrame, today: str) -> DataFrame:
    """``sessions`` with age: whole days since the last event under 30, months under 365, then years with one decimal; a future one is today, none unknown."""
    seconds = F.unix_timestamp(F.lit(today).cast("timestamp")) - F.unix_timestamp(F.coalesce("last_event_at", "created_at").cast("timestamp"))
    days = F.floor(seconds / 86_400)
    text = (
        F.when(seconds.isNull(), "未知").when(days <= 0, "今天").when(days < 30, F.concat(days, F.lit(" 天前")))
        .when(days < 365, F.concat(F.floor(days / 30), F.lit(" 个月前"))).otherwise(F.concat(F.format_string("%.1f", days / 365), F.lit(" 年前")))
    )
    return sessions.withColumn("age", text)
