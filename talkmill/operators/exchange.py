"""Hand-off packages: redacted export, fingerprints, integrity, merging imports, quarantine, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkmill.functions.text import redact, redaction_counts
from talkmill.operators.listing import listed_decisions
from talkmill.operators.stats import envelope, top_files
from talkmill.operators.store import session_id


def fingerprints(messages: DataFrame) -> DataFrame:
    """(session_id, content_hash): SHA-256 of a session's ordered ``seq|role|content`` lines."""
    line = F.concat_ws("|", "seq_num", "role", "content")
    ordered = F.array_sort(F.collect_list(F.struct("seq_num", line.alias("line"))))
    body = messages.groupBy("session_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("body"))
    return body.select("session_id", F.concat(F.lit("sha256:"), F.sha2("body", 256)).alias("content_hash"))


def redaction_report(messages: DataFrame) -> DataFrame:
    """(session_id, seq_num, pattern, n): what redaction finds, one row per message and pattern."""
    counts = messages.select("session_id", "seq_num", redaction_counts(F.col("content")).alias("c"))
    names = ["aws_access_key", "private_key", "bearer_token", "secret_assign", "db_conn"]
    pairs = F.array(*[F.struct(F.lit(n.replace("_", "-")).alias("pattern"), F.col(f"c.{n}").alias("n")) for n in names])
    return counts.select("session_id", "seq_num", F.inline(pairs)).filter("n > 0")


def session_files(sessions: DataFrame, messages: DataFrame, redacted: bool = True, without_tags: list[str] | None = None) -> DataFrame:
    """(path, body): one JSON document per session, secrets taken out unless told otherwise."""
    rows = sessions.filter(~F.coalesce(F.arrays_overlap("user_tags", F.array(*map(F.lit, without_tags))), F.lit(False))) if without_tags else sessions
    content = redact(F.col("content")) if redacted else F.col("content")
    said = messages.groupBy("session_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("seq_num").alias("seq"), "role", content.alias("content"), "created_at"))).alias("messages")
    )
    columns = [c for c in ("source", "source_session_id", "project_id", "title", "created_at", "last_event_at", "topics", "decisions", "summary_rule", "author") if c in rows.columns]
    return rows.join(said, "session_id", "left").select(
        F.concat(F.lit("sessions/"), "session_id", F.lit(".json")).alias("path"), F.to_json(F.struct("session_id", *columns, "messages")).alias("body")
    )


def manifest(files: DataFrame) -> DataFrame:
    """(path, sha256, bytes) of a package's files."""
    return files.select("path", F.concat(F.lit("sha256:"), F.sha2("body", 256)).alias("sha256"), F.octet_length("body").cast("long").alias("bytes"))


def integrity(files: DataFrame, listed: DataFrame, strict: bool = False) -> DataFrame:
    """(path, fault): listed files that are missing or differ, paths that leave the package, with ``strict`` also unlisted files."""
    own = manifest(files).select("path", F.col("sha256").alias("own"))
    both = listed.select("path", "sha256").join(own, "path", "full_outer")
    leaves = F.col("path").rlike(r"(^|[\\/])\.\.([\\/]|$)|^[\\/]|^[A-Za-z]:")
    fault = F.when(leaves, "leaves the package").when(F.col("own").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted" if strict else None)
    return both.withColumn("fault", fault.when(F.col("own") != F.col("sha256"), "differs")).filter("fault is not null").select("path", "fault")


def merge_import(stored: DataFrame, incoming: DataFrame, suffix: str) -> DataFrame:
    """``incoming`` (source, source_session_id, content_hash, ...) with new_id and action.

    ``skip``: same identity and hash; ``twin``: same identity, other hash, kept beside it under a
    suffixed id; ``insert``: unknown.
    """
    known = stored.select("source", "source_session_id", F.col("content_hash").alias("_hash"), F.lit(True).alias("_known"))
    rows = incoming.join(known, ["source", "source_session_id"], "left")
    action = F.when(F.col("_known").isNull(), "insert").when(F.coalesce(F.col("_hash") == F.col("content_hash"), F.lit(False)), "skip").otherwise("twin")
    own = F.when(action == "twin", F.concat("source_session_id", F.lit(f"#imp-{suffix}"))).otherwise(F.col("source_session_id"))
    return rows.withColumns({"action": action, "new_id": session_id(F.col("source"), own)}).drop("_hash", "_known")


def quarantine(incoming: DataFrame, messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sessions to show now, bodies held back): metadata is visible, the package's message count stays."""
    counts = messages.groupBy("session_id").agg(F.count("*").alias("message_count"))
    return incoming.drop("message_count").join(counts, "session_id", "left").withColumn("bodies_present", F.lit(False)), messages


def release(held: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """(bodies to append, bodies still held) for the sessions whose id starts with ``prefix``."""
    free = F.col("session_id").startswith(prefix)
    return held.filter(free), held.filter(~free)


def handoff(sessions: DataFrame, decisions: int = 30, questions: int = 15, summary_only: bool = False) -> DataFrame:
    """(section, place, line): a Markdown hand-off: figures, decisions by date, the most mentioned files, open questions, summaries.

    ``sessions`` holds decisions and key_questions as the extractors give them. Each section but the summaries is a report
    of its first rows; summaries, the first four lines of every session's, have no order.
    """
    day = lambda c: F.substring(c, 6, 5)
    figures = envelope(sessions).select(
        F.lit("figures").alias("section"), F.lit(1).alias("place"),
        F.concat_ws(" ", F.lit("-"), "sessions", F.lit("sessions,"), "messages", F.lit("messages,"), F.substring("first", 1, 10), F.lit("to"), F.substring("last", 1, 10), F.concat(F.lit("("), "sources", F.lit(")"))).alias("line"),
    )

    def numbered(rows: DataFrame, section: str, line, order: list, n: int) -> DataFrame:
        first = rows.orderBy(*order).limit(n)
        return first.select(F.lit(section).alias("section"), F.row_number().over(Window.orderBy(*order)).alias("place"), line.alias("line"))

    text = F.substring(F.regexp_replace("text", r"\|", "/"), 1, 80)
    told = numbered(listed_decisions(sessions), "decisions", F.concat(F.lit("| "), day("at"), F.lit(" | "), text, F.lit(" | "), "source", F.lit(" |")), ["at", "session_id", "seq"], decisions)
    files = numbered(top_files(sessions), "files", F.concat(F.lit("- `"), "file", F.lit("`（讨论 "), "n", F.lit(" 次）")), [F.desc("n"), F.col("file")], 15)
    open_ = sessions.select("session_id", "source", "created_at", F.posexplode("key_questions").alias("i", "q")).filter("q.unresolved")
    asked = F.concat(F.lit("- [ ] "), "q.q", F.lit("（"), day(F.coalesce("q.at", "created_at")), F.lit("，"), "source", F.lit("）"))
    parts = [figures, told, files, numbered(open_, "questions", asked, ["created_at", "session_id", "i"], questions)]
    if not summary_only:
        head = F.concat(F.lit("### "), F.coalesce("title", "session_id"), F.lit("（"), day("created_at"), F.lit("，"), "source", F.lit("）"))
        body = F.coalesce(F.substring_index("summary_rule", "\n", 4), F.concat(F.lit("_"), F.col("message_count").cast("string"), F.lit(" 条消息（无规则摘要）_")))
        parts.append(sessions.select(F.lit("summaries").alias("section"), F.lit(0).alias("place"), F.concat(head, F.lit("\n"), body).alias("line")))
    return reduce(DataFrame.unionByName, [p.withColumn("place", F.col("place").cast("long")) for p in parts])


def flattened(sessions: DataFrame) -> DataFrame:
    """(session_id, at, text, seq): the decisions of an export, by the sessions' creation."""
    each = sessions.select("session_id", "created_at", F.explode("decisions").alias("d"))
    return each.select("session_id", F.coalesce("d.at", "created_at").alias("at"), "d.text", "d.seq").orderBy("at", "session_id", "seq")


def timeline(sessions: DataFrame) -> DataFrame:
    """(day, line): sessions by day with their state."""
    line = F.concat(F.lit("- "), F.substring("created_at", 12, 5), F.lit(" "), F.coalesce("title", F.lit("（无标题）")), F.lit(" ["), "state", F.lit("] "), F.col("message_count"))
    return sessions.select(F.substring("created_at", 1, 10).alias("day"), line.alias("line"))
