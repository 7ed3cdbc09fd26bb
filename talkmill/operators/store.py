"""Keyed tables as DataFrames: idempotent inserts, upserts, cursors, tombstones, links, tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MESSAGE_KEY = ["session_id", "seq_num"]


def session_id(source, source_session_id):
    """First 16 hex digits of the SHA-1 of ``source:id``."""
    return F.substring(F.sha1(F.concat_ws(":", source, source_session_id)), 1, 16)


def new_messages(arrivals: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """``arrivals`` once per (session_id, seq_num), without those already stored. Of a repeated key the smallest row counts."""
    rest = [c for c in arrivals.columns if c not in MESSAGE_KEY]
    once = arrivals.groupBy(*MESSAGE_KEY).agg(F.min(F.struct(*rest)).alias("r")).select(*MESSAGE_KEY, *[f"r.{c}" for c in rest]).select(arrivals.columns)
    return once if stored is None else once.join(stored.select(*MESSAGE_KEY), MESSAGE_KEY, "left_anti")


def upsert_sessions(stored: DataFrame, captured: DataFrame) -> DataFrame:
    """Full outer join on session_id: new rows become active; a known row keeps its title if it has one and takes the later event."""
    new = captured.select(*[F.col(c).alias(f"_{c}") for c in captured.columns])
    rows = stored.join(new, F.col("session_id") == F.col("_session_id"), "full_outer")
    values = {}
    for c in stored.columns:
        if f"_{c}" not in new.columns:
            values[c] = F.col(c)
        elif c == "last_event_at":
            values[c] = F.greatest(c, f"_{c}")
        elif c == "origin":
            values[c] = F.coalesce(f"_{c}", c)
        else:
            values[c] = F.coalesce(c, f"_{c}")
    if "state" in values:
        values["state"] = F.coalesce("state", F.lit("active"))
    return rows.select(*[v.alias(c) for c, v in values.items()])


def merge_cursors(stored: DataFrame, read: DataFrame) -> DataFrame:
    """(source_file, position, lines, bad_lines, suspect): the furthest position; bad lines add up; once suspect, always suspect."""
    both = stored.unionByName(read)
    return both.groupBy("source_file").agg(
        F.max("position").alias("position"), F.max("lines").alias("lines"), F.sum("bad_lines").alias("bad_lines"), F.max("suspect").alias("suspect")
    )


def without_forgotten(found: DataFrame, tombstones: DataFrame) -> DataFrame:
    return found.join(tombstones.select("source", "source_session_id").distinct(), ["source", "source_session_id"], "left_anti")


def changed(current: DataFrame, seen: DataFrame) -> DataFrame:
    """(session_id, signature) rows whose signature is new or other than the one seen."""
    return current.join(seen.select("session_id", "signature"), ["session_id", "signature"], "left_anti")


def change_signatures(messages: DataFrame, parts: DataFrame, row: str = "rowid") -> DataFrame:
    """(session_id, signature): highest row of messages and of parts, ``m/p``."""
    m = messages.groupBy("session_id").agg(F.max(row).alias("m"))
    p = parts.groupBy("session_id").agg(F.max(row).alias("p"))
    return m.join(p, "session_id", "full_outer").select("session_id", F.concat_ws("/", F.coalesce("m", F.lit(0)), F.coalesce("p", F.lit(0))).alias("signature"))


def linked(links: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session_id, other_id, kind, direction, title): links of every session in both directions, without loops."""
    edges = links.filter("session_id != linked_session_id").select("session_id", "linked_session_id", "kind").distinct()
    out = edges.select("session_id", F.col("linked_session_id").alias("other_id"), "kind", F.lit("out").alias("direction"))
    back = edges.select(F.col("linked_session_id").alias("session_id"), F.col("session_id").alias("other_id"), "kind", F.lit("in").alias("direction"))
    titles = sessions.select(F.col("session_id").alias("other_id"), "title")
    return out.unionByName(back).join(titles, "other_id").select("session_id", "other_id", "kind", "direction", "title")


def annotate(sessions: DataFrame, changes: DataFrame) -> DataFrame:
    """``sessions`` with tags added and removed and a summary set, by ``changes`` (session_id, add, remove, summary)."""
    none = F.array().cast("array<string>")
    rows = sessions.join(changes, "session_id", "left")
    tags = F.array_except(F.array_union(F.coalesce("user_tags", none), F.coalesce("add", none)), F.coalesce("remove", none))
    return rows.withColumns({"user_tags": tags, "user_summary": F.coalesce("summary", "user_summary")}).drop("add", "remove", "summary")


def append_log(log: DataFrame, entries: DataFrame, order: list[str]) -> DataFrame:
    """``log`` with ``entries`` after it, numbered on from its last log_id in ``order``."""
    last = log.agg(F.coalesce(F.max("log_id"), F.lit(0)).alias("_last"))
    # A batch of audit entries is small: one for a command, not for a session.
    numbered = entries.withColumn("log_id", F.row_number().over(Window.orderBy(*order)).cast("long")).join(F.broadcast(last), F.lit(True))
    return log.unionByName(numbered.withColumn("log_id", F.col("log_id") + F.col("_last")).select(log.columns))


def tail(log: DataFrame, key: str, n: int) -> DataFrame:
    """The last ``n`` rows of an append-only log."""
    return log.orderBy(F.desc(key)).limit(n)
