"""Batches of captured sessions: what to read, one idempotent batch over all tables, rebuilds, notes, saves, hook events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.functions import fixed_values as fixed
from talkmill.operators import extract, lifecycle, store
from talkmill.operators.search import meta_text

ID = ["source", "source_session_id"]


def to_read(found: DataFrame, known: DataFrame, seen: DataFrame) -> DataFrame:
    """``found`` (with session_id, signature) but for known sessions whose signature is the one last seen."""
    settled = known.select("session_id").join(seen.select("session_id", "signature"), "session_id")
    return found.join(settled, ["session_id", "signature"], "left_anti").select(found.columns)


def batch_changes(tables: dict[str, DataFrame], found: DataFrame, arrivals: DataFrame, cursors: DataFrame, blocked: Column | None = None, mode: str = "full") -> dict[str, DataFrame]:
    """What one batch makes of sessions, vectors and cursors, and the messages that it adds (``added``); tables that stay as they are are left out.

    ``found`` are the sessions that the batch names, ``arrivals`` their messages. Forgotten sessions, and those that
    ``blocked`` marks, are left out; their cursors move on all the same. New sessions become active; known ones
    keep their title. A message counts once by its key. New messages bring a session of any state back to active:
    summary and pending time are cleared, an archived one is archived no more, and its vector goes. Mode
    ``meta`` counts messages without keeping them, ``off`` only moves cursors.
    """
    out = {"cursors": store.merge_cursors(tables["cursors"], cursors)}
    if mode == "off":
        return out
    live = store.without_forgotten(found, tables["tombstones"])
    live = live.filter(~blocked) if blocked is not None else live
    kept = [c for c in tables["sessions"].columns if c in live.columns]
    fresh = store.new_messages(arrivals.join(live.select("session_id"), "session_id", "left_semi").select(arrivals.columns), tables["messages"])
    sessions = store.upsert_sessions(tables["sessions"], live.select(kept))
    out["sessions"] = lifecycle.resume(sessions, fresh)
    out["vectors"] = lifecycle.without_stale_vectors(tables["vectors"], tables["sessions"], fresh)
    if mode == "full":
        out["added"] = fresh.select(tables["messages"].columns)
    return out


def ingest_batch(tables: dict[str, DataFrame], found: DataFrame, arrivals: DataFrame, cursors: DataFrame, blocked: Column | None = None, mode: str = "full") -> dict[str, DataFrame]:
    """All tables after ``batch_changes``; the same batch again changes nothing but bad line counts."""
    changes = batch_changes(tables, found, arrivals, cursors, blocked, mode)
    added = changes.pop("added", None)
    return {**tables, **changes, **({"messages": tables["messages"].unionByName(added)} if added is not None else {})}


def rebuild(stored: DataFrame, stored_messages: DataFrame, found: DataFrame, arrivals: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """(sessions, messages) made anew from the sources: imported sessions come over as they are, all others from ``found`` and ``arrivals``.

    A session's state follows from its last event: idle and cooled down by ``now`` is confirmed, idle is pending, else active.
    """
    theirs = stored.filter("origin = 'imported'")
    messages = store.new_messages(arrivals)
    counts = messages.groupBy("session_id").agg(F.count("*").alias("message_count"), F.max("created_at").alias("last_event_at"))
    at, last = F.lit(now).cast("timestamp"), F.col("last_event_at").cast("timestamp")
    idle = last + F.expr(f"interval {fixed.IDLE_MINUTES} minutes")
    state = F.when(idle + F.expr(f"interval {fixed.COOLDOWN_HOURS} hours") < at, "confirmed").when(idle < at, "pending_end").otherwise("active")
    own = found.join(theirs.select("session_id"), "session_id", "left_anti").drop("message_count", "last_event_at", "state").join(counts, "session_id", "left")
    own = own.withColumns({"message_count": F.coalesce("message_count", F.lit(0)), "state": F.coalesce(state, F.lit("active"))})
    kept_messages = stored_messages.join(theirs.select("session_id"), "session_id", "left_semi").select(messages.columns)
    mine = messages.join(own.select("session_id"), "session_id", "left_semi").select(messages.columns)
    return own.unionByName(theirs.select([c for c in theirs.columns if c in own.columns]), allowMissingColumns=True), mine.unionByName(kept_messages)


def notes(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sessions, messages) of notes (note_id, project_id, title, content, tags, at): one message each, confirmed at once and extracted.

    The note's own tags are searched with its title and topics, the decisions in it are not.
    """
    own = texts.withColumn("session_id", store.session_id(F.lit("note"), F.col("note_id")))
    said = own.select("session_id", F.lit(1).cast("long").alias("seq_num"), F.lit("user").alias("role"), "content", F.col("at").alias("created_at"))
    none = F.array().cast("array<string>")
    base = own.select(
        "session_id", F.lit("note").alias("source"), F.col("note_id").alias("source_session_id"), "project_id", F.lit("manual").alias("origin"), F.lit("confirmed").alias("state"),
        F.substring("title", 1, 120).alias("title"), F.col("at").alias("created_at"), F.col("at").alias("last_event_at"), F.col("at").alias("confirmed_at"),
        F.lit(1).cast("long").alias("message_count"), F.coalesce("tags", none).alias("user_tags"),
    )
    full = extract.apply(base, said)
    return full.withColumn("meta_text", meta_text(F.col("title"), F.col("topics"), tags=F.col("user_tags"))), said


def pick(found: DataFrame, ref: str | None = None, since: str | None = None, source: str | None = None) -> DataFrame:
    """Sessions to save by hand: the id starts with or holds ``ref``, changed since, of one source."""
    rows = found
    if ref:
        rows = rows.filter(F.col("source_session_id").startswith(ref) | F.col("source_session_id").contains(ref))
    if since:
        rows = rows.filter(F.col("last_event_at") >= since)
    return rows.filter(F.col("source") == source) if source else rows


def save(sessions: DataFrame, messages: DataFrame, picked: DataFrame, now: str, tags: list[str]) -> DataFrame:
    """``sessions`` with the picked ones confirmed by hand, extracted and tagged."""
    chosen = sessions.join(picked.select("session_id"), "session_id", "left_semi")
    own = chosen.withColumns({
        "state": F.lit("confirmed"), "origin": F.lit("manual"), "confirmed_at": F.lit(now), "pending_at": F.lit(None).cast("string"),
        "user_tags": F.array_union(F.coalesce("user_tags", F.array().cast("array<string>")), F.array(*map(F.lit, tags)).cast("array<string>")),
    })
    full = extract.apply(own, messages)
    return full.unionByName(sessions.join(picked.select("session_id"), "session_id", "left_anti"), allowMissingColumns=True)


def end_signals(sessions: DataFrame, events: DataFrame, now: str) -> DataFrame:
    """``sessions`` after hook events (JSON lines ``{event, sid}``): an active session whose source says that it ended is pending at once. Bad lines do nothing."""
    ended = events.filter(F.get_json_object("line", "$.event") == "session-end").select(F.get_json_object("line", "$.sid").alias("source_session_id"), F.lit(True).alias("_ended")).distinct()
    rows = sessions.join(ended, "source_session_id", "left")
    now_pending = F.coalesce("_ended", F.lit(False)) & (F.col("state") == "active")
    return rows.withColumns({"pending_at": F.when(now_pending, F.lit(now)).otherwise(F.col("pending_at")), "state": F.when(now_pending, "pending_end").otherwise(F.col("state"))}).drop("_ended")
