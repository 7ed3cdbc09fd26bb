"""The memory's tables under one manifest: a batch of the stream, a rebuild or a deletion changes all of them or none."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkmill.functions.text import title_of
from talkmill.operators import capture, extract, lifecycle, store
from talkmill.operators.commits import Change, Conflict, Tables

#: Tables, each with the column by which it is dealt to folders.
SCHEMAS = {
    "sessions": (
        "session_id",
        "session_id string, source string, source_session_id string, project_id string, origin string, state string, title string, created_at string, last_event_at string, "
        "pending_at string, confirmed_at string, message_count long, cleanup_at string, summary_rule string, meta_text string, user_tags array<string>, files_mentioned array<string>, "
        "topics array<string>, decisions array<struct<text:string,seq:long,at:string>>, key_questions array<struct<q:string,seq:long,at:string,unresolved:boolean>>, "
        "code_changes struct<code_blocks:long,key_exchanges:array<struct<user_text:string,ai_text:string,user_seq:long,reason:string>>>",
    ),
    "messages": ("session_id", "session_id string, seq_num long, role string, content string, created_at string"),
    "vectors": ("session_id", "session_id string, model string, dim int, vec array<float>, embedded_at string"),
    "cursors": ("source_file", "source_file string, position long, lines long, bad_lines long, suspect boolean"),
    "tombstones": ("source_session_id", "source string, source_session_id string, forgotten_at string"),
    "audit": ("session_id", "session_id string, source string, messages_deleted long, reason string, at string"),
}
#: How often a batch is tried again after another commit came first.
ATTEMPTS = 5


class StalePreview(RuntimeError):
    """What a preview showed is no longer so; nothing has been changed."""


@dataclass(frozen=True)
class Arrived:
    """A batch taken apart: sessions that it names, their messages, how far its files were read, and files that were written anew."""

    found: DataFrame
    messages: DataFrame
    cursors: DataFrame
    restarted: DataFrame | None = None


def open_memory(spark: SparkSession, path: str) -> Tables:
    """The tables below ``path``; empty ones where there are none yet."""
    tables = Tables(spark, path)
    if tables.latest()[0] < 0:
        try:
            tables.create({name: (by, T.StructType.fromDDL(ddl)) for name, (by, ddl) in SCHEMAS.items()})
        except Conflict:
            return tables  # another writer made them
    return tables


def arrived(rows: DataFrame) -> Arrived:
    """``rows``: (source, source_session_id, project_id, seq_num, role, content, created_at, source_file, position), one for each message."""
    rows = rows.withColumn("session_id", store.session_id(F.col("source"), F.col("source_session_id")))
    first = F.min(F.when(F.col("role") == "user", F.struct("seq_num", title_of(F.col("content")).alias("title"))))
    found = rows.groupBy("session_id", "source", "source_session_id").agg(
        F.min("project_id").alias("project_id"), F.lit("native").alias("origin"), first["title"].alias("title"), F.min("created_at").alias("created_at"), F.max("created_at").alias("last_event_at")
    )
    lines = F.max("line_no") if "line_no" in rows.columns else F.count("*")
    cursors = rows.groupBy("source_file").agg(F.max("position").alias("position"), lines.cast("long").alias("lines"), F.lit(0).cast("long").alias("bad_lines"), F.lit(False).alias("suspect"))
    return Arrived(found, rows.select("session_id", "seq_num", "role", "content", "created_at"), cursors)


def commit_batch(
    tables: Tables, batch: DataFrame, batch_id: int, writer: str, take_apart: Callable[[DataFrame, DataFrame], Arrived] = lambda rows, _: arrived(rows), blocked: Column | None = None, mode: str = "full"
) -> int:
    """Commits what ``capture.ingest_batch`` makes of a batch: sessions, messages, vectors and cursors at once; the version.

    The folders of the batch's sessions and files alone are read and written; messages are only added to. ``take_apart`` gets the
    batch and the cursors of the version it is committed to. A batch of ``writer`` that was committed
    before is not committed again, however often it is replayed. If another commit comes first it is tried anew on that.
    """
    batch = batch.persist()
    try:
        for attempt in range(ATTEMPTS):
            version, state = tables.latest()
            if state["batches"].get(writer, -1) >= batch_id:
                return version
            cursors = tables.read("cursors", state=state)
            took = take_apart(batch, cursors)
            sessions, files = tables.touched(took.found, "session_id"), tables.touched(took.cursors, "source_file")
            known = {n: tables.read(n, sessions, state) for n in ("sessions", "messages", "vectors")} | {"tombstones": tables.read("tombstones", tables.touched(took.found, "source_session_id"), state)}
            known["cursors"] = tables.read("cursors", files, state)
            if took.restarted is not None:
                known["cursors"] = known["cursors"].join(took.restarted.select("source_file"), "source_file", "left_anti")
            made = capture.batch_changes(known, took.found, took.messages, took.cursors, blocked, mode)
            changes = {n: Change(made[n], True, files if n == "cursors" else sessions) for n in ("sessions", "vectors", "cursors") if n in made}
            if "added" in made:
                changes["messages"] = Change(made["added"])
            try:
                return tables.change(changes, version, state, (writer, batch_id))
            except Conflict:
                if attempt + 1 == ATTEMPTS:
                    raise
        raise AssertionError("unreachable")
    finally:
        batch.unpersist()


def rebuild(tables: Tables, found: DataFrame, arrivals: DataFrame, now: str) -> int:
    """Swaps in sessions and messages made anew from the sources, and drops vectors of sessions that are gone; Conflict if anything was committed meanwhile."""
    version, state = tables.latest()
    sessions, messages = capture.rebuild(tables.read("sessions", state=state), tables.read("messages", state=state), found, arrivals, now)
    vectors = tables.read("vectors", state=state).join(sessions.select("session_id"), "session_id", "left_semi")
    whole = {"sessions": sessions, "messages": messages, "vectors": vectors}
    return tables.change({n: Change(_shaped(tables, state, n, rows), True) for n, rows in whole.items()}, version, state)


def _shaped(tables: Tables, state: dict, name: str, rows: DataFrame) -> DataFrame:
    """``rows`` with the table's columns, null where they are missing."""
    kinds = T.StructType.fromJson(state["tables"][name]["schema"])
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds])


def tick(tables: Tables, now: str) -> int | None:
    """Judges all sessions at ``now``; those that are confirmed by that are extracted in the same commit. None, and no commit, if no state changes."""
    version, state = tables.latest()
    sessions = tables.read("sessions", state=state)
    due = lifecycle.judge(sessions.withColumn("_before", F.col("state")), now).filter("state != _before").drop("_before")
    folders = tables.touched(due, "session_id")
    if not folders:
        return None
    known = lifecycle.judge(tables.read("sessions", folders, state), now)
    confirmed = due.filter("state = 'confirmed'")
    told = extract.apply(confirmed, tables.read("messages", folders, state))
    rest = known.join(confirmed.select("session_id"), "session_id", "left_anti")
    rows = _shaped(tables, state, "sessions", rest).unionByName(_shaped(tables, state, "sessions", told))
    return tables.change({"sessions": Change(rows, True, folders)}, version, state)


def preview(tables: Tables, doomed: Column) -> DataFrame:
    """(session_id, digest) of the sessions that ``forget`` would take out now."""
    return lifecycle.snapshot(tables.read("sessions").filter(doomed))


def forget(tables: Tables, previewed: DataFrame, now: str, reason: str) -> int:
    """Takes out the previewed sessions and all that belongs to them, and leaves tombstones and an audit; the version.

    StalePreview if one of them is gone or other than the preview saw it; Conflict if a commit comes in between. Either way nothing is changed.
    """
    version, state = tables.latest()
    sessions = tables.read("sessions", state=state)
    if stale := lifecycle.changed_since(previewed, sessions).take(1):
        raise StalePreview(f"session {stale[0].session_id} is {stale[0].change} since the preview")
    doomed = sessions.join(previewed.select("session_id"), "session_id", "left_semi")
    folders = tables.touched(previewed, "session_id")
    known = {n: tables.read(n, folders, state) for n in ("sessions", "messages", "vectors")}
    made = lifecycle.forget(known, doomed, now, reason)
    changes = {n: Change(made[n], True, folders) for n in ("sessions", "messages", "vectors")}
    changes |= {n: Change(_shaped(tables, state, n, made[n])) for n in ("tombstones", "audit")}
    return tables.change(changes, version, state)
