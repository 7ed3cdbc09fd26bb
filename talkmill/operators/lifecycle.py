"""A session's life: judge, transitions, resume, archive, forget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkmill.functions import fixed_values as fixed


def judge(sessions: DataFrame, now: str, idle_minutes: int = fixed.IDLE_MINUTES, cooldown_hours: int = fixed.COOLDOWN_HOURS) -> DataFrame:
    """``sessions`` after one tick at ``now``: active ones idle for longer become pending, pending ones cooled for longer confirmed.

    Limits are strict. A session moves one step in a tick; pending_at and confirmed_at say when.
    """
    at = F.lit(now).cast("timestamp")
    idle = (F.col("state") == "active") & (F.col("last_event_at").cast("timestamp") < at - F.expr(f"interval {idle_minutes} minutes"))
    cooled = (F.col("state") == "pending_end") & (F.col("pending_at").cast("timestamp") < at - F.expr(f"interval {cooldown_hours} hours"))
    idle, cooled = F.coalesce(idle, F.lit(False)), F.coalesce(cooled, F.lit(False))
    return sessions.withColumns(
        {
            "state": F.when(idle, "pending_end").when(cooled, "confirmed").otherwise(F.col("state")),
            "pending_at": F.when(idle, F.lit(now)).otherwise(F.col("pending_at")),
            "confirmed_at": F.when(cooled, F.lit(now)).otherwise(F.col("confirmed_at")),
        }
    )


def transitions(spark) -> DataFrame:
    return spark.createDataFrame(list(fixed.TRANSITIONS), "`from` string, `on` string, `to` string, effect string")


def transition(state: Column, event: Column) -> Column:
    """The state after ``event``; an illegal event leaves it as it is."""
    out = F.lit(None).cast("string")
    for a, on, b, _ in reversed(fixed.TRANSITIONS):
        out = F.when((state == a) & (event == on), F.lit(b)).otherwise(out)
    return F.coalesce(out, state)


def replay(events: DataFrame, initial: str = "active") -> DataFrame:
    """(session_id, state, events, illegal): each session's ordered events folded over the transition table.

    Only a session's own events are gathered, as (ts, event) pairs; the fold runs in Catalyst.
    """
    legal = lambda s, e: F.exists(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(on).alias("on")) for a, on, *_ in fixed.TRANSITIONS]), lambda t: (t["a"] == s) & (t["on"] == e))
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event")))
    start = F.struct(F.lit(initial).alias("state"), F.lit(0).cast("long").alias("illegal"))
    step = lambda acc, x: F.struct(
        transition(acc["state"], x["event"]).alias("state"), (acc["illegal"] + F.when(legal(acc["state"], x["event"]), 0).otherwise(1)).cast("long").alias("illegal")
    )
    folded = events.groupBy("session_id").agg(F.aggregate(ordered, start, step).alias("r"), F.count("*").alias("events"))
    return folded.select("session_id", "r.state", "events", "r.illegal")


def gap_sessions(events: DataFrame, key: str, ts: str, minutes: int = fixed.IDLE_MINUTES) -> DataFrame:
    """(key, start, end, n): runs of events with no gap of ``minutes`` or more."""
    return events.groupBy(key, F.session_window(ts, f"{minutes} minutes").alias("w")).agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n")).drop("w")


def resume(sessions: DataFrame, arrivals: DataFrame) -> DataFrame:
    """``sessions`` after new messages (session_id, created_at): any state goes back to active, summary and confirmation are cleared.

    Their vectors are those that ``without_stale_vectors`` leaves.
    """
    latest = arrivals.groupBy("session_id").agg(F.max("created_at").alias("_new"), F.count("*").alias("_k"))
    rows = sessions.join(latest, "session_id", "left")
    back = F.col("_new").isNotNull()
    clear = lambda c: F.when(~back | (F.col("state") == "active"), F.col(c))
    return rows.withColumns(
        {
            "summary_rule": clear("summary_rule"), "confirmed_at": clear("confirmed_at"), "pending_at": clear("pending_at"),
            "cleanup_at": F.when(~back, F.col("cleanup_at")), "last_event_at": F.greatest("last_event_at", "_new"),
            "message_count": F.coalesce("message_count", F.lit(0)) + F.coalesce("_k", F.lit(0)), "state": F.when(back, "active").otherwise(F.col("state")),
        }
    ).drop("_new", "_k")


def without_stale_vectors(vectors: DataFrame, sessions: DataFrame, arrivals: DataFrame) -> DataFrame:
    """``vectors`` without those of sessions that new messages bring back: their texts have grown."""
    back = sessions.filter("state != 'active'").join(arrivals.select("session_id"), "session_id", "left_semi").select("session_id")
    return vectors.join(back, "session_id", "left_anti").select(vectors.columns)


def purge_pending(tables: dict[str, DataFrame], project_id: str) -> dict[str, DataFrame]:
    """All tables without the pending sessions of a project and what belongs to them."""
    gone = tables["sessions"].filter((F.col("project_id") == project_id) & (F.col("state") == "pending_end")).select("session_id")
    return {n: t.join(gone, "session_id", "left_anti").select(t.columns) for n, t in tables.items() if "session_id" in t.columns}


def force_confirm(sessions: DataFrame, chosen: Column, now: str) -> DataFrame:
    """Chosen sessions confirmed whatever their state."""
    return sessions.withColumns({"confirmed_at": F.when(chosen, F.lit(now)).otherwise(F.col("confirmed_at")), "pending_at": F.when(~chosen, F.col("pending_at")), "state": F.when(chosen, "confirmed").otherwise(F.col("state"))})


def archive_totals(plan: DataFrame) -> DataFrame:
    """(candidates, archived, skipped, est_bytes) of a plan; bytes are those of what goes."""
    bytes_ = F.coalesce(F.sum(F.when(F.col("archived"), F.col("est_bytes"))), F.lit(0))
    return plan.agg(F.count("*").alias("candidates"), F.count(F.when(F.col("archived"), 1)).alias("archived"), F.count("skip_reason").alias("skipped"), bytes_.alias("est_bytes"))


def cleanup_log(plan: DataFrame, log_id: int, now: str, hard: bool = False) -> tuple[DataFrame, DataFrame]:
    """(log row, details): the audit of one archive run."""
    totals = archive_totals(plan)
    log = totals.select(F.lit(log_id).cast("long").alias("log_id"), F.lit(now).alias("at"), F.lit("hard" if hard else "soft").alias("mode"), F.col("archived").alias("sessions"), "est_bytes")
    return log, plan.filter("archived").select(F.lit(log_id).cast("long").alias("log_id"), "session_id", "est_bytes")


def cleanup_history(log: DataFrame, details: DataFrame | None = None, session_prefix: str | None = None, last: int | None = 20) -> DataFrame:
    """The latest archive runs, or those that touched a session whose id starts with ``session_prefix``; all of them if ``last`` is None."""
    if session_prefix is None:
        rows = log.orderBy(F.desc("log_id"))
        return rows if last is None else rows.limit(last)
    mine = details.filter(F.col("session_id").startswith(session_prefix)).select("log_id", "session_id", F.col("est_bytes").alias("session_bytes"))
    rows = log.join(mine, "log_id").orderBy(F.desc("log_id"), "session_id")
    return rows if last is None else rows.limit(last)


def snapshot(sessions: DataFrame) -> DataFrame:
    """(session_id, digest): what a preview saw of each session."""
    return sessions.select("session_id", F.sha2(F.concat_ws("|", "state", F.coalesce("last_event_at", F.lit("")), "message_count"), 256).alias("digest"))


def changed_since(preview: DataFrame, current: DataFrame) -> DataFrame:
    """(session_id, change): previewed sessions that are gone or other than the preview saw; with any, nothing may be executed."""
    now = snapshot(current).withColumnRenamed("digest", "_now")
    both = preview.join(now, "session_id", "left")
    change = F.when(F.col("_now").isNull(), "gone").when(F.col("_now") != F.col("digest"), "changed")
    return both.select("session_id", change.alias("change")).filter("change is not null")


def archive_plan(sessions: DataFrame, before: str, budget_bytes: int | None = None, source: str | None = None, include_protected: bool = False) -> DataFrame:
    """(session_id, skip_reason, est_bytes, archived) of the sessions last active before ``before`` and not archived yet.

    Active, imported and note sessions and those tagged as kept are skipped. Bytes are counted oldest
    first, and the one that passes the budget still goes, as the first always does. The running sum
    is taken by day first and then within a day, so that no task orders all candidates.
    """
    last = F.coalesce("last_event_at", "created_at")
    rows = sessions.filter(F.col("cleanup_at").isNull() & (last < before))
    if source:
        rows = rows.filter(F.col("source") == source)
    note = (F.col("origin") == "note") | (F.col("source") == "note")
    reason = F.when(F.col("state") == "active", "active").when(F.col("origin") == "imported", "imported").when(note, "note").when(F.array_contains("user_tags", fixed.PROTECTED_TAG), "tag")
    rows = rows.select(
        "session_id", last.alias("last"), (F.lit(None).cast("string") if include_protected else reason).alias("skip_reason"),
        (F.col("message_count") * fixed.ARCHIVE_BYTES_PER_MESSAGE).cast("long").alias("est_bytes"),
    )
    if budget_bytes is None:
        return rows.select("session_id", "skip_reason", "est_bytes", F.col("skip_reason").isNull().alias("archived"))
    rows = rows.withColumn("day", F.substring("last", 1, 10))
    counted = F.when(F.col("skip_reason").isNull(), F.col("est_bytes")).otherwise(0)
    days = rows.groupBy("day").agg(F.sum(counted).alias("day_bytes"))
    earlier = F.sum("day_bytes").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1))
    days = days.withColumn("_before_day", F.coalesce(earlier, F.lit(0))).drop("day_bytes")
    within = F.sum(counted).over(Window.partitionBy("day").orderBy("last", "session_id").rowsBetween(Window.unboundedPreceding, -1))
    before_it = F.col("_before_day") + F.coalesce(within, F.lit(0))
    placed = rows.join(days, "day").withColumn("_sum", before_it)
    archived = F.col("skip_reason").isNull() & ((F.col("_sum") == 0) | (F.col("_sum") < budget_bytes))
    return placed.select("session_id", "skip_reason", "est_bytes", archived.alias("archived"))


def archive(sessions: DataFrame, messages: DataFrame, vectors: DataFrame, plan: DataFrame, now: str, hard: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sessions, messages, vectors) after the plan: bodies and vectors go; a soft archive keeps the session's row."""
    gone = plan.filter("archived").select("session_id")
    messages, vectors = (t.join(gone, "session_id", "left_anti") for t in (messages, vectors))
    if hard:
        return sessions.join(gone, "session_id", "left_anti"), messages, vectors
    marked = sessions.join(gone.withColumn("_gone", F.lit(True)), "session_id", "left")
    is_gone = F.coalesce("_gone", F.lit(False))
    kept = marked.withColumns(
        {
            "cleanup_at": F.when(is_gone, F.lit(now)).otherwise(F.col("cleanup_at")),
            "original_message_count": F.when(is_gone, F.col("message_count")).otherwise(F.col("original_message_count")),
            "message_count": F.when(is_gone, F.lit(0).cast("long")).otherwise(F.col("message_count")),
        }
    )
    return kept.drop("_gone"), messages, vectors


def forget(tables: dict[str, DataFrame], doomed: DataFrame, now: str, reason: str) -> dict[str, DataFrame]:
    """All tables without the sessions of ``doomed`` (session_id, source, source_session_id), with tombstones and an audit.

    Children (messages, vectors, links on either end) go with their session; the audit keeps counts, no text.
    """
    ids = doomed.select("session_id")
    out = {n: t.join(ids, "session_id", "left_anti") for n, t in tables.items() if "session_id" in t.columns}
    if "links" in out:
        out["links"] = out["links"].join(ids.withColumnRenamed("session_id", "linked_session_id"), "linked_session_id", "left_anti").select(tables["links"].columns)
    counts = tables["messages"].join(ids, "session_id", "left_semi").groupBy("session_id").agg(F.count("*").alias("messages_deleted"))
    out["tombstones"] = doomed.select("source", "source_session_id", F.lit(now).alias("forgotten_at"))
    out["audit"] = doomed.join(counts, "session_id", "left").select(
        "session_id", "source", F.coalesce("messages_deleted", F.lit(0)).alias("messages_deleted"), F.lit(reason).alias("reason"), F.lit(now).alias("at")
    )
    return out


def forget_history(log: DataFrame, details: DataFrame) -> DataFrame:
    """(log_id, at, reason, details): each entry with its sessions."""
    nested = details.groupBy("log_id").agg(F.array_sort(F.collect_list(F.struct("session_id", "messages_deleted"))).alias("details"))
    return log.join(nested, "log_id", "left").orderBy(F.desc("log_id"))
