"""Queries of batches, lifecycle, notes and archives over the memory's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from talkmill.functions.scope import Scope, assemble, recent
from talkmill.operators import capture, exchange, extract, lifecycle, listing, memory_store, related, search, stats, store
from talkmill.plans import memory
from talkmill.plans.memory import MEMORY_SQL
from talkmill.plans.queries import MARKED_SQL, NOW, with_marks, with_metadata
from talkmill.plans.registry import query
from talkmill.sources.shared import shared_dir, written

LATE = "2024-02-01T00:00:0"

# --- one batch ---------------------------------------------------------------------------------


def _stored(spark, d):
    """Even sessions with their first two messages, a vector each, half of them archived; tombstones of every fifth of s1; a cursor a session."""
    s, m, n = memory.sessions(spark, d), memory.messages(spark, d), F.col("conv_id")
    even = s.filter(n % 2 == 0).withColumns({"message_count": F.least("message_count", F.lit(2)).cast("long"), "cleanup_at": F.when(n % 4 == 0, NOW), "summary_rule": F.lit("old")})
    cursors = even.select(F.col("session_id").alias("source_file"), F.lit(2).cast("long").alias("position"), F.lit(2).cast("long").alias("lines"), F.lit(1).cast("long").alias("bad_lines"), F.lit(False).alias("suspect"))
    return {
        "sessions": even, "messages": m.filter((n % 2 == 0) & (F.col("seq_num") <= 2)).drop("conv_id"), "tombstones": s.filter((F.col("source") == "s1") & (n % 5 == 0)),
        "vectors": even.select("session_id", F.lit("m").alias("model")), "cursors": cursors,
    }


def _batch(spark, d, mode="full"):
    """All sessions but every third, each message twice; every seventh is ignored."""
    s, m, n = memory.sessions(spark, d), memory.messages(spark, d), F.col("conv_id")
    found = s.filter(n % 3 != 0).select("session_id", "source", "source_session_id", "project_id", F.lit("found").alias("title"), "created_at", "last_event_at", "conv_id")
    arrivals = m.filter(n % 3 != 0).drop("conv_id")
    cursors = m.filter(n % 3 != 0).groupBy(F.col("session_id").alias("source_file")).agg(F.max("seq_num").alias("position"), F.count("*").alias("lines"), F.lit(2).cast("long").alias("bad_lines"), F.lit(True).alias("suspect"))
    return capture.ingest_batch(_stored(spark, d), found, arrivals.unionByName(arrivals), cursors, F.col("conv_id") % 7 == 0, mode)


BATCH_SQL = MEMORY_SQL + """, live AS (SELECT * FROM sessions WHERE conv_id % 3 != 0 AND conv_id % 7 != 0 AND NOT (source = 's1' AND conv_id % 5 = 0)),
fresh AS (SELECT m.* FROM messages m JOIN live USING (session_id) WHERE m.conv_id % 2 = 1 OR seq_num > 2), k AS (SELECT session_id, count(*) AS k FROM fresh GROUP BY 1)"""


@query("ingest_sessions", BATCH_SQL + """ SELECT s.session_id, CASE WHEN s.conv_id % 2 = 0 THEN s.title ELSE 'found' END AS title, CASE WHEN k IS NOT NULL OR s.conv_id % 2 = 1 THEN 'active' ELSE state END AS state,
 CASE WHEN s.conv_id % 2 = 0 THEN least(message_count, 2) ELSE 0 END + coalesce(k, 0) AS message_count, s.conv_id % 4 = 0 AND k IS NULL AS archived, s.conv_id % 2 = 0 AND (k IS NULL OR state = 'active') AS summed
FROM sessions s LEFT JOIN k USING (session_id) WHERE s.conv_id % 2 = 0 OR session_id IN (SELECT session_id FROM live)""")
def ingest_sessions(spark, d):
    s = _batch(spark, d)["sessions"]
    return s.select("session_id", "title", "state", "message_count", F.col("cleanup_at").isNotNull().alias("archived"), F.col("summary_rule").isNotNull().alias("summed"))


@query("ingest_messages", BATCH_SQL + " SELECT session_id, seq_num, role, content FROM fresh UNION ALL SELECT session_id, seq_num, role, content FROM messages WHERE conv_id % 2 = 0 AND seq_num <= 2")
def ingest_messages(spark, d):
    return _batch(spark, d)["messages"].select("session_id", "seq_num", "role", "content")


@query("ingest_vectors", BATCH_SQL + " SELECT session_id FROM sessions LEFT JOIN k USING (session_id) WHERE conv_id % 2 = 0 AND (k IS NULL OR state = 'active')")
def ingest_vectors(spark, d):
    return _batch(spark, d)["vectors"].select("session_id")


@query("ingest_cursors", MEMORY_SQL + """, c AS (SELECT session_id AS source_file, 2 AS position, 2 AS lines, 1 AS bad, false AS suspect FROM sessions WHERE conv_id % 2 = 0
 UNION ALL SELECT session_id, max(seq_num), count(*), 2, true FROM messages WHERE conv_id % 3 != 0 GROUP BY session_id)
SELECT source_file, max(position) AS position, max(lines) AS lines, sum(bad)::BIGINT AS bad_lines, bool_or(suspect) AS suspect FROM c GROUP BY source_file""")
def ingest_cursors(spark, d):
    return _batch(spark, d)["cursors"]


@query("ingest_meta_mode", BATCH_SQL + " SELECT 'messages' AS kind, (SELECT count(*) FROM messages WHERE conv_id % 2 = 0 AND seq_num <= 2) AS n UNION ALL SELECT 'counted', sum(n)::BIGINT FROM (SELECT count(*) AS n FROM fresh UNION ALL SELECT count(*) FROM messages WHERE conv_id % 2 = 0 AND seq_num <= 2)")
def ingest_meta_mode(spark, d):
    out = _batch(spark, d, "meta")
    return out["messages"].agg(F.lit("messages").alias("kind"), F.count("*").alias("n")).unionByName(out["sessions"].agg(F.lit("counted").alias("kind"), F.sum("message_count").alias("n")))


@query("ingest_again", BATCH_SQL + " SELECT count(*) AS n FROM (SELECT session_id FROM fresh UNION ALL SELECT session_id FROM messages WHERE conv_id % 2 = 0 AND seq_num <= 2)")
def ingest_again(spark, d):
    """The same batch once more adds no message."""
    once = _batch(spark, d)
    m, n = memory.messages(spark, d), F.col("conv_id")
    s = memory.sessions(spark, d).filter((n % 3 != 0) & (n % 7 != 0))
    found = s.select("session_id", "source", "source_session_id", "project_id", "title", "created_at", "last_event_at")
    return capture.ingest_batch(once, found, m.filter(n % 3 != 0).drop("conv_id"), once["cursors"])["messages"].agg(F.count("*").alias("n"))


@query("sessions_to_read", MEMORY_SQL + " SELECT session_id FROM sessions WHERE NOT (conv_id % 2 = 0 AND conv_id % 3 = 0)")
def sessions_to_read(spark, d):
    s, n = memory.sessions(spark, d), F.col("conv_id")
    found = s.select("session_id", F.lit("1/1").alias("signature"))
    seen = s.select("session_id", F.when(n % 3 == 0, "1/1").otherwise("0/9").alias("signature"))
    return capture.to_read(found, s.filter(n % 2 == 0), seen).select("session_id")


@query("changed_signatures", MEMORY_SQL + " SELECT session_id FROM sessions WHERE conv_id % 4 != 0")
def changed_signatures(spark, d):
    s, n = memory.sessions(spark, d), F.col("conv_id")
    seen = s.filter(n % 4 < 2).select("session_id", F.when(n % 4 == 0, "a").otherwise("b").alias("signature"))
    return store.changed(s.select("session_id", F.lit("a").alias("signature")), seen).select("session_id")


@query("rebuilt_sessions", MEMORY_SQL + """, r AS (SELECT s.*, CASE WHEN last_event_at::TIMESTAMP < TIMESTAMP '2024-01-20 05:50:00' THEN 'confirmed' WHEN last_event_at::TIMESTAMP < TIMESTAMP '2024-01-20 11:50:00' THEN 'pending_end' ELSE 'active' END AS st FROM sessions s)
SELECT session_id, CASE WHEN origin = 'imported' THEN state ELSE st END AS state, message_count, origin FROM r""")
def rebuilt_sessions(spark, d):
    s, m = memory.sessions(spark, d), memory.messages(spark, d)
    sessions, _ = capture.rebuild(s, m, s.drop("message_count", "last_event_at", "state"), m.unionByName(m), NOW)
    return sessions.select("session_id", "state", "message_count", "origin")


@query("rebuilt_messages", MEMORY_SQL + " SELECT session_id, seq_num, content FROM messages")
def rebuilt_messages(spark, d):
    s, m = memory.sessions(spark, d), memory.messages(spark, d)
    _, messages = capture.rebuild(s, m, s, m.filter("conv_id % 10 != 7").unionByName(m), NOW)
    return messages.select("session_id", "seq_num", "content")


@query("end_signals", MEMORY_SQL + " SELECT session_id, CASE WHEN state = 'active' AND conv_id % 3 = 0 THEN 'pending_end' ELSE state END AS state, CASE WHEN state = 'active' AND conv_id % 3 = 0 THEN '2024-01-20T12:00:00' ELSE pending_at END AS pending_at FROM sessions")
def end_signals(spark, d):
    s, n = memory.sessions(spark, d), F.col("conv_id")
    event = F.to_json(F.struct(F.when(n % 3 == 0, "session-end").otherwise("session-start").alias("event"), F.col("source_session_id").alias("sid")))
    events = s.select(F.when(n % 3 == 1, F.lit("{bad")).otherwise(event).alias("line"))
    return capture.end_signals(s, events.unionByName(events), NOW).select("session_id", "state", "pending_at")


@query("purged_pending", MEMORY_SQL + " SELECT session_id, count(*) AS n FROM messages WHERE session_id NOT IN (SELECT session_id FROM sessions WHERE project_id = 'p1' AND state = 'pending_end') GROUP BY 1")
def purged_pending(spark, d):
    left = lifecycle.purge_pending({"sessions": memory.sessions(spark, d), "messages": memory.messages(spark, d)}, "p1")
    return left["messages"].join(left["sessions"].select("session_id"), "session_id").groupBy("session_id").agg(F.count("*").alias("n"))


@query("forced_confirm", MEMORY_SQL + " SELECT session_id, CASE WHEN source = 's2' THEN 'confirmed' ELSE state END AS state, CASE WHEN source != 's2' THEN pending_at END AS pending_at FROM sessions")
def forced_confirm(spark, d):
    return lifecycle.force_confirm(memory.sessions(spark, d), F.col("source") == "s2", NOW).select("session_id", "state", "pending_at")


@query("resumed_vectors", MEMORY_SQL + " SELECT session_id FROM sessions WHERE NOT (conv_id % 4 = 0 AND state != 'active')")
def resumed_vectors(spark, d):
    s, m = memory.sessions(spark, d), memory.messages(spark, d)
    return lifecycle.without_stale_vectors(s.select("session_id"), s, m.filter("conv_id % 4 = 0"))


# --- archives, forgetting, logs ----------------------------------------------------------------

GONE_SQL = MEMORY_SQL + ", g AS (SELECT session_id FROM sessions WHERE last_event_at < '2024-01-10' AND state != 'active' AND origin != 'imported' AND NOT list_contains(user_tags, '保留'))"


@query("archived_children", GONE_SQL + " SELECT 'messages' AS kind, count(*) AS n FROM messages WHERE session_id NOT IN (FROM g) UNION ALL SELECT 'vectors', count(*) FROM embeddings WHERE vec_id::VARCHAR NOT IN (FROM g) UNION ALL SELECT 'sessions', count(*) FROM sessions UNION ALL SELECT 'left by hard', count(*) FROM sessions WHERE session_id NOT IN (FROM g)")
def archived_children(spark, d):
    s, m, v = memory.sessions(spark, d), memory.messages(spark, d), memory.vectors(spark, d)
    plan = lifecycle.archive_plan(s, "2024-01-10")
    soft, hard = lifecycle.archive(s, m, v, plan, NOW), lifecycle.archive(s, m, v, plan, NOW, hard=True)
    parts = {"sessions": soft[0], "messages": soft[1], "vectors": soft[2], "left by hard": hard[0]}
    rows = [t.agg(F.lit(k).alias("kind"), F.count("*").alias("n")) for k, t in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query("archive_totals", MEMORY_SQL + """, c AS (SELECT message_count * 5120 AS b, state = 'active' OR origin = 'imported' OR list_contains(user_tags, '保留') AS skip FROM sessions WHERE last_event_at < '2024-01-25')
SELECT count(*) AS candidates, count(*) FILTER (NOT skip) AS archived, count(*) FILTER (skip) AS skipped, coalesce(sum(b) FILTER (NOT skip), 0)::BIGINT AS est_bytes FROM c""")
def archive_totals(spark, d):
    return lifecycle.archive_totals(lifecycle.archive_plan(memory.sessions(spark, d), "2024-01-25"))


def _logs(spark, d):
    s = memory.sessions(spark, d)
    runs = [lifecycle.cleanup_log(lifecycle.archive_plan(s, before), i, NOW) for i, before in enumerate(("2024-01-08", "2024-01-15", "2024-01-25"), 1)]
    logs, details = [r[0] for r in runs], [r[1] for r in runs]
    return logs[0].unionByName(logs[1]).unionByName(logs[2]), details[0].unionByName(details[1]).unionByName(details[2])


LOGS_SQL = MEMORY_SQL + """, b AS (SELECT * FROM (VALUES (1, '2024-01-08'), (2, '2024-01-15'), (3, '2024-01-25')) v(log_id, before)),
det AS (SELECT log_id::BIGINT AS log_id, session_id, message_count * 5120 AS est_bytes FROM sessions, b WHERE last_event_at < before AND NOT (state = 'active' OR origin = 'imported' OR list_contains(user_tags, '保留'))),
logs AS (SELECT log_id::BIGINT AS log_id, '2024-01-20T12:00:00' AS "at", 'soft' AS mode, (SELECT count(*) FROM det WHERE det.log_id = b.log_id) AS sessions, (SELECT coalesce(sum(est_bytes), 0)::BIGINT FROM det WHERE det.log_id = b.log_id) AS est_bytes FROM b)"""


@query("cleanup_history", LOGS_SQL + " SELECT * FROM logs ORDER BY log_id DESC LIMIT 2")
def cleanup_history(spark, d):
    return lifecycle.cleanup_history(_logs(spark, d)[0], last=2)


@query("cleanup_of_session", LOGS_SQL + " SELECT logs.*, session_id, det.est_bytes AS session_bytes FROM logs JOIN det USING (log_id) WHERE starts_with(session_id, '1')")
def cleanup_of_session(spark, d):
    return lifecycle.cleanup_history(*_logs(spark, d), session_prefix="1", last=None)


@query("snapshot_check", MEMORY_SQL + " SELECT session_id, CASE WHEN conv_id % 5 = 2 THEN 'gone' ELSE 'changed' END AS change FROM sessions WHERE conv_id % 2 = 0 AND (conv_id % 5 = 2 OR conv_id % 3 = 0)")
def snapshot_check(spark, d):
    s, n = memory.sessions(spark, d), F.col("conv_id")
    later = s.filter(n % 5 != 2).withColumn("message_count", F.col("message_count") + F.when(n % 3 == 0, 1).otherwise(0))
    return lifecycle.changed_since(lifecycle.snapshot(s.filter(n % 2 == 0)), later)


@query("forget_history", MEMORY_SQL + ", f AS (SELECT session_id, project_id, message_count AS n FROM sessions WHERE source = 's2') SELECT substr(project_id, 2)::BIGINT AS log_id, string_agg(session_id || ':' || n, ',' ORDER BY session_id) AS details FROM f GROUP BY 1 UNION ALL SELECT 9, NULL")
def forget_history(spark, d):
    f = memory.sessions(spark, d).filter("source = 's2'").select(F.substring("project_id", 2, 9).cast("long").alias("log_id"), "session_id", F.col("message_count").alias("messages_deleted"))
    log = f.select("log_id").distinct().unionByName(spark.range(9, 10).select(F.col("id").alias("log_id")))
    told = F.array_join(F.transform("details", lambda x: F.concat_ws(":", x["session_id"], x["messages_deleted"])), ",")
    return lifecycle.forget_history(log, f).select("log_id", told.alias("details"))


@query("appended_log", MEMORY_SQL + " SELECT conv_id AS log_id, session_id AS entry FROM sessions WHERE conv_id < 10 UNION ALL SELECT 9 + row_number() OVER (ORDER BY session_id), session_id FROM sessions WHERE conv_id BETWEEN 50 AND 60")
def appended_log(spark, d):
    s = memory.sessions(spark, d)
    log = s.filter("conv_id < 10").select(F.col("conv_id").cast("long").alias("log_id"), F.col("session_id").alias("entry"))
    return store.append_log(log, s.filter("conv_id between 50 and 60").select(F.col("session_id").alias("entry")), ["entry"])


# --- notes, saves, lists -----------------------------------------------------------------------

NOTE_SQL = MEMORY_SQL + """, n AS (SELECT conv_id, 'n' || conv_id AS note_id, project_id, coalesce(title, '') AS title, created_at FROM sessions WHERE conv_id % 3 = 0)"""


def _notes(spark, d):
    s = memory.sessions(spark, d).filter("conv_id % 3 = 0")
    content = F.concat(F.lit("决定采用方案"), F.col("conv_id").cast("string"), F.lit("号存储引擎。"))
    return s.select(F.concat(F.lit("n"), "conv_id").alias("note_id"), "project_id", F.coalesce("title", F.lit("")).alias("title"), content.alias("content"), F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("pin"))).alias("tags"), F.col("created_at").alias("at"))


@query("note_sessions", NOTE_SQL + """ SELECT substr(sha1('note:' || note_id), 1, 16) AS session_id, title, 'manual' AS origin, 'confirmed' AS state, '决定采用方案' || conv_id || '号存储引擎' AS decision,
 array_to_string(list_concat(regexp_extract_all(lower(title), '[a-z0-9_][a-z0-9_./\\-]*'), ['决', '定', '定', '采']), ' ') AS head, conv_id % 2 = 0 AS pinned FROM n""")
def note_sessions(spark, d):
    s, _ = capture.notes(_notes(spark, d))
    title_terms = F.size(F.regexp_extract_all(F.lower("title"), F.lit(r"[a-z0-9_][a-z0-9_./\-]*"), F.lit(0)))
    head = F.array_join(F.slice(F.split("meta_text", " "), F.lit(1), title_terms + 4), " ")
    return s.select("session_id", "title", "origin", "state", F.col("decisions")[0]["text"].alias("decision"), head.alias("head"), F.col("meta_text").endswith("pin").alias("pinned"))


@query("note_messages", NOTE_SQL + " SELECT substr(sha1('note:' || note_id), 1, 16) AS session_id, 1::BIGINT AS seq_num, '决定采用方案' || conv_id || '号存储引擎。' AS content, created_at FROM n")
def note_messages(spark, d):
    return capture.notes(_notes(spark, d))[1].select("session_id", "seq_num", "content", "created_at")


@query("saved_by_hand", MEMORY_SQL + ", p AS (SELECT session_id FROM sessions WHERE contains(source_session_id, '1') AND last_event_at >= '2024-01-10' AND source = 's1') SELECT session_id, CASE WHEN session_id IN (FROM p) THEN 'confirmed' ELSE state END AS state, CASE WHEN session_id IN (FROM p) THEN 'manual' ELSE origin END AS origin, CASE WHEN session_id IN (FROM p) THEN list_contains(user_tags, 'sensitive') ELSE list_contains(user_tags, 'sensitive') END AS sensitive, session_id IN (FROM p) AS tagged FROM sessions")
def saved_by_hand(spark, d):
    s = memory.sessions(spark, d)
    out = capture.save(s, memory.messages(spark, d), capture.pick(s, "1", "2024-01-10", "s1"), NOW, ["kept"])
    return out.select("session_id", "state", "origin", F.array_contains("user_tags", "sensitive").alias("sensitive"), F.array_contains("user_tags", "kept").alias("tagged"))


@query("save_picker", MEMORY_SQL + " SELECT session_id FROM sessions WHERE contains(source_session_id, '3') AND last_event_at >= '2024-01-05'")
def save_picker(spark, d):
    return capture.pick(memory.sessions(spark, d), "3", "2024-01-05").select("session_id")


@query("day_sessions", MEMORY_SQL + " SELECT session_id FROM sessions WHERE left(last_event_at, 10) = '2024-01-07'")
def day_sessions(spark, d):
    return listing.on_day(memory.sessions(spark, d), "2024-01-07").select("session_id")


@query("notes_apart", MEMORY_SQL + " SELECT conv_id % 9 = 0 AS is_note, count(*) AS n FROM sessions GROUP BY 1")
def notes_apart(spark, d):
    s = memory.sessions(spark, d).withColumn("source", F.when(F.col("conv_id") % 9 == 0, "note").otherwise(F.col("source")))
    return listing.by_kind(s).groupBy("is_note").agg(F.count("*").alias("n"))


@query("latest_decisions", MEMORY_SQL + " SELECT created_at AS \"at\", session_id, 'use ' || conv_id % 6 AS text FROM sessions WHERE conv_id % 3 != 0 AND origin != 'workflow' ORDER BY 1 DESC, 2 DESC LIMIT 10")
def latest_decisions(spark, d):
    return listing.latest_decisions(with_metadata(spark, d)).select("at", "session_id", "text")


@query("unresolved_since", f"""{MEMORY_SQL}, q AS (SELECT 'why  ' || conv_id % 50 AS q, created_at AS "at", session_id FROM sessions WHERE conv_id % 2 = 0 AND origin != 'workflow'
  QUALIFY row_number() OVER (PARTITION BY conv_id % 50 ORDER BY created_at DESC, session_id) = 1) SELECT * FROM q WHERE "at" >= '2024-01-10' ORDER BY "at" DESC, session_id LIMIT 20""")
def unresolved_since(spark, d):
    return listing.listed_unresolved(with_metadata(spark, d), since="2024-01-10").select("q", "at", "session_id")


@query("full_projection", MEMORY_SQL + " SELECT session_id, CASE WHEN conv_id % 4 < 2 THEN 0 ELSE len(topics) END AS n_topics, CASE conv_id % 4 WHEN 2 THEN 'use x' END AS decision, CASE WHEN conv_id % 2 = 0 THEN message_count ELSE 0 END AS message_count FROM sessions")
def full_projection(spark, d):
    """Lists as JSON text, of which some are null and some broken."""
    n = F.col("conv_id")
    s = memory.sessions(spark, d).select(
        "session_id", F.when(n % 4 == 0, F.lit(None).cast("string")).when(n % 4 == 1, '["a').otherwise(F.to_json("topics")).alias("topics"),
        F.when(n % 4 == 2, '[{"text":"use x","seq":3}]').when(n % 4 == 3, "nothing").alias("decisions"), F.when(n % 2 == 0, F.col("message_count")).alias("message_count"),
    )
    return listing.decoded(s).select("session_id", F.size("topics").alias("n_topics"), F.get(F.transform("decisions", lambda x: x["text"]), F.lit(0)).alias("decision"), "message_count")


@query("resolve_prefix", f"{MEMORY_SQL}, f AS (SELECT session_id FROM sessions WHERE starts_with(session_id, '1') AND session_id != '1') SELECT session_id, 'prefix' AS how, count(*) OVER () AS matches FROM f ORDER BY session_id LIMIT 10")
def resolve_prefix(spark, d):
    """The exact id is not there, so a prefix of many is ambiguous."""
    return listing.resolve(memory.sessions(spark, d).filter("session_id != '1'"), "1")


@query("resolve_exact", f"{MEMORY_SQL} SELECT session_id, 'id' AS how, 1::BIGINT AS matches FROM sessions WHERE session_id = '1'")
def resolve_exact(spark, d):
    return listing.resolve(memory.sessions(spark, d), "1")


@query("scope_recent", MEMORY_SQL + " SELECT session_id FROM sessions WHERE created_at >= '2024-01-11T12:00:00' AND list_has_any(topics, ['t1', 't2', 't3'])")
def scope_recent(spark, d):
    return memory.sessions(spark, d).filter(assemble(Scope(topics=("t1", "t2", "t3")), None, recent("2024-02-10T12:00:00Z"))).select("session_id")


# --- search results, figures -------------------------------------------------------------------


@query("hits_with_briefs", MEMORY_SQL + " SELECT conv_id::VARCHAR AS session_id, round(conv_id / 7, 3) AS score, s.title, s.source, s.state FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 4 = 1) LEFT JOIN (SELECT * FROM sessions WHERE conv_id % 8 != 1) s USING (conv_id)")
def hits_with_briefs(spark, d):
    s = memory.sessions(spark, d)
    hits = s.filter("conv_id % 4 = 1").select("session_id", (F.col("conv_id") / 7).alias("score"))
    return search.with_briefs(hits, s.filter("conv_id % 8 != 1")).select("session_id", "score", "title", "source", "state")


@query("scope_hint", MEMORY_SQL + ", n AS (SELECT count(*) AS k FROM sessions WHERE source = 's1') SELECT h::BIGINT AS hits, k AS matching, h < 3 AND k > h AS more FROM n, (VALUES (0), (2), (3)) v(h)")
def scope_hint(spark, d):
    s = memory.sessions(spark, d)
    rows = [search.hint(s, Scope(sources=("s1",)).column(), h) for h in (0, 2, 3)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("file_history", MARKED_SQL + " SELECT DISTINCT session_id FROM marked WHERE contains(content, 'src/mod3/file1.ts')")
def file_history(spark, d):
    s = memory.sessions(spark, d).withColumn("meta_text", F.lit(""))
    return search.body_and_meta_hits(with_marks(memory.messages(spark, d)), s, search.file_query("src\\mod3\\file1.ts"))[0].select("session_id")


@query("semantic_append", MEMORY_SQL + ", b AS (SELECT DISTINCT session_id FROM messages WHERE regexp_matches(lower(content), '(^|[^a-z0-9])thing([^a-z0-9]|$)')) SELECT session_id, CASE WHEN session_id IN (FROM b) THEN 'body' ELSE 'semantic' END AS via FROM sessions WHERE session_id IN (FROM b) OR conv_id % 3 = 0")
def semantic_append(spark, d):
    s = memory.sessions(spark, d).withColumn("meta_text", F.lit(""))
    found = s.filter("conv_id % 3 = 0").select("session_id", (F.lit(1.0) / (F.col("conv_id") + 1)).alias("score"))
    return search.with_semantic(search.body_and_meta_hits(memory.messages(spark, d), s, "thing")[0], found, s).select("session_id", "via")


@query("side_by_side", MEMORY_SQL + " SELECT session_id, CASE WHEN conv_id % 2 = 0 THEN conv_id::INT END AS text_position, CASE WHEN conv_id % 3 = 0 THEN conv_id::INT + 1 END AS fused_position FROM sessions WHERE conv_id % 2 = 0 OR conv_id % 3 = 0")
def side_by_side(spark, d):
    s, n = memory.sessions(spark, d), F.col("conv_id")
    return related.side_by_side(s.filter(n % 2 == 0).select("session_id", n.cast("int").alias("position")), s.filter(n % 3 == 0).select("session_id", (n + 1).cast("int").alias("position")))


@query("export_envelope", MEMORY_SQL + " SELECT array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, min(created_at) AS first, max(last_event_at) AS last, count(*) AS sessions, sum(message_count)::BIGINT AS messages FROM sessions")
def export_envelope(spark, d):
    return stats.envelope(memory.sessions(spark, d))


@query("transfer_packages", MEMORY_SQL + " SELECT count(DISTINCT conv_id % 7) AS packages FROM sessions WHERE conv_id % 2 = 0")
def transfer_packages(spark, d):
    n = F.col("conv_id")
    return stats.packages(memory.sessions(spark, d).select(F.when(n % 2 == 0, "import").otherwise("export").alias("type"), (n % 7).cast("string").alias("file_path")))


@query("growth_of_project", f"""{MEMORY_SQL}, m AS (SELECT left(m.created_at, 10) AS day, count(*) AS msgs FROM messages m JOIN sessions s USING (session_id) WHERE project_id = 'p1' GROUP BY 1), s AS (SELECT left(last_event_at, 10) AS day, count(*) AS sess FROM sessions WHERE project_id = 'p1' GROUP BY 1)
SELECT coalesce(m.day, s.day) AS day, coalesce(msgs, 0) AS msgs, coalesce(sess, 0) AS sess FROM m FULL JOIN s ON m.day = s.day WHERE coalesce(m.day, s.day) >= '2024-01-10'""")
def growth_of_project(spark, d):
    return stats.growth(memory.messages(spark, d), memory.sessions(spark, d), "2024-01-10", "p1")


# --- vectors -----------------------------------------------------------------------------------


@query("vector_scoped", """WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 7), s AS (SELECT vec_id, list_dot_product(embedding::DOUBLE[], q::DOUBLE[]) AS score FROM embeddings, q WHERE vec_id % 3 = 1)
SELECT vec_id::VARCHAR AS session_id, round(score, 4) AS score FROM s WHERE score >= 0.05 ORDER BY s.score DESC, session_id LIMIT 5""")
def vector_scoped(spark, d):
    """Only some sessions are allowed, and some vectors have another length."""
    v, n = memory.vectors(spark, d), F.col("session_id").cast("long")
    q = v.filter("session_id = '7'").first().vec
    odd = v.filter(n % 10 == 1).withColumns({"session_id": F.concat("session_id", F.lit("x")), "vec": F.slice("vec", 1, 3)})
    allowed = v.filter(n % 3 == 1).select("session_id").unionByName(odd.select("session_id"))
    return related.vector_search(v.unionByName(odd), q, allowed, 0.05).withColumn("score", F.round("score", 4))


@query("search_without_vectors", MEMORY_SQL + ", b AS (SELECT DISTINCT session_id FROM messages WHERE regexp_matches(lower(content), '(^|[^a-z0-9])thing([^a-z0-9]|$)')) SELECT session_id, 'body' AS via FROM b")
def search_without_vectors(spark, d):
    """Without vectors a search goes by text alone."""
    s = memory.sessions(spark, d).withColumn("meta_text", F.lit(""))
    hits, _ = search.body_and_meta_hits(memory.messages(spark, d), s, "thing")
    return search.with_semantic(hits, related.semantic_hits(None, "thing"), s).select("session_id", "via")


@query("vectors_upserted", MEMORY_SQL + " SELECT session_id, CASE WHEN conv_id % 3 = 0 THEN 'new' ELSE 'old' END AS model, CASE WHEN conv_id % 3 = 0 THEN '2' ELSE '0' END AS embedded_at FROM sessions WHERE conv_id % 3 = 0 OR conv_id % 2 = 0")
def vectors_upserted(spark, d):
    s, n = memory.sessions(spark, d), F.col("conv_id")
    old = s.filter(n % 2 == 0).select("session_id", F.lit("old").alias("model"), F.lit("0").alias("embedded_at"))
    new = s.filter(n % 3 == 0).select("session_id", F.lit("new").alias("model"), F.explode(F.array(F.lit("1"), F.lit("2"))).alias("embedded_at"))
    return related.upsert_vectors(old, new)


@query("digest_queue", MEMORY_SQL + " SELECT session_id, 'm' AS model, 64 AS dim FROM sessions WHERE state = 'confirmed' AND conv_id % 4 != 0 AND conv_id % 7 != 0 ORDER BY created_at DESC, session_id LIMIT 20")
def digest_queue(spark, d):
    s = memory.sessions(spark, d)
    have = s.filter("conv_id % 4 = 0").select("session_id", F.lit("m").alias("model"))
    return related.digest(s, memory.messages(spark, d), have, "m", 20, s.filter("conv_id % 7 = 0")).select("session_id", "model", "dim")


# --- extraction --------------------------------------------------------------------------------


EXTRACTED_SQL = MARKED_SQL + """, f AS (SELECT session_id, len(list_distinct(flatten(list(regexp_extract_all(content, 'src/mod\\d/file\\d\\.ts'))))) AS n FROM marked GROUP BY 1), c AS (SELECT session_id, (sum(len(regexp_extract_all(content, '```'))) // 2)::BIGINT AS code_blocks FROM marked GROUP BY 1),
q AS (SELECT session_id, count(*) AS q FROM marked WHERE role = 'user' AND seq_num % 2 = 1 GROUP BY 1), dd AS (SELECT session_id, count(DISTINCT conv_id % 6) AS d FROM marked WHERE seq_num % 3 = 0 GROUP BY 1)
SELECT session_id, n AS files, code_blocks, coalesce(q, 0) AS questions, coalesce(d, 0) AS decisions, coalesce(d, 0) > 0 AS searchable FROM f JOIN c USING (session_id) LEFT JOIN q USING (session_id) LEFT JOIN dd USING (session_id)"""


def _extracted(out):
    files = F.size(F.filter("files_mentioned", lambda f: f.startswith("src/mod")))
    return out.select("session_id", files.cast("long").alias("files"), "code_changes.code_blocks", F.size("key_questions").cast("long").alias("questions"), F.size("decisions").cast("long").alias("decisions"), F.contains("meta_text", F.lit("决 定")).alias("searchable"))


@query("applied_extraction", EXTRACTED_SQL)
def applied_extraction(spark, d):
    return _extracted(extract.apply(memory.sessions(spark, d), with_marks(memory.messages(spark, d))))


@query("grown_extraction", EXTRACTED_SQL)
def grown_extraction(spark, d):
    """The lists of all messages, from the state after the first three of each session and the messages after them."""
    found = extract.features(with_marks(memory.messages(spark, d)))
    before, after = (written(found.filter(part), "features") for part in ("seq_num <= 3", "seq_num > 3"))
    state = {name: written(rows, name) for name, rows in extract.state_of(before).items()}
    return _extracted(extract.with_lists(memory.sessions(spark, d), extract.told(extract.grown(state, after))))


@query("committed_memory", MEMORY_SQL + " SELECT source_session_id, 'active' AS state, message_count, message_count AS kept, project_id, title, last_event_at FROM sessions")
def committed_memory(spark, d):
    """Sessions and their stored messages after two commits of the conversations, the first of them replayed, the second with what the first had already."""
    tables = memory_store.open_memory(spark, f"{shared_dir(spark)}/talkmill/memory-{uuid.uuid4().hex}")
    s = memory.sessions(spark, d).select("session_id", "source", "source_session_id", "project_id")
    rows = memory.messages(spark, d).join(s, "session_id").select("source", "source_session_id", "project_id", "seq_num", "role", "content", "created_at", F.col("session_id").alias("source_file"), F.col("seq_num").alias("position"))
    for batch_id, batch in ((0, rows.filter("seq_num <= 2")), (0, rows), (1, rows.filter("seq_num > 1"))):
        memory_store.commit_batch(tables, batch, batch_id, "replay")
    kept = tables.read("messages").groupBy("session_id").agg(F.count("*").alias("kept"))
    return tables.read("sessions").join(kept, "session_id").select("source_session_id", "state", "message_count", "kept", "project_id", "title", "last_event_at")


@query("summaries", MARKED_SQL + """, dd AS (SELECT session_id, min(conv_id % 6) AS k FROM marked WHERE seq_num % 3 = 0 GROUP BY 1)
SELECT session_id, coalesce(title, '（无标题）') AS first, CASE WHEN k IS NOT NULL THEN '决策（1）：1) 决定采用方案' || k || '号存储引擎' END AS told, '数据：' || message_count || ' 消息 · ' || source || ' · ' || left(created_at, 10) || ' → ' || left(last_event_at, 10) AS figures FROM sessions LEFT JOIN dd USING (session_id)""")
def summaries(spark, d):
    out = extract.summaries(memory.sessions(spark, d), with_marks(memory.messages(spark, d)))
    lines = F.split("summary_rule", "\n")
    return out.select("session_id", lines[0].alias("first"), F.get(F.filter(lines, lambda x: x.startswith("决策")), F.lit(0)).alias("told"), F.element_at(lines, -1).alias("figures"))


@query("refreshed_decisions", MARKED_SQL + " SELECT session_id, '决定采用方案' || conv_id % 6 || '号存储引擎' AS text, min(seq_num) AS seq FROM marked WHERE seq_num % 3 = 0 AND conv_id % 3 != 0 AND (conv_id % 3 = 1 OR seq_num > 3) GROUP BY session_id, conv_id")
def refreshed_decisions(spark, d):
    """Known by text in every third session; in the next, nothing is known; in the last, another is, up to the third message."""
    m = with_marks(memory.messages(spark, d))
    s, n = memory.sessions(spark, d), F.col("conv_id")
    known = s.filter(n % 3 != 1).select("session_id", F.when(n % 3 == 0, F.concat(F.lit("决定采用方案"), (n % 6).cast("string"), F.lit("号存储引擎"))).otherwise("other").alias("text"), F.when(n % 3 == 0, 1).otherwise(3).cast("long").alias("seq"))
    return extract.refresh_decisions(known, m).select("session_id", "text", "seq")


@query("refreshed_questions", MARKED_SQL + " SELECT session_id, '为什么要选这个第' || seq_num || '个方案呢？' AS q FROM marked WHERE role = 'user' AND seq_num % 2 = 1 AND seq_num > 1 AND seq_num != 5")
def refreshed_questions(spark, d):
    s = memory.sessions(spark, d)
    known = s.select("session_id", F.lit("为什么要选这个第5个方案呢？").alias("q"))
    return extract.refresh_questions(known, s.select("session_id", F.lit(1).cast("long").alias("seq")), with_marks(memory.messages(spark, d))).select("session_id", "q")


# --- hand-off ----------------------------------------------------------------------------------


def _told(spark, d):
    return with_metadata(spark, d).withColumn("summary_rule", F.when(F.col("conv_id") % 2 == 0, "a\nb\nc\nd\ne"))


@query("handoff_lines", f"""{MEMORY_SQL}, dec AS (SELECT created_at, session_id, '| ' || substr(created_at, 6, 5) || ' | use ' || conv_id % 6 || ' | ' || source || ' |' AS line FROM sessions WHERE conv_id % 3 != 0 AND origin != 'workflow'),
f AS (SELECT unnest(files_mentioned) AS f FROM sessions), fc AS (SELECT f, count(*) AS n FROM f GROUP BY f ORDER BY n DESC, f LIMIT 15),
q AS (SELECT created_at, session_id, '- [ ] why  ' || conv_id % 50 || '（' || substr(created_at, 6, 5) || '，' || source || '）' AS line FROM sessions WHERE conv_id % 2 = 0)
SELECT 'figures' AS section, 1::BIGINT AS place, '- ' || count(*) || ' sessions, ' || sum(message_count)::BIGINT || ' messages, ' || left(min(created_at), 10) || ' to ' || left(max(last_event_at), 10) || ' (' || array_to_string(list_sort(list(DISTINCT source)), ',') || ')' AS line FROM sessions
UNION ALL SELECT 'decisions', row_number() OVER (ORDER BY created_at, session_id), line FROM (SELECT * FROM dec ORDER BY created_at, session_id LIMIT 30)
UNION ALL SELECT 'files', row_number() OVER (ORDER BY n DESC, f), '- `' || f || '`（讨论 ' || n || ' 次）' FROM fc
UNION ALL SELECT 'questions', row_number() OVER (ORDER BY created_at, session_id), line FROM (SELECT * FROM q ORDER BY created_at, session_id LIMIT 15)
UNION ALL SELECT 'summaries', 0, '### ' || coalesce(title, session_id) || '（' || substr(created_at, 6, 5) || '，' || source || '）' || chr(10) || CASE WHEN conv_id % 2 = 0 THEN 'a' || chr(10) || 'b' || chr(10) || 'c' || chr(10) || 'd' ELSE '_' || message_count || ' 条消息（无规则摘要）_' END FROM sessions""")
def handoff_lines(spark, d):
    return exchange.handoff(_told(spark, d))


@query("flattened_decisions", f"{MEMORY_SQL} SELECT session_id, created_at AS \"at\", 'use ' || conv_id % 6 AS text, 3::BIGINT AS seq FROM sessions WHERE conv_id % 3 != 0")
def flattened_decisions(spark, d):
    return exchange.flattened(with_metadata(spark, d))


@query("quarantined", MEMORY_SQL + " SELECT session_id, message_count, false AS bodies_present FROM sessions")
def quarantined(spark, d):
    return exchange.quarantine(memory.sessions(spark, d), memory.messages(spark, d))[0].select("session_id", "message_count", "bodies_present")


@query("released", MEMORY_SQL + " SELECT CASE WHEN starts_with(session_id, '2') THEN 'free' ELSE 'held' END AS kind, count(*) AS n FROM messages GROUP BY 1")
def released(spark, d):
    free, held = exchange.release(memory.messages(spark, d), "2")
    return free.agg(F.lit("free").alias("kind"), F.count("*").alias("n")).unionByName(held.agg(F.lit("held").alias("kind"), F.count("*").alias("n")))
