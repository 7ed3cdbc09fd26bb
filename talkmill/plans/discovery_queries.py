"""Queries of discovery: listings derived from the conversations, one file or table row for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkmill.plans.registry import query, table
from talkmill.sources import chat_logs, discovery

ROOT = "C:\\work\\App"
BORN_MS = 1_704_067_200_000

#: Per conversation n a file of each layout; sizes and times by n. Every fifth lies elsewhere.
LIST_SQL = f"""WITH c AS (SELECT conv_id AS n, count(*) AS lines FROM conversations GROUP BY conv_id),
t AS (SELECT n, lines, n * 10 AS size, strftime(make_timestamp(({BORN_MS} + n * 3600001) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS updated_at FROM c)"""


def _numbers(spark, d):
    c = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("n")).agg(F.count("*").alias("lines"))
    return c.withColumns({"size": F.col("n") * 10, "modified_ms": F.lit(BORN_MS) + F.col("n") * 3_600_001})


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _uuid(n):
    return _text("0000ABCD-0000-0000-0000-", F.lpad(n.cast("string"), 12, "0"))


def _slugged(spark, d):
    c, n = _numbers(spark, d), F.col("n")
    path = F.when(n % 5 == 0, _text("/logs/C--work-Other/k", n, ".jsonl")).when(n % 7 == 0, _text("/logs/C--work-App/sub/k", n, ".jsonl")).when(n % 11 == 0, _text("/logs/C--work-App/k", n, ".txt"))
    return c.withColumn("path", path.otherwise(_text("/logs/C--work-App/k", n, ".jsonl")))


@query("discover_slugged", f"{LIST_SQL} SELECT 'claude-code' AS source, 'k' || n AS source_session_id, '/logs/C--work-App/k' || n || '.jsonl' AS source_file, size, updated_at FROM t WHERE n % 5 != 0 AND n % 7 != 0 AND n % 11 != 0")
def discover_slugged(spark, d):
    return discovery.slugged_sessions(_slugged(spark, d), "/logs", ROOT).select("source", "source_session_id", "source_file", "size", "updated_at")


def _headed(spark, d):
    c, n = _numbers(spark, d), F.col("n")
    c = c.withColumn("path", _text("/codex/", F.when(n % 3 == 0, "archived_sessions").otherwise("sessions"), "/2024/rollout-1-", _uuid(n), ".jsonl"))
    own = F.struct(F.when(n % 5 == 0, "d:\\else").otherwise("c:\\WORK\\app").alias("cwd"), F.when(n % 2 == 0, _text("id", n)).alias("session_id"), F.lit("2024-01-01").alias("timestamp"))
    heads = c.select("path", F.to_json(F.struct(F.when(n % 7 == 0, "event").otherwise("session_meta").alias("type"), own.alias("payload"))).alias("line"))
    titles = c.filter(n % 4 == 0).select(F.explode(F.array(F.lit(1), F.lit(2))).alias("line_no"), "n").select("line_no", F.to_json(F.struct(_text("id", n).alias("id"), _text("name ", n, " ", F.col("line_no")).alias("thread_name"))).alias("line"))
    return discovery.headed_sessions(c, heads, titles.unionByName(titles.limit(1).select("line_no", F.lit("{bad").alias("line"))), ROOT)


@query("discover_headed", f"""{LIST_SQL} SELECT 'codex' AS source, CASE WHEN n % 2 = 0 THEN 'id' || n ELSE '0000ABCD-0000-0000-0000-' || lpad(n::VARCHAR, 12, '0') END AS source_session_id,
 CASE WHEN n % 4 = 0 THEN 'name ' || n || ' 2' END AS title, '2024-01-01' AS created_at, updated_at FROM t WHERE n % 5 != 0 AND n % 7 != 0""")
def discover_headed(spark, d):
    return _headed(spark, d).select("source", "source_session_id", "title", "created_at", "updated_at")


def _tasks(spark, d):
    c, n = _numbers(spark, d), F.col("n")
    c = c.withColumn("path", _text("/q/cache/projects/", F.when(n % 5 == 0, "application").otherwise("aPP"), F.when(n % 7 == 0, "-12").otherwise("-0123abcdEF"), "/conversation-history/t", n, "/t", n + F.when(n % 11 == 0, 1).otherwise(0), ".jsonl"))
    return discovery.task_sessions(c, c.select("path", F.when(n % 13 == 0, 1).otherwise(F.col("lines")).alias("lines")), ROOT)


@query("discover_tasks", f"{LIST_SQL} SELECT 't' || n AS source_session_id, 'Qoder 对话（t' || n || '）' AS title, size FROM t WHERE n % 5 != 0 AND n % 7 != 0 AND n % 11 != 0 AND n % 13 != 0 AND lines >= 2")
def discover_tasks(spark, d):
    return _tasks(spark, d).select("source_session_id", "title", "size")


def _workspaces(spark, d):
    c, n = _numbers(spark, d), F.col("n")
    text = F.to_json(F.struct(F.when(n % 5 == 0, "file:///d%3A/x").when(n % 2 == 0, "file:///C%3A%5Cwork%5Capp").alias("folder"), F.lit("file:///c:\\work\\App").alias("workspace")))
    value = F.when(n % 7 == 0, "[]").otherwise('[{"inputText":"hello"}]')
    rows = c.select(_text("w", n, "-abcdefghij").alias("workspace"), _text("/ws/", n).alias("path"), text.alias("text"), F.when(n % 11 == 0, "other").otherwise(chat_logs.fixed.PROMPT_KEY).alias("key"), value.alias("value"), "modified_ms")
    return discovery.workspace_sessions(rows, ROOT)


@query("discover_workspaces", f"{LIST_SQL} SELECT 'trae-w' || n || '-abcdefghij' AS source_session_id, 'Trae 对话（' || substr('w' || n || '-abcdefghij', 1, 8) || '）' AS title, updated_at FROM t WHERE n % 5 != 0 AND n % 7 != 0 AND n % 11 != 0")
def discover_workspaces(spark, d):
    return _workspaces(spark, d).select("source_session_id", "title", "updated_at")


def _session_table(spark, d):
    c, n = _numbers(spark, d), F.col("n")
    rows = c.select(_text("z", n).alias("id"), F.when(n % 3 == 0, _text("Workflow SubAgent ", n)).when(n % 3 == 1, _text("plain ", n)).alias("title"),
                    F.when(n % 5 == 0, "x").otherwise("c:\\Work\\app").alias("directory"), F.col("modified_ms").alias("time_created"), (F.col("modified_ms") + 1).alias("time_updated"))
    return discovery.table_sessions(rows, ROOT)


@query("session_table", f"""{LIST_SQL} SELECT 'z' || n AS source_session_id, 'zcode:z' || n AS source_file, CASE n % 3 WHEN 0 THEN 'Workflow SubAgent ' || n WHEN 1 THEN 'plain ' || n END AS title,
 updated_at AS created_at, strftime(make_timestamp(({BORN_MS} + n * 3600001 + 1) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS updated_at, CASE WHEN n % 3 = 0 THEN 'workflow' END AS origin FROM t WHERE n % 5 != 0""")
def session_table(spark, d):
    return _session_table(spark, d).select("source_session_id", "source_file", "title", "created_at", "updated_at", "origin")


@query("discover_all", f"""{LIST_SQL}, x AS (SELECT 'claude-code' AS source, 'k' || n AS id FROM t WHERE n % 5 != 0 AND n % 7 != 0 AND n % 11 != 0 UNION ALL SELECT 'zcode', 'z' || n FROM t WHERE n % 5 != 0
 UNION ALL SELECT 'qoder', 't' || n FROM t WHERE n % 5 != 0 AND n % 7 != 0 AND n % 11 != 0 AND n % 13 != 0 AND lines >= 2) SELECT source, id AS source_session_id FROM x""")
def discover_all(spark, d):
    """Three sources in the register, one of them registered anew."""
    sources = discovery.Sources()
    sources.register("zcode", lambda: _session_table(spark, d).limit(0))
    sources.register("claude-code", lambda: discovery.slugged_sessions(_slugged(spark, d), "/logs", ROOT))
    sources.register("qoder", lambda: _tasks(spark, d))
    sources.register("zcode", lambda: _session_table(spark, d))
    return sources.all().select("source", "source_session_id")


@query("backfill_cutoff", f"{LIST_SQL} SELECT 'k' || n AS source_session_id FROM t WHERE n % 5 != 0 AND n % 7 != 0 AND n % 11 != 0 AND n >= 20")
def backfill_cutoff(spark, d):
    files = _slugged(spark, d)
    return discovery.recent_files(discovery.slugged_sessions(files, "/logs", ROOT), files, BORN_MS + 20 * 3_600_001).select("source_session_id")


@query("path_names", """WITH c AS (SELECT DISTINCT conv_id AS n FROM conversations), p AS (SELECT n, CASE n % 4 WHEN 0 THEN 'C:\\work\\App' WHEN 1 THEN 'C:\\work\\App\\src\\f' || n || '.ts' WHEN 2 THEN 'C:/work/App/lib/f' || n ELSE 'D:\\x\\' || n END AS p FROM c)
SELECT n, 'proj_' || lower(regexp_replace(p, '[\\\\/:]', '-', 'g')) AS project_id, CASE n % 4 WHEN 0 THEN '.' WHEN 1 THEN 'src/f' || n || '.ts' WHEN 2 THEN 'lib/f' || n ELSE 'D:/x/' || n END AS rel FROM p""")
def path_names(spark, d):
    n = F.col("n")
    path = F.when(n % 4 == 0, ROOT).when(n % 4 == 1, _text(ROOT + "\\src\\f", n, ".ts")).when(n % 4 == 2, _text("C:/work/App/lib/f", n)).otherwise(_text("D:\\x\\", n))
    return _numbers(spark, d).select("n", discovery.project_id(path).alias("project_id"), discovery.relative(ROOT, path).alias("rel"))


@query("rewritten_logs", f"{LIST_SQL} SELECT n, CASE WHEN n % 3 = 0 THEN 'rewritten' WHEN n % 3 = 1 THEN 'grown' ELSE 'same' END AS change FROM t")
def rewritten_logs(spark, d):
    """Offsets one byte beyond the size, one before it, and at it."""
    n, size = F.col("n"), F.col("size")
    offset = size + F.when(n % 3 == 0, 1).when(n % 3 == 1, -1).otherwise(0)
    return _numbers(spark, d).select("n", F.when(chat_logs.rewritten(size, offset), "rewritten").when(chat_logs.grown(size, offset), "grown").otherwise("same").alias("change"))
