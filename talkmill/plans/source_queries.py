"""Queries of the sources: the driver's conversations written as log lines and read back, key-value and part tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.operators import store
from talkmill.plans import memory
from talkmill.plans.registry import query, table
from talkmill.sources import chat_logs

#: White space off both ends.
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _lines(spark, d: str, line, broken) -> DataFrame:
    """(source_file, line_no, line): a JSON line for each turn; every line that ``broken`` names is cut in half."""
    c = table(spark, d, "conversations").withColumn("source_file", F.concat(F.lit("f"), "conv_id")).withColumn("line_no", (F.col("turn") + 1).cast("long"))
    return c.select("source_file", "line_no", F.when(broken, F.substring(line, 1, 9)).otherwise(line).alias("line"))


def _json(*fields):
    """JSON text of the fields, nulls written out."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def _blocks(*texts):
    """(type, text) pairs as content blocks."""
    return F.array(*[F.struct(F.lit(kind).alias("type"), (F.lit(t) if t is None or isinstance(t, str) else t).cast("string").alias("text")) for kind, t in texts])


def _said(parsed: DataFrame) -> DataFrame:
    return parsed.filter("kind = 'message'").select("source_file", "seq_num", "role", "content")


@query(
    "parse_typed_lines",
    """SELECT 'f' || conv_id AS source_file, (turn + 1)::BIGINT AS seq_num, role, CASE WHEN (conv_id + turn) % 3 = 0 THEN text ELSE text || chr(10) || chr(10) || 'more' END AS content FROM conversations
WHERE role IN ('user', 'assistant') AND trim(text) != '' AND (conv_id + turn) % 11 != 0 AND (conv_id + turn) % 7 != 0 AND (conv_id + turn) % 13 != 0""",
)
def parse_typed_lines(spark, d):
    """Content as a string or in blocks, of which a tool's is left out and a textless one is empty; attachments that are null and that are not; side threads; bad lines."""
    n = F.col("conv_id") + F.col("turn")
    blocks = _blocks(("text", F.col("text")), ("tool_use", "hidden"), ("text", None), ("text", "more"))
    rest = [F.col("role").alias("type"), (n % 7 == 0).alias("isSidechain"), F.when(n % 13 == 0, "file.png").alias("attachment")]
    line = F.when(n % 3 == 0, _json(*rest, F.struct(F.col("text").alias("content")).alias("message"))).otherwise(_json(*rest, F.struct(blocks.alias("content")).alias("message")))
    return _said(chat_logs.typed_lines(_lines(spark, d, line, n % 11 == 0)))


@query(
    "parse_payload_lines",
    f"""SELECT 'f' || conv_id AS source_file, (turn + 1)::BIGINT AS seq_num, role, {STRIP.format("'  ' || text || chr(10) || 'seen' || chr(10)")} AS content FROM conversations
WHERE role IN ('user', 'assistant') AND (conv_id + turn) % 11 != 0 AND (conv_id + turn) % 5 != 0""",
)
def parse_payload_lines(spark, d):
    """Blocks of any type, the last without text; other line types; other roles."""
    n = F.col("conv_id") + F.col("turn")
    blocks = _blocks(("input_text", F.concat(F.lit("  "), "text")), ("image", "seen"), ("output_text", None))
    said = F.struct(F.lit("message").alias("type"), F.when(F.col("role") == "system", "developer").otherwise(F.col("role")).alias("role"), blocks.alias("content"))
    line = _json(F.when(n % 5 == 0, "event_msg").otherwise("response_item").alias("type"), said.alias("payload"))
    return _said(chat_logs.payload_lines(_lines(spark, d, line, n % 11 == 0)))


@query(
    "parse_role_lines",
    f"""WITH c AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN {STRIP.format("'<user_info>kept</user_info>' || CASE WHEN turn % 4 = 0 THEN '' ELSE text END")}
  ELSE {STRIP.format("'<user_query>' || text || '</user_query>'")} END AS content FROM conversations WHERE role IN ('user', 'assistant'))
SELECT 'f' || conv_id AS source_file, (turn + 1)::BIGINT AS seq_num, role, content FROM c WHERE length(content) >= 2""",
)
def parse_role_lines(spark, d):
    """Tags over several lines, bare tags, a tag that stays, assistants' texts that keep them all."""
    asked = F.concat(F.lit("<system-reminder>a\nb</system-reminder> <user_query>"), F.lit("<user_info>kept</user_info>"), F.when(F.col("turn") % 4 == 0, "").otherwise(F.col("text")), F.lit("</user_query>"))
    answered = F.concat(F.lit("<user_query>"), "text", F.lit("</user_query>"))
    blocks = F.when(F.col("role") == "user", _blocks(("text", asked), ("text", "<environment_context>x\n</environment_context>"))).otherwise(_blocks(("text", answered), ("other", None)))
    return _said(chat_logs.role_lines(_lines(spark, d, _json("role", F.struct(blocks.alias("content")).alias("message")), F.lit(False))))


@query(
    "bad_line_counts",
    "SELECT 'f' || conv_id AS source_file, count(*) FILTER ((conv_id + turn) % 11 = 0) AS bad, count(*) AS lines FROM conversations GROUP BY conv_id",
)
def bad_line_counts(spark, d):
    n = F.col("conv_id") + F.col("turn")
    line = _json(F.col("role").alias("type"), F.struct(F.col("text").alias("content")).alias("message"))
    kinds = chat_logs.typed_lines(_lines(spark, d, line, n % 11 == 0))
    return kinds.groupBy("source_file").agg(F.count(F.when(F.col("kind") == chat_logs.BAD, 1)).alias("bad"), F.count("*").alias("lines"))


@query(
    "prompt_history",
    f"""WITH p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq_num, {STRIP.format("CASE WHEN turn % 6 = 0 THEN ' x ' ELSE '  ' || text || chr(10) END")} AS content
FROM conversations WHERE role = 'user' AND conv_id % 10 != 3) SELECT 'f' || conv_id AS source_file, seq_num, 'user' AS role, content FROM p WHERE length(content) >= 2""",
)
def prompt_history(spark, d):
    """Texts with white space round them, one-letter texts, values already read in full."""
    users = table(spark, d, "conversations").filter("role = 'user'")
    typed = F.array_sort(F.collect_list(F.struct("turn", F.when(F.col("turn") % 6 == 0, " x ").otherwise(F.concat(F.lit("  "), "text", F.lit("\n"))).alias("inputText"))))
    entries = users.groupBy("conv_id").agg(F.to_json(F.transform(typed, lambda x: F.struct(x["inputText"].alias("inputText")))).alias("value"))
    entries = entries.select("conv_id", F.concat(F.lit("f"), "conv_id").alias("source_file"), F.lit(chat_logs.fixed.PROMPT_KEY).alias("key"), "value")
    seen = entries.filter("conv_id % 10 = 3").select("source_file", F.length("value").alias("length"))
    return chat_logs.prompt_history(entries, seen).withColumn("seq_num", F.col("seq_num").cast("long"))


def _messages_and_parts(spark, d: str) -> tuple[DataFrame, DataFrame]:
    """Each turn as a message of two text parts; every ninth turn still waits for its parts."""
    c = table(spark, d, "conversations").withColumns({"session_id": F.col("conv_id").cast("string"), "id": F.concat_ws("-", "conv_id", "turn"), "rowid": (F.col("turn") + 1).cast("long")})
    messages = c.select("session_id", "id", "rowid", (F.col("turn") * 60_000).cast("long").alias("time_created"), F.to_json(F.struct("role")).alias("data"))
    cut = lambda a, b: F.to_json(F.struct(F.lit("text").alias("type"), F.substring("text", a, b).alias("text")))
    halves = F.array(F.struct(F.lit(0).alias("sequence"), cut(1, 20).alias("data")), F.struct(F.lit(1).alias("sequence"), cut(21, 1 << 20).alias("data")))
    parts = c.filter((F.col("conv_id") + F.col("turn")) % 9 != 0).select(F.col("id").alias("message_id"), F.inline(halves))
    return messages, parts


#: Sessions by three were read up to row 2; a message that waits for its parts is held from 60 000 ms on.
PARTS_SQL = f"""WITH m AS (SELECT conv_id::VARCHAR AS session_id, (turn + 1)::BIGINT AS rowid, CASE role WHEN 'user' THEN 'user' ELSE 'assistant' END AS role, turn * 60000 AS time_created,
  CASE WHEN (conv_id + turn) % 9 != 0 THEN {STRIP.format("substr(text, 1, 20) || chr(10) || substr(text, 21)")} ELSE '' END AS content, CASE WHEN conv_id % 3 = 0 THEN 2 ELSE 0 END AS read FROM conversations),
n AS (SELECT * FROM m WHERE rowid > read),
c AS (SELECT session_id, greatest(max(read), coalesce(min(rowid) FILTER (content = '' AND time_created >= 60000) - 1, max(rowid))) AS cursor FROM n GROUP BY session_id)"""


def _read_parts(spark, d):
    messages, parts = _messages_and_parts(spark, d)
    read = messages.filter("cast(session_id as long) % 3 = 0").select("session_id", F.lit(2).cast("long").alias("cursor")).distinct()
    return chat_logs.joined_parts(messages, parts, 660_000, read)


@query("joined_parts", f"{PARTS_SQL} SELECT session_id, rowid, role, content FROM n WHERE content != ''")
def joined_parts(spark, d):
    return _read_parts(spark, d)[0].select("session_id", "rowid", "role", "content")


@query("late_part_cursors", f"{PARTS_SQL} SELECT session_id, cursor FROM c")
def late_part_cursors(spark, d):
    return _read_parts(spark, d)[1]


@query(
    "compaction_summaries",
    f"""SELECT conv_id::VARCHAR AS session_id, -(turn * 1000 + 500)::BIGINT AS seq_num, 'system' AS role, '{chat_logs.fixed.COMPACTION_MARK}' || substr({STRIP.format("repeat(text || ' ', 40)")}, 1, 2000) AS content
FROM conversations WHERE turn % 4 = 1 AND turn * 1000 + 500 > 2000 AND (conv_id + turn) % 9 != 0 AND {STRIP.format("text")} != ''""",
)
def compaction_summaries(spark, d):
    """A compaction after every fourth turn, whose summary is long; what was read before, and summaries without text, give nothing."""
    c = table(spark, d, "conversations").withColumns({"session_id": F.col("conv_id").cast("string"), "message_id": F.concat_ws("-", "conv_id", "turn")})
    mark = F.to_json(F.struct(F.lit("compaction").alias("type"), F.col("message_id").alias("summaryMessageId")))
    marks = c.filter("turn % 4 = 1").select("session_id", F.concat(F.lit("c"), "message_id").alias("message_id"), F.lit(0).alias("sequence"), (F.col("turn") * 1000 + 500).cast("long").alias("time_created"), mark.alias("data"))
    said = F.to_json(F.struct(F.lit("text").alias("type"), F.repeat(F.concat("text", F.lit(" ")), 40).alias("text")))
    texts = c.filter((F.col("conv_id") + F.col("turn")) % 9 != 0).select("session_id", "message_id", F.lit(0).alias("sequence"), (F.col("turn") * 1000).cast("long").alias("time_created"), said.alias("data"))
    since = c.select("session_id", F.lit(2000).cast("long").alias("time")).distinct()
    return chat_logs.compaction_summaries(marks.unionByName(texts), since).drop("time_created")


@query(
    "compaction_loss",
    """WITH e AS (SELECT customer_id AS session_id, event_id, l_before, l_before - l_lost AS l_after FROM
 (SELECT o_custkey AS customer_id, o_orderkey AS event_id, floor(o_totalprice) AS l_before, floor(o_totalprice / 3) AS l_lost FROM orders))
SELECT session_id::VARCHAR AS session_id, greatest(0, floor((max_by(l_before, event_id) - max_by(l_after, event_id)) / 500))::BIGINT AS lost_messages FROM e GROUP BY session_id""",
)
def compaction_loss(spark, d):
    o = table(spark, d, "orders")
    whole = F.floor("o_totalprice")
    said = F.struct(F.lit("compaction").alias("type"), whole.alias("preCompactTokenCount"), (whole - F.floor(F.col("o_totalprice") / 3)).alias("truePostCompactTokenCount"))
    parts = o.select(F.col("o_custkey").cast("string").alias("session_id"), F.col("o_orderkey").alias("time_created"), F.to_json(said).alias("data"))
    return chat_logs.lost_by_compaction(parts)


@query(
    "ignore_rules",
    f"""{memory.MEMORY_SQL} SELECT session_id FROM sessions WHERE NOT (source || '/' || source_session_id = 's1/k1' OR source = 's3' OR coalesce(contains(title, 'the'), false)
 OR regexp_matches('logs/' || source || '/' || session_id || '.jsonl', '^logs/s2/[^/]*[.]jsonl$'))""",
)
def ignore_rules(spark, d):
    rows = memory.sessions(spark, d).withColumn("source_file", F.concat(F.lit("logs/"), "source", F.lit("/"), "session_id", F.lit(".jsonl")))
    rules = ["# kept out", "session:s1/k1", "source:s3", "title:the", "logs/s2/*.jsonl"]
    return rows.filter(~chat_logs.ignored(rules)).select("session_id")


@query(
    "change_probe",
    """SELECT conv_id::VARCHAR AS session_id, max(turn) || '/' || coalesce(max(turn) FILTER (role = 'assistant'), 0) AS signature FROM conversations GROUP BY conv_id""",
)
def change_probe(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), "role", F.col("turn").alias("rowid"))
    return store.change_signatures(rows, rows.filter("role = 'assistant'"))
