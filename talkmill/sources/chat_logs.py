"""Chat logs as tables: lines of several formats, ignore rules, parts joined to messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkmill.functions import fixed_values as fixed
from talkmill.functions.text import strip

CONTENT = "array<struct<type:string,text:string>>"
BAD, SKIP, MESSAGE = "bad", "skip", "message"


def read_lines(spark, path: str) -> DataFrame:
    """(source_file, line_no, line): physical lines, numbered from 1 within each file.

    Files may be of any size: Spark splits them, lines of a part of a file are numbered there and the
    counts of the parts before it are added. Lines must not be blank only of line ends, as blank ones keep their number.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("source_file"), place.alias("place"), F.col("value").alias("line"))
    rows = rows.withColumn("block", F.col("place.block"))
    counts = rows.groupBy("source_file", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    within = F.row_number().over(Window.partitionBy("source_file", "block").orderBy("place"))
    starts = counts.select("source_file", "block", F.coalesce(before, F.lit(0)).alias("before"))
    numbered = rows.withColumn("within", within).join(starts, ["source_file", "block"])
    return numbered.filter("line != ''").select("source_file", (F.col("before") + F.col("within")).cast("long").alias("line_no"), "line")


def _text_of(v: Column, path: str, kind: str | None = None) -> Column:
    """Text at ``path`` of a variant: a string as it stands; of an array all blocks' texts, or those of ``kind``, one below the other."""
    found = F.try_variant_get(v, path, "variant")
    blocks = F.from_json(F.to_json(found), CONTENT)
    if kind:
        blocks = F.filter(blocks, lambda b: b["type"] == kind)
    joined = F.array_join(F.transform(blocks, lambda b: F.coalesce(b["text"], F.lit(""))), "\n")
    shape = F.schema_of_variant(found)
    return F.when(shape.startswith("ARRAY"), joined).when(shape == "STRING", F.try_variant_get(v, path, "string")).otherwise("")


def _parsed(lines: DataFrame) -> DataFrame:
    return lines.withColumn("v", F.try_parse_json("line"))


def _classified(rows: DataFrame, wanted: Column, role: Column, content: Column, at: Column) -> DataFrame:
    text = F.when(wanted, content)
    kind = F.when(F.col("v").isNull(), BAD).when(F.coalesce(wanted, F.lit(False)) & (strip(text) != ""), MESSAGE).otherwise(SKIP)
    return rows.select("source_file", F.col("line_no").alias("seq_num"), kind.alias("kind"), role.alias("role"), text.alias("content"), at.alias("created_at"))


def typed_lines(lines: DataFrame) -> DataFrame:
    """Lines ``{type, message: {content}, timestamp, isSidechain, attachment}``: users' and assistants' turns of the main thread.

    Of content in blocks only those of type text count. A null, false or empty attachment is none.
    """
    rows, v = _parsed(lines), F.col("v")
    kind = F.try_variant_get(v, "$.type", "string")
    side = F.coalesce(F.try_variant_get(v, "$.isSidechain", "boolean"), F.lit(False))
    attached = F.coalesce(F.to_json(F.try_variant_get(v, "$.attachment", "variant")), F.lit("null"))
    wanted = kind.isin("user", "assistant") & ~side & attached.isin("null", "false", "0", '""')
    return _classified(rows, wanted, kind, _text_of(v, "$.message.content", "text"), F.try_variant_get(v, "$.timestamp", "string"))


def payload_lines(lines: DataFrame) -> DataFrame:
    """Lines ``{type: response_item, payload: {type: message, role, content}}``: all blocks' texts, trimmed; users and assistants only."""
    rows, v = _parsed(lines), F.col("v")
    role = F.try_variant_get(v, "$.payload.role", "string")
    wanted = (F.try_variant_get(v, "$.type", "string") == "response_item") & (F.try_variant_get(v, "$.payload.type", "string") == "message")
    return _classified(rows, wanted & role.isin("user", "assistant"), role, strip(_text_of(v, "$.payload.content")), F.try_variant_get(v, "$.timestamp", "string"))


def role_lines(lines: DataFrame) -> DataFrame:
    """Lines ``{role, message: {content}}``: all blocks' texts, trimmed; what programs put into users' texts is taken out, texts under 2 characters skipped."""
    rows, v = _parsed(lines), F.col("v")
    role = F.try_variant_get(v, "$.role", "string")
    text = strip(_text_of(v, "$.message.content"))
    clean = text
    for pattern in fixed.SYSTEM_TAGS:
        clean = F.regexp_replace(clean, pattern, "")
    content = F.when(role == "user", strip(clean)).otherwise(text)
    return _classified(rows, role.isin("user", "assistant") & (F.length(content) >= 2), role, content, F.lit(None).cast("string"))


def prompt_history(entries: DataFrame, seen: DataFrame | None = None, key: str = fixed.PROMPT_KEY) -> DataFrame:
    """(source_file, seq_num, role, content) of a key-value table (source_file, key, value) whose value lists ``inputText``.

    Texts are trimmed, those under 2 characters skipped. A value no longer than what ``seen`` (source_file, length) says was read is passed over.
    """
    rows = entries.filter(F.col("key") == key)
    if seen is not None:
        before = seen.select("source_file", F.col("length").alias("_read"))
        rows = rows.join(before, "source_file", "left").filter(F.length("value") > F.coalesce("_read", F.lit(0)))
    each = rows.select("source_file", F.posexplode(F.from_json("value", "array<struct<inputText:string>>")).alias("i", "x")).withColumn("content", strip(F.col("x.inputText")))
    return each.filter(F.length("content") >= 2).select("source_file", (F.col("i") + 1).cast("long").alias("seq_num"), F.lit("user").alias("role"), "content")


def _texts_of_parts(parts: DataFrame) -> DataFrame:
    """(message_id, content): a message's text parts in order, one below the other, trimmed."""
    said = parts.filter(F.get_json_object("data", "$.type") == "text").groupBy("message_id").agg(
        F.array_sort(F.collect_list(F.struct("sequence", F.coalesce(F.get_json_object("data", "$.text"), F.lit("")).alias("t")))).alias("p")
    )
    return said.select("message_id", strip(F.array_join(F.transform("p", lambda x: x["t"]), "\n")).alias("content"))


def joined_parts(messages: DataFrame, parts: DataFrame, now_ms: int, cursors: DataFrame | None = None, grace_ms: int = fixed.GRACE_MS) -> tuple[DataFrame, DataFrame]:
    """(messages with content, (session_id, cursor)): each message beyond its session's cursor with its text parts in order.

    The first message without text that is no older than ``grace_ms`` holds its session's cursor before it,
    so that it is read again; what follows it is given all the same, and given once more by the next read,
    which the message key makes harmless. An older one is passed over. A cursor never goes back. Every
    role but user is the assistant's.
    """
    rows = messages
    if cursors is not None:
        rows = rows.join(cursors.select("session_id", F.col("cursor").alias("_at")), "session_id", "left").filter(F.col("rowid") > F.coalesce("_at", F.lit(0)))
    else:
        rows = rows.withColumn("_at", F.lit(0).cast("long"))
    rows = rows.join(_texts_of_parts(parts), F.col("id") == F.col("message_id"), "left")
    role = F.when(F.get_json_object("data", "$.role") == "user", "user").otherwise("assistant")
    rows = rows.select("session_id", "rowid", "time_created", role.alias("role"), F.coalesce("content", F.lit("")).alias("content"), F.coalesce("_at", F.lit(0)).alias("_at"))
    waits = (F.col("content") == "") & (F.col("time_created") >= now_ms - grace_ms)
    limits = rows.groupBy("session_id").agg(F.min(F.when(waits, F.col("rowid"))).alias("hold"), F.max("rowid").alias("last"), F.max("_at").alias("_at"))
    moved = limits.select("session_id", F.greatest("_at", F.coalesce(F.col("hold") - 1, "last")).alias("cursor"))
    return rows.filter("content != ''").drop("_at"), moved


def compaction_summaries(parts: DataFrame, since: DataFrame | None = None, most_chars: int = 2000) -> DataFrame:
    """(session_id, seq_num, role, content, time_created): the summary that each compaction left, as a system message.

    ``parts`` holds session_id, message_id, sequence, time_created, data; ``since`` (session_id, time) marks what was read. The
    number is minus the time in milliseconds, which no turn has. Compactions without a summary text give none.
    """
    found = parts.filter(F.get_json_object("data", "$.type") == "compaction").select("session_id", "time_created", F.get_json_object("data", "$.summaryMessageId").alias("message_id"))
    if since is not None:
        found = found.join(since.select("session_id", F.col("time").alias("_time")), "session_id", "left").filter(F.col("time_created") > F.coalesce("_time", F.lit(0)))
    told = found.join(_texts_of_parts(parts), "message_id").filter("content != ''")
    return told.select(
        "session_id", (-F.col("time_created")).alias("seq_num"), F.lit("system").alias("role"),
        F.concat(F.lit(fixed.COMPACTION_MARK), F.substring("content", 1, most_chars)).alias("content"), "time_created",
    )


def lost_by_compaction(parts: DataFrame) -> DataFrame:
    """(session_id, lost_messages): by the latest compaction, the tokens it dropped in units of 500."""
    size = lambda name: F.get_json_object("data", f"$.{name}").cast("double")
    found = parts.filter(F.get_json_object("data", "$.type") == "compaction")
    last = found.groupBy("session_id").agg(F.max_by(F.struct(size("preCompactTokenCount").alias("a"), size("truePostCompactTokenCount").alias("b")), "time_created").alias("x"))
    return last.select("session_id", F.greatest(F.lit(0), F.floor((F.col("x.a") - F.col("x.b")) / 500)).cast("long").alias("lost_messages"))


def glob_pattern(glob: str) -> str:
    """Regular expression of a path rule: ``**`` crosses folders, ``*`` and ``?`` don't; a closing slash takes all below."""
    folder = glob.endswith("/")
    quoted = "".join("\\" + c if c in ".+^${}()|[]\\" else c for c in glob.rstrip("/").replace("\\", "/"))
    return "^" + quoted.replace("**", "\0").replace("*", "[^/]*").replace("?", "[^/]").replace("\0", ".*") + ("($|/)" if folder else "$")


def ignored(rules: list[str]) -> Column:
    """True for sessions (source, source_session_id, title, source_file) that a rule names: session:, source:, title: or a path."""
    found = F.lit(False)
    for rule in (r.strip() for r in rules):
        if not rule or rule.startswith("#"):
            continue
        kind, _, rest = rule.partition(":")
        if kind == "session":
            found = found | (F.concat_ws("/", "source", "source_session_id") == rest)
        elif kind == "source":
            found = found | (F.col("source") == rest.strip())
        elif kind == "title":
            found = found | F.coalesce(F.contains("title", F.lit(rest.strip())), F.lit(False)) if rest.strip() else found
        else:
            found = found | F.regexp_replace("source_file", r"\\", "/").rlike(glob_pattern(rule))
    return found


def rewritten(size: Column, offset: Column) -> Column:
    """A log shorter than what was read of it has been written anew."""
    return size < offset


def grown(size: Column, offset: Column) -> Column:
    """A log that is longer than what was read of it."""
    return size > offset
