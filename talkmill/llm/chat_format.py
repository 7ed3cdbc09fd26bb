"""Chat formatting: tool calls linked to their results, validated against schemas, as canonical JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkmill.llm.common import small, table

#: Schema rows up to this many are broadcast; more are joined by shuffle, with each tool's calls in this many parts.
BROADCAST_SCHEMAS, SCHEMA_PARTS = 100_000, 64
#: Turns of a conversation that one task orders.
TURNS_PER_BUCKET = 1024

#: (tool, parameter, type, required); types are those of JSON.
SCHEMAS = [("reply", "question", "string", True), ("reply", "turn", "integer", True), ("reply", "chars", "integer", False)]
PARAMETERS = "array<struct<parameter:string,type:string,required:boolean>>"


def _json_type(value):
    """JSON type of a variant column. Numbers without a fraction are integers, however they are written: 1.0, 1e2, beyond 64 bits."""
    kind = F.schema_of_variant(value)
    whole = F.try_variant_get(value, "$", "double")
    return (
        F.when(kind == "BIGINT", "integer").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null")
        .when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind.rlike(r"^DECIMAL\(\d+,0\)$"), "integer")
        .when(kind.isin("DOUBLE", "FLOAT") & (whole == F.floor(whole).cast("double")), "integer").otherwise("number")
    )


def _inner(entry):
    """The members of an object and the elements of an array, as struct(path, value)."""
    kind, path = F.schema_of_variant(entry["value"]), entry["path"]
    members = F.transform(F.map_entries(F.try_variant_get(entry["value"], "$", "map<string,variant>")), lambda m: F.struct(F.concat(path, F.lit("."), m["key"]).alias("path"), m["value"].alias("value")))
    elements = F.transform(F.try_variant_get(entry["value"], "$", "array<variant>"), lambda x: F.struct(F.concat(path, F.lit("[]")).alias("path"), x.alias("value")))
    return F.when(kind.startswith("OBJECT"), members).when(kind.startswith("ARRAY"), elements).otherwise(F.array().cast("array<struct<path:string,value:variant>>"))


def _types(text, depth: int):
    """(path, type) of all values of a JSON object down to ``depth`` levels: ``a``, ``a.b``, ``a[]``, ``a[].b``."""
    level = F.transform(F.map_entries(F.from_json(text, "map<string,variant>")), lambda e: F.struct(e["key"].alias("path"), e["value"].alias("value")))
    levels = [level]
    for _ in range(depth - 1):
        levels.append(F.flatten(F.transform(levels[-1], _inner)))
    return F.transform(F.concat(*levels), lambda e: F.struct(e["path"].alias("path"), _json_type(e["value"]).alias("type")))


def validate_arguments(calls: DataFrame, schemas: DataFrame, name: str = "call_name", arguments: str = "call_arguments") -> DataFrame:
    """``calls`` with errors (array<string>, sorted; empty if there are none), in place: no call is sent to others of its kind.

    ``arguments`` holds JSON text; ``schemas`` holds tool, parameter, type, required. A parameter may lie deeper: ``a.b`` is member b of
    the object a, ``a[]`` stands for the elements of the array a, ``a[].b`` for their members. Arguments that aren't
    a JSON object, repeated keys, unknown tools, missing required parameters (members: of an object that is there), unknown parameters (of objects with
    declared members) and wrong types are errors; an integer passes for a number. A null argument text is ``{}``. Repeated schema rows count once.
    """
    schemas = schemas.dropna().dropDuplicates(["tool", "parameter"])
    depth = schemas.agg(F.max(F.regexp_count("parameter", F.lit(r"\.|\[\]")) + 1)).first()[0] or 1
    tools = schemas.groupBy(F.col("tool").alias("_tool")).agg(F.collect_list(F.struct("parameter", "type", "required")).cast(PARAMETERS).alias("_params"))
    if small(schemas, BROADCAST_SCHEMAS):
        known = calls.join(F.broadcast(tools), F.col(name) == F.col("_tool"), "left")
    else:
        parted = tools.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SCHEMA_PARTS - 1))))
        own = F.pmod(F.xxhash64(*calls.columns), F.lit(SCHEMA_PARTS)).cast("int")
        known = calls.withColumn("_own", own).join(parted, (F.col(name) == F.col("_tool")) & (F.col("_own") == F.col("_part")), "left").drop("_own", "_part")
    text = F.coalesce(F.col(arguments), F.lit("{}"))
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.lit(False))
    # A variant has each key once; a map of strings takes them all.
    repeats = ~is_object & F.from_json(text, "map<string,string>").isNotNull()
    known = known.withColumns({"_object": is_object, "_repeats": repeats, "_got": F.when(is_object, _types(text, depth))})
    some = lambda x: F.coalesce(x, F.array().cast("array<string>"))
    at = lambda path: F.filter("_got", lambda g: g["path"] == path)
    parent = lambda path: F.regexp_extract(path, r"^(.*)(\.[^.\[\]]*|\[\])$", 1)
    objects = lambda path: F.when(path == "", 1).otherwise(F.size(F.filter(at(path), lambda g: g["type"] == "object")))
    missing = F.transform(F.filter("_params", lambda p: p["required"] & (F.size(at(p["parameter"])) < objects(parent(p["parameter"])))), lambda p: F.concat(p["parameter"], F.lit(": missing")))
    names = F.transform("_params", lambda p: p["parameter"])
    declared = lambda path: (path == "") | F.exists(names, lambda n: n.startswith(F.concat(path, F.lit("."))))
    given = F.filter(F.transform("_got", lambda g: g["path"]), lambda path: ~path.endswith("[]") & declared(parent(path)))
    unknown = F.transform(F.array_except(given, names), lambda k: F.concat(k, F.lit(": unknown")))
    fits = lambda got, want: (got == want) | ((got == "integer") & (want == "number"))
    wrong = F.flatten(F.transform("_params", lambda p: F.transform(F.filter(at(p["parameter"]), lambda g: ~fits(g["type"], p["type"])), lambda g: F.concat(p["parameter"], F.lit(": "), g["type"], F.lit(" for "), p["type"]))))
    errors = (
        F.when(F.col("_repeats"), F.array(F.lit("arguments: repeated key"))).when(~F.col("_object"), F.array(F.lit("arguments: not an object")))
        .when(F.col("_tool").isNull(), F.array(F.lit("name: unknown tool"))).otherwise(F.array_sort(F.array_distinct(F.concat(some(missing), some(unknown), some(wrong)))))
    )
    return known.withColumn("errors", errors).drop("_tool", "_params", "_object", "_repeats", "_got")


def _bucketed(rows: DataFrame, at: str) -> DataFrame:
    """``rows`` with _conv (conv_id, null told apart) and _bucket: TURNS_PER_BUCKET turns of a conversation, so that no task orders a whole long one."""
    conv = F.when(F.col("conv_id").isNull(), "n").otherwise(F.concat(F.lit("v"), "conv_id"))
    return rows.withColumns({"_conv": conv, "_bucket": F.coalesce(F.floor(F.col(at) / TURNS_PER_BUCKET), F.lit(-(1 << 62))).cast("long")})


def _carried(buckets: DataFrame, value, out: str) -> DataFrame:
    """(_conv, _bucket, out): ``value`` over the buckets before each; one row for a bucket is ordered, not its turns."""
    before = Window.partitionBy("_conv").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return buckets.select("_conv", "_bucket", value.over(before).alias(out))


def format_chats(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, position, role, call_id, link, errors, message (canonical JSON).

    ``messages`` holds conv_id, turn, role, text, call_id, call_name, call_arguments. A message with a
    call_name makes the call ``call_id``; a message of role ``tool`` with a call_id is its result.
    Calls and results of a conversation are joined by identifier: of repeated calls the first turn
    counts. ``link`` is ``call`` or ``result``, for one without a partner ``open call`` or
    ``orphan result``, else null. Positions (from 0) are a topological order: turns as they stand,
    but a result that precedes its call comes right after it. Ties in turn go by role, call_id, text.
    Null roles and texts are empty; null turns come first. JSON has sorted keys and no white space; calls'
    arguments are canonical too, or the raw text if they aren't JSON. Extra columns are not read.

    Messages that are neither call nor result are not joined, and a conversation is ordered in buckets of
    turns with the counts carried over, so that neither plain messages nor one long conversation meet in a task.
    """
    rows = messages.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "call_id", "call_name", "call_arguments"
    )
    is_call, is_result = F.col("call_name").isNotNull(), (F.col("role") == "tool") & F.col("call_id").isNotNull() & F.col("call_name").isNull()
    named = is_result | (is_call & F.col("call_id").isNotNull())
    ends = rows.filter(named).groupBy("conv_id", "call_id").agg(F.min(F.when(is_call, F.col("turn"))).alias("call_turn"), F.min(F.when(is_result, F.col("turn"))).alias("result_turn"))
    ends = ends.withColumnRenamed("conv_id", "_conv").withColumnRenamed("call_id", "_call")
    linked = rows.filter(named).join(ends, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("call_id") == F.col("_call")), "left").drop("_conv", "_call")
    plain = rows.filter(~named).withColumns({"call_turn": F.lit(None).cast(rows.schema["turn"].dataType), "result_turn": F.lit(None).cast(rows.schema["turn"].dataType)})
    linked = linked.unionByName(plain)
    link = F.when(is_call, F.when(F.col("result_turn").isNull(), "open call").otherwise("call")).when(
        is_result, F.when(F.col("call_turn").isNull(), "orphan result").otherwise("result")
    )
    late = is_result & (F.col("call_turn") > F.col("turn"))
    linked = _bucketed(linked.withColumns({"link": link, "at": F.when(late, F.col("call_turn")).otherwise(F.col("turn")), "moved": F.when(late, 1).otherwise(0)}), "at")
    counts = _carried(linked.groupBy("_conv", "_bucket").agg(F.count("*").alias("n")), F.sum("n"), "before")
    order = Window.partitionBy("_conv", "_bucket").orderBy("at", "moved", "turn", "role", "call_id", "text")
    placed = linked.withColumn("place", F.row_number().over(order)).join(counts, ["_conv", "_bucket"])
    placed = placed.withColumn("position", (F.coalesce("before", F.lit(0)) + F.col("place") - 1).cast("long"))
    checked = validate_arguments(placed, schemas)
    canonical = F.coalesce(F.to_json(F.try_parse_json(F.coalesce("call_arguments", F.lit("{}")))), F.col("call_arguments"))
    call = F.when(is_call, F.struct(canonical.alias("arguments"), F.col("call_id").alias("id"), F.col("call_name").alias("name")))
    body = F.struct(
        F.col("text").alias("content"), "role", call.alias("tool_call"), F.when(is_result, F.col("call_id")).alias("tool_call_id")
    )
    return checked.select(
        "conv_id", "turn", "position", "role", F.when(is_call | is_result, F.col("call_id")).alias("call_id"), "link",
        F.when(is_call, F.size("errors")).alias("n_errors"), F.when(is_call & (F.size("errors") > 0), F.col("errors")).alias("errors"), F.to_json(body).alias("message"),
    )


def conversations_as_calls(conversations: DataFrame) -> DataFrame:
    """The plain conversations as calls, with the faults that real logs have: each user turn calls ``reply``, the assistant's next turn is the result.

    The identifier is ``<conv_id>-<turn>`` of the user turn; turns are doubled. An assistant turn that follows no
    user is a plain message. By the sum of conv_id and turn, some calls come after their result, lose
    their identifier's result, name an unknown tool, are cut off, or have a wrong, unknown or missing argument.
    """
    rows = _bucketed(conversations.select("conv_id", "turn", "role", "text"), "turn")
    user_turn = F.when(F.col("role") == "user", F.col("turn"))
    within = F.last(user_turn, True).over(Window.partitionBy("_conv", "_bucket").orderBy("turn", "role", "text"))
    carried = _carried(rows.groupBy("_conv", "_bucket").agg(F.max(user_turn).alias("last")), F.last("last", True), "earlier")
    seen = rows.withColumn("within", within).join(carried, ["_conv", "_bucket"]).withColumn("asked", F.coalesce("within", "earlier"))
    user, answer = F.col("role") == "user", (F.col("role") == "assistant") & F.col("asked").isNotNull()
    n, text = F.col("conv_id") + F.col("turn"), F.coalesce("text", F.lit(""))
    rest = [F.when(n % 29 != 0, text).alias("question"), F.length(text).alias("chars"), F.when(n % 23 == 0, "calm").alias("mood")]
    whole = F.when(n % 19 == 0, F.to_json(F.struct(F.col("turn").cast("string").alias("turn"), *rest))).otherwise(F.to_json(F.struct("turn", *rest)))
    arguments = F.when(n % 17 == 0, F.substring(whole, 1, 5)).otherwise(whole)
    return seen.select(
        "conv_id", F.when(user & (n % 7 == 0), F.col("turn") * 2 + 3).otherwise(F.col("turn") * 2).alias("turn"),
        F.when(answer, "tool").otherwise(F.col("role")).alias("role"), "text",
        F.when(answer & (n % 11 == 0), F.concat_ws("-", F.lit("lost"), "conv_id", "turn")).when(user | answer, F.concat_ws("-", "conv_id", "asked")).alias("call_id"),
        F.when(user, F.when(n % 13 == 0, "guess").otherwise("reply")).alias("call_name"), F.when(user, arguments).alias("call_arguments"),
    )


def op8_chat_format(spark, sf_dir: str) -> DataFrame:
    schemas = spark.createDataFrame(SCHEMAS, "tool string, parameter string, type string, required boolean")
    out = format_chats(conversations_as_calls(table(spark, sf_dir, "conversations")), schemas)
    return out.select("conv_id", "turn", "position", "role", "call_id", "link", "n_errors", F.array_join("errors", "; ").alias("faults"), "message")


OP8_SQL = r"""
WITH seen AS (SELECT conv_id, turn AS own, conv_id + turn AS n, role, coalesce(text, '') AS text, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS)
  OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS asked FROM conversations),
told AS (SELECT conv_id, own, n, text, role = 'user' AS is_call, role = 'assistant' AND asked IS NOT NULL AS is_result,
  CASE WHEN role = 'user' AND n % 7 = 0 THEN 2 * own + 3 ELSE 2 * own END AS turn,
  CASE WHEN role = 'assistant' AND asked IS NOT NULL THEN 'tool' ELSE coalesce(role, '') END AS role,
  CASE WHEN role = 'assistant' AND asked IS NOT NULL AND n % 11 = 0 THEN 'lost-' || conv_id || '-' || own
       WHEN role = 'user' OR (role = 'assistant' AND asked IS NOT NULL) THEN conv_id || '-' || asked END AS call_id FROM seen),
ends AS (SELECT conv_id, call_id, min(turn) FILTER (is_call) AS call_turn, min(turn) FILTER (is_result) AS result_turn FROM told WHERE call_id IS NOT NULL GROUP BY ALL),
linked AS (SELECT t.*, call_turn, result_turn, is_result AND coalesce(call_turn > turn, false) AS late FROM told t LEFT JOIN ends e USING (conv_id, call_id)),
judged AS (SELECT *, CASE WHEN NOT is_call THEN [] WHEN n % 17 = 0 THEN ['arguments: not an object'] WHEN n % 13 = 0 THEN ['name: unknown tool'] ELSE list_sort(list_filter([
  CASE WHEN n % 29 = 0 THEN 'question: missing' END, CASE WHEN n % 19 = 0 THEN 'turn: string for integer' END, CASE WHEN n % 23 = 0 THEN 'mood: unknown' END], lambda x: x IS NOT NULL)) END AS errors,
  CASE WHEN n % 17 = 0 THEN '{"tur' ELSE '{"chars":' || length(text) || CASE WHEN n % 23 = 0 THEN ',"mood":"calm"' ELSE '' END || CASE WHEN n % 29 = 0 THEN '' ELSE ',"question":' || to_json(text)::VARCHAR END
    || ',"turn":' || CASE WHEN n % 19 = 0 THEN '"' || own || '"' ELSE own::VARCHAR END || '}' END AS arguments FROM linked)
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN late THEN call_turn ELSE turn END, late, turn, role, call_id NULLS FIRST, text) - 1 AS position, role, call_id,
  CASE WHEN is_call THEN CASE WHEN result_turn IS NULL THEN 'open call' ELSE 'call' END WHEN is_result THEN CASE WHEN call_turn IS NULL THEN 'orphan result' ELSE 'result' END END AS link,
  CASE WHEN is_call THEN len(errors)::INT END AS n_errors, CASE WHEN is_call AND len(errors) > 0 THEN array_to_string(errors, '; ') END AS faults,
  '{"content":' || to_json(text)::VARCHAR || ',"role":' || to_json(role)::VARCHAR
  || CASE WHEN is_call THEN ',"tool_call":{"arguments":' || to_json(arguments)::VARCHAR || ',"id":' || to_json(call_id)::VARCHAR || ',"name":"' || CASE WHEN n % 13 = 0 THEN 'guess' ELSE 'reply' END || '"}' ELSE '' END
  || CASE WHEN is_result THEN ',"tool_call_id":' || to_json(call_id)::VARCHAR ELSE '' END || '}' AS message
FROM judged
"""
