"""Sessions found in listings of log files and in session tables, one function per layout, and a register of sources.

Listings are DataFrames (path, size, modified_ms), as ``listing`` reads them; no file is opened for them. Every
function gives ``FOUND`` columns: source, source_session_id, source_file, title, created_at, updated_at, size, origin.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.functions import fixed_values as fixed

FOUND = ["source", "source_session_id", "source_file", "title", "created_at", "updated_at", "size", "origin"]
UUID_NAME = r"(?i)([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})\.jsonl$"


def listing(spark, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """(path, size, modified_ms) of the files below ``path``; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified_ms"))


def slug(path: Column) -> Column:
    """A path as one folder name."""
    return F.regexp_replace(path, r"[\\/:]", "-")


def project_id(root: Column) -> Column:
    return F.concat(F.lit("proj_"), F.lower(slug(root)))


def relative(root: str, path: Column) -> Column:
    """``path`` below ``root`` with forward slashes; the root itself is ``.``."""
    plain, base = F.regexp_replace(path, r"\\", "/"), root.replace("\\", "/").rstrip("/")
    return F.when(plain == base, ".").when(plain.startswith(base + "/"), F.substring(plain, F.lit(len(base) + 2), F.length(plain))).otherwise(plain)


def iso(ms: Column) -> Column:
    """Milliseconds since 1970 as ISO 8601 in UTC, whatever the session's time zone."""
    at = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.timestamp_millis(ms).cast("timestamp_ntz"))
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _found(rows: DataFrame, source: str, **columns) -> DataFrame:
    none = F.lit(None).cast("string")
    base = {"title": none, "created_at": none, "origin": none, "size": F.lit(0).cast("long")}
    values = {**base, **columns, "source": F.lit(source)}
    return rows.select(*[values[c].alias(c) for c in FOUND])


def _name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^\\/]*)$", 1)


def slugged_sessions(files: DataFrame, base: str, root: str, source: str = fixed.SLUGGED) -> DataFrame:
    """``<base>/<slug of the root>/<id>.jsonl``."""
    folder = base.rstrip("/") + "/" + "".join("-" if c in "\\/:" else c for c in root) + "/"
    rest = F.substring("path", F.lit(len(folder) + 1), F.length("path"))
    own = files.filter(F.col("path").startswith(folder) & rest.endswith(".jsonl") & ~rest.contains("/"))
    return _found(own, source, source_session_id=F.regexp_replace(_name(F.col("path")), r"\.jsonl$", ""), source_file=F.col("path"), updated_at=iso(F.col("modified_ms")), size=F.col("size"))


def headed_sessions(files: DataFrame, first_lines: DataFrame, titles: DataFrame, root: str, source: str = fixed.HEADED) -> DataFrame:
    """Files whose first line (path, line) is a session's head with the root as its folder, ignoring case.

    The id is the head's or the UUID in the name; titles come from an index of lines ``{id, thread_name}``.
    """
    head = first_lines.filter(F.get_json_object("line", "$.type") == "session_meta").select(
        "path", *[F.get_json_object("line", f"$.payload.{c}").alias(f"_{c}") for c in ("cwd", "session_id", "timestamp")]
    )
    own = files.filter(F.col("path").rlike(r"[\\/](sessions|archived_sessions)[\\/].*\.jsonl$")).join(head.filter(F.lower("_cwd") == root.lower()), "path")
    uuid = F.regexp_extract("path", UUID_NAME, 1)
    named = F.when(uuid != "", uuid).otherwise(F.regexp_replace(_name(F.col("path")), r"\.jsonl$", ""))
    own = own.withColumn("_id", F.coalesce("_session_id", named))
    index = titles.select(F.get_json_object("line", "$.id").alias("_id"), F.get_json_object("line", "$.thread_name").alias("_title"), "line_no").filter("_id != '' and _title != ''")
    index = index.groupBy("_id").agg(F.max_by("_title", "line_no").alias("_title"))
    own = own.join(index, "_id", "left")
    return _found(own, source, source_session_id=F.col("_id"), source_file=F.col("path"), title=F.col("_title"), created_at=F.col("_timestamp"), updated_at=iso(F.col("modified_ms")), size=F.col("size"))


def task_sessions(files: DataFrame, line_counts: DataFrame, root: str, source: str = fixed.TASKS) -> DataFrame:
    """``cache/projects/<folder>-<hex>/conversation-history/<task>/<task>.jsonl`` of the root's folder name with two lines (path, lines) or more."""
    place = r"(?i)[\\/]cache[\\/]projects[\\/]([^\\/]+)-[0-9a-f]{8,}[\\/]conversation-history[\\/]([^\\/]+)[\\/]\2\.jsonl$"
    folder = root.replace("\\", "/").rstrip("/").rsplit("/", 1)[-1].lower()
    own = files.filter(F.lower(F.regexp_extract("path", place, 1)) == folder).join(line_counts.filter("lines >= 2").select("path"), "path", "left_semi")
    task = F.regexp_extract("path", place, 2)
    return _found(own, source, source_session_id=task, source_file=F.col("path"), title=F.concat(F.lit(fixed.TASK_TITLE), task, F.lit("）")), updated_at=iso(F.col("modified_ms")), size=F.col("size"))


def workspace_path(text: Column) -> Column:
    """The folder that a workspace's JSON names by a ``file:///`` address, decoded; null if it names none."""
    raw = F.coalesce(F.get_json_object(text, "$.folder"), F.get_json_object(text, "$.workspace"))
    return F.when(raw.startswith("file:///"), F.url_decode(F.regexp_replace(F.substring(raw, F.lit(9), F.length(raw)), r"\+", "%2B")))


def workspace_sessions(workspaces: DataFrame, root: str, key: str = fixed.PROMPT_KEY, source: str = fixed.WORKSPACES) -> DataFrame:
    """Rows (workspace, path, text, key, value, modified_ms) of workspaces at the root whose prompt history is not empty."""
    own = workspaces.filter((F.lower(workspace_path(F.col("text"))) == root.lower()) & (F.col("key") == key) & (F.length("value") > 10))
    title = F.concat(F.lit(fixed.WORKSPACE_TITLE), F.substring("workspace", 1, 8), F.lit("）"))
    return _found(own, source, source_session_id=F.concat(F.lit(f"{source}-"), "workspace"), source_file=F.col("path"), title=title, updated_at=iso(F.col("modified_ms")))


def table_sessions(sessions: DataFrame, root: str, source: str = fixed.TABLE) -> DataFrame:
    """Rows (id, title, directory, time_created, time_updated) of a session table at the root, ignoring case; program-made ones are marked."""
    own = sessions.filter(F.lower("directory") == root.lower())
    origin = F.when(F.coalesce(F.col("title"), F.lit("")).rlike(fixed.WORKFLOW_TITLE), "workflow")
    return _found(
        own, source, source_session_id=F.col("id"), source_file=F.concat(F.lit(f"{source}:"), "id"), title=F.col("title"),
        created_at=iso(F.col("time_created")), updated_at=iso(F.col("time_updated")), origin=origin,
    )


class Sources:
    """Named sources: functions () -> DataFrame of ``FOUND`` columns. One registered later under the same name replaces the earlier."""

    def __init__(self):
        self.known: dict[str, Callable[[], DataFrame]] = {}

    def register(self, name: str, discover: Callable[[], DataFrame]) -> None:
        if not name or not callable(discover):
            raise ValueError("a source needs a name and a function")
        self.known[name] = discover

    def all(self, names: list[str] | None = None) -> DataFrame:
        """What the named sources find, or all; unknown names are an error."""
        chosen = list(self.known) if names is None else names
        if missing := [n for n in chosen if n not in self.known]:
            raise KeyError(f"no source {', '.join(missing)}")
        return reduce(DataFrame.unionByName, [self.known[n]().select(FOUND) for n in chosen])


def recent_files(found: DataFrame, files: DataFrame, since_ms: int | None) -> DataFrame:
    """``found`` without those whose file was last changed before ``since_ms``; null keeps all."""
    if since_ms is None:
        return found
    return found.join(files.filter(F.col("modified_ms") >= since_ms).select(F.col("path").alias("source_file")), "source_file", "left_semi")
