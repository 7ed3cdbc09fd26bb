"""Ingest as a stream: each micro-batch is one commit of all the memory's tables, whatever is replayed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.operators.memory_store import Arrived, arrived, commit_batch, open_memory
from talkmill.sources.log_tail import line_numbers

#: What a line of a log holds; lines that aren't such objects are counted as bad.
LINE = "sid string, seq long, role string, text string, ts string, project string"


def ingest(
    stream: DataFrame, path: str, checkpoint: str, take_apart: Callable[[DataFrame, DataFrame], Arrived] = lambda rows, _: arrived(rows),
    blocked: Column | None = None, mode: str = "full", available_now: bool = True,
):
    """Starts the query that keeps the tables at ``path``; ``checkpoint`` is also the writer's name, under which its batches are noted.

    Modes: ``full``; ``meta`` counts messages without keeping them; ``off`` only moves cursors.
    """
    tables = open_memory(stream.sparkSession, path)
    commit = lambda batch, batch_id: commit_batch(tables, batch, batch_id, checkpoint, take_apart, blocked, mode)
    writer = stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if available_now else writer.trigger(processingTime="30 seconds").start()


def from_log_lines(source: str) -> Callable[[DataFrame, DataFrame], Arrived]:
    """Takes apart lines of the ``log_tail`` source, each a JSON object of LINE; a line without a session, number or role is bad. Files count on from their cursors."""

    def take_apart(batch: DataFrame, cursors: DataFrame) -> Arrived:
        numbered = line_numbers(batch, cursors).withColumn("m", F.from_json("line", LINE))
        good = F.col("m.sid").isNotNull() & F.col("m.seq").isNotNull() & F.col("m.role").isNotNull()
        rows = numbered.filter(good).select(
            F.lit(source).alias("source"), F.col("m.sid").alias("source_session_id"), F.col("m.project").alias("project_id"), F.col("m.seq").alias("seq_num"), F.col("m.role").alias("role"),
            F.col("m.text").alias("content"), F.col("m.ts").alias("created_at"), "source_file", "position",
        )
        bad = F.count(F.when(~good & (F.trim("line") != ""), 1))
        read = numbered.groupBy("source_file").agg(F.max("position").alias("position"), F.max("line_no").alias("lines"), bad.alias("bad_lines"), F.lit(False).alias("suspect"), F.min("stretch").alias("_low"))
        known = cursors.select("source_file", F.col("position").alias("_position"))
        restarted = read.join(known, "source_file").filter("_low < _position").select("source_file")
        parts = arrived(rows)
        return Arrived(parts.found, parts.messages, read.drop("_low"), restarted)

    return take_apart
