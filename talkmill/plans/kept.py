"""Indexes of the driver's tables that are kept between queries: built once for each state of the files, then only read."""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from talkmill.operators.commits import Commits, Conflict
from talkmill.operators.search import meta_text
from talkmill.operators.session_index import SessionIndex
from talkmill.operators.text_index import FORMAT, TextIndex
from talkmill.plans import memory
from talkmill.plans.registry import table
from talkmill.sources.shared import shared_dir, written


def _stamp(spark: SparkSession, d: str, name: str) -> str:
    """What a table's files are called, how long they are and when they were written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(path))
    return hashlib.sha256(repr(found).encode()).hexdigest()[:24]


def kept(spark: SparkSession, d: str, name: str, label: str, build) -> str:
    """The folder that ``build`` (folder) filled for this state of a table; it is named in a manifest once it is complete."""
    known = Commits(spark, f"{shared_dir(spark)}/talkmill-kept")
    label = f"{label}-{FORMAT}-{_stamp(spark, d, name)}"
    while True:
        version, state = known.latest()
        if label in state:
            return f"{known.path}/{state[label]}"
        where = known.folder(label)
        build(f"{known.path}/{where}")
        try:
            known.commit(version, {**known.latest()[1], label: where})
        except Conflict:
            continue


def session_index(spark: SparkSession, d: str, role: str | None = None, metadata: bool = True) -> SessionIndex:
    """Message bodies (all, or those not of ``role``) and, unless a search does without it, the metadata of all conversations; each is built when it is first asked for."""

    def bodies(where):
        m = memory.messages(spark, d)
        SessionIndex(TextIndex(spark, where), None).add_messages(m.filter(F.col("role") != role) if role else m)

    def named(where):
        s = memory.sessions(spark, d).select("session_id", meta_text(F.col("title"), F.col("topics")).alias("meta_text"))
        SessionIndex(None, TextIndex(spark, where)).add_sessions(written(s, "metadata"))

    body = TextIndex(spark, kept(spark, d, "conversations", f"bodies-{role or 'all'}", bodies))
    return SessionIndex(body, TextIndex(spark, kept(spark, d, "conversations", "metadata", named)) if metadata else None)


def document_index(spark: SparkSession, d: str) -> TextIndex:
    """The documents' index after additions, changes and removals: half of the texts were others before, and some documents have gone."""

    def build(where):
        docs, n = table(spark, d, "documents").select("doc_id", "text"), F.col("doc_id")
        index = TextIndex(spark, where)
        gone = docs.filter(n % 5 == 0).select((-1 - n).alias("doc_id"), F.lit("thing then thing").alias("text"))
        index.add(gone.unionByName(docs.filter(n % 8 == 0).withColumn("text", F.lit("thing then"))), "doc_id", "text")
        index.add(docs.filter(n % 2 == 1), "doc_id", "text")
        index.replace(docs.filter(n % 2 == 0), "doc_id", "text")
        index.remove(gone, "doc_id")

    return TextIndex(spark, kept(spark, d, "documents", "documents", build))
