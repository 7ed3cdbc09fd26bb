"""The corpus pipeline: five operators, one after another, over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the
next stage's docs. All but the last return the columns of ``documents``. Nulls, empty texts, repeated
rows and empty tables are handled as the stages' operators say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.llm import mixing, near_dups, packing, quality, repeats
from talkmill.llm.common import discard, durable, table
from talkmill.llm.tokens import DEFAULT_TOKENIZER

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SIMILARITY = 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the classifier, fitted on the labels of ``docs``, accepts.

    Rows are judged by their text alone: null texts as empty ones, repeated rows alike, null ids like any.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score_documents(docs.select(COLUMNS), model).filter("predicted = 1").select(COLUMNS)


def numbered(docs: DataFrame, label: str) -> DataFrame:
    """``docs`` with _row, a number of each row's own, written once so that every later read sees the same."""
    return durable(docs.select(COLUMNS).withColumn("_row", F.monotonically_increasing_id()), label)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row, that of the smallest doc_id (nulls last), of each group of near-duplicates.

    Rows are documents: of repeated rows one stays, whatever their doc_id, and different texts under one doc_id are judged apart.
    """
    rows = numbered(docs, "near-dup-rows")
    found = near_dups.near_duplicates(rows, SIMILARITY, key="_row").select(F.col("doc_id").alias("_row"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row"))
    kept = found.join(rows.select("_row", "doc_id"), "_row").groupBy("component_id").agg(first.alias("first")).select("first._row")
    return rows.join(kept, "_row", "left_semi").select(COLUMNS)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the bytes of repeated strings out of the texts; characters cut in half go whole.

    All rows stay, an emptied text as an empty one; so does a null text. Repeated rows of 200 bytes or more
    would empty each other, but the stage before leaves one of them. Ties don't matter; an empty table stays empty.
    """
    kept = repeats.remove_repeats(docs.select(COLUMNS), whole_characters=True)
    return kept.withColumn("text", F.col("kept").cast("string")).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, whatever its doc_id; rows that the mix can't tell apart are ordered by text."""
    rows = numbered(docs, "mixing-rows")
    mixed = mixing.mix(rows.withColumn("_tie", F.xxhash64("text")), carry=("_tie", "_row"))
    copies = mixed.filter("copies > 0").select("_row", "copies")
    return rows.join(copies, "_row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, in sequences of at most 4096 tokens; null texts and repeated rows are documents like any."""
    return packing.pack(docs, public_tokenizers.path(DEFAULT_TOKENIZER))


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_dup_stage),
    ("suffix-array dedup", repeats_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        earlier, docs = docs, durable(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if i:
            discard(earlier)  # the next stage's rows are written
    return STAGES[-1][1](spark, docs, sf_dir)
