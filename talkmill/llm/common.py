"""Shared helpers: table access, durable intermediate tables, row packing."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a Python worker keeps from one task to the next; a task that has no use for it empties it.
WORKER_CACHES: list[dict] = []

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words are runs of anything but these; the same class as ``[^\x20\x09-\x0D]+``.
SPACES = "[ \\t\\n\\x0B\\f\\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_caches() -> None:
    """Gives a reused Python worker's memory back before a task of another kind."""
    for cache in WORKER_CACHES:
        cache.clear()
    pa.default_memory_pool().release_unused()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset, as in tests, one of our own on a single machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='talkmill-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the driver's interpreter ends."""
    path = f"{shared_dir(spark)}/talkmill/{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def discard(df: DataFrame) -> None:
    """Removes what ``durable`` wrote for ``df``; nothing may read it any more."""
    _remove(df.sparkSession, df.stored_at)


def _drop(spark: SparkSession, name: str) -> None:
    if spark.sparkContext._jsc is not None:
        try:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        except Exception:  # noqa: BLE001  the session may be gone already
            return


def scratch_table(spark: SparkSession, label: str) -> tuple[str, str]:
    """(name, path) of a new table of the catalogue in the shared folder; both go when the driver's interpreter ends."""
    name, path = f"talkmill_{label}_{uuid.uuid4().hex}", scratch_path(spark, label)
    atexit.register(_drop, spark, name)
    return name, path


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may be gone already
        return


def durable(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back.

    It cuts lineage and survives lost executors: whoever needs the rows again reads files.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def ascii_lower(col):
    return F.translate(col, ASCII_UPPER, ASCII_LOWER)


def small(df: DataFrame, rows: int) -> bool:
    """True if ``df`` has at most ``rows`` rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


#: A key with more than this share of all rows is hot; there are fewer such keys than its inverse.
HOT_SHARE = 1 / 1000


def join_skewed(left: DataFrame, right: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Left outer join of ``left`` to ``right``, which holds a combination of keys once; ``keys`` maps left columns to right ones.

    The rows of ``right`` for hot keys, at most 1 / HOT_SHARE, are broadcast; the others are joined by shuffle.
    """
    names, theirs = list(keys), list(keys.values())
    counts = left.groupBy(*names).agg(F.count("*").alias("_n"))
    total = F.broadcast(counts.agg(F.sum("_n").alias("_total")))
    hot = counts.join(total, F.col("_n") > F.col("_total") * HOT_SHARE).select(*[F.col(a).alias(f"_hot_{a}") for a in names])
    same = lambda other: reduce(lambda x, y: x & y, [F.col(a) == F.col(b) for a, b in zip(names, other, strict=True)])
    is_hot = same([f"_hot_{a}" for a in names])
    theirs_hot = reduce(lambda x, y: x & y, [F.col(b) == F.col(f"_hot_{a}") for a, b in keys.items()])
    often = left.join(F.broadcast(hot), is_hot, "left_semi").join(F.broadcast(right.join(F.broadcast(hot), theirs_hot, "left_semi")), same(theirs), "left")
    return often.unionByName(left.join(F.broadcast(hot), is_hot, "left_anti").join(right, same(theirs), "left"))
