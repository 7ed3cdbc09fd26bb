"""The folder that driver and executors share: intermediate rows that are read more than once, and tables that are kept."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where that is unset, as in tests, a folder of our own on a single machine; a cluster is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='talkmill-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder, if the session still lives."""
    if spark.sparkContext._jsc is not None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001  the session may be gone already
        return


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: it survives lost executors, and goes when the driver's interpreter ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/talkmill/{label}-{uuid.uuid4().hex}"
    atexit.register(_remove_at_exit, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
