"""Shared helpers: table access, the shared scratch folder, keyed text pieces."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Words of ASCII letters, ASCII digits and any character beyond ASCII; everything else separates.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset, a fresh one in a local session alone.

    What operators write there stays; whoever runs them removes it, as only they know when results are read.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not set_dir:
        set_dir = context.getCheckpointDir()
    if not set_dir:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        set_dir = tempfile.mkdtemp(prefix="spark-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(set_dir)
    return set_dir


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, kept in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def table(df: DataFrame, name: str) -> DataFrame:
    """The same rows written once as Parquet in the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def forget(df: DataFrame) -> None:
    """Removes what `table` wrote for `df`: for tables that no later step reads, so that they don't add up."""
    if files := df.inputFiles():
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0].rpartition("/")[0])
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(col):
    """A-Z lowered, all other characters as they are; texts of ASCII alone take the faster function."""
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def words(col):
    """Array of a text's words (null: no words)."""
    return F.coalesce(F.regexp_extract_all(ascii_lower(col), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))
