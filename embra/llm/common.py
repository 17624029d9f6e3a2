"""Helpers shared by the training-data operators.

Intermediate tables are written below ``spark.checkpoint.dir`` (shared by the
driver and the executors) and read back: lineage ends there, a lost executor
never changes what a later step sees, and sampled range bounds or batch
numbers are fixed once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# Java regular expression of a word: anything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

# A-Z to a-z and nothing else, for UTF-8 bytes.
ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def scratch_uri(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    path = scratch_uri(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def null_key(col: Column) -> Column:
    """A non-null string key: equal exactly when the values are equal or both null."""
    return F.coalesce(F.concat(F.lit("v"), col.cast("string")), F.lit("n"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
