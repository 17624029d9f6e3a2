"""Driver tables and the corpus views derived from them.

corpus schema: line_no long, cat_id string, sent_id string, words array<string>
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import simple_preprocess
from .operators.ordering import dense_index

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents_corpus(spark: SparkSession, sf_dir: str, cat_col: str = "lang") -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("line_no"),
                    F.col(cat_col).cast("string").alias("cat_id"),
                    F.col("doc_id").cast("string").alias("sent_id"),
                    simple_preprocess("text").alias("words"))


def documents_corpus_sql(cat_col: str = "lang") -> str:
    from .functions.text import simple_preprocess_sql
    return (f"SELECT doc_id AS line_no, CAST({cat_col} AS VARCHAR) AS cat_id, "
            f"CAST(doc_id AS VARCHAR) AS sent_id, {simple_preprocess_sql('text')} AS words "
            f"FROM documents")


def conversations_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line per turn: sent_id = conversation, cat_id = role."""
    c = table(spark, sf_dir, "conversations")
    c = dense_index(c, [F.col("conv_id"), F.col("turn")], "line_no")
    return c.select("line_no", F.col("role").alias("cat_id"),
                    F.col("conv_id").cast("string").alias("sent_id"),
                    simple_preprocess("text").alias("words"))


def conversations_corpus_sql() -> str:
    from .functions.text import simple_preprocess_sql
    return ("SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS line_no, "
            "role AS cat_id, CAST(conv_id AS VARCHAR) AS sent_id, "
            f"{simple_preprocess_sql('text')} AS words FROM conversations")


def benchmark_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("line_no"), F.lit(None).cast("string").alias("cat_id"),
                    F.col("item_id").cast("string").alias("sent_id"),
                    simple_preprocess("text").alias("words"))


def benchmark_corpus_sql() -> str:
    from .functions.text import simple_preprocess_sql
    return ("SELECT item_id AS line_no, CAST(NULL AS VARCHAR) AS cat_id, "
            f"CAST(item_id AS VARCHAR) AS sent_id, {simple_preprocess_sql('text')} AS words "
            "FROM benchmark")


def part_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word sentences from part names (tiny vocabulary)."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("line_no"),
                    F.col("p_type").alias("cat_id"),
                    F.col("p_partkey").cast("string").alias("sent_id"),
                    F.split(F.lower(F.trim("p_name")), r"\s+").alias("words"))


def part_corpus_sql() -> str:
    return ("SELECT p_partkey AS line_no, p_type AS cat_id, CAST(p_partkey AS VARCHAR) AS sent_id, "
            "string_split_regex(lower(trim(p_name)), '\\s+') AS words FROM part")


def embedding_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, vec array<double>) from the embeddings table."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vec"))
