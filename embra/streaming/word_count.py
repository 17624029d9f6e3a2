"""Running vocabulary counts over a stream of sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import list_folders

COMPACT_EVERY = 16   # triggers whose deltas are folded into a new base


def stream_word_count(stream: DataFrame, words: str = "words") -> DataFrame:
    """Streaming (word, cnt): a stateful aggregation over arriving rows;
    the final answer equals the batch ``word_count``."""
    from ..operators.vocab import explode_tokens
    return (explode_tokens(stream.select(words), words)
            .groupBy("word").agg(F.count(F.lit(1)).alias("cnt")))


def run_to_table(counts: DataFrame, table_path: str, checkpoint: str, compact_every: int = COMPACT_EVERY):
    """Drain the available input (trigger availableNow) in update mode.

    Every trigger writes the words it changed, with their new counts, to a folder of its
    own and, when that is complete, a one-row marker; every ``compact_every`` triggers the
    latest counts are written as a new base.  Nothing that a reader may use is
    overwritten, and a repeated trigger replaces only its own folders by the same rows.
    Returns the stopped query."""
    def write(batch: DataFrame, epoch: int):
        spark = batch.sparkSession
        batch.select("word", "cnt").write.mode("overwrite").parquet(f"{table_path}/deltas/{epoch}")
        if (epoch + 1) % compact_every == 0:
            latest_counts(spark, table_path, epoch).write.mode("overwrite").parquet(f"{table_path}/bases/{epoch}")
            _mark(spark, table_path, "compacted", epoch)
        _mark(spark, table_path, "markers", epoch)

    q = (counts.writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def _mark(spark: SparkSession, table_path: str, kind: str, epoch: int) -> None:
    spark.range(1).select(F.lit(epoch).cast("long").alias("done")).write.mode("overwrite").parquet(
        f"{table_path}/{kind}/{epoch}")


def latest_counts(spark: SparkSession, table_path: str, epoch: int) -> DataFrame:
    """(word, cnt) after a trigger: the last base before it and the deltas since, of which
    the latest row of a word counts."""
    bases = [n for n in list_folders(f"{table_path}/compacted") if n < epoch]
    base = max(bases, default=-1)
    paths = [f"{table_path}/bases/{base}"] * (base >= 0) + [
        f"{table_path}/deltas/{n}" for n in list_folders(f"{table_path}/deltas") if base < n <= epoch]
    rows = spark.read.schema("word string, cnt long").parquet(*paths)
    # counts only grow: the latest is the largest
    return rows.groupBy("word").agg(F.max("cnt").alias("cnt"))


def read_counts(spark: SparkSession, table_path: str) -> DataFrame:
    """(word, cnt) of the last complete trigger."""
    return latest_counts(spark, table_path, max(list_folders(f"{table_path}/markers")))
