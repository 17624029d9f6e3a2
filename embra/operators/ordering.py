"""Global positions and running sums without a single-partition window.

``row_number() over (order by ...)`` and ``sum() over (order by ...)``
without PARTITION BY move every row into one task.  The helpers here
split the order into ranges, compute per-range totals (one row per range,
broadcast), and finish inside each range.

Range bounds from ``repartitionByRange`` are sampled, and the sample
depends on the (non-deterministic) row order after a shuffle.  The two
branches (totals and in-range positions) must see the same ranges, so the
range-partitioned data is written once with a reliable ``checkpoint()``
(to the shared ``spark.checkpoint.dir``) before branching.  When the order
is already a dense 0-based index, fixed-width buckets of it are used
instead and nothing has to be written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DENSE_BUCKET_ROWS = 1 << 20


def _range_parts(df: DataFrame, order: list, num_partitions: int | None) -> DataFrame:
    # without a number, ranges of little data are put together: whatever reads the result has as few tasks
    n = [num_partitions] if num_partitions else []
    s = (df.repartitionByRange(*n, *order).sortWithinPartitions(*order)
         .withColumn("_mid", F.monotonically_increasing_id())
         .withColumn("_pid", F.shiftright("_mid", 33)))
    return s.checkpoint(eager=True)


def _offsets(s: DataFrame, key: str, value, name: str) -> DataFrame:
    counts = s.groupBy(key).agg(F.sum(value).alias("_n"))
    w = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(counts.withColumn(name, F.coalesce(F.sum("_n").over(w), F.lit(0)))
                       .select(key, name))


def dense_index(df: DataFrame, order: list, name: str = "idx",
                num_partitions: int | None = None) -> DataFrame:
    """0-based position of each row in ``order`` (which must be total).

    Within a partition ``monotonically_increasing_id`` is consecutive, so the
    local position is ``_mid - (_pid << 33)``; earlier partitions' row
    counts give the offset.
    """
    s = _range_parts(df, order, num_partitions)
    s = s.withColumn("_r", F.col("_mid") - F.shiftleft(F.col("_pid"), 33))
    off = _offsets(s, "_pid", F.lit(1), "_off")
    return (s.join(off, "_pid")
            .withColumn(name, (F.col("_off") + F.col("_r")).cast("long"))
            .drop("_mid", "_pid", "_r", "_off"))


def running_sum(df: DataFrame, order: list, value, name: str,
                num_partitions: int | None = None) -> DataFrame:
    """Inclusive running sum of ``value`` in ``order`` (a total order)."""
    s = _range_parts(df, order, num_partitions)
    off = _offsets(s, "_pid", value, "_off")
    w = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (s.join(off, "_pid")
            .withColumn(name, F.col("_off") + F.sum(value).over(w))
            .drop("_mid", "_pid", "_off"))


def running_sum_dense(df: DataFrame, idx: str, value, name: str,
                      bucket_rows: int = DENSE_BUCKET_ROWS) -> DataFrame:
    """Inclusive running sum in the order of a dense 0-based ``idx``.

    Buckets ``idx div bucket_rows`` are deterministic, so no sampling and
    no materialisation are needed.
    """
    b = df.withColumn("_b", F.floor(F.col(idx) / F.lit(bucket_rows)))
    off = _offsets(b, "_b", value, "_off")
    w = Window.partitionBy("_b").orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    return (b.join(off, "_b")
            .withColumn(name, F.col("_off") + F.sum(value).over(w))
            .drop("_b", "_off"))


def running_max(df: DataFrame, order: list, value, name: str) -> DataFrame:
    """Inclusive running max in ``order`` (range partitioned, as running_sum)."""
    s = _range_parts(df, order, None)
    tot = s.groupBy("_pid").agg(F.max(value).alias("_mx"))
    w0 = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    off = F.broadcast(tot.withColumn("_off", F.max("_mx").over(w0)).select("_pid", "_off"))
    w = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (s.join(off, "_pid")
            .withColumn(name, F.greatest(F.col("_off"), F.max(value).over(w)))
            .drop("_mid", "_pid", "_off"))


def running_max_dense(df: DataFrame, idx: str, value, name: str,
                      bucket_rows: int = DENSE_BUCKET_ROWS) -> DataFrame:
    """Inclusive running max in the order of a dense 0-based ``idx``
    (fixed-width buckets, nothing written)."""
    b = df.withColumn("_b", F.floor(F.col(idx) / F.lit(bucket_rows)))
    tot = b.groupBy("_b").agg(F.max(value).alias("_mx"))
    w0 = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    off = F.broadcast(tot.withColumn("_off", F.max("_mx").over(w0)).select("_b", "_off"))
    w = Window.partitionBy("_b").orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    return (b.join(off, "_b")
            .withColumn(name, F.greatest(F.col("_off"), F.max(value).over(w)))
            .drop("_b", "_off"))
