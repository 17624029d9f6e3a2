"""Text sinks: header lines + ordered data lines in one or more part files.

Rows are range-partitioned by the sort key, so part files follow the sort
order and the header (smallest key) starts the first part file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_lines(df: DataFrame, path: str, order: list, header: list[str] | DataFrame | None = None,
                compression: str | None = None, mode: str = "overwrite", value: Column | None = None) -> None:
    """Write ``df.value`` in ``order``; ``header`` lines (literal strings or
    a DataFrame of ``value``) come first.  ``value``: the line as an expression over
    ``df``, computed after the sort, whose sampling would run it once more."""
    if value is not None:
        if header is not None:
            raise ValueError("a header needs lines that are a column")
        w = df.orderBy(*order).select(value.alias("value")).write.mode(mode)
        if compression:
            w = w.option("compression", compression)
        w.text(path)
        return
    body = df.select(F.lit(1).alias("_h"), F.lit(0).cast("long").alias("_hn"), *order, "value")
    if header is not None:
        if isinstance(header, DataFrame):
            h = header.select("value")
            h = h.withColumn("_hn", F.monotonically_increasing_id())
        else:
            spark = df.sparkSession
            h = spark.createDataFrame([(i, v) for i, v in enumerate(header)], "_hn long, value string")
        for c in order:
            name = c if isinstance(c, str) else None
            if name is None:
                raise ValueError("order must be column names")
            h = h.withColumn(name, F.lit(None).cast(dict(df.dtypes)[name]))
        body = h.withColumn("_h", F.lit(0)).select(body.columns).unionByName(body)
    w = body.orderBy("_h", "_hn", *order).select("value").write.mode(mode)
    if compression:
        w = w.option("compression", compression)
    w.text(path)
