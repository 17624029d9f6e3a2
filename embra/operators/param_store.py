"""Versioned parameter rows, hash-partitioned into blocks by (kind, id).

A store is a base of all rows and a few layers of rows that changed since.  An
update appends one layer with the touched rows only; a read looks a key up in
the newest layer that has it, by joins of equally partitioned tables, so neither
moves rows that nobody asked for.  Layers are folded into a new base when there
are ``MAX_LAYERS`` of them.  Layers live in the shared checkpoint folder.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_LAYERS = 6
BLOCK_ROWS = 1 << 16  # rows of a block, about


@contextmanager
def with_conf(spark: SparkSession, name: str, value: str):
    """A setting for what runs inside."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def whole_batches(spark: SparkSession):
    """For rows that reach Python by groups of bounded size: Spark otherwise measures an Arrow batch after every row,
    which takes longer than all else that is done with rows of vectors."""
    return with_conf(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str((1 << 31) - 1))


def written(rows: DataFrame) -> DataFrame:
    """Rows written as they are partitioned and ordered, such that what reads them knows it: an adaptive plan's
    checkpoint forgets both, and every later join and group would move the rows again."""
    with with_conf(rows.sparkSession, "spark.sql.adaptive.enabled", "false"), whole_batches(rows.sparkSession):
        return rows.checkpoint(eager=True)


class ParamStore:
    """``params``: kind, id, vec, state (one row per key)."""

    def __init__(self, params: DataFrame, blocks: int | None = None):
        self.spark = params.sparkSession
        # as many as the rows need: what has a static plan isn't coalesced
        self.blocks = blocks or max(self.spark.sparkContext.defaultParallelism, -(-params.count() // BLOCK_ROWS))
        self.layers = [written(self.place(params))]

    def place(self, rows: DataFrame) -> DataFrame:
        """Rows in their blocks, in key order, so that reads merge without sorting."""
        return rows.repartition(self.blocks, "kind", "id").sortWithinPartitions("kind", "id")

    def read(self, keys: DataFrame, state: bool = False) -> DataFrame:
        """``keys`` (kind, id and more columns; best partitioned by :meth:`place`) with the
        latest ``vec`` (and ``state``); keys without a row are left out."""
        names = ["vec", "state"] if state else ["vec"]
        out = keys
        for k, layer in enumerate(reversed(self.layers)):
            out = out.join(layer.select("kind", "id", *[F.col(n).alias(f"_{n}{k}") for n in names]),
                           ["kind", "id"], "left")
        cols = [F.coalesce(*[F.col(f"_{n}{k}") for k in range(len(self.layers))]).alias(n) for n in names]
        return out.select(*keys.columns, *cols).filter(F.col("vec").isNotNull())

    def append(self, rows: DataFrame) -> None:
        """New versions of some rows."""
        if len(self.layers) == MAX_LAYERS:
            self.layers = [written(self.latest())]
        self.layers.append(written(self.place(rows.select("kind", "id", "vec", "state"))))

    def latest(self) -> DataFrame:
        """All rows in their latest version."""
        if len(self.layers) == 1:
            return self.layers[0]
        return self.read(self.layers[0].select("kind", "id"), state=True)
