"""Token counts as delta-maintained rollups.

A change of the corpus is a set of signed rows: an insert adds a document's
count, a delete subtracts it, a revised count subtracts the old and adds the
new one.  A batch of changes is summed by (source, language, tokenizer version)
before it is stored, so the store holds a few rows per batch and totals are
plain sums over batches, whatever their order.

Layout below the folder of a store:

    parts/<batch>/<attempt>     the sums of one attempt to write a batch
    commits/<batch>             one row naming the attempt that counts

A batch counts from the moment its commit is complete.  Applying a committed
batch again does nothing; an attempt that died before its commit is repeated
and never read.  One writer at a time.
"""

from __future__ import annotations

import uuid
from urllib.parse import quote

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import open_fs

DIMENSIONS = ["source", "lang", "tokenizer"]
SUMS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
COMMIT = "batch string, part string, covers array<string>"


def inserts(rows: DataFrame) -> DataFrame:
    """``rows`` with the dimensions and ``tokens`` -> signed rows that add them."""
    return rows.select(*DIMENSIONS, F.lit(1).cast("long").alias("n_docs"),
                       F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("n_tokens"))


def deletes(rows: DataFrame) -> DataFrame:
    s = inserts(rows)
    return s.select(*DIMENSIONS, (-F.col("n_docs")).alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Documents counted anew: their old rows and their new ones."""
    return deletes(old).unionByName(inserts(new))


class TokenRollup:
    """A store of token totals.  Null dimensions are values like any other; null counts
    are 0; an empty batch commits and changes nothing."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def committed(self, batch: str) -> bool:
        fs, path = open_fs(f"{self.folder}/commits/{quote(batch, safe='')}/_SUCCESS")
        return fs.get_file_info(path).type != pafs.FileType.NotFound

    def apply(self, batch: str, signed: DataFrame) -> bool:
        """Commit a batch of signed rows once; False if it was committed before."""
        if self.committed(batch):
            return False
        part = f"parts/{quote(batch, safe='')}/{uuid.uuid4().hex}"
        signed.groupBy(*DIMENSIONS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")) \
            .write.parquet(f"{self.folder}/{part}")
        self._commit(batch, part, [])
        return True

    def _commit(self, batch: str, part: str, covers: list[str]) -> None:
        # the commit protocol of the writer creates _SUCCESS last
        self.spark.createDataFrame([(batch, part, covers)], COMMIT).coalesce(1).write.mode("overwrite").parquet(
            f"{self.folder}/commits/{quote(batch, safe='')}")

    def _live(self) -> list:
        """Commits that no snapshot covers: one row per batch since the last snapshot."""
        fs, path = open_fs(f"{self.folder}/commits")
        found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
        done = [f.base_name for f in found if f.type == pafs.FileType.Directory
                and fs.get_file_info(f"{f.path}/_SUCCESS").type != pafs.FileType.NotFound]
        if not done:
            return []
        rows = self.spark.read.schema(COMMIT).parquet(
            *[f"{self.folder}/commits/{quote(n, safe='%')}" for n in done]).collect()
        covered = {b for r in rows for b in r["covers"]}
        return [r for r in rows if r["batch"] not in covered]

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) of all committed batches, without
        groups that have gone to nothing."""
        paths = [f"{self.folder}/{r['part']}" for r in self._live()]
        rows = self.spark.read.schema(SUMS).parquet(*paths) if paths \
            else self.spark.createDataFrame([], SUMS)
        return rows.groupBy(*DIMENSIONS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")) \
            .filter("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> None:
        """Fold all committed batches into one snapshot; their ids stay committed."""
        live = self._live()
        if len(live) < 2:
            return
        name = f"snapshot {uuid.uuid4().hex}"
        part = f"parts/{quote(name, safe='')}/{uuid.uuid4().hex}"
        self.totals().write.parquet(f"{self.folder}/{part}")
        self._commit(name, part, [r["batch"] for r in live] + [b for r in live for b in r["covers"]])
