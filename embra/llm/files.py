"""Sharded binary files on the shared storage, committed through temporary names.

Tasks write to any file system that pyarrow can open (local mounts, object
stores, HDFS).  Every attempt writes under its own temporary name and reports
it in its output rows; Spark keeps the rows of one attempt of each task in the
manifest table, a second job renames exactly those files, and the commit ends
with the manifest under its final name.  Files of lost or repeated attempts
are never listed and are removed with the temporary folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or of a plain local path."""
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[len("file:"):]
    return pafs.FileSystem.from_uri(uri)


class TempFiles:
    """Files of one task attempt below ``<folder>/_temporary``."""

    def __init__(self, folder: str):
        self.fs, self.path = open_fs(folder)
        self.path += "/_temporary"
        self.fs.create_dir(self.path, recursive=True)

    def create(self):
        """-> (temporary name, open stream)"""
        name = f"{uuid.uuid4().hex}.tmp"
        return name, self.fs.open_output_stream(f"{self.path}/{name}", compression=None)

    def drop(self, name: str) -> None:
        self.fs.delete_file(f"{self.path}/{name}")


def commit(written: DataFrame, folder: str) -> DataFrame:
    """``written``: one row per file with ``tmp`` and its final ``name``, the output of
    the tasks that wrote them.  Returns the manifest table, read from storage."""
    spark = written.sparkSession
    pending = f"{folder}/_pending"
    written.write.mode("overwrite").parquet(pending)  # the attempts that count

    def rename(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_fs(folder)
        for b in batches:
            for tmp, name in zip(b.column("tmp").to_pylist(), b.column("name").to_pylist()):
                source, target = f"{path}/_temporary/{tmp}", f"{path}/{name}"
                # a repeated task finds its work done
                if fs.get_file_info(source).type != pafs.FileType.NotFound:
                    fs.move(source, target)
                elif fs.get_file_info(target).type == pafs.FileType.NotFound:
                    raise FileNotFoundError(target)
            yield b

    listed = spark.read.schema(written.schema).parquet(pending)
    listed.mapInArrow(rename, listed.schema).write.mode("overwrite").parquet(f"{folder}/_manifest")
    fs, path = open_fs(folder)
    if fs.get_file_info(f"{path}/_temporary").type != pafs.FileType.NotFound:
        fs.delete_dir(f"{path}/_temporary")
    return manifest(spark, folder, written.schema)


def manifest(spark: SparkSession, folder: str, schema=None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{folder}/_manifest").drop("tmp")


def one_task_per_file(files: DataFrame) -> DataFrame:
    """Spread manifest rows so that files are read in parallel."""
    n = max(1, files.count())
    limit = max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4)
    return files.repartition(min(n, limit), F.col("name"))
