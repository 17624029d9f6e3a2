"""Model persistence: one Parquet
table per part of the model and a one-row ``meta`` table.  Normalised
caches are not stored; they are recomputed."""

from __future__ import annotations

import dataclasses
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.train import TrainSpec

PARTS = ("params", "vocab", "docs", "cats", "pairs")


def save_model(path: str, spec: TrainSpec, mode: str = "overwrite", **tables: DataFrame) -> None:
    """Write ``params`` (partitioned by kind) and any of vocab/docs/cats/pairs."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        if name not in PARTS or df is None:
            continue
        w = df.write.mode(mode)
        if name == "params":
            w = w.partitionBy("kind")
        w.parquet(f"{path}/{name}")
    meta = spark.createDataFrame([(spec.identifier(), json.dumps(dataclasses.asdict(spec)),
                                   ",".join(n for n, d in tables.items() if d is not None))],
                                 "model_id string, spec string, parts string")
    meta.write.mode(mode).parquet(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> tuple[TrainSpec, dict[str, DataFrame]]:
    meta = spark.read.parquet(f"{path}/meta").first()
    spec = TrainSpec(**json.loads(meta["spec"]))
    out = {}
    for name in meta["parts"].split(","):
        df = spark.read.parquet(f"{path}/{name}")
        if name == "params":
            df = df.select("kind", F.col("id").cast("long"), "vec", "state")
        out[name] = df
    return spec, out
