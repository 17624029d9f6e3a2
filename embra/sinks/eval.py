"""Evaluation results: appended result lines and
the confusion matrix table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def result_lines(acc: DataFrame, model_id: str, prefix: str = "infer_cat") -> DataFrame:
    """``<prefix>_k<k><TAB><accuracy %f><TAB><model>`` per k."""
    return acc.select("k", F.format_string(f"{prefix}_k%d\t%f\t%s", F.col("k"), F.col("accuracy"),
                                           F.lit(model_id)).alias("value"))


def append_results(acc: DataFrame, path: str, model_id: str, prefix: str = "infer_cat") -> None:
    result_lines(acc, model_id, prefix).orderBy("k").select("value").write.mode("append").text(path)


def save_confusion(conf: DataFrame, path: str) -> None:
    conf.write.mode("overwrite").parquet(path)
