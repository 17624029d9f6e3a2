"""Corpus pipeline over the training-data operators.

``documents`` pass five stages: language ID, near-dedup, benchmark
decontamination, mixing to target weights and token-id files.  Every stage
takes what its predecessor kept; its output is written as Parquet and read
again.  All stages but the last return the columns of their input.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from embra.llm import decontam, langid, mix, queries, simhash  # noqa: E402
from embra.llm.common import scratch_uri  # noqa: E402
from embra.session import ensure_checkpoint_dir, ship_package  # noqa: E402
from embra.tables import table  # noqa: E402

MIN_SCORE = 0.5   # calibrated probability below which a prediction doesn't fill a missing language


def _ready(spark: SparkSession) -> None:
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters and those of no known language go: ``lang`` is missing and
    the prediction, which fills it otherwise, is unsure.  A given ``lang`` stays, however
    sure the model is.  The model learns from the folds that op9 learns from."""
    _ready(spark)
    cols = docs.columns
    model = langid.train(docs.filter(langid.fold(F.col("doc_id")) != 0))
    out = langid.predict(docs, model).filter((F.col("lang_pred") != langid.UNKNOWN) & (
        F.col("row.lang").isNotNull() | (F.col("score") >= MIN_SCORE)))
    return out.select(*[F.coalesce("row.lang", "lang_pred").alias(c) if c == "lang"
                        else F.col("row").getField(c).alias(c) for c in cols])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates stays: three-word shingles, three
    bits."""
    _ready(spark)
    return simhash.representatives(docs, shingle=3, bits=3)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more lies in passages of ``benchmark`` go."""
    _ready(spark)
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"), length=13, share=20)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated or left out, so that sources reach their target weights."""
    _ready(spark)
    return mix.mixed_rows(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id files of the mix, read back: one row per document and repeat."""
    _ready(spark)
    return queries.token_digest(spark, docs)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]

# fingerprints and token ids aren't expressible in SQL; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    _ready(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_uri(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
