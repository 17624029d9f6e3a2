"""Streaming queries: run with trigger(availableNow=True)
over a file stream of a driver table, then read the sink table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.text import simple_preprocess
from ..functions.vectors import r6
from ..operators import train as T
from ..operators import vocab as V
from ..session import scratch_path
from ..streaming.infer import stream_infer
from ..streaming.word_count import read_counts, run_to_table, stream_word_count
from ..tables import benchmark_corpus, conversations_corpus, table
from . import sqlh
from .infer_queries import CAT_SPEC, ITERS, K, _C, _PAIRS
from .registry import register
from .vocab_queries import DOC_CORPUS, WC


def _scratch(spark, name):
    return scratch_path(spark, f"stream/{name}-{uuid.uuid4().hex[:12]}")


def _file_stream(spark, sf, name, triggers):
    """A driver table dealt into files, of which equal numbers arrive in every trigger.  There are as many as the table
    has splits, so that no task writes or reads a third of it."""
    t = table(spark, sf, name)
    path = _scratch(spark, name)
    each = -(-t.rdd.getNumPartitions() // triggers)
    t.repartition(triggers * each).write.parquet(path)
    return spark.readStream.schema(t.schema).option("maxFilesPerTrigger", each).parquet(path)


@register("stream_word_count", sql=f"WITH {DOC_CORPUS}, {WC} SELECT word, cnt FROM wc")
def q_stream_word_count(spark, sf):
    """Vocabulary counts of the documents table arriving as a stream; the state is carried
    over three triggers."""
    s = _file_stream(spark, sf, "documents", 3).select(simple_preprocess("text").alias("words"))
    out, ck = _scratch(spark, "wc"), _scratch(spark, "wc_ckpt")
    run_to_table(stream_word_count(s), out, ck)
    return read_counts(spark, out)


@register("stream_infer", sql=sqlh.with_ctes(_C) + ",\n" + _PAIRS + f"""
SELECT d2.sent_id, r.rank, cats.cat_id, {sqlh.r6('r.sim')} AS sim
FROM r JOIN docs2 d2 ON d2.sent_no = r.q_id JOIN cats ON cats.cat_no = r.grp""")
def q_stream_infer(spark, sf):
    """Benchmark texts arriving as a stream, each inferred against the
    category model and given its top-2 categories; equals the batch answer."""
    corpus = conversations_corpus(spark, sf)
    params, vocab, docs, cats = T.train(corpus, CAT_SPEC)
    pairs = V.sent_cat_pairs(corpus, docs, cats)
    b = benchmark_corpus(spark, sf)  # to reuse the corpus projection on the stream
    s = _file_stream(spark, sf, "benchmark", 2).select(
        F.col("item_id").alias("line_no"), F.lit(None).cast("string").alias("cat_id"),
        F.col("item_id").cast("string").alias("sent_id"), simple_preprocess("text").alias("words"))
    assert s.columns == b.columns
    out, ck = _scratch(spark, "infer"), _scratch(spark, "infer_ckpt")
    stream_infer(s, params, vocab, pairs, CAT_SPEC, out, ck, k=K, iterations=ITERS)
    res = spark.read.parquet(out)
    return (res.join(cats.select("cat_no", "cat_id"), "cat_no")
            .select("sent_id", "rank", "cat_id", r6("sim").alias("sim")))
