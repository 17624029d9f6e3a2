"""Inference of vectors for unseen documents.

The same synchronous gradient step as training, with every word, output
and category row frozen: only the new document rows learn.  Each pass
draws fresh windows / negatives (keyed by the pass number) and the
learning rate decays over the passes (SGD).  Out-of-vocabulary tokens keep
their positions as gaps.

Documents don't meet, so all passes of a document run in one task: its lines
are brought to one group together with the frozen rows that any pass reads, and
nothing is shuffled or written between passes.  Only documents with more than
``HOT_TOKENS`` tokens, whose lines are dealt over several groups, take their
passes one by one, their gradients summed by Spark.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import train as T
from . import train_vec as X
from . import vocab as V
from .param_store import ParamStore, whole_batches


def inference_spec(spec: T.TrainSpec) -> T.TrainSpec:
    return replace(spec, word_learn=False, cat_learn=False, batches=1)


def pass_alphas(spec: T.TrainSpec, iterations: int) -> list[float]:
    if spec.optimizer != "sgd":
        return [spec.alpha] * iterations
    return [max(spec.min_alpha, spec.alpha * (1 - 1.0 * i / iterations)) for i in range(iterations)]


def frozen_store(params: DataFrame, blocks: int | None = None) -> ParamStore:
    """The rows of a model that inference reads, placed once and shared by any number of calls."""
    return ParamStore(params.filter(F.col("kind") != "sent"), blocks)


def _updated(spec: T.TrainSpec, v: np.ndarray, s: np.ndarray, g: np.ndarray, alpha: float):
    """The optimizer's step (:func:`train.updated_rows`) on whole matrices -> vectors, states."""
    d = spec.size
    if spec.optimizer == "sgd":
        return v + alpha * g, s
    if spec.optimizer == "adagrad":
        s = s + g * g
        return v + alpha * g / np.sqrt(T.ADAGRAD_EPS + s), s
    if spec.optimizer == "adadelta":
        rho, eps = T.ADADELTA_RHO, T.ADADELTA_EPS
        sg = rho * s[:, :d] + (1 - rho) * g * g
        step = np.sqrt(eps + s[:, d:]) / np.sqrt(eps + sg) * g
        return v + step, np.hstack((sg, rho * s[:, d:] + (1 - rho) * step * step))
    b1, p1, p2 = (s[:, 2 * d + k, None] for k in range(3))
    m = b1 * s[:, :d] + (1 - b1) * g
    q = T.ADAM_B2 * s[:, d:2 * d] + (1 - T.ADAM_B2) * g * g
    v = v + T.ADAM_A * m / (1 - p1) / np.sqrt(T.ADAGRAD_EPS + q / (1 - p2))
    return v, np.hstack((m, q, b1 * T.ADAM_L, p1 * T.ADAM_B1, p2 * T.ADAM_B2))


def _all_passes(table: pa.Table, rows: pa.Table, spec: T.TrainSpec, alphas: list[float]) -> pa.Table:
    """The vectors of a group's documents after all passes."""
    have = X.Fetched(rows, spec)
    ids = have.ids[X.SENT]
    docs = have.mats["sent"][:len(ids)]
    state = np.zeros((len(ids), spec.state_width))
    if spec.optimizer == "adam":
        state[:, -3:] = T.ADAM_B1, T.ADAM_B1, T.ADAM_B2
    lines = X.Lines(table) if len(table) else None
    for i, alpha in enumerate(alphas if lines else []):
        step = X._Step(have.side, have.mats, spec, i)
        lines.feed(step, spec, None, have, docs)
        if X.SENT not in step.counts:
            continue
        n = step.counts[X.SENT][:len(ids)]
        at = np.flatnonzero(n)
        g = step.gradient(X.SENT, at)
        if spec.combine == "mean":
            g = g / n[at, None]
        v, s = _updated(spec, docs[at], state[at], g, alpha)
        docs = docs.copy()
        docs[at], state[at] = v, s
    offsets = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * spec.size)
    return pa.table({"sent_no": pa.array(ids), "vec": pa.ListArray.from_arrays(offsets, pa.array(docs.ravel()))})


def infer_vectors(new_corpus: DataFrame, params: DataFrame, vocab: DataFrame, spec: T.TrainSpec,
                  iterations: int = 5, cat_no: int | None = None, store: ParamStore | None = None,
                  groups: int | None = None) -> DataFrame:
    """(sent_id, sent_no, vec) for the documents of ``new_corpus``.

    ``cat_no`` holds the category vector at a model category (frozen);
    otherwise the category vector is absent (zero).  ``store``: from
    :func:`frozen_store`, to use a model more than once.
    """
    ispec = inference_spec(spec)
    store = store or frozen_store(params)
    alphas = pass_alphas(ispec, iterations)
    docs = V.doc_ids(new_corpus)
    lines = T.prepare_lines(new_corpus, vocab, ispec, 0, docs, None, keep_oov=True, segment_len=T.SEGMENT_LEN)
    lines = lines.withColumn("cat_no", F.lit(cat_no).cast("long")).checkpoint(eager=True)
    # initial vectors are keyed by the document id, so a document gets the
    # same vector whichever batch or stream trigger it arrives in
    first = docs.select("sent_id", "sent_no", T._init_vec("inf", F.col("sent_id"), ispec.size, ispec.seed,
                                                          T.doc_denominator(ispec)).alias("start"))
    hot = lines.groupBy("sent_no").agg(F.sum(F.col("c_hi") - F.col("c_lo")).alias("n")).filter(
        F.col("n") > X.HOT_TOKENS).select("sent_no").checkpoint(eager=True)
    done = _fused(lines.join(hot, "sent_no", "left_anti"), first, vocab, ispec, alphas, store, groups)
    if not hot.isEmpty():
        done = done.unionByName(_pass_by_pass(lines.join(hot, "sent_no", "left_semi"), first.join(hot, "sent_no"),
                                              params, vocab, ispec, alphas, groups))
    return first.join(done, "sent_no", "left").select(
        "sent_id", "sent_no", F.coalesce("vec", "start").alias("vec"))


def _fused(lines: DataFrame, first: DataFrame, vocab: DataFrame, spec: T.TrainSpec, alphas: list[float],
           store: ParamStore, groups: int | None) -> DataFrame:
    lines, _ = X.spread_lines(lines, spec, groups or X.group_count(lines, vocab, spec))
    keys, side = X.group_keys(lines, vocab, spec, list(range(len(alphas))), store)
    own = lines.select("part", "sent_no").distinct().join(first, "sent_no").select(
        F.col("part").alias("group"), F.lit("sent").alias("kind"), F.col("sent_no").alias("id"),
        F.col("start").alias("vec"))
    rows = X.fetched(store, keys.filter("kind <> 'sent'"), side, 0).unionByName(own, allowMissingColumns=True)

    def run(table: pa.Table, mine: pa.Table) -> pa.Table:
        return _all_passes(table, mine, spec, alphas)

    done = lines.groupBy("part").cogroup(rows.groupBy("group")).applyInArrow(run, "sent_no long, vec array<double>")
    with whole_batches(lines.sparkSession):
        return done.checkpoint(eager=True)


def _pass_by_pass(lines: DataFrame, first: DataFrame, params: DataFrame, vocab: DataFrame, spec: T.TrainSpec,
                  alphas: list[float], groups: int | None) -> DataFrame:
    rows = first.select(F.lit("sent").alias("kind"), F.col("sent_no").alias("id"), F.col("start").alias("vec"),
                        T.init_state(spec).alias("state"))
    store = ParamStore(params.filter(F.col("kind") != "sent").unionByName(rows))
    lines, _ = X.spread_lines(lines, spec, groups or X.group_count(lines, vocab, spec))
    for i, alpha in enumerate(alphas):
        keys, side = X.group_keys(lines, vocab, spec, [i], store)
        grads = X.gradients_vec(store, lines, keys, side, spec, epoch=i)
        store.append(T.updated_rows(store.read(grads, state=True), spec, alpha))
    return store.latest().filter(F.col("kind") == "sent").select(F.col("id").alias("sent_no"), "vec")
