"""Training queries.

Every objective x optimizer is registered as one epoch of two synchronous
mini-batches at d=4 on a whole driver table, with a DuckDB twin that
repeats the same computation in SQL (Huffman tree by recursive CTE).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import r6_array
from ..operators import train as T
from ..operators import vocab as V
from ..tables import (benchmark_corpus, benchmark_corpus_sql, conversations_corpus,
                      conversations_corpus_sql)
from .registry import register
from ..operators.train_vec import train_epoch_vec
from .train_sql import epochs_sql, train_sql

D = 4
BASE = dict(size=D, window=3, negative=0, batches=2, alpha=0.025, seed=7)
NEG = 3


def corpus_for(family):
    if family == "cat":
        return conversations_corpus, conversations_corpus_sql, 20
    return benchmark_corpus, benchmark_corpus_sql, 2


def build_model_inputs(spark, sf, spec: T.TrainSpec, corpus_fn):
    corpus = corpus_fn(spark, sf)
    vocab = V.build_vocab(corpus, spec.min_count, spec.sample, hs=spec.hs,
                          negative=spec.negative).checkpoint(eager=True)
    docs = V.doc_ids(corpus) if spec.family != "word" else None
    cats = V.cat_ids(corpus) if spec.family == "cat" else None
    lines = T.prepare_lines(corpus, vocab, spec, 0, docs, cats).checkpoint(eager=True)
    return corpus, vocab, docs, cats, lines


def train_once(spark, sf, spec: T.TrainSpec, corpus_fn, vectorised: bool = True):
    _, vocab, docs, cats, lines = build_model_inputs(spark, sf, spec, corpus_fn)
    params = T.init_params(spec, vocab, docs, cats)
    step = train_epoch_vec if vectorised else T.train_epoch
    params = step(params, lines, vocab, spec, 0)
    return params.select("kind", "id", r6_array("vec").alias("vec"), r6_array("state").alias("state"))


def _register(name: str, spec: T.TrainSpec):
    cfn, csql, mc = corpus_for(spec.family)
    spec = T.with_spec(spec, min_count=mc).validate()

    @register(name, sql=train_sql(spec, csql()))
    def q(spark, sf, _spec=spec, _cfn=cfn):
        return train_once(spark, sf, _spec, _cfn)

    return q


# word model: skip-gram / CBOW x hs / negative (SGD)
for arch in ("sg", "cbow"):
    for obj in ("hs", "neg"):
        _register(f"w2v_{arch}_{obj}",
                  T.TrainSpec(family="word", arch=arch, hs=obj == "hs",
                              cbow_mean=arch == "cbow", **{**BASE, "negative": NEG if obj == "neg" else 0}))

# paragraph and category models: DBoW / DM x hs / negative x 4 optimizers
for fam, pre in (("sent", "d2v"), ("cat", "c2v")):
    for arch, aname in (("sg", "dbow"), ("cbow", "dm")):
        for obj in ("hs", "neg"):
            for opt in T.OPTIMIZERS:
                _register(f"{pre}_{aname}_{obj}_{opt}",
                          T.TrainSpec(family=fam, arch=arch, hs=obj == "hs", optimizer=opt,
                                      cbow_mean=(fam == "cat" and arch == "cbow"),
                                      **{**BASE, "negative": NEG if obj == "neg" else 0}))


def _init_sql():
    from . import sqlh
    from .train_sql import ids_sql, init_params_sql, vocab_sql
    ctes = [f"corpus AS ({conversations_corpus_sql()})"] + vocab_sql(INIT_SPEC) + ids_sql(INIT_SPEC)
    ctes.append(f"p0 AS ({init_params_sql(INIT_SPEC)})")
    return (sqlh.with_ctes(ctes) +
            f"\nSELECT kind, id, {sqlh.r6_list('vec')} AS vec, {sqlh.r6_list('state')} AS state FROM p0")


INIT_SPEC = T.TrainSpec(family="cat", size=D, min_count=20, hs=True, negative=NEG, optimizer="adam")


@register("init_weights", sql=_init_sql())
def q_init_weights(spark, sf):
    """Initial parameters (and ADAM state) of the category model on conversations."""
    _, vocab, docs, cats, _ = build_model_inputs(spark, sf, INIT_SPEC, conversations_corpus)
    p = T.init_params(INIT_SPEC, vocab, docs, cats)
    return p.select("kind", "id", r6_array("vec").alias("vec"), r6_array("state").alias("state"))


@register("words_trained", sql=f"""
WITH corpus AS ({benchmark_corpus_sql()}),
wc AS (SELECT word, count(*) AS cnt FROM (SELECT unnest(words) AS word FROM corpus) GROUP BY word),
vocab AS (SELECT word FROM wc WHERE cnt >= 2)
SELECT count(*) AS words_trained FROM (SELECT unnest(words) AS word FROM corpus) t JOIN vocab USING (word)""")
def q_words_trained(spark, sf):
    """Number of in-vocabulary tokens one epoch trains (no sub-sampling)."""
    spec = T.TrainSpec(family="sent", min_count=2)
    _, _, _, _, lines = build_model_inputs(spark, sf, spec, benchmark_corpus)
    return lines.agg(F.sum(F.size("idxs")).cast("long").alias("words_trained"))


# the 'mean' combination (each touched row moves by its mean gradient)
_register("c2v_dbow_hs_sgd_mean", T.TrainSpec(family="cat", arch="sg", hs=True, combine="mean",
                                              **{**BASE, "alpha": 0.5}))
_register("d2v_dm_neg_adam_mean", T.TrainSpec(family="sent", arch="cbow", hs=False, optimizer="adam",
                                              combine="mean", **{**BASE, "negative": NEG}))


# the relational form of the same step (no broadcast bound), kept in the gate
_REL = T.with_spec(T.TrainSpec(family="cat", arch="cbow", hs=True, negative=NEG, optimizer="adagrad",
                               cbow_mean=True, **{k: v for k, v in BASE.items() if k != "negative"}),
                   min_count=20).validate()


@register("c2v_dm_hsneg_adagrad_relational", sql=train_sql(_REL, conversations_corpus_sql()))
def q_relational(spark, sf):
    """Category DM with both objectives, computed with the relational step."""
    return train_once(spark, sf, _REL, conversations_corpus, vectorised=False)


# vocab_reuse: a category model on conversations whose word vectors start
# from a word model stored earlier (here: initial word vectors of benchmark)
REUSE_SPEC = T.TrainSpec(family="cat", size=D, min_count=20, hs=True, seed=7)
OLD_SPEC = T.TrainSpec(family="word", size=D, min_count=2, hs=True, seed=11)


def _reuse_sql():
    from . import sqlh
    from .train_sql import ids_sql, init_params_sql, rand_vec_sql, vocab_sql, word_denominator
    ctes = [f"corpus AS ({conversations_corpus_sql()})"] + vocab_sql(REUSE_SPEC) + ids_sql(REUSE_SPEC)
    ctes.append(f"p0 AS ({init_params_sql(REUSE_SPEC)})")
    ctes.append(f"ocorpus AS ({benchmark_corpus_sql()})")
    ctes.append("owc AS (SELECT word, count(*) AS cnt FROM (SELECT unnest(words) AS word FROM ocorpus) "
                "GROUP BY word)")
    ctes.append(f"ovocab AS (SELECT word, row_number() OVER (ORDER BY cnt DESC, word) - 1 AS idx FROM owc "
                f"WHERE cnt >= {OLD_SPEC.min_count})")
    ctes.append(f"old AS (SELECT word, {rand_vec_sql(OLD_SPEC, 'syn0', 'idx', word_denominator(OLD_SPEC))} "
                f"AS vec FROM ovocab)")
    return (sqlh.with_ctes(ctes) + f"""
SELECT v.word, p.id AS idx, {sqlh.r6_list('coalesce(o.vec, p.vec)')} AS vec, o.word IS NOT NULL AS reused
FROM p0 p JOIN vocab v ON v.idx = p.id LEFT JOIN old o ON o.word = v.word WHERE p.kind = 'syn0'""")


@register("vocab_reuse", sql=_reuse_sql())
def q_vocab_reuse(spark, sf):
    """Word vectors of a new model taken from a stored model where the word
    is known (equi-join on the word), initialised otherwise."""
    conv = conversations_corpus(spark, sf)
    vocab = V.build_vocab(conv, REUSE_SPEC.min_count, hs=True)
    p = T.init_params(REUSE_SPEC, vocab, V.doc_ids(conv), V.cat_ids(conv))
    bench = benchmark_corpus(spark, sf)
    ov = V.build_vocab(bench, OLD_SPEC.min_count, hs=True)
    old = T.init_params(OLD_SPEC, ov).filter(F.col("kind") == "syn0").join(
        ov.select(F.col("idx").alias("id"), "word"), "id").select("word", "vec")
    p2 = T.reuse_word_vectors(p, vocab, old).filter(F.col("kind") == "syn0")
    hit = old.select("word", F.lit(True).alias("_h"))
    return (p2.join(vocab.select(F.col("idx").alias("id"), "word"), "id").join(hit, "word", "left")
            .select("word", F.col("id").alias("idx"), r6_array("vec").alias("vec"),
                    F.coalesce("_h", F.lit(False)).alias("reused")))


_REL_DBOW = T.with_spec(T.TrainSpec(family="cat", arch="sg", hs=True, negative=NEG, optimizer="sgd",
                                    **{k: v for k, v in BASE.items() if k != "negative"}),
                        min_count=20).validate()


@register("c2v_dbow_hsneg_sgd_relational", sql=train_sql(_REL_DBOW, conversations_corpus_sql()))
def q_relational_dbow(spark, sf):
    """Category DBoW with both objectives, relational step (single-input shortcut)."""
    return train_once(spark, sf, _REL_DBOW, conversations_corpus, vectorised=False)


_LOOP = T.TrainSpec(family="cat", arch="cbow", hs=True, negative=2, cbow_mean=True, size=D, window=3, min_count=20,
                    sample=0.01, batches=3, epochs=2, slice_len=50, normalize_each_epoch=True, seed=7).validate()


@register("epoch_loop", sql=epochs_sql(_LOOP, conversations_corpus_sql()))
def q_epoch_loop(spark, sf):
    """Two epochs of three mini-batches with sub-sampling, vectors normalised after each."""
    params, *_ = T.train(conversations_corpus(spark, sf), _LOOP)
    return params.select("kind", "id", r6_array("vec").alias("vec"), r6_array("state").alias("state"))
