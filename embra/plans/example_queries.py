"""Example generation and training control."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import keyed_uniform, norm, r6, r6_array
from ..operators import train as T
from ..operators import vocab as V
from ..operators.similarity import knn, unit_vectors
from ..tables import (benchmark_corpus, benchmark_corpus_sql, conversations_corpus,
                      conversations_corpus_sql, documents_corpus, documents_corpus_sql)
from . import sqlh
from .registry import register
from .train_sql import fl, init_params_sql, prefix_ctes, examples_sql

W_SPEC = T.TrainSpec(family="word", size=4, window=3, min_count=2, batches=1, seed=7)
S_SPEC = T.TrainSpec(family="sent", size=4, window=3, min_count=2, batches=1, seed=7)
SUB_SPEC = T.TrainSpec(family="word", size=4, window=3, min_count=5, sample=1e-3, seed=7)
NEG_SPEC = T.TrainSpec(family="sent", size=4, window=3, min_count=2, batches=1, seed=7,
                       hs=False, negative=5)
C_SPEC = T.TrainSpec(family="cat", size=4, window=3, min_count=20, batches=1, seed=7)
LR_SPEC = T.TrainSpec(family="sent", size=4, window=3, min_count=2, batches=4, seed=7,
                      slice_len=16)
INIT_SPEC = T.TrainSpec(family="cat", size=4, min_count=20, hs=True, negative=3, optimizer="adam",
                        arch="cbow", seed=7)


def _with(ctes, select):
    return sqlh.with_ctes(ctes) + "\n" + select


def _lines(spark, sf, spec, corpus_fn, keep_oov=False):
    corpus = corpus_fn(spark, sf)
    vocab = V.build_vocab(corpus, spec.min_count, spec.sample, hs=spec.hs, negative=spec.negative)
    docs = V.doc_ids(corpus) if spec.family != "word" else None
    cats = V.cat_ids(corpus) if spec.family == "cat" else None
    return T.prepare_lines(corpus, vocab, spec, 0, docs, cats, keep_oov=keep_oov), vocab, docs, cats


@register("words_to_vocab", sql=_with(prefix_ctes(W_SPEC, benchmark_corpus_sql(), False),
                                      "SELECT line_no, idxs FROM lines"))
def q_words_to_vocab(spark, sf):
    """In-vocabulary token ids per line, OOV dropped and positions compacted."""
    lines, *_ = _lines(spark, sf, W_SPEC, benchmark_corpus)
    return lines.select("line_no", "idxs")


# corpus, vocabulary and the token table; lines are rebuilt with a left join
_GAPS = prefix_ctes(W_SPEC, benchmark_corpus_sql(), False)[:-2]


@register("words_to_vocab_gaps", sql=_with(_GAPS, """
SELECT t.line_no, list(v.idx ORDER BY t.opos) AS idxs FROM toks t LEFT JOIN vocab v ON v.word = t.word
GROUP BY t.line_no"""))
def q_words_to_vocab_gaps(spark, sf):
    """Token ids per line with null for OOV words (positions kept)."""
    lines, *_ = _lines(spark, sf, W_SPEC, benchmark_corpus, keep_oov=True)
    return lines.select("line_no", "idxs")


@register("subsample", sql=_with(prefix_ctes(SUB_SPEC, documents_corpus_sql("lang"), False),
                                 "SELECT line_no, idxs FROM lines"))
def q_subsample(spark, sf):
    """Frequent-word down-sampling with keyed draws (sample=1e-3)."""
    lines, *_ = _lines(spark, sf, SUB_SPEC, documents_corpus)
    return lines.select("line_no", "idxs")


@register("ctx_window", sql=_with(prefix_ctes(W_SPEC, benchmark_corpus_sql()),
                                  "SELECT line_no, i, word, lo, ctx FROM pos"))
def q_ctx_window(spark, sf):
    """Reduced context window of every position (inside the row, no self-join)."""
    lines, *_ = _lines(spark, sf, W_SPEC, benchmark_corpus)
    return T.positions(lines, W_SPEC).select("line_no", "i", "word", "lo", "ctx")


def _targets(spark, sf, spec):
    lines, vocab, *_ = _lines(spark, sf, spec, benchmark_corpus)
    pos = T.positions(lines, spec)
    _, tg = T.examples(pos, spec)
    return T.targets_out(tg, vocab, spec)


@register("hs_targets", sql=_with(prefix_ctes(S_SPEC, benchmark_corpus_sql()) + examples_sql(S_SPEC, 0),
                                  "SELECT line_no, i, j, out_id, label FROM outs0"))
def q_hs_targets(spark, sf):
    """Huffman path (inner node, 1-code) of every DBoW example."""
    return _targets(spark, sf, S_SPEC).select("line_no", "i", "j", "out_id", "label")


@register("neg_sample", sql=_with(prefix_ctes(NEG_SPEC, benchmark_corpus_sql()) + examples_sql(NEG_SPEC, 0),
                                  "SELECT line_no, i, j, out_id, label FROM outs0"))
def q_neg_sample(spark, sf):
    """Target + negative draws (noise interval lookup, draws equal to the target skipped)."""
    return _targets(spark, sf, NEG_SPEC).select("line_no", "i", "j", "out_id", "label")


@register("ids_lookup", sql=_with(prefix_ctes(C_SPEC, conversations_corpus_sql(), False),
                                  "SELECT line_no, sent_no, cat_no FROM lines"))
def q_ids_lookup(spark, sf):
    """Document and category numbers of every line (equi-joins on the id maps)."""
    lines, *_ = _lines(spark, sf, C_SPEC, conversations_corpus)
    return lines.select("line_no", "sent_no", "cat_no")


_LR = prefix_ctes(LR_SPEC, benchmark_corpus_sql())
from .train_sql import alphas_sql  # noqa: E402

_LR += alphas_sql(LR_SPEC)


@register("lr_schedule", sql=_with(_LR, f"SELECT CAST(b AS BIGINT) AS batch, {sqlh.r6('alpha')} AS alpha "
                                        "FROM alphas"))
def q_lr_schedule(spark, sf):
    """Learning rate of each of K=4 mini-batches (linear decay by words done)."""
    lines, vocab, *_ = _lines(spark, sf, LR_SPEC, benchmark_corpus)
    a = T.batch_alpha_frame(lines, vocab, LR_SPEC)
    return a.select("batch", r6("alpha").alias("alpha"))


_INIT = prefix_ctes(INIT_SPEC, conversations_corpus_sql(), False)
_INIT.append(f"p0 AS ({init_params_sql(INIT_SPEC)})")


def _init_params(spark, sf):
    corpus = conversations_corpus(spark, sf)
    vocab = V.build_vocab(corpus, INIT_SPEC.min_count, hs=True, negative=INIT_SPEC.negative)
    return T.init_params(INIT_SPEC, vocab, V.doc_ids(corpus), V.cat_ids(corpus)), vocab


@register("normalize_epoch", sql=_with(_INIT, f"SELECT kind, id, {sqlh.r6_list(sqlh.unit('vec'))} AS vec "
                                               "FROM p0"))
def q_normalize(spark, sf):
    """L2-normalise all parameter matrices (zero rows stay zero)."""
    p, _ = _init_params(spark, sf)
    return T.normalize_params(p).select("kind", "id", r6_array("vec").alias("vec"))


_SAN = _INIT + [
    "cn AS (SELECT max(sqrt(list_dot_product(vec, vec))) AS max_cat_norm FROM p0 WHERE kind = 'cat')",
    f"w AS (SELECT id, {sqlh.unit('vec')} AS uvec FROM p0 WHERE kind = 'syn0')",
    "nv2 AS (SELECT count(*) AS n FROM w)",
    f"picks AS (SELECT r, CAST(floor({sqlh.keyed_uniform(7, repr('sanity'), 'r')} * n) AS BIGINT) AS id "
    "FROM range(0, 10) t(r), nv2)",
    f"nn AS {sqlh.knn('SELECT p.r AS q_id, w.uvec FROM picks p JOIN w ON w.id = p.id', 'SELECT id AS i_id, uvec FROM w', 10, extra_where='i.i_id <> (SELECT id FROM picks WHERE r = q.q_id)')}",
    "s10 AS (SELECT avg(sim) AS sim10 FROM nn WHERE rank = 10)",
]


@register("sanity_check", sql=_with(_SAN, f"""
SELECT {sqlh.r6('max_cat_norm')} AS max_cat_norm, {sqlh.r6('sim10')} AS sim10,
       (max_cat_norm <= 100000 AND sim10 <= 0.9) AS ok FROM cn, s10"""))
def q_sanity(spark, sf):
    """Category max norm and, for CBOW, mean 10th-neighbour similarity of 10
    keyed-random words (draws with replacement, as in the reference)."""
    p, _ = _init_params(spark, sf)
    cn = p.filter(F.col("kind") == "cat").agg(F.max(norm("vec")).alias("max_cat_norm"))
    w = unit_vectors(p.filter(F.col("kind") == "syn0").select("id", "vec"))
    n = w.agg(F.count(F.lit(1)).alias("n"))
    picks = (p.sparkSession.range(10).select(F.col("id").alias("r"))
             .select("r", F.floor(keyed_uniform(7, F.lit("sanity"), F.col("r")) * n.scalar())
                     .cast("long").alias("wid")))
    q = picks.join(w, picks.wid == w.id).select(F.col("r").alias("q_id"), "uvec", F.array("wid").alias("ex"))
    nn = knn(q, w.select(F.col("id").alias("i_id"), "uvec"), 10, q_vec="uvec", i_vec="uvec", exclude="ex")
    s10 = nn.filter(F.col("rank") == 10).agg(F.avg("sim").alias("sim10"))
    out = cn.withColumn("sim10", s10.scalar())
    return out.select(r6("max_cat_norm").alias("max_cat_norm"), r6("sim10").alias("sim10"),
                      ((F.col("max_cat_norm") <= 100000) & (F.col("sim10") <= 0.9)).alias("ok"))


@register("model_summary", sql=_with(_INIT, f"""
SELECT count(*) AS vocab_size, max(len(vec)) AS size, {fl(INIT_SPEC.alpha)} AS alpha
FROM p0 WHERE kind = 'syn0'"""))
def q_model_summary(spark, sf):
    """Vocabulary size, dimension and alpha of a model."""
    p, _ = _init_params(spark, sf)
    return (p.filter(F.col("kind") == "syn0")
            .agg(F.count(F.lit(1)).alias("vocab_size"), F.max(F.size("vec")).alias("size"))
            .withColumn("alpha", F.lit(float(INIT_SPEC.alpha))))
