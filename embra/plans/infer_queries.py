"""Inference queries: vectors for unseen documents and the
searches built on them.  Models are trained here on ``conversations``
(d=4, one epoch of two mini-batches); the unseen documents are the
``benchmark`` texts; 3 inference passes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import r6, r6_array, unit, vadd, vsub
from ..operators import train as T
from ..operators import vocab as V
from ..operators.infer import infer_vectors, inference_spec, pass_alphas
from ..operators.similarity import knn
from ..tables import benchmark_corpus, benchmark_corpus_sql, conversations_corpus, conversations_corpus_sql
from . import sqlh
from .registry import register
from .train_sql import (doc_denominator, fl, lines_sql, pos_sql, rand_vec_sql, state_sql, step_sql,
                        train_ctes)

ITERS = 3
K = 2
CAT_SPEC = T.TrainSpec(family="cat", arch="sg", hs=True, size=4, window=3, min_count=20, batches=2, seed=7)
SENT_SPEC = T.TrainSpec(family="sent", arch="cbow", hs=True, size=4, window=3, min_count=20, batches=2,
                        seed=7)
GIVEN_CAT = "user"


def infer_ctes(spec, cat_fixed="NULL"):
    ctes, final = train_ctes(spec, conversations_corpus_sql())
    ispec = inference_spec(spec)
    ctes.append(f"corpus2 AS ({benchmark_corpus_sql()})")
    ctes.append("docs2 AS (SELECT sent_id, row_number() OVER (ORDER BY first_line, sent_id) - 1 AS sent_no "
                "FROM (SELECT sent_id, min(line_no) AS first_line FROM corpus2 GROUP BY sent_id))")
    ctes += lines_sql(ispec, tag="2", corpus="corpus2", docs="docs2", keep_oov=True, cat_fixed=cat_fixed)
    ctes.append(f"wrows AS (SELECT * FROM {final} WHERE kind <> 'sent')")
    ctes.append(f"d0 AS (SELECT 'sent' AS kind, sent_no AS id, "
                f"{rand_vec_sql(ispec, 'inf', 'sent_id', doc_denominator(ispec))} AS vec, "
                f"{state_sql(ispec)} AS state FROM docs2)")
    for i, a in enumerate(pass_alphas(ispec, ITERS)):
        tag = f"_i{i}"
        ctes += pos_sql(ispec, epoch=i, tag=tag, lines="lines2")
        ctes.append(f"plk{i} AS (SELECT * FROM wrows UNION ALL SELECT * FROM d{i})")
        ctes += step_sql(ispec, 0, f"d{i}", f"d{i + 1}", f"SELECT {fl(a)} AS alpha", tag=tag, epoch=i,
                         p_lookup=f"plk{i}")
    return ctes, final, f"d{ITERS}"


def _w(ctes, body):
    return sqlh.with_ctes(ctes) + ",\n" + body


def _model(spark, sf, spec):
    corpus = conversations_corpus(spark, sf)
    params, vocab, docs, cats = T.train(corpus, spec)
    return corpus, params, vocab, docs, cats


def _inferred(spark, sf, spec, cat_no=None):
    corpus, params, vocab, docs, cats = _model(spark, sf, spec)
    inf = infer_vectors(benchmark_corpus(spark, sf), params, vocab, spec, ITERS, cat_no=cat_no)
    return corpus, params, vocab, docs, cats, inf


_C, _CF, _CD = infer_ctes(CAT_SPEC)


@register("infer_vec", sql=_w(_C, f"""
res AS (SELECT d2.sent_id, v.vec FROM {_CD} v JOIN docs2 d2 ON d2.sent_no = v.id)
SELECT sent_id, {sqlh.r6_list('vec')} AS vec FROM res"""))
def q_infer_vec(spark, sf):
    """Vectors of the benchmark texts under a category model trained on conversations."""
    *_, inf = _inferred(spark, sf, CAT_SPEC)
    return inf.select("sent_id", r6_array("vec").alias("vec"))


_PAIRS = f"""pairs AS (SELECT row_number() OVER (ORDER BY cat_no, sent_no) - 1 AS pair_no, sent_no, cat_no FROM
  (SELECT DISTINCT d.sent_no, c.cat_no FROM corpus JOIN docs d USING (sent_id) JOIN cats c USING (cat_id))),
pv AS (SELECT p.pair_no AS i_id, p.cat_no AS grp, p.sent_no, {sqlh.unit(sqlh.vadd('s.vec', 'c.vec'))} AS uvec
  FROM pairs p JOIN {_CF} s ON s.kind = 'sent' AND s.id = p.sent_no JOIN {_CF} c ON c.kind = 'cat' AND c.id = p.cat_no),
r AS {sqlh.knn_grouped(f'SELECT id AS q_id, {sqlh.unit("vec")} AS uvec FROM {_CD}', 'SELECT i_id, grp, uvec FROM pv', K)}"""


def _category_hits(spark, sf):
    corpus, params, vocab, docs, cats, inf = _inferred(spark, sf, CAT_SPEC)
    pairs = V.sent_cat_pairs(corpus, docs, cats)
    sv = params.filter(F.col("kind") == "sent").select(F.col("id").alias("sent_no"), F.col("vec").alias("sv"))
    cv = params.filter(F.col("kind") == "cat").select(F.col("id").alias("cat_no"), F.col("vec").alias("cv"))
    pv = pairs.join(sv, "sent_no").join(cv, "cat_no").select(
        F.col("pair_no").alias("i_id"), F.col("cat_no").alias("grp"), "sent_no", unit(vadd("sv", "cv")).alias("uvec"))
    r = knn(inf.select(F.col("sent_no").alias("q_id"), unit("vec").alias("uvec")),
            pv.select("i_id", "grp", "uvec"), K, q_vec="uvec", i_vec="uvec", i_group="grp")
    return r, inf, pv, docs, cats, params


@register("infer_category", sql=_w(_C, _PAIRS + """
SELECT d2.sent_id, r.rank, cats.cat_id, docs.sent_id AS pair_sent_id, """ + sqlh.r6("r.sim") + """ AS sim
FROM r JOIN docs2 d2 ON d2.sent_no = r.q_id JOIN pv ON pv.i_id = r.i_id JOIN cats ON cats.cat_no = r.grp
JOIN docs ON docs.sent_no = pv.sent_no"""))
def q_infer_category(spark, sf):
    """Infer, then the top-2 distinct categories by pair similarity."""
    r, inf, pv, docs, cats, _ = _category_hits(spark, sf)
    return (r.join(inf.select(F.col("sent_no").alias("q_id"), "sent_id"), "q_id")
            .join(pv.select("i_id", F.col("sent_no").alias("psn")), "i_id")
            .join(cats.select(F.col("cat_no").alias("grp"), "cat_id"), "grp")
            .join(docs.select(F.col("sent_no").alias("psn"), F.col("sent_id").alias("pair_sent_id")), "psn")
            .select("sent_id", "rank", "cat_id", "pair_sent_id", r6("sim").alias("sim")))


@register("infer_category_vecs", sql=_w(_C, _PAIRS + f""",
top AS (SELECT r.q_id, r.grp FROM r WHERE rank = 1)
SELECT d2.sent_id, cats.cat_id, {sqlh.r6_list('c.vec')} AS cat_vec,
       {sqlh.r6_list(sqlh.vsub('v.vec', 'c.vec'))} AS sent_vec
FROM top JOIN docs2 d2 ON d2.sent_no = top.q_id JOIN cats ON cats.cat_no = top.grp
JOIN {_CF} c ON c.kind = 'cat' AND c.id = top.grp JOIN {_CD} v ON v.id = top.q_id"""))
def q_infer_category_vecs(spark, sf):
    """The category vector of the top category and the document vector
    with it taken out (inferred + zero category - top category)."""
    r, inf, _, _, cats, params = _category_hits(spark, sf)
    cv = params.filter(F.col("kind") == "cat").select(F.col("id").alias("grp"), F.col("vec").alias("cat_vec"))
    top = r.filter(F.col("rank") == 1).select(F.col("q_id").alias("sent_no"), "grp")
    return (top.join(inf, "sent_no").join(cv, "grp")
            .join(cats.select(F.col("cat_no").alias("grp"), "cat_id"), "grp")
            .select("sent_id", "cat_id", r6_array("cat_vec").alias("cat_vec"),
                    r6_array(vsub("vec", "cat_vec")).alias("sent_vec")))


_S, _SF, _SD = infer_ctes(CAT_SPEC, cat_fixed=f"(SELECT cat_no FROM cats WHERE cat_id = '{GIVEN_CAT}')")


def _nearest_docs_sql(final, dname):
    return f"""
r AS {sqlh.knn(f'SELECT id AS q_id, {sqlh.unit("vec")} AS uvec FROM {dname}',
               f"SELECT id AS i_id, {sqlh.unit('vec')} AS uvec FROM {final} WHERE kind = 'sent'", 3)}
SELECT d2.sent_id, r.rank, docs.sent_id AS nbr_sent_id, {sqlh.r6('r.sim')} AS sim
FROM r JOIN docs2 d2 ON d2.sent_no = r.q_id JOIN docs ON docs.sent_no = r.i_id"""


def _nearest_docs(inf, params, docs):
    items = params.filter(F.col("kind") == "sent").select(F.col("id").alias("i_id"), unit("vec").alias("uvec"))
    r = knn(inf.select(F.col("sent_no").alias("q_id"), unit("vec").alias("uvec")), items, 3,
            q_vec="uvec", i_vec="uvec")
    return (r.join(inf.select(F.col("sent_no").alias("q_id"), "sent_id"), "q_id")
            .join(docs.select(F.col("sent_no").alias("i_id"), F.col("sent_id").alias("nbr_sent_id")), "i_id")
            .select("sent_id", "rank", "nbr_sent_id", r6("sim").alias("sim")))


@register("infer_sent_in_cat", sql=_w(_S, _nearest_docs_sql(_SF, _SD)))
def q_infer_sent_in_cat(spark, sf):
    """Infer with the category vector held at a given category, then the
    three nearest training documents."""
    corpus, params, vocab, docs, cats = _model(spark, sf, CAT_SPEC)
    cat_no = cats.filter(F.col("cat_id") == GIVEN_CAT).select("cat_no").first()[0]
    inf = infer_vectors(benchmark_corpus(spark, sf), params, vocab, CAT_SPEC, ITERS, cat_no=cat_no)
    return _nearest_docs(inf, params, docs)


_P, _PF, _PD = infer_ctes(SENT_SPEC)


@register("infer_sent", sql=_w(_P, _nearest_docs_sql(_PF, _PD)))
def q_infer_sent(spark, sf):
    """Paragraph model (DM): infer, then the three nearest training documents."""
    corpus, params, vocab, docs, cats, inf = _inferred(spark, sf, SENT_SPEC)
    return _nearest_docs(inf, params, docs)
