"""Sparse-corpus queries.

Sparse corpus from ``events``: document = user_id, term = rank of the
event type name, weight = summed value.  Dense matrices come from
``embeddings``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import r6, r6_array
from ..operators import sparse as S
from ..operators.ordering import dense_index
from ..tables import embedding_vectors, table
from . import sqlh
from .registry import register

TOPN = 5

SP = """terms AS (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS term_id
                  FROM (SELECT DISTINCT event_type FROM events)),
sp AS (SELECT e.user_id AS doc_no, t.term_id, sum(e.value) AS weight FROM events e JOIN terms t USING (event_type)
       GROUP BY e.user_id, t.term_id),
nt AS (SELECT coalesce(max(term_id), -1) + 1 AS num_terms FROM sp)"""
EMB = "(SELECT vec_id, embedding::DOUBLE[] AS vec FROM embeddings)"


def event_corpus(spark, sf):
    ev = table(spark, sf, "events")
    terms = dense_index(ev.select("event_type").distinct(), [F.col("event_type")], "term_id")
    terms = terms.withColumn("term_id", F.col("term_id").cast("int"))
    return (ev.groupBy("user_id", "event_type").agg(F.sum("value").alias("weight"))
            .join(terms, "event_type")
            .select(F.col("user_id").alias("doc_no"), "term_id", "weight"))


@register("corpus_to_csc", sql=f"""WITH {SP}
SELECT doc_no, term_id, {sqlh.r6('weight')} AS weight, row_number() OVER (ORDER BY doc_no, term_id) - 1 AS pos
FROM sp""")
def q_corpus_to_csc(spark, sf):
    """COO entries with their CSC data position (documents as columns)."""
    c = S.to_csc(event_corpus(spark, sf))
    return c.select("doc_no", "term_id", r6("weight").alias("weight"), "pos")


@register("csc_indptr", sql=f"""WITH {SP},
c AS (SELECT doc_no, row_number() OVER (ORDER BY doc_no, term_id) - 1 AS pos FROM sp)
SELECT doc_no, min(pos) AS start, max(pos) + 1 AS stop FROM c GROUP BY doc_no""")
def q_csc_indptr(spark, sf):
    return S.csc_indptr(S.to_csc(event_corpus(spark, sf)))


@register("csc_shape", sql=f"""WITH {SP}
SELECT count(DISTINCT doc_no) AS num_docs, coalesce(max(term_id), -1) + 1 AS num_terms, count(*) AS nnz FROM sp""")
def q_csc_shape(spark, sf):
    return S.csc_shape(event_corpus(spark, sf))


@register("csc_to_corpus", sql=f"""WITH {SP}
SELECT doc_no, list(term_id ORDER BY term_id) AS terms, {sqlh.r6_list('list(weight ORDER BY term_id)')} AS weights
FROM sp GROUP BY doc_no""")
def q_csc_to_corpus(spark, sf):
    d = S.to_docs(event_corpus(spark, sf))
    return d.select("doc_no", "terms", r6_array("weights").alias("weights"))


_DENSE_SQL = f"""WITH {SP},
docs AS (SELECT DISTINCT doc_no FROM sp),
g AS (SELECT d.doc_no, r.i, coalesce(s.weight, 0.0::DOUBLE) AS w
      FROM docs d, nt, range(0, nt.num_terms + {{extra}}) r(i)
      LEFT JOIN sp s ON s.doc_no = d.doc_no AND s.term_id = r.i)
SELECT doc_no, {sqlh.r6_list('list(w ORDER BY i)')} AS vec FROM g GROUP BY doc_no"""


@register("corpus_to_dense", sql=_DENSE_SQL.format(extra=0))
def q_corpus_to_dense(spark, sf):
    sp = event_corpus(spark, sf)
    d = S.to_docs(sp).withColumn("_nt", S.num_terms(sp).scalar())
    return S.to_full(d, F.col("_nt")).select("doc_no", r6_array("vec").alias("vec"))


@register("sparse_to_full", sql=_DENSE_SQL.format(extra=3))
def q_sparse_to_full(spark, sf):
    """sparse2full with a length 3 beyond the number of terms (zeros)."""
    sp = event_corpus(spark, sf)
    d = S.to_docs(sp).withColumn("_nt", S.num_terms(sp).scalar() + 3)
    return S.to_full(d, F.col("_nt")).select("doc_no", r6_array("vec").alias("vec"))


@register("full_to_sparse", sql=f"""
SELECT vec_id AS doc_no, CAST(i - 1 AS INTEGER) AS term_id, {sqlh.r6('x')} AS weight
FROM (SELECT vec_id, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM {EMB}) WHERE abs(x) > 1e-9""")
def q_full_to_sparse(spark, sf):
    e = embedding_vectors(spark, sf)
    s = S.full_to_sparse(e, "vec_id", "vec")
    return s.select("doc_no", "term_id", r6("weight").alias("weight"))


@register("dense_to_corpus_t", sql=f"""
SELECT CAST(i - 1 AS BIGINT) AS doc_no, CAST(vec_id AS INTEGER) AS term_id, {sqlh.r6('x')} AS weight
FROM (SELECT vec_id, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM {EMB}) WHERE abs(x) > 1e-9""")
def q_dense_to_corpus_t(spark, sf):
    """Matrix with documents as columns: roles of rows and columns swapped."""
    e = embedding_vectors(spark, sf)
    s = S.full_to_sparse(e, "vec_id", "vec", documents_columns=True)
    return s.select("doc_no", "term_id", r6("weight").alias("weight"))


def _clip_sql(key: str) -> str:
    ent = (f"list_filter(list_transform(vec, lambda x, i: struct_pack(k := {key}, i := CAST(i - 1 AS INTEGER), "
           f"x := x)), lambda e: abs(e.x) > 1e-9)")
    top = f"list_sort({ent})[1:{TOPN}]"
    return (f"SELECT vec_id, list_transform({top}, lambda e: e.i) AS idx, "
            f"{sqlh.r6_list(f'list_transform({top}, lambda e: e.x)')} AS val FROM {EMB}")


def _clip(spark, sf, by):
    e = embedding_vectors(spark, sf)
    c = e.select("vec_id", S.clip_top(F.col("vec"), TOPN, by=by).alias("c"))
    return c.select("vec_id", F.transform("c", lambda t: t["i"]).alias("idx"),
                    r6_array(F.transform("c", lambda t: t["x"])).alias("val"))


@register("sparse_clip", sql=_clip_sql("-x"))
def q_sparse_clip(spark, sf):
    """Top-5 entries by signed value (the reference's coded behaviour)."""
    return _clip(spark, sf, "value")


@register("sparse_clip_abs", sql=_clip_sql("-abs(x)"))
def q_sparse_clip_abs(spark, sf):
    """Top-5 entries by magnitude (the documented behaviour)."""
    return _clip(spark, sf, "abs")


@register("argsort_topn", sql=f"""
SELECT vec_id, list_transform(list_sort(list_transform(vec, lambda x, i: struct_pack(k := -x,
       i := CAST(i - 1 AS INTEGER))))[1:3], lambda e: e.i) AS top FROM {EMB}""")
def q_argsort_topn(spark, sf):
    e = embedding_vectors(spark, sf)
    return e.select("vec_id", S.argsort_topn(F.col("vec"), 3).alias("top"))


@register("sparse_len", sql=f"WITH {SP} SELECT doc_no, {sqlh.r6('sqrt(sum(weight * weight))')} AS len "
                            "FROM sp GROUP BY doc_no")
def q_sparse_len(spark, sf):
    return S.veclen(event_corpus(spark, sf)).select("doc_no", r6("len").alias("len"))


@register("unit_vec", sql=f"""WITH {SP},
l AS (SELECT doc_no, sqrt(sum(weight * weight)) AS len FROM sp GROUP BY doc_no)
SELECT doc_no, term_id, {sqlh.r6('CASE WHEN len > 0 THEN weight / len ELSE weight END')} AS weight
FROM sp JOIN l USING (doc_no)""")
def q_unit_vec(spark, sf):
    return S.unitvec(event_corpus(spark, sf)).select("doc_no", "term_id", r6("weight").alias("weight"))


@register("sparse_cosine", sql=f"""WITH {SP},
pairs AS (SELECT DISTINCT a.user_id AS doc_a, b.user_id AS doc_b FROM events a JOIN events b
          ON b.event_id = a.event_id + 1),
l AS (SELECT doc_no, sqrt(sum(weight * weight)) AS len FROM sp GROUP BY doc_no),
u AS (SELECT doc_no, term_id, CASE WHEN len > 0 THEN weight / len ELSE weight END AS w FROM sp JOIN l USING (doc_no)),
d AS (SELECT p.doc_a, p.doc_b, sum(ua.w * ub.w) AS sim FROM pairs p JOIN u ua ON ua.doc_no = p.doc_a
      JOIN u ub ON ub.doc_no = p.doc_b AND ub.term_id = ua.term_id GROUP BY p.doc_a, p.doc_b)
SELECT p.doc_a, p.doc_b, {sqlh.r6('coalesce(d.sim, 0.0::DOUBLE)')} AS sim
FROM pairs p LEFT JOIN d USING (doc_a, doc_b)""")
def q_sparse_cosine(spark, sf):
    """Cosine of the users of consecutive events (pairs by an equi-join on event_id + 1)."""
    ev = table(spark, sf, "events").select("event_id", "user_id")
    nxt = ev.select(F.col("event_id").alias("nid"), F.col("user_id").alias("doc_b"))
    pairs = (ev.join(nxt, nxt.nid == ev.event_id + 1)
             .select(F.col("user_id").alias("doc_a"), "doc_b").distinct())
    c = S.cossim(pairs, event_corpus(spark, sf))
    return c.select("doc_a", "doc_b", r6("sim").alias("sim"))


@register("max_term", sql=f"WITH {SP} SELECT coalesce(max(term_id), -1) AS max_term FROM sp")
def q_max_term(spark, sf):
    return S.max_term(event_corpus(spark, sf))


@register("term_dict", sql=f"""WITH {SP}
SELECT CAST(r.id AS INTEGER) AS id, CAST(r.id AS VARCHAR) AS name
FROM (SELECT coalesce(max(term_id), -1) AS m FROM sp), range(0, m + 1) r(id)""")
def q_term_dict(spark, sf):
    return S.term_dict(event_corpus(spark, sf))


@register("pad_matrix", sql=f"""
SELECT vec_id, {sqlh.r6_list('list_concat(vec, [0.0::DOUBLE, 0.0::DOUBLE])')} AS vec FROM {EMB}
UNION ALL
SELECT m + r.i AS vec_id, list_transform(range(0, w + 2), lambda k: 0.0::DOUBLE) AS vec
FROM (SELECT max(vec_id) AS m, max(len(vec)) AS w FROM {EMB}), range(1, 4) r(i)""")
def q_pad_matrix(spark, sf):
    """Two zero columns and three zero rows appended."""
    e = embedding_vectors(spark, sf).select("vec_id", "vec")
    p = S.pad(e, 3, 2, "vec_id", "vec")
    return p.select("vec_id", r6_array("vec").alias("vec"))


@register("chunk_rows", sql="""
SELECT CAST(floor(ix / 1000) AS BIGINT) AS chunk, count(*) AS n, list(event_id ORDER BY event_id) AS ids
FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS ix FROM events) GROUP BY 1""")
def q_chunk_rows(spark, sf):
    """Consecutive chunks of 1000 events in event_id order."""
    ev = table(spark, sf, "events")
    return S.chunk_rows(ev, [F.col("event_id")], 1000, "event_id")
