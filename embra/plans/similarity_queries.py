"""Similarity / top-k queries over the embeddings table.

The embeddings table stands in for trained document vectors: documents
are ``vec_id``, categories are ``label`` with the mean document vector as
category vector, and every document forms one (document, category) pair.
For the two-model ("joint") searches the 64-dim vector is read as two
models of 32 dimensions each over the same pairs.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import dot, r6, r6_array, unit, vadd, vscale
from ..operators.similarity import knn, pair_norm, sum_vectors
from ..tables import embedding_vectors, table
from . import sqlh
from .registry import register

K = 3
KS = 5

# ---------------------------------------------------------------- SQL pieces
E = "(SELECT vec_id, label, embedding::DOUBLE[] AS vec FROM embeddings)"
CATS = sqlh.vec_agg(E, ["label"], "vec", "avg")
PAIRS = (f"(SELECT e.vec_id, e.label, {sqlh.unit(sqlh.vadd('e.vec', 'c.vec'))} AS uvec "
         f"FROM {E} e JOIN {CATS} c USING (label))")
DOCS_U = f"(SELECT vec_id, label, {sqlh.unit('vec')} AS uvec FROM {E})"


def half_sql(lo: str, hi: str) -> str:
    return f"(SELECT vec_id, label, embedding[{lo}:{hi}]::DOUBLE[] AS vec FROM embeddings)"


# the two models are the two halves of each vector, whatever its length
HA, HB = half_sql("1", "len(embedding) // 2"), half_sql("len(embedding) // 2 + 1", "len(embedding)")
CA, CB = sqlh.vec_agg(HA, ["label"], "vec", "avg"), sqlh.vec_agg(HB, ["label"], "vec", "avg")
JOINT = (f"(SELECT a.vec_id, a.label, {sqlh.unit(sqlh.vadd('a.vec', 'ca.vec'))} AS ua, "
         f"{sqlh.unit(sqlh.vadd('b.vec', 'cb.vec'))} AS ub, "
         f"{sqlh.unit(sqlh.vconcat(sqlh.vadd('a.vec', 'ca.vec'), sqlh.vadd('b.vec', 'cb.vec')))} AS uj, "
         f"{sqlh.unit('a.vec')} AS sa, {sqlh.unit('b.vec')} AS sb "
         f"FROM {HA} a JOIN {HB} b USING (vec_id, label) JOIN {CA} ca ON ca.label = a.label "
         f"JOIN {CB} cb ON cb.label = a.label)")


# -------------------------------------------------------------- Spark pieces
def category_vectors(spark, sf):
    e = embedding_vectors(spark, sf)
    return sum_vectors(e, ["label"], "vec", how="mean").withColumn("uvec", unit("vec"))


def _pairs(spark, sf):
    e = embedding_vectors(spark, sf)
    cats = sum_vectors(e, ["label"], "vec", how="mean")
    s = e.select(F.col("vec_id").alias("sent_no"), "vec")
    c = cats.select(F.col("label").alias("cat_no"), "vec")
    pr = e.select(F.col("vec_id").alias("sent_no"), F.col("label").alias("cat_no"))
    p = pair_norm(pr, s, c).select(F.col("sent_no").alias("vec_id"), F.col("cat_no").alias("label"), "uvec")
    return e, cats, p


def _halves(spark, sf):
    e = embedding_vectors(spark, sf)
    half = F.floor(F.size("vec") / 2).cast("int")
    a = e.select("vec_id", "label", F.slice("vec", F.lit(1), half).alias("vec"))
    b = e.select("vec_id", "label", F.slice("vec", half + 1, F.size("vec") - half).alias("vec"))
    ca = sum_vectors(a, ["label"], "vec", how="mean").withColumnRenamed("vec", "cvec")
    cb = sum_vectors(b, ["label"], "vec", how="mean").withColumnRenamed("vec", "cvec")
    ja = a.join(ca, "label").select("vec_id", "label", vadd("vec", "cvec").alias("pa"),
                                   unit("vec").alias("sa"))
    jb = b.join(cb, "label").select("vec_id", vadd("vec", "cvec").alias("pb"), unit("vec").alias("sb"))
    return (ja.join(jb, "vec_id")
            .select("vec_id", "label", unit("pa").alias("ua"), unit("pb").alias("ub"),
                    unit(F.concat("pa", "pb")).alias("uj"), "sa", "sb"))


def _out(r, q="q_id", i="i_id", extra=()):
    return r.select(F.col("q_id").alias(q), F.col("i_id").alias(i), *extra, "rank", r6("sim").alias("sim"))


# ------------------------------------------------------------------ queries
@register("knn_cat", sql=f"""
WITH c AS (SELECT label, {sqlh.unit('vec')} AS uvec FROM {CATS})
SELECT q_id AS cat_id, i_id AS nbr_cat_id, rank, {sqlh.r6('sim')} AS sim
FROM {sqlh.knn('SELECT label AS q_id, uvec FROM c', 'SELECT label AS i_id, uvec FROM c', K, exclude_self=True)}
""")
def knn_cat(spark, sf):
    """For each category, the K most similar other categories."""
    c = category_vectors(spark, sf)
    r = knn(c.select(F.col("label").alias("q_id"), "uvec"),
            c.select(F.col("label").alias("i_id"), "uvec"), K,
            q_vec="uvec", i_vec="uvec", exclude_self=True)
    return _out(r, "cat_id", "nbr_cat_id")


@register("unit_vectors", sql=f"SELECT vec_id, {sqlh.r6_list('uvec')} AS uvec FROM {DOCS_U}")
def q_unit_vectors(spark, sf):
    e = embedding_vectors(spark, sf)
    return e.select("vec_id", r6_array(unit("vec")).alias("uvec"))


@register("vec_lookup", sql=f"""
SELECT l.doc_id, {sqlh.r6_list('e.vec')} AS vec FROM labels l JOIN {E} e ON e.vec_id = l.doc_id""")
def q_vec_lookup(spark, sf):
    """Vector of every labelled document (equi-join lookup)."""
    e = embedding_vectors(spark, sf)
    lab = table(spark, sf, "labels").select("doc_id")
    return lab.join(e, lab.doc_id == e.vec_id).select("doc_id", r6_array("vec").alias("vec"))


@register("sent_similarity", sql=f"""
SELECT a.vec_id, b.vec_id AS next_id, {sqlh.r6('list_dot_product(a.uvec, b.uvec)')} AS sim
FROM {DOCS_U} a JOIN {DOCS_U} b ON b.vec_id = a.vec_id + 1""")
def q_sent_similarity(spark, sf):
    """Cosine of each document with the next document id."""
    e = embedding_vectors(spark, sf).select("vec_id", unit("vec").alias("u"))
    n = e.select(F.col("vec_id").alias("next_id"), F.col("u").alias("nu"))
    return (e.join(n, n.next_id == e.vec_id + 1)
            .select("vec_id", "next_id", r6(dot("u", "nu")).alias("sim")))


@register("cat_similarity", sql=f"""
WITH c AS (SELECT label, {sqlh.unit('vec')} AS uvec FROM {CATS})
SELECT a.label, b.label AS next_label, {sqlh.r6('list_dot_product(a.uvec, b.uvec)')} AS sim
FROM c a JOIN c b ON b.label = a.label + 1""")
def q_cat_similarity(spark, sf):
    """Cosine of each category with the next category id."""
    c = category_vectors(spark, sf).select("label", "uvec")
    n = c.select(F.col("label").alias("next_label"), F.col("uvec").alias("nu"))
    return (c.join(n, n.next_label == c.label + 1)
            .select("label", "next_label", r6(dot("uvec", "nu")).alias("sim")))


@register("knn_sent", sql=f"""
SELECT q_id AS vec_id, i_id AS nbr_id, rank, {sqlh.r6('sim')} AS sim
FROM {sqlh.knn(f'SELECT vec_id AS q_id, uvec FROM {DOCS_U}', f'SELECT vec_id AS i_id, uvec FROM {DOCS_U}', KS, exclude_self=True)}""")
def q_knn_sent(spark, sf):
    """Top-5 most similar other documents of every document."""
    e = embedding_vectors(spark, sf).select("vec_id", unit("vec").alias("uvec"))
    r = knn(e.select(F.col("vec_id").alias("q_id"), "uvec"), e.select(F.col("vec_id").alias("i_id"), "uvec"),
            KS, q_vec="uvec", i_vec="uvec", exclude_self=True)
    return _out(r, "vec_id", "nbr_id")


@register("knn_sent_cand", sql=f"""
SELECT q_id AS vec_id, i_id AS nbr_id, rank, {sqlh.r6('sim')} AS sim
FROM {sqlh.knn(f'SELECT vec_id AS q_id, uvec FROM {DOCS_U}',
               f'SELECT vec_id AS i_id, uvec FROM {DOCS_U} WHERE vec_id IN (SELECT doc_id FROM labels WHERE quality = 1)',
               KS, exclude_self=True)}""")
def q_knn_sent_cand(spark, sf):
    """Top-5 documents among the candidates (labelled quality=1); the
    candidate list is a semi-join applied before scoring."""
    e = embedding_vectors(spark, sf).select("vec_id", unit("vec").alias("uvec"))
    cand = table(spark, sf, "labels").filter(F.col("quality") == 1).select(F.col("doc_id").alias("vec_id"))
    items = e.join(cand, "vec_id", "left_semi")
    r = knn(e.select(F.col("vec_id").alias("q_id"), "uvec"),
            items.select(F.col("vec_id").alias("i_id"), "uvec"), KS, q_vec="uvec", i_vec="uvec",
            exclude_self=True)
    return _out(r, "vec_id", "nbr_id")


@register("pair_norm", sql=f"SELECT vec_id, label, {sqlh.r6_list('uvec')} AS uvec FROM {PAIRS}")
def q_pair_norm(spark, sf):
    _, _, p = _pairs(spark, sf)
    return p.select("vec_id", "label", r6_array("uvec").alias("uvec"))


_PQ = (f"SELECT e.vec_id AS q_id, {sqlh.unit(sqlh.vadd('e.vec', 'c.vec'))} AS uvec "
       f"FROM {E} e JOIN {CATS} c USING (label)")


@register("knn_pair_sum", sql=f"""
SELECT q_id AS vec_id, i_id AS pair_vec_id, rank, {sqlh.r6('sim')} AS sim
FROM {sqlh.knn(_PQ, f'SELECT vec_id AS i_id, uvec FROM {PAIRS}', KS, exclude_self=True)}""")
def q_knn_pair_sum(spark, sf):
    """dot(unit(s + c), pair table) top-5 for every document's own (s, c)."""
    e, cats, p = _pairs(spark, sf)
    q = e.join(cats.withColumnRenamed("vec", "cvec"), "label").select(
        F.col("vec_id").alias("q_id"), unit(vadd("vec", "cvec")).alias("uvec"))
    r = knn(q, p.select(F.col("vec_id").alias("i_id"), "uvec"), KS, q_vec="uvec", i_vec="uvec",
            exclude_self=True)
    return _out(r, "vec_id", "pair_vec_id")


@register("knn_pair_sum_ident", sql=f"""
SELECT q_id AS vec_id, grp AS label, i_id AS pair_vec_id, rank, {sqlh.r6('sim')} AS sim
FROM {sqlh.knn_grouped(_PQ, f'SELECT vec_id AS i_id, label AS grp, uvec FROM {PAIRS}', K, 'q.q_id <> i.i_id')}""")
def q_knn_pair_sum_ident(spark, sf):
    """As knn_pair_sum keeping only the best pair per category (top-3 categories)."""
    e, cats, p = _pairs(spark, sf)
    q = e.join(cats.withColumnRenamed("vec", "cvec"), "label").select(
        F.col("vec_id").alias("q_id"), unit(vadd("vec", "cvec")).alias("uvec"))
    r = knn(q, p.select(F.col("vec_id").alias("i_id"), "label", "uvec"), K, q_vec="uvec", i_vec="uvec",
            exclude_self=True, i_group="label")
    return _out(r, "vec_id", "pair_vec_id", extra=("label",))


_CQ = (f"SELECT e.vec_id AS q_id, {sqlh.vconcat(sqlh.vscale(sqlh.unit('e.vec'), '0.5::DOUBLE'), sqlh.vscale(sqlh.unit('c.vec'), '0.5::DOUBLE'))} AS uvec "
       f"FROM {E} e JOIN {CATS} c USING (label)")
_CI = (f"SELECT e.vec_id AS i_id, {sqlh.vconcat(sqlh.unit('e.vec'), sqlh.unit('c.vec'))} AS uvec "
       f"FROM {E} e JOIN {CATS} c USING (label)")


@register("knn_pair_concat", sql=f"""
SELECT q_id AS vec_id, i_id AS pair_vec_id, rank, {sqlh.r6('sim')} AS sim
FROM {sqlh.knn(_CQ, _CI, KS, exclude_self=True)}""")
def q_knn_pair_concat(spark, sf):
    """0.5 cos(s, s') + 0.5 cos(c, c') over pairs, as one dot product of
    concatenated unit vectors."""
    e = embedding_vectors(spark, sf)
    cats = sum_vectors(e, ["label"], "vec", how="mean").withColumnRenamed("vec", "cvec")
    j = e.join(cats, "label")
    q = j.select(F.col("vec_id").alias("q_id"),
                 F.concat(vscale(unit("vec"), 0.5), vscale(unit("cvec"), 0.5)).alias("uvec"))
    i = j.select(F.col("vec_id").alias("i_id"), F.concat(unit("vec"), unit("cvec")).alias("uvec"))
    r = knn(q, i, KS, q_vec="uvec", i_vec="uvec", exclude_self=True)
    return _out(r, "vec_id", "pair_vec_id")


@register("joint_pair_norm", sql=f"SELECT vec_id, label, {sqlh.r6_list('uj')} AS uvec FROM {JOINT}")
def q_joint_pair_norm(spark, sf):
    """unit(concat(s1 + c1, s2 + c2)) per pair, models joined on (doc, category)."""
    return _halves(spark, sf).select("vec_id", "label", r6_array("uj").alias("uvec"))


@register("knn_joint_concat", sql=f"""
SELECT q_id AS vec_id, i_id AS pair_vec_id, rank, {sqlh.r6('sim')} AS sim
FROM {sqlh.knn(f'SELECT vec_id AS q_id, uj AS uvec FROM {JOINT}', f'SELECT vec_id AS i_id, uj AS uvec FROM {JOINT}', KS, exclude_self=True)}""")
def q_knn_joint_concat(spark, sf):
    j = _halves(spark, sf)
    r = knn(j.select(F.col("vec_id").alias("q_id"), "uj"), j.select(F.col("vec_id").alias("i_id"), "uj"),
            KS, q_vec="uj", i_vec="uj", exclude_self=True)
    return _out(r, "vec_id", "pair_vec_id")


@register("knn_joint_sum_pair", sql=f"""
SELECT q_id AS vec_id, grp AS label, i_id AS pair_vec_id, rank, {sqlh.r6('sim')} AS sim
FROM {sqlh.knn_grouped(f'SELECT vec_id AS q_id, list_concat(ua, ub) AS uvec FROM {JOINT}',
                       f'SELECT vec_id AS i_id, label AS grp, list_concat(ua, ub) AS uvec FROM {JOINT}',
                       K, 'q.q_id <> i.i_id')}""")
def q_knn_joint_sum_pair(spark, sf):
    """Sum of both models' pair similarities (a dot product of the two unit
    vectors side by side), top-3 distinct categories."""
    j = _halves(spark, sf).withColumn("uab", F.concat("ua", "ub"))
    r = knn(j.select(F.col("vec_id").alias("q_id"), "uab"),
            j.select(F.col("vec_id").alias("i_id"), "label", "uab"), K, q_vec="uab", i_vec="uab",
            exclude_self=True, i_group="label")
    return _out(r, "vec_id", "pair_vec_id", extra=("label",))


@register("knn_joint_sum_sent", sql=f"""
SELECT q_id AS vec_id, grp AS label, i_id AS nbr_id, rank, {sqlh.r6('sim')} AS sim
FROM {sqlh.knn_grouped(f'SELECT vec_id AS q_id, list_concat(sa, sb) AS uvec FROM {JOINT}',
                       f'SELECT vec_id AS i_id, label AS grp, list_concat(sa, sb) AS uvec FROM {JOINT}',
                       K, 'q.q_id <> i.i_id')}""")
def q_knn_joint_sum_sent(spark, sf):
    """Sum of both models' document similarities; categories of the nearest
    documents, top-3 distinct."""
    j = _halves(spark, sf).withColumn("sab", F.concat("sa", "sb"))
    r = knn(j.select(F.col("vec_id").alias("q_id"), "sab"),
            j.select(F.col("vec_id").alias("i_id"), "label", "sab"), K, q_vec="sab", i_vec="sab",
            exclude_self=True, i_group="label")
    return _out(r, "vec_id", "nbr_id", extra=("label",))


_NAMES = "(SELECT DISTINCT CAST(doc_id AS VARCHAR) AS name FROM labels)"


@register("neighbours_of", sql=f"""
WITH c AS (SELECT CAST(label AS VARCHAR) AS name, {sqlh.unit('vec')} AS uvec FROM {CATS}),
d AS (SELECT CAST(vec_id AS VARCHAR) AS name, uvec FROM {DOCS_U}),
nc AS {sqlh.knn(f'SELECT n.name AS q_id, c.uvec FROM {_NAMES} n JOIN c USING (name)', 'SELECT name AS i_id, uvec FROM c', 10, exclude_self=True)},
nd AS {sqlh.knn(f'SELECT n.name AS q_id, d.uvec FROM {_NAMES} n JOIN d USING (name)', 'SELECT name AS i_id, uvec FROM d', 10, exclude_self=True)},
hits AS (SELECT q_id AS name, 'category' AS kind, i_id AS nbr, rank, sim FROM nc
         UNION ALL SELECT q_id, 'document', i_id, rank, sim FROM nd)
SELECT n.name, h.kind, h.nbr, h.rank, {sqlh.r6('h.sim')} AS sim
FROM {_NAMES} n LEFT JOIN hits h USING (name)""")
def q_neighbours_of(spark, sf):
    """Names (labelled doc ids) looked up as category and/or document; ten
    nearest of each kind without the name itself; unknown names kept with
    nulls."""
    names = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("name")).distinct()
    c = category_vectors(spark, sf).select(F.col("label").cast("string").alias("name"), "uvec")
    d = embedding_vectors(spark, sf).select(F.col("vec_id").cast("string").alias("name"),
                                            unit("vec").alias("uvec"))
    parts = []
    for kind, tab in (("category", c), ("document", d)):
        q = names.join(tab, "name").select(F.col("name").alias("q_id"), "uvec")
        r = knn(q, tab.select(F.col("name").alias("i_id"), "uvec"), 10, q_vec="uvec", i_vec="uvec",
                exclude_self=True)
        parts.append(r.select(F.col("q_id").alias("name"), F.lit(kind).alias("kind"),
                              F.col("i_id").alias("nbr"), "rank", "sim"))
    hits = parts[0].unionByName(parts[1])
    return names.join(hits, "name", "left").select("name", "kind", "nbr", "rank", r6("sim").alias("sim"))


@register("top_texts", sql=f"""
WITH c AS (SELECT label, {sqlh.unit('vec')} AS uvec FROM {CATS}),
r AS {sqlh.knn('SELECT label AS q_id, uvec FROM c', f'SELECT vec_id AS i_id, uvec FROM {DOCS_U}', K)}
SELECT r.q_id AS label, r.rank, r.i_id AS vec_id, {sqlh.r6('r.sim')} AS sim, d.text
FROM r LEFT JOIN documents d ON d.doc_id = r.i_id""")
def q_top_texts(spark, sf):
    """Top-3 documents of every category with their text."""
    c = category_vectors(spark, sf)
    e = embedding_vectors(spark, sf).select(F.col("vec_id").alias("i_id"), unit("vec").alias("uvec"))
    r = knn(c.select(F.col("label").alias("q_id"), "uvec"), e, K, q_vec="uvec", i_vec="uvec")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("i_id"), "text")
    return (r.join(docs, "i_id", "left")
            .select(F.col("q_id").alias("label"), "rank", F.col("i_id").alias("vec_id"),
                    r6("sim").alias("sim"), "text"))
