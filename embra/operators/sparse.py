"""Sparse-corpus operators on long COO tables.

sparse : doc_no long, term_id int, weight double  (one row per non-zero)
dense  : id long, vec array<double>

Everything is per-row array work or a groupBy on the document; nothing
transposes a matrix into one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import dense_index

EPS = 1e-9


def num_terms(sparse: DataFrame) -> DataFrame:
    """One row: num_terms = max term id + 1 (0 when empty)."""
    return sparse.agg((F.coalesce(F.max("term_id"), F.lit(-1)) + 1).alias("num_terms"))


def max_term(sparse: DataFrame) -> DataFrame:
    return sparse.agg(F.coalesce(F.max("term_id"), F.lit(-1)).alias("max_term"))


def term_dict(sparse: DataFrame) -> DataFrame:
    """id -> str(id) for 0..max term id."""
    last = max_term(sparse).first()["max_term"]
    return sparse.sparkSession.range(last + 1).select(
        F.col("id").cast("int").alias("id"), F.col("id").cast("string").alias("name"))


def to_csc(sparse: DataFrame) -> DataFrame:
    """COO with its position in document-major order (the CSC data index)."""
    return dense_index(sparse, [F.col("doc_no"), F.col("term_id")], "pos")


def csc_indptr(csc: DataFrame) -> DataFrame:
    """(doc_no, start, stop) into the data array."""
    return csc.groupBy("doc_no").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("stop"))


def csc_shape(sparse: DataFrame) -> DataFrame:
    return sparse.agg(F.countDistinct("doc_no").alias("num_docs"),
                      (F.coalesce(F.max("term_id"), F.lit(-1)) + 1).alias("num_terms"),
                      F.count(F.lit(1)).alias("nnz"))


def to_docs(sparse: DataFrame) -> DataFrame:
    """(doc_no, terms, weights) sorted by term: the corpus form of a matrix.
    A document's entries are one group (bounded by the number of terms)."""
    g = sparse.groupBy("doc_no").agg(F.sort_array(F.collect_list(F.struct("term_id", "weight"))).alias("_e"))
    return g.select("doc_no", F.transform("_e", lambda e: e["term_id"]).alias("terms"),
                    F.transform("_e", lambda e: e["weight"]).alias("weights"))


def to_full(docs: DataFrame, length) -> DataFrame:
    """Dense array of ``length`` from (doc_no, terms, weights)."""
    ln = length if isinstance(length, Column) else F.lit(int(length))
    m = F.map_from_arrays("terms", "weights")
    return docs.select("doc_no", F.transform(F.sequence(F.lit(0), ln - 1),
                                             lambda i: F.coalesce(m[i], F.lit(0.0))).alias("vec"))


def full_to_sparse(dense: DataFrame, id_col: str = "id", vec: str = "vec", eps: float = EPS,
                   documents_columns: bool = False) -> DataFrame:
    """Long COO of the entries with |x| > eps.  ``documents_columns`` reads
    the matrix transposed (documents are columns), by swapping the roles."""
    e = dense.select(F.col(id_col).alias("_r"), F.posexplode(vec).alias("_c", "weight")) \
        .filter(F.abs("weight") > eps)
    if documents_columns:
        return e.select(F.col("_c").cast("long").alias("doc_no"), F.col("_r").cast("int").alias("term_id"),
                        "weight")
    return e.select(F.col("_r").alias("doc_no"), F.col("_c").cast("int").alias("term_id"), "weight")


def sparse_entries(vec: Column, eps: float = EPS) -> Column:
    """Row-wise: array<struct<i int, x double>> of entries with |x| > eps."""
    return F.filter(F.transform(vec, lambda x, i: F.struct(i.alias("i"), x.alias("x"))),
                    lambda e: F.abs(e["x"]) > eps)


def clip_top(vec: Column, topn: int, eps: float = EPS, by: str = "value") -> Column:
    """Top-n entries by signed value (``by='value'``) or magnitude; ties by index."""
    ent = sparse_entries(vec, eps)
    key = (lambda e: -e["x"]) if by == "value" else (lambda e: -F.abs(e["x"]))
    s = F.sort_array(F.transform(ent, lambda e: F.struct(key(e).alias("k"), e["i"].alias("i"),
                                                         e["x"].alias("x"))))
    return F.slice(F.transform(s, lambda e: F.struct(e["i"].alias("i"), e["x"].alias("x"))), 1, topn)


def argsort_topn(vec: Column, topn: int) -> Column:
    """Indices of the topn largest values, descending (ties by index)."""
    s = F.sort_array(F.transform(vec, lambda x, i: F.struct((-x).alias("k"), i.alias("i"))))
    return F.slice(F.transform(s, lambda e: e["i"]), 1, topn)


def veclen(sparse: DataFrame) -> DataFrame:
    """(doc_no, len): Euclidean length of every document with entries. A document whose
    entries are all zero is an error: sparse documents hold no explicit zeros."""
    ln = F.sqrt(F.sum(F.col("weight") * F.col("weight")))
    zero = F.raise_error(F.concat(F.lit("document with explicit zero entries only: "),
                                  F.col("doc_no").cast("string"))).cast("double")
    return sparse.groupBy("doc_no").agg(ln.alias("len")).withColumn(
        "len", F.when(F.col("len") > 0, F.col("len")).otherwise(zero))


def unitvec(sparse: DataFrame) -> DataFrame:
    ln = veclen(sparse)
    return (sparse.join(ln, "doc_no")
            .withColumn("weight", F.col("weight") / F.col("len")).drop("len"))


def cossim(pairs: DataFrame, sparse: DataFrame) -> DataFrame:
    """pairs (doc_a, doc_b) -> (doc_a, doc_b, sim); 0 when either is empty.
    Dot products by an equi-join on (document, term); no pair is formed
    beyond the requested ones."""
    u = unitvec(sparse)
    a = u.select(F.col("doc_no").alias("doc_a"), "term_id", F.col("weight").alias("wa"))
    b = u.select(F.col("doc_no").alias("doc_b"), "term_id", F.col("weight").alias("wb"))
    d = (pairs.join(a, "doc_a").join(b, ["doc_b", "term_id"])
         .groupBy("doc_a", "doc_b").agg(F.sum(F.col("wa") * F.col("wb")).alias("sim")))
    return (pairs.join(d, ["doc_a", "doc_b"], "left")
            .select("doc_a", "doc_b", F.coalesce("sim", F.lit(0.0)).alias("sim")))


def pad(dense: DataFrame, padrow: int, padcol: int, id_col: str = "id", vec: str = "vec") -> DataFrame:
    """Zero columns appended to every row, zero rows appended after the last id."""
    padrow, padcol = max(0, padrow), max(0, padcol)
    widened = dense.select(id_col, F.concat(vec, F.array_repeat(F.lit(0.0), padcol)).alias(vec))
    if padrow == 0:
        return widened
    stats = dense.agg(F.max(id_col).alias("_m"), F.max(F.size(vec)).alias("_w"))
    extra = stats.select(F.explode(F.sequence(F.col("_m") + 1, F.col("_m") + padrow)).alias(id_col),
                         F.array_repeat(F.lit(0.0), F.col("_w") + padcol).alias(vec))
    return widened.unionByName(extra)


def chunk_rows(df: DataFrame, order: list, n: int, id_col: str) -> DataFrame:
    """Consecutive chunks of n rows in ``order``: (chunk, n, ids)."""
    ix = dense_index(df.select(id_col), order, "_ix")
    return (ix.groupBy(F.floor(F.col("_ix") / n).cast("long").alias("chunk"))
            .agg(F.count(F.lit(1)).alias("n"),
                 F.sort_array(F.collect_list(id_col)).alias("ids")))


def is_corpus(df: DataFrame) -> bool:
    """True when ``df`` has the sparse-corpus shape (doc_no integral,
    term_id integral, weight numeric) and at least one row."""
    t = dict(df.dtypes)
    integral = ("int", "bigint", "smallint", "tinyint")
    weight = t.get("weight", "")
    numeric = weight in integral + ("double", "float") or weight.startswith("decimal")
    ok = t.get("doc_no") in integral and t.get("term_id") in integral and numeric
    return ok and not df.limit(1).isEmpty()
