"""Source / sink round trips.

Each query writes data derived from the driver tables in the reference's
file format to a fresh folder under the shared checkpoint directory,
reads it back with the matching reader and returns what was read.  The
SQL twin computes the same result directly from the tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.text import simple_preprocess, simple_preprocess_sql, tokenize, tokenize_sql
from ..functions.vectors import r6, r6_array
from ..operators import train as T
from ..operators import vocab as V
from ..operators.words import word_vectors
from ..session import scratch_path
from ..sinks.eval import append_results
from ..sinks.mm import HEADER_LINE, write_mm
from ..sinks.model import load_model, save_model
from ..sinks.text import write_lines
from ..sinks.vectors import save_doc_vectors, save_vocab, save_word2vec_binary, save_word2vec_text
from ..sources.mm import read_mm
from ..sources.text import (read_brown, read_cat_tsv, read_line_sentences, read_lines, read_questions,
                            read_text8, read_wiki, repeat_corpus)
from ..sources.vectors import read_doc_vectors, read_word2vec_binary, read_word2vec_text
from ..tables import conversations_corpus, conversations_corpus_sql, part_corpus, part_corpus_sql, table
from . import sqlh
from .registry import register
from .train_sql import train_ctes


def _scratch(spark, name):
    return scratch_path(spark, f"io/{name}-{uuid.uuid4().hex[:12]}")


# ------------------------------------------------------------ labelled TSV
def _conv_tsv_rows(spark, sf):
    c = conversations_corpus(spark, sf)
    return c.select("line_no", F.concat_ws("\t", F.concat(F.array("cat_id", "sent_id"), "words")).alias("value"))


CONV_SQL = f"SELECT line_no, cat_id, sent_id, words FROM ({conversations_corpus_sql()})"


@register("src_cat_tsv", sql=CONV_SQL)
def q_src_cat_tsv(spark, sf):
    """Labelled TSV (cat, sent, words...) written from conversations and read back."""
    path = _scratch(spark, "cat_tsv")
    write_lines(_conv_tsv_rows(spark, sf), path, ["line_no"])
    return read_cat_tsv(spark, path).select("line_no", "cat_id", "sent_id", "words")


@register("src_cat_tsv_split", sql=CONV_SQL)
def q_src_cat_tsv_split(spark, sf):
    """The same TSV split over ``source.aa`` / ``source.ab`` and read by the glob."""
    path = _scratch(spark, "cat_tsv_split")
    rows = _conv_tsv_rows(spark, sf)
    n = rows.count()
    write_lines(rows.filter(F.col("line_no") < n // 2), path + ".aa", ["line_no"])
    write_lines(rows.filter(F.col("line_no") >= n // 2), path + ".ab", ["line_no"])
    return read_cat_tsv(spark, path, split=True).select("line_no", "cat_id", "sent_id", "words")


# -------------------------------------------------------------------- wiki
def _wiki_rows(spark, sf):
    d = table(spark, sf, "documents")
    cats = F.concat_ws(" ", "lang", "source", F.concat_ws("/", "lang", "source"))
    words = simple_preprocess("text")
    return d.select("doc_id", F.concat_ws("\t", F.concat(
        F.array(F.col("doc_id").cast("string"), F.concat(F.lit("d"), F.col("doc_id").cast("string")),
                F.col("source"), cats), words)).alias("value"))


_WIKI_SQL = f"""WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS line_no, 'd' || doc_id AS sent_id,
  lang, source, {simple_preprocess_sql('text')} AS words FROM documents)
SELECT line_no, c AS cat_id, sent_id, words FROM (SELECT *, unnest([lang, source]) AS c FROM d)"""


@register("src_wiki", sql=_WIKI_SQL)
def q_src_wiki(spark, sf):
    """Wiki TSV (title, categories incl. one with '/', words) from documents."""
    path = _scratch(spark, "wiki")
    write_lines(_wiki_rows(spark, sf), path, ["doc_id"])
    return read_wiki(spark, path)


@register("src_wiki_sampled", sql=f"SELECT * FROM ({_WIKI_SQL}) WHERE "
                                  f"{sqlh.keyed_uniform(1120, 'line_no')} <= 0.5")
def q_src_wiki_sampled(spark, sf):
    """Wiki reader keeping a line iff its keyed draw <= 0.5 (all categories together)."""
    path = _scratch(spark, "wiki_sampled")
    write_lines(_wiki_rows(spark, sf), path, ["doc_id"])
    return read_wiki(spark, path, sample=0.5, seed=1120)


# ------------------------------------------------------- line / text8 / brown
def _doc_token_lines(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.array_join(simple_preprocess("text"), " ").alias("value"))


def _write_doc_lines(spark, sf, path, compression=None):
    """The documents' words, a line each."""
    write_lines(table(spark, sf, "documents").select("doc_id", "text"), path, ["doc_id"], compression=compression,
                value=F.array_join(simple_preprocess("text"), " "))


_LINE_SQL = (f"SELECT row_number() OVER (ORDER BY doc_id) - 1 AS line_no, {simple_preprocess_sql('text')} AS words "
             f"FROM documents")


@register("src_line", sql=_LINE_SQL)
def q_src_line(spark, sf):
    path = _scratch(spark, "line")
    _write_doc_lines(spark, sf, path)
    return read_line_sentences(spark, path).select("line_no", "words")


@register("src_compressed", sql=_LINE_SQL)
def q_src_compressed(spark, sf):
    """Line sentences written gzip-compressed, decoded transparently."""
    path = _scratch(spark, "line_gz")
    _write_doc_lines(spark, sf, path, "gzip")
    return read_line_sentences(spark, path).select("line_no", "words")


@register("src_compressed_bz2", sql=_LINE_SQL)
def q_src_compressed_bz2(spark, sf):
    """The same written with bzip2 (a splittable codec)."""
    path = _scratch(spark, "line_bz2")
    _write_doc_lines(spark, sf, path, "bzip2")
    return read_line_sentences(spark, path).select("line_no", "words")


@register("src_text8", sql=f"""
WITH d AS (SELECT doc_id, {simple_preprocess_sql('text')} AS words FROM documents),
c AS (SELECT doc_id, words, coalesce(sum(len(words)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING
      AND 1 PRECEDING), 0) AS off FROM d),
t AS (SELECT off, unnest(words) AS w, generate_subscripts(words, 1) AS k FROM c)
SELECT CAST(floor((off + k - 1) / 1000) AS BIGINT) AS line_no, list(w ORDER BY off + k) AS words FROM t GROUP BY 1""")
def q_src_text8(spark, sf):
    """The documents' token stream cut into 1000-token sentences."""
    path = _scratch(spark, "text8")
    write_lines(_doc_token_lines(spark, sf), path, ["doc_id"])
    return read_text8(spark, path).select("line_no", "words")


@register("src_brown", sql=f"""
SELECT line_no, words FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS line_no,
  list_transform(list_filter({tokenize_sql('text', lower=False)}, lambda t: length(t) % 3 = 2),
                 lambda t: lower(t) || '/' || upper(lang)) AS words FROM documents) WHERE len(words) > 0""")
def q_src_brown(spark, sf):
    """Tagged tokens ``word/TAG`` with some malformed tags (two slashes,
    a non-letter tag) that the reader drops; empty sentences dropped."""
    d = table(spark, sf, "documents")
    tag = F.upper("lang")

    def tagged(t):
        n = F.length(t) % 3
        return (F.when(n == 0, F.concat(t, F.lit("/"), tag, F.lit("/x")))
                .when(n == 1, F.concat(t, F.lit("/9"), tag))
                .otherwise(F.concat(t, F.lit("/"), tag, F.lit("q"))))

    rows = d.select("doc_id", F.array_join(F.transform(tokenize("text"), tagged), " ").alias("value"))
    path = _scratch(spark, "brown")
    write_lines(rows, path, ["doc_id"])
    return read_brown(spark, path).select("line_no", "words")


# --------------------------------------------------------------- questions
_Q_SQL = """q AS (SELECT a.p_brand AS brand, a.p_partkey AS pk,
  lower(split_part(a.p_name, ' ', 1)) || ' ' || lower(split_part(a.p_name, ' ', 2)) || ' ' ||
  lower(split_part(b.p_name, ' ', 1)) || ' ' || lower(split_part(b.p_name, ' ', 2)) AS value
  FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
l AS (SELECT brand, 0 AS kind, -1 AS pk, ': ' || brand AS value FROM (SELECT DISTINCT brand FROM q)
      UNION ALL SELECT brand, 1, pk, value FROM q),
n AS (SELECT *, row_number() OVER (ORDER BY brand, kind, pk) - 1 AS line_no FROM l)"""


@register("src_questions", sql=f"""WITH {_Q_SQL}
SELECT line_no, brand AS section, split_part(value, ' ', 1) AS wa, split_part(value, ' ', 2) AS wb,
       split_part(value, ' ', 3) AS wc, split_part(value, ' ', 4) AS expected FROM n WHERE kind = 1""")
def q_src_questions(spark, sf):
    """Analogy file (``: SECTION`` lines + questions) from consecutive parts; sections filled down."""
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_name")
    nx = p.select(F.col("p_partkey").alias("nk"), F.col("p_name").alias("nn"))
    q = p.join(nx, nx.nk == p.p_partkey + 1).select(
        F.col("p_brand").alias("brand"), F.col("p_partkey").alias("pk"),
        F.lower(F.concat_ws(" ", F.split("p_name", " ")[0], F.split("p_name", " ")[1],
                            F.split("nn", " ")[0], F.split("nn", " ")[1])).alias("value"))
    heads = q.select("brand").distinct().select("brand", F.lit(-1).cast("long").alias("pk"),
                                                F.concat(F.lit(": "), "brand").alias("value"))
    rows = (heads.withColumn("kind", F.lit(0)).unionByName(q.withColumn("kind", F.lit(1))))
    path = _scratch(spark, "questions")
    write_lines(rows, path, ["brand", "kind", "pk"])
    return read_questions(spark, path)


# ------------------------------------------------------------------ repeat
@register("src_repeat", sql="""
WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ix FROM documents),
n AS (SELECT count(*) AS n, CAST(floor(2.5 * count(*)) AS BIGINT) AS reps FROM documents)
SELECT c.i * n.n + d.ix AS row_no, d.doc_id FROM d, n, range(0, CAST(ceil(n.reps / n.n) AS BIGINT)) c(i)
WHERE c.i * n.n + d.ix < n.reps""")
def q_src_repeat(spark, sf):
    """Cycle the documents until exactly 2.5 x their number of rows."""
    d = table(spark, sf, "documents").select("doc_id")
    reps = int(2.5 * d.count())
    return repeat_corpus(d, [F.col("doc_id")], reps).select("row_no", "doc_id")


# ------------------------------------------------------------ word vectors
P_SPEC = T.TrainSpec(family="word", arch="sg", hs=True, size=4, window=2, min_count=1, batches=2, seed=7)


def _part_words(spark, sf):
    params, vocab, _, _ = T.train(part_corpus(spark, sf), P_SPEC)
    return word_vectors(params, vocab)


def _wv_sql(select):
    ctes, final = train_ctes(P_SPEC, part_corpus_sql())
    ctes.append(f"wv AS (SELECT v.word, v.idx, v.cnt, p.vec FROM vocab v JOIN {final} p "
                f"ON p.kind = 'syn0' AND p.id = v.idx)")
    ctes.append("wo AS (SELECT *, row_number() OVER (ORDER BY cnt DESC, idx) - 1 AS rank, "
                "count(*) OVER () AS V FROM wv)")
    return sqlh.with_ctes(ctes) + "\n" + select


@register("w2v_text", sql=_wv_sql(f"SELECT word, rank AS idx, cnt, {sqlh.r6_list('vec')} AS vec FROM wo"))
def q_w2v_text(spark, sf):
    """Word vectors saved in the text format with a vocabulary file, loaded back."""
    w = _part_words(spark, sf)
    path, vpath = _scratch(spark, "w2v_txt"), _scratch(spark, "w2v_vocab")
    save_word2vec_text(w, path, fvocab=vpath)
    r = read_word2vec_text(spark, path, fvocab=vpath)
    return r.select("word", "idx", "cnt", r6_array("vec").alias("vec"))


@register("w2v_text_novocab", sql=_wv_sql(f"SELECT word, rank AS idx, V - rank AS cnt, "
                                           f"{sqlh.r6_list('vec')} AS vec FROM wo"))
def q_w2v_text_novocab(spark, sf):
    """Text format without a vocabulary file: count = V - line number."""
    w = _part_words(spark, sf)
    path = _scratch(spark, "w2v_txt_nv")
    save_word2vec_text(w, path)
    r = read_word2vec_text(spark, path)
    return r.select("word", "idx", "cnt", r6_array("vec").alias("vec"))


@register("w2v_vocab", sql=_wv_sql("SELECT word, cnt FROM wo"))
def q_w2v_vocab(spark, sf):
    """Vocabulary file ``word count`` written and read back."""
    from ..sources.vectors import read_vocab
    w = _part_words(spark, sf)
    path = _scratch(spark, "vocab")
    save_vocab(w, path)
    return read_vocab(spark, path)


@register("w2v_binary", sql=_wv_sql(
    f"SELECT word, rank AS idx, V - rank AS cnt, "
    f"{sqlh.r6_list('list_transform(vec, lambda x: CAST(CAST(x AS FLOAT) AS DOUBLE))')} AS vec FROM wo"))
def q_w2v_binary(spark, sf):
    """Binary format (float32) written per partition and parsed back."""
    w = _part_words(spark, sf)
    path = _scratch(spark, "w2v_bin")
    save_word2vec_binary(w, path)
    r = read_word2vec_binary(spark, path)
    return r.select("word", "idx", "cnt", r6_array("vec").alias("vec"))


# ------------------------------------------------- paragraph / category vectors
C_SPEC = T.TrainSpec(family="cat", arch="sg", hs=True, size=4, window=3, min_count=20, batches=2, seed=7)


def _cv_sql(select):
    ctes, final = train_ctes(C_SPEC, conversations_corpus_sql())
    return sqlh.with_ctes(ctes) + ",\n" + select.replace("{final}", final)


@register("doc_vectors_text", sql=_cv_sql(f"""
res AS (SELECT 'sent' AS kind, d.sent_id AS id, d.sent_no AS no, p.vec FROM docs d JOIN {{final}} p
        ON p.kind = 'sent' AND p.id = d.sent_no
        UNION ALL SELECT 'cat', c.cat_id, c.cat_no, p.vec FROM cats c JOIN {{final}} p
        ON p.kind = 'cat' AND p.id = c.cat_no)
SELECT kind, id, no, {sqlh.r6_list('vec')} AS vec FROM res"""))
def q_doc_vectors_text(spark, sf):
    """Paragraph and category vector files (six header lines + id<TAB>vector)."""
    params, _, docs, cats = T.train(conversations_corpus(spark, sf), C_SPEC)
    sv = docs.join(params.filter(F.col("kind") == "sent").select(F.col("id").alias("sent_no"), "vec"), "sent_no") \
        .select(F.col("sent_id").alias("id"), F.col("sent_no").alias("no"), "vec")
    cv = cats.join(params.filter(F.col("kind") == "cat").select(F.col("id").alias("cat_no"), "vec"), "cat_no") \
        .select(F.col("cat_id").alias("id"), F.col("cat_no").alias("no"), "vec")
    sp, cp = _scratch(spark, "sents"), _scratch(spark, "cats")
    flags = dict(size=C_SPEC.size, sg=1, hs=1, negative=0, cbow_mean=0)
    save_doc_vectors(sv, sp, "sents", **flags)
    save_doc_vectors(cv, cp, "cats", **flags)
    rs, _ = read_doc_vectors(spark, sp)
    rc, _ = read_doc_vectors(spark, cp)
    return (rs.withColumn("kind", F.lit("sent")).unionByName(rc.withColumn("kind", F.lit("cat")))
            .select("kind", "id", "no", r6_array("vec").alias("vec")))


@register("doc_vectors_header", sql="""
SELECT 'sents_len' AS key, CAST(count(DISTINCT conv_id) AS VARCHAR) AS value FROM conversations
UNION ALL SELECT 'size', '4' UNION ALL SELECT 'sg', '1' UNION ALL SELECT 'hs', '1'
UNION ALL SELECT 'negative', '0' UNION ALL SELECT 'cbow_mean', '0'""")
def q_doc_vectors_header(spark, sf):
    """Header lines of a paragraph vector file, read back as (key, value)."""
    c = conversations_corpus(spark, sf)
    docs = V.doc_ids(c)
    v = docs.select(F.col("sent_id").alias("id"), F.col("sent_no").alias("no"),
                    F.array_repeat(F.lit(0.0), C_SPEC.size).alias("vec"))
    path = _scratch(spark, "sents_hdr")
    save_doc_vectors(v, path, "sents", size=C_SPEC.size, sg=1, hs=1, negative=0, cbow_mean=0)
    _, head = read_doc_vectors(spark, path)
    return head


# ------------------------------------------------------------ Matrix Market
_MM_SQL = """
WITH terms AS (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS term_id
               FROM (SELECT DISTINCT event_type FROM events)),
sp AS (SELECT e.user_id AS doc_no, t.term_id, sum(e.value) AS weight FROM events e JOIN terms t USING (event_type)
       GROUP BY e.user_id, t.term_id HAVING abs(sum(e.value)) > 1e-12),
dd AS (SELECT doc_no, list(term_id ORDER BY term_id) AS terms, list(weight ORDER BY term_id) AS weights
       FROM sp GROUP BY doc_no),
alld AS (SELECT r.i AS doc_no FROM (SELECT max(doc_no) AS m FROM sp), range(0, m + 1) r(i))
SELECT a.doc_no, coalesce(dd.terms, []::INTEGER[]) AS terms,
       """ + sqlh.r6_list("coalesce(dd.weights, []::DOUBLE[])") + """ AS weights
FROM alld a LEFT JOIN dd USING (doc_no)"""


@register("mm_roundtrip", sql=_MM_SQL)
def q_mm_roundtrip(spark, sf):
    """Sparse event corpus written as Matrix Market and read back, with
    implicit empty documents up to the header's document count."""
    from .sparse_queries import event_corpus
    path = _scratch(spark, "mm")
    write_mm(event_corpus(spark, sf), path)
    docs, _ = read_mm(spark, path)
    return docs.select("doc_no", "terms", r6_array("weights").alias("weights"))


@register("mm_transposed", sql=_MM_SQL)
def q_mm_transposed(spark, sf):
    """The same corpus as a term-document file (``term doc weight``), read with
    ``transposed=False``."""
    from .sparse_queries import event_corpus
    s = event_corpus(spark, sf).filter(F.abs("weight") > 1e-12)
    head = s.agg(F.format_string("%d %d %d", F.max("term_id") + 1, F.max("doc_no") + 1, F.count(F.lit(1))).alias("n"))
    rows = s.select("doc_no", "term_id", F.format_string(
        "%d %d %s", F.col("term_id") + 1, F.col("doc_no") + 1, F.col("weight").cast("string")).alias("value"))
    path = _scratch(spark, "mm_t")
    write_lines(rows, path, ["doc_no", "term_id"],
                header=head.select(F.explode(F.array(F.lit(HEADER_LINE), "n")).alias("value")))
    docs, _ = read_mm(spark, path, transposed=False)
    return docs.select("doc_no", "terms", r6_array("weights").alias("weights"))


@register("mm_metadata", sql="SELECT DISTINCT user_id AS doc_no, 'user ' || user_id AS metadata FROM events")
def q_mm_metadata(spark, sf):
    """Document metadata written beside the matrix and read back."""
    from .sparse_queries import event_corpus
    s = event_corpus(spark, sf)
    meta = s.select("doc_no").distinct().withColumn(
        "metadata", F.concat(F.lit("user "), F.col("doc_no").cast("string")))
    write_mm(s, _scratch(spark, "mm_m"), metadata=meta, metadata_path=(side := _scratch(spark, "mm_meta")))
    return spark.read.parquet(side)


# ------------------------------------------------------------------- model
def _init_model_sql():
    from .example_queries import _INIT
    return (sqlh.with_ctes(_INIT) +
            f"\nSELECT kind, id, {sqlh.r6_list('vec')} AS vec, {sqlh.r6_list('state')} AS state FROM p0")


@register("model_roundtrip", sql=_init_model_sql())
def q_model_roundtrip(spark, sf):
    """Model saved as Parquet tables + meta and loaded back."""
    from .example_queries import INIT_SPEC, _init_params
    p, vocab = _init_params(spark, sf)
    path = _scratch(spark, "model")
    save_model(path, INIT_SPEC, params=p, vocab=vocab)
    spec, t = load_model(spark, path)
    assert spec == INIT_SPEC
    return t["params"].select("kind", "id", r6_array("vec").alias("vec"), r6_array("state").alias("state"))


# -------------------------------------------------------------- eval results
def _eval_sql():
    from .eval_queries import _P_CAT, _Q_ALL, _acc_sql
    inner = _acc_sql(_P_CAT, _Q_ALL)
    return (f"SELECT printf('infer_cat_k%d\t%f\t%s', k, accuracy, 'embeddings') AS value FROM ({inner})")


@register("eval_results", sql=_eval_sql())
def q_eval_results(spark, sf):
    """Result lines appended to a result file and read back."""
    from .eval_queries import KS, _queries, preds_cat
    from ..operators.evaluate import accuracy_at
    acc = accuracy_at(_queries(spark, sf), preds_cat(spark, sf), KS).withColumn("accuracy", r6("accuracy"))
    path = _scratch(spark, "results")
    append_results(acc, path, "embeddings")
    return read_lines(spark, path).select("value")
