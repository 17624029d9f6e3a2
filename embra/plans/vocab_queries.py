"""Vocabulary, ids and derived tables, plus the implicit
lookups of 2.5 that do not need examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import r6
from ..operators import vocab as V
from ..tables import (conversations_corpus, conversations_corpus_sql, documents_corpus,
                      documents_corpus_sql, part_corpus, part_corpus_sql, table)
from . import sqlh
from .registry import register
from .train_sql import huffman_sql

MIN_COUNT = 5
SAMPLE = 1e-3

DOC_CORPUS = f"corpus AS ({documents_corpus_sql('lang')})"
CONV_CORPUS = f"corpus AS ({conversations_corpus_sql()})"
WC = "wc AS (SELECT word, count(*) AS cnt FROM (SELECT unnest(words) AS word FROM corpus) GROUP BY word)"
VOCAB = (f"vocab AS (SELECT word, cnt, row_number() OVER (ORDER BY cnt DESC, word) - 1 AS idx "
         f"FROM wc WHERE cnt >= {MIN_COUNT})")


def doc_vocab(spark, sf):
    return V.vocab_prune(V.word_count(documents_corpus(spark, sf)), MIN_COUNT)


@register("word_count", sql=f"WITH {DOC_CORPUS}, {WC} SELECT word, cnt FROM wc")
def q_word_count(spark, sf):
    return V.word_count(documents_corpus(spark, sf))


@register("corpus_stats", sql=f"""
WITH {DOC_CORPUS},
l AS (SELECT count(*) AS n_lines, CAST(sum(len(words)) AS BIGINT) AS n_words,
             count(DISTINCT sent_id) AS n_sents, count(DISTINCT cat_id) AS n_cats FROM corpus),
t AS (SELECT count(*) AS n_types FROM (SELECT DISTINCT unnest(words) FROM corpus))
SELECT * FROM l, t""")
def q_corpus_stats(spark, sf):
    return V.corpus_stats(documents_corpus(spark, sf))


@register("vocab_prune", sql=f"WITH {DOC_CORPUS}, {WC}, {VOCAB} SELECT word, cnt, idx FROM vocab")
def q_vocab_prune(spark, sf):
    return doc_vocab(spark, sf).select("word", "cnt", "idx")


@register("doc_ids", sql=f"""
WITH {CONV_CORPUS}
SELECT sent_id, row_number() OVER (ORDER BY first_line, sent_id) - 1 AS sent_no, first_line
FROM (SELECT sent_id, min(line_no) AS first_line FROM corpus GROUP BY sent_id)""")
def q_doc_ids(spark, sf):
    return V.doc_ids(conversations_corpus(spark, sf)).select("sent_id", "sent_no", "first_line")


@register("cat_ids", sql=f"""
WITH {DOC_CORPUS}
SELECT cat_id, row_number() OVER (ORDER BY first_line, cat_id) - 1 AS cat_no, first_line
FROM (SELECT cat_id, min(line_no) AS first_line FROM corpus GROUP BY cat_id)""")
def q_cat_ids(spark, sf):
    return V.cat_ids(documents_corpus(spark, sf)).select("cat_id", "cat_no", "first_line")


PAIRS_SQL = f"""
WITH {CONV_CORPUS},
docs AS (SELECT sent_id, row_number() OVER (ORDER BY first_line, sent_id) - 1 AS sent_no
         FROM (SELECT sent_id, min(line_no) AS first_line FROM corpus GROUP BY sent_id)),
cats AS (SELECT cat_id, row_number() OVER (ORDER BY first_line, cat_id) - 1 AS cat_no
         FROM (SELECT cat_id, min(line_no) AS first_line FROM corpus GROUP BY cat_id)),
p AS (SELECT sent_no, cat_no, count(*) AS n FROM corpus JOIN docs USING (sent_id)
      JOIN cats USING (cat_id) GROUP BY sent_no, cat_no)
SELECT row_number() OVER (ORDER BY cat_no, sent_no) - 1 AS pair_no, sent_no, cat_no, n FROM p"""


@register("sent_cat_pairs", sql=PAIRS_SQL)
def q_sent_cat_pairs(spark, sf):
    c = conversations_corpus(spark, sf)
    return V.sent_cat_pairs(c, V.doc_ids(c), V.cat_ids(c)).select("pair_no", "sent_no", "cat_no", "n")


@register("huffman")
def q_huffman(spark, sf):
    """Huffman codes of the pruned vocabulary (checked by invariants)."""
    return V.huffman(doc_vocab(spark, sf)).select("word", "idx", "cnt", "code", "point")


@register("noise_dist", sql=f"""
WITH {DOC_CORPUS}, {WC}, {VOCAB},
w AS (SELECT word, idx, pow(cnt::DOUBLE, 0.75) AS w FROM vocab),
c AS (SELECT word, idx, w, sum(w) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
             sum(w) OVER () AS z FROM w)
SELECT word, idx, {sqlh.r6('(cum - w) / z')} AS noise_lo,
       {sqlh.r6('CASE WHEN idx = (SELECT max(idx) FROM vocab) THEN 1.0::DOUBLE ELSE cum / z END')} AS noise_hi
FROM c""")
def q_noise_dist(spark, sf):
    v = V.noise_dist(doc_vocab(spark, sf))
    return v.select("word", "idx", r6("noise_lo").alias("noise_lo"), r6("noise_hi").alias("noise_hi"))


SAMPLE_SQL = (f"sv AS (SELECT word, idx, cnt, least((sqrt(cnt / t) + 1) * (t / cnt), 1.0::DOUBLE) AS p "
              f"FROM vocab, (SELECT sum(cnt) * {SAMPLE} AS t FROM vocab))")


@register("subsample_prob", sql=f"""
WITH {DOC_CORPUS}, {WC}, {VOCAB}, {SAMPLE_SQL}
SELECT word, idx, {sqlh.r6('p')} AS sample_prob FROM sv""")
def q_subsample_prob(spark, sf):
    v = V.subsample_prob(doc_vocab(spark, sf), SAMPLE)
    return v.select("word", "idx", r6("sample_prob").alias("sample_prob"))


@register("expected_words", sql=f"""
WITH {DOC_CORPUS}, {WC}, {VOCAB}, {SAMPLE_SQL}
SELECT {sqlh.r6('sum(cnt * p)')} AS expected_words FROM sv""")
def q_expected_words(spark, sf):
    e = V.expected_words(V.subsample_prob(doc_vocab(spark, sf), SAMPLE))
    return e.select(r6("expected_words").alias("expected_words"))


@register("sent_to_cat", sql=f"""
WITH {CONV_CORPUS} SELECT sent_id, arg_max(cat_id, line_no) AS cat_id FROM corpus GROUP BY sent_id""")
def q_sent_to_cat(spark, sf):
    return V.sent_to_cat(conversations_corpus(spark, sf))


@register("rev_dict", sql="SELECT lang AS key, max(doc_id) AS value FROM documents GROUP BY lang")
def q_rev_dict(spark, sf):
    return V.rev_dict(table(spark, sf, "documents"), "doc_id", "lang")


@register("oov_words", sql=f"""
WITH {DOC_CORPUS}, {WC}, {VOCAB}
SELECT wc.word, wc.cnt FROM wc ANTI JOIN vocab USING (word)""")
def q_oov_words(spark, sf):
    wc = V.word_count(documents_corpus(spark, sf))
    return wc.join(doc_vocab(spark, sf).select("word"), "word", "left_anti")


@register("vec_lookup_membership", sql=f"""
WITH {CONV_CORPUS}, words AS (SELECT DISTINCT unnest(words) AS word FROM corpus),
doc AS ({documents_corpus_sql('lang')}),
dwc AS (SELECT word, count(*) AS cnt FROM (SELECT unnest(words) AS word FROM doc) GROUP BY word),
vocab AS (SELECT word FROM dwc WHERE cnt >= {MIN_COUNT})
SELECT w.word, (v.word IS NOT NULL) AS in_vocab FROM words w LEFT JOIN vocab v USING (word)""")
def q_membership(spark, sf):
    """``word in model``: every word of the conversations against the
    documents vocabulary (left join, no collect)."""
    words = V.explode_tokens(conversations_corpus(spark, sf).select("words")).distinct()
    v = doc_vocab(spark, sf).select("word", F.lit(True).alias("_hit"))
    return (words.join(v, "word", "left")
            .select("word", F.coalesce("_hit", F.lit(False)).alias("in_vocab")))


@register("huffman_part", sql="""
WITH RECURSIVE corpus AS (""" + part_corpus_sql() + """),
wc AS (SELECT word, count(*) AS cnt FROM (SELECT unnest(words) AS word FROM corpus) GROUP BY word),
vocab0 AS (SELECT word, cnt, row_number() OVER (ORDER BY cnt DESC, word) - 1 AS idx FROM wc),
nv AS (SELECT count(*) AS V FROM vocab0),
""" + ",\n".join(huffman_sql("vocab0")) + """
SELECT v.word, v.idx, v.cnt, h.code, h.point FROM vocab0 v JOIN hpaths h ON h.node = v.idx""")
def q_huffman_part(spark, sf):
    """Huffman codes of the part-name vocabulary (the SQL twin builds the
    tree with a recursive CTE, practical on a small vocabulary)."""
    v = V.vocab_prune(V.word_count(part_corpus(spark, sf)), 1)
    return V.huffman(v).select("word", "idx", "cnt", "code", "point")
