"""Word-vector queries.

The word vectors are trained here from the tables (skip-gram + HS, one
epoch of two mini-batches, d=4): on ``part`` names (two-word sentences,
8 adjectives x 8 nouns) and on ``benchmark`` texts.  The DuckDB twins
retrain the same model with the training CTEs and then run the query.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import r6
from ..operators import train as T
from ..operators.similarity import knn
from ..operators.vocab import explode_tokens
from ..operators.words import (analogy_accuracy, analogy_vectors, doesnt_match, most_similar, word_similarity,
                               word_vectors)
from ..tables import benchmark_corpus, benchmark_corpus_sql, part_corpus, part_corpus_sql, table
from . import sqlh
from .registry import register
from .train_sql import train_ctes

P_SPEC = T.TrainSpec(family="word", arch="sg", hs=True, size=4, window=2, min_count=1, batches=2, seed=7)
B_SPEC = T.TrainSpec(family="word", arch="sg", hs=True, size=4, window=3, min_count=2, batches=2, seed=7)
RESTRICT_VOCAB = 30000


def trained_words(spark, sf, spec, corpus_fn):
    """(word, idx, cnt, vec, uvec) of a freshly trained word model."""
    corpus = corpus_fn(spark, sf)
    params, vocab, _, _ = T.train(corpus, spec)
    return word_vectors(params, vocab)


def _sql(spec, corpus_sql, body):
    ctes, final = train_ctes(spec, corpus_sql)
    ctes.append(f"wv AS (SELECT v.word, v.idx, v.cnt, p.vec, {sqlh.unit('p.vec')} AS uvec FROM vocab v "
                f"JOIN {final} p ON p.kind = 'syn0' AND p.id = v.idx)")
    return sqlh.with_ctes(ctes) + ",\n" + body


# analogy-style questions from consecutive parts: (adj_k, noun_k, adj_k+1, noun_k+1)
QUESTIONS_SQL = """questions AS (SELECT a.p_brand AS section, a.p_partkey AS q_id,
    lower(split_part(a.p_name, ' ', 1)) AS wa, lower(split_part(a.p_name, ' ', 2)) AS wb,
    lower(split_part(b.p_name, ' ', 1)) AS wc, lower(split_part(b.p_name, ' ', 2)) AS expected
    FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)"""


def questions(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_name")
    nxt = p.select(F.col("p_partkey").alias("nk"), F.col("p_name").alias("nname"))
    j = p.join(nxt, nxt.nk == p.p_partkey + 1)
    sp = lambda c, i: F.lower(F.split(c, " ").getItem(i))
    return j.select(F.col("p_brand").alias("section"), F.col("p_partkey").alias("q_id"),
                    sp("p_name", 0).alias("wa"), sp("p_name", 1).alias("wb"),
                    sp("nname", 0).alias("wc"), sp("nname", 1).alias("expected"))


@register("knn_word", sql=_sql(P_SPEC, part_corpus_sql(), f"""
r AS {sqlh.knn('SELECT idx AS q_id, uvec FROM wv', 'SELECT idx AS i_id, uvec FROM wv', 3, exclude_self=True)}
SELECT q.word, i.word AS nbr, r.rank, {sqlh.r6('r.sim')} AS sim FROM r JOIN wv q ON q.idx = r.q_id
JOIN wv i ON i.idx = r.i_id"""))
def q_knn_word(spark, sf):
    """most_similar(word, topn=3) for every vocabulary word."""
    w = trained_words(spark, sf, P_SPEC, part_corpus)
    r = knn(w.select(F.col("idx").alias("q_id"), "uvec"), w.select(F.col("idx").alias("i_id"), "uvec"), 3,
            q_vec="uvec", i_vec="uvec", exclude_self=True)
    names = w.select("idx", "word")
    return (r.join(names.withColumnRenamed("idx", "q_id"), "q_id")
            .join(names.select(F.col("idx").alias("i_id"), F.col("word").alias("nbr")), "i_id")
            .select("word", "nbr", "rank", r6("sim").alias("sim")))


_ANALOGY_Q = """aq AS (SELECT q.q_id, q.section, q.expected, a.idx AS ia, b.idx AS ib, c.idx AS ic,
        list_transform(list_zip(list_zip(b.uvec, c.uvec), a.uvec), lambda t: t[1][1] + t[1][2] - t[2]) AS s
    FROM questions q JOIN wv a ON a.word = q.wa JOIN wv b ON b.word = q.wb JOIN wv c ON c.word = q.wc),
aqu AS (SELECT q_id, section, expected, ia, ib, ic, """ + sqlh.unit("s") + """ AS uvec FROM aq)"""


@register("knn_word_analogy", sql=_sql(P_SPEC, part_corpus_sql(), QUESTIONS_SQL + ",\n" + _ANALOGY_Q + f""",
r AS (SELECT * FROM (SELECT q_id, i_id, sim, CAST(row_number() OVER (PARTITION BY q_id
      ORDER BY round(sim, 9) DESC, i_id) AS INTEGER) AS rank FROM (SELECT q.q_id, w.idx AS i_id,
      list_dot_product(q.uvec, w.uvec) AS sim FROM aqu q, wv w WHERE w.idx NOT IN (q.ia, q.ib, q.ic)))
      WHERE rank <= 3)
SELECT q.q_id, w.word AS nbr, r.rank, {sqlh.r6('r.sim')} AS sim FROM questions q LEFT JOIN r ON r.q_id = q.q_id
LEFT JOIN wv w ON w.idx = r.i_id"""))
def q_knn_word_analogy(spark, sf):
    """most_similar(positive=[b, c], negative=[a], topn=3): unit vectors
    weighted +1/+1/-1, input words excluded; a question with an unknown word is one row of nulls."""
    w = trained_words(spark, sf, P_SPEC, part_corpus)
    q = questions(spark, sf)
    qv = analogy_vectors(q, w)
    r = knn(qv.filter("uvec is not null").select("q_id", "uvec", "ex"), w.select(F.col("idx").alias("i_id"), "uvec"), 3,
            q_vec="uvec", i_vec="uvec", exclude="ex")
    named = r.join(w.select(F.col("idx").alias("i_id"), F.col("word").alias("nbr")), "i_id")
    return (q.select("q_id").join(named.select("q_id", "nbr", "rank", "sim"), "q_id", "left")
            .select("q_id", "nbr", "rank", r6("sim").alias("sim")))


# a stated list of query words: those of the parts of one brand
DIST_WORDS_SQL = """SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS word FROM part WHERE p_brand = 'Brand#11'"""


@register("word_dists", sql=_sql(P_SPEC, part_corpus_sql(), f"""
qw AS ({DIST_WORDS_SQL})
SELECT q.word, i.word AS other, """ + sqlh.r6("list_dot_product(q.uvec, i.uvec)") + """ AS sim
FROM qw JOIN wv q USING (word), wv i"""))
def q_word_dists(spark, sf):
    """most_similar(word, topn=False): similarity of every word of a given list to every
    vocabulary word."""
    w = trained_words(spark, sf, P_SPEC, part_corpus)
    p = table(spark, sf, "part").filter("p_brand = 'Brand#11'")
    q = w.join(p.select(F.lower(F.split("p_name", " ").getItem(0)).alias("word")), "word", "left_semi")
    r = knn(q.select(F.col("idx").alias("q_id"), "uvec"), w.select(F.col("idx").alias("i_id"), "uvec"), None,
            q_vec="uvec", i_vec="uvec")
    names = w.select("idx", "word")
    return (r.join(names.withColumnRenamed("idx", "q_id"), "q_id")
            .join(names.select(F.col("idx").alias("i_id"), F.col("word").alias("other")), "i_id")
            .select("word", "other", r6("sim").alias("sim")))


@register("most_similar", sql=_sql(P_SPEC, part_corpus_sql(), QUESTIONS_SQL + """,
terms AS (SELECT q_id, wb AS word, 1.0::DOUBLE AS weight FROM questions UNION ALL
          SELECT q_id, CASE WHEN wa = wc THEN wc || 'zz' ELSE wc END, 0.5 FROM questions UNION ALL
          SELECT q_id, wa, -1.0 FROM questions),
tv AS (SELECT t.q_id, t.word, w.idx, list_transform(w.uvec, lambda x: x * t.weight) AS v
       FROM terms t LEFT JOIN wv w USING (word)),
qs AS (SELECT q_id, list_sort(coalesce(list(DISTINCT word) FILTER (idx IS NULL), [])) AS missing, list(idx) AS ex
       FROM tv GROUP BY q_id),
sv AS (SELECT q_id, """ + sqlh.unit("vec") + """ AS uvec FROM """ + sqlh.vec_agg(
    "(SELECT * FROM tv WHERE idx IS NOT NULL)", ["q_id"], "v", "sum") + """),
sc AS (SELECT s.q_id, w.word AS nbr, w.idx, list_dot_product(s.uvec, w.uvec) AS sim FROM sv s
       JOIN qs ON qs.q_id = s.q_id AND len(qs.missing) = 0, wv w WHERE NOT list_contains(qs.ex, w.idx)),
r AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY q_id ORDER BY round(sim, 9) DESC, idx) AS INTEGER)
      AS rank FROM sc) WHERE rank <= 3)
SELECT qs.q_id, r.nbr, r.rank, CASE WHEN r.sim IS NOT NULL THEN """ + sqlh.r6("r.sim") + """ END AS sim, qs.missing
FROM qs LEFT JOIN r USING (q_id)"""))
def q_most_similar(spark, sf):
    """most_similar with weights 1, 0.5 and -1; where the two adjectives agree, one of them is
    replaced by a word that isn't in the vocabulary."""
    w = trained_words(spark, sf, P_SPEC, part_corpus)
    q = questions(spark, sf)
    strange = F.when(F.col("wa") == F.col("wc"), F.concat("wc", F.lit("zz"))).otherwise(F.col("wc"))

    def term(word, weight):
        return q.select("q_id", word.alias("word"), F.lit(None).cast("array<double>").alias("vec"),
                        F.lit(weight).alias("weight"))

    terms = term(F.col("wb"), 1.0).unionByName(term(strange, 0.5)).unionByName(term(F.col("wa"), -1.0))
    return most_similar(terms, w, 3).withColumn("sim", r6("sim"))


@register("word_similarity", sql=_sql(P_SPEC, part_corpus_sql(), """
pairs AS (SELECT p_partkey, lower(split_part(p_name, ' ', 1)) AS w1,
    lower(split_part(p_name, ' ', 2)) || CASE WHEN p_size = 1 THEN 'zz' ELSE '' END AS w2 FROM part)
SELECT p.p_partkey, CASE WHEN a.word IS NOT NULL AND b.word IS NOT NULL THEN """
                                  + sqlh.r6("list_dot_product(a.uvec, b.uvec)") + """ END AS sim,
    list_filter([CASE WHEN a.word IS NULL THEN p.w1 END, CASE WHEN b.word IS NULL THEN p.w2 END],
                lambda x: x IS NOT NULL) AS missing
FROM pairs p LEFT JOIN wv a ON a.word = p.w1 LEFT JOIN wv b ON b.word = p.w2"""))
def q_word_similarity(spark, sf):
    """similarity(w1, w2) of the two words of every part name; the second word of parts of
    size 1 is altered, so that it isn't in the vocabulary."""
    w = trained_words(spark, sf, P_SPEC, part_corpus).select("word", "uvec")
    p = table(spark, sf, "part").select(
        "p_partkey", F.lower(F.split("p_name", " ").getItem(0)).alias("w1"),
        F.concat(F.lower(F.split("p_name", " ").getItem(1)),
                 F.when(F.col("p_size") == 1, F.lit("zz")).otherwise(F.lit(""))).alias("w2"))
    return word_similarity(p, w).select("p_partkey", r6("sim").alias("sim"), "missing")


@register("doesnt_match", sql=_sql(B_SPEC, benchmark_corpus_sql(), f"""
wtoks AS (SELECT line_no, unnest(words) AS word FROM corpus),
wtv AS (SELECT t.line_no, t.word, w.uvec FROM wtoks t JOIN wv w USING (word)),
m AS (SELECT line_no, {sqlh.unit('vec')} AS mu FROM {sqlh.vec_agg('wtv', ['line_no'], 'uvec', 'sum')}),
s AS (SELECT wtv.line_no, wtv.word, round(list_dot_product(wtv.uvec, m.mu), 9) AS d FROM wtv JOIN m USING (line_no)),
best AS (SELECT line_no, arg_min(word, struct_pack(d := d, w := word)) AS word FROM s GROUP BY line_no)
SELECT t.line_no, b.word FROM (SELECT DISTINCT line_no FROM wtoks) t LEFT JOIN best b USING (line_no)"""))
def q_doesnt_match(spark, sf):
    """The in-vocabulary word of each benchmark text farthest from the mean of its words."""
    w = trained_words(spark, sf, B_SPEC, benchmark_corpus)
    toks = explode_tokens(benchmark_corpus(spark, sf).select("line_no", "words"))
    return doesnt_match(toks, w)


@register("analogy_accuracy", sql=_sql(P_SPEC, part_corpus_sql(), QUESTIONS_SQL + ",\n" + f"""
okv AS (SELECT word, idx, uvec FROM wv WHERE idx < {RESTRICT_VOCAB}),
qq AS (SELECT q.* FROM questions q WHERE wa IN (SELECT word FROM okv) AND wb IN (SELECT word FROM okv)
       AND wc IN (SELECT word FROM okv) AND expected IN (SELECT word FROM okv)),
aq AS (SELECT q.q_id, q.section, q.expected, a.idx AS ia, b.idx AS ib, c.idx AS ic,
        list_transform(list_zip(list_zip(b.uvec, c.uvec), a.uvec), lambda t: t[1][1] + t[1][2] - t[2]) AS s
    FROM qq q JOIN wv a ON a.word = q.wa JOIN wv b ON b.word = q.wb JOIN wv c ON c.word = q.wc),
aqu AS (SELECT q_id, section, expected, ia, ib, ic, {sqlh.unit('s')} AS uvec FROM aq),
sc AS (SELECT q.q_id, q.section, q.expected, o.word, round(list_dot_product(q.uvec, o.uvec), 9) AS d, o.idx
       FROM aqu q, okv o WHERE o.idx NOT IN (q.ia, q.ib, q.ic)),
pred AS (SELECT q_id, section, expected, arg_max(word, struct_pack(d := d, n := -idx)) AS predicted
         FROM sc GROUP BY q_id, section, expected),
per AS (SELECT section, CAST(sum(CASE WHEN predicted = expected THEN 1 ELSE 0 END) AS BIGINT) AS correct,
        CAST(sum(CASE WHEN predicted = expected THEN 0 ELSE 1 END) AS BIGINT) AS incorrect FROM pred GROUP BY section)
SELECT section, correct, incorrect FROM per
UNION ALL SELECT 'total', CAST(sum(correct) AS BIGINT), CAST(sum(incorrect) AS BIGINT) FROM per"""))
def q_analogy_accuracy(spark, sf):
    """accuracy(questions): per section and total, questions restricted to
    the most frequent words; prediction excludes the three input words."""
    w = trained_words(spark, sf, P_SPEC, part_corpus)
    return analogy_accuracy(questions(spark, sf), w, RESTRICT_VOCAB)
