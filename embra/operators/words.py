"""Word-vector lookups and searches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, unit
from .similarity import knn, sum_vectors


def word_vectors(params: DataFrame, vocab: DataFrame) -> DataFrame:
    """(word, idx, cnt, vec, uvec) from the syn0 rows of a model."""
    p = params.filter(F.col("kind") == "syn0").select(F.col("id").alias("idx"), "vec")
    return vocab.select("word", "idx", "cnt").join(p, "idx").withColumn("uvec", unit("vec"))


def query_vectors(terms: DataFrame, words: DataFrame) -> DataFrame:
    """Weighted query vectors: ``terms (q_id, word, vec, weight)``, one row per input, which
    is either a word or a raw vector (the other one null).

    -> ``(q_id, uvec, ex, missing)``: unit sum of weight x unit vector, the ids of the
    input words (never answers) and the words that aren't in the vocabulary.  A query
    with a missing word has no vector; its row stays, with null.
    """
    wv = words.select("word", "idx", F.col("uvec").alias("_wv"))
    j = terms.join(wv, "word", "left").withColumn("_v", F.coalesce("_wv", unit("vec")))
    ok = j.groupBy("q_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("_v").isNull(), F.col("word")))).alias("missing"),
        F.array_sort(F.collect_set("idx")).alias("ex"))
    sv = sum_vectors(j.filter(F.col("_v").isNotNull())
                     .withColumn("sv", F.transform("_v", lambda x: x * F.col("weight"))), ["q_id"], "sv")
    return ok.join(sv, "q_id", "left").select(
        "q_id", F.when(F.size("missing") == 0, unit("vec")).alias("uvec"), "ex", "missing")


def most_similar(terms: DataFrame, words: DataFrame, topn: int = 10) -> DataFrame:
    """Nearest words of every weighted query (see :func:`query_vectors`), the input words
    left out: ``(q_id, nbr, rank, sim, missing)``.  A query that can't be answered is one
    row with a null neighbour and its missing words."""
    q = query_vectors(terms, words)
    r = knn(q.filter("uvec is not null").select("q_id", "uvec", "ex"),
            words.select(F.col("idx").alias("i_id"), "uvec"), topn, q_vec="uvec", i_vec="uvec", exclude="ex")
    named = r.join(words.select(F.col("idx").alias("i_id"), F.col("word").alias("nbr")), "i_id")
    return q.select("q_id", "missing").join(named.select("q_id", "nbr", "rank", "sim"), "q_id", "left") \
        .select("q_id", "nbr", "rank", "sim", "missing")


def word_similarity(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """``pairs (w1, w2, ...)`` -> all their columns with ``sim`` and ``missing``: null and the
    words that aren't in the vocabulary where one isn't."""
    a = words.select(F.col("word").alias("w1"), F.col("uvec").alias("_u1"))
    b = words.select(F.col("word").alias("w2"), F.col("uvec").alias("_u2"))
    lost = F.array_compact(F.array(F.when(F.col("_u1").isNull(), F.col("w1")), F.when(F.col("_u2").isNull(), F.col("w2"))))
    return (pairs.join(a, "w1", "left").join(b, "w2", "left")
            .withColumn("sim", dot("_u1", "_u2")).withColumn("missing", lost).drop("_u1", "_u2"))


def analogy_vectors(questions: DataFrame, words: DataFrame) -> DataFrame:
    """unit((b + c) - a) of unit word vectors for questions (q_id, wa, wb, wc, ...), with the ids ``ex`` of the
    three words; a question with an unknown word stays, with null for both."""
    def side(c, n):
        return words.select(F.col("word").alias(c), F.col("idx").alias(f"i{n}"), F.col("uvec").alias(f"u{n}"))
    j = questions.join(side("wa", "a"), "wa", "left").join(side("wb", "b"), "wb", "left").join(
        side("wc", "c"), "wc", "left")
    s = F.zip_with(F.zip_with("ub", "uc", lambda x, y: x + y), "ua", lambda x, y: x - y)
    known = F.col("ia").isNotNull() & F.col("ib").isNotNull() & F.col("ic").isNotNull()
    return j.select("*", F.when(known, unit(s)).alias("uvec"), F.when(known, F.array("ia", "ib", "ic")).alias("ex"))


def doesnt_match(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """tokens (line_no, word) -> (line_no, word) farthest from the mean of
    the line's in-vocabulary unit vectors; ties by word; null for a line
    without any word of the vocabulary."""
    tw = tokens.join(words.select("word", "uvec"), "word", "left")
    m = sum_vectors(tw.filter("uvec is not null"), ["line_no"], "uvec", out="mv").withColumn("mu", unit("mv"))
    s = tw.join(m.select("line_no", "mu"), "line_no", "left").withColumn("d", F.round(dot("uvec", "mu"), 9))
    known = F.when(F.col("uvec").isNotNull(), F.struct("d", "word"))
    return s.groupBy("line_no").agg(F.min(known).alias("_b")).select("line_no", F.col("_b.word").alias("word"))


def analogy_accuracy(questions: DataFrame, words: DataFrame, restrict_vocab: int = 30000) -> DataFrame:
    """(section, correct, incorrect) per section plus a 'total' row.

    Questions whose four words are not all among the ``restrict_vocab``
    most frequent words are skipped; the prediction is the nearest
    restricted word to unit(b - a + c) other than a, b, c."""
    ok = words.filter(F.col("idx") < restrict_vocab)
    okw = ok.select("word")
    qq = questions
    for c in ("wa", "wb", "wc", "expected"):
        qq = qq.join(okw.withColumnRenamed("word", c), c, "left_semi")
    qv = analogy_vectors(qq, ok)
    best = knn(qv.select("q_id", "uvec", "ex"), ok.select(F.col("idx").alias("i_id"), "uvec"), 1,
               q_vec="uvec", i_vec="uvec", exclude="ex")
    pred = (best.join(ok.select(F.col("idx").alias("i_id"), F.col("word").alias("predicted")), "i_id")
            .select("q_id", "predicted"))
    res = qq.select("q_id", "section", "expected").join(pred, "q_id", "left")
    hit = F.when(F.col("predicted") == F.col("expected"), 1).otherwise(0)
    # one pass for the sections and the total over them
    return res.rollup("section").agg(F.sum(hit).cast("long").alias("correct"),
                                     F.sum(1 - hit).cast("long").alias("incorrect"),
                                     F.grouping("section").alias("_all")).select(
        F.when(F.col("_all") == 1, "total").otherwise(F.col("section")).alias("section"), "correct", "incorrect")
