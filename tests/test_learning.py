"""A trained model must carry the category signal: on documents labelled by
language, leave-one-out prediction from the nearest document vectors beats
the majority class by a wide margin."""

from pyspark.sql import functions as F

from embra.functions.vectors import unit
from embra.operators import train as T
from embra.operators.evaluate import accuracy_at
from embra.operators.similarity import knn
from embra.tables import documents_corpus


def test_category_prediction_beats_majority(spark, sf):
    corpus = documents_corpus(spark, sf, cat_col="lang")
    spec = T.TrainSpec(family="cat", arch="sg", hs=True, size=16, window=3, min_count=3, batches=4,
                       slice_len=50, epochs=3, combine="mean", alpha=0.5, seed=1)
    params, vocab, docs, cats = T.train(corpus, spec)
    dv = (params.filter(F.col("kind") == "sent").select(F.col("id").alias("sent_no"), unit("vec").alias("u"))
          .join(docs.select("sent_no", "sent_id"), "sent_no")
          .join(corpus.select("sent_id", F.col("cat_id").alias("gold")), "sent_id"))
    r = knn(dv.select(F.col("sent_no").alias("q_id"), "u"), dv.select(F.col("sent_no").alias("i_id"), "u"),
            1, q_vec="u", i_vec="u", exclude_self=True)
    preds = r.join(dv.select(F.col("sent_no").alias("i_id"), F.col("gold").alias("pred")), "i_id") \
        .select("q_id", "pred", "rank")
    queries = dv.select(F.col("sent_no").alias("q_id"), "gold")
    acc = accuracy_at(queries, preds, [1]).first()["accuracy"]
    counts = [r["count"] for r in corpus.groupBy("cat_id").count().collect()]
    majority = max(counts) / sum(counts)
    assert acc > majority + 0.1, (acc, majority)
