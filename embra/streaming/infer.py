"""Category inference for a stream of unseen documents.

Stateless and order-free: every micro-batch is inferred against the frozen
model with the batch operators and appended to the output table.  Initial
document vectors and all draws are keyed by document / line ids, so the
result does not depend on how rows are cut into micro-batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import unit, vadd
from ..operators.infer import frozen_store, infer_vectors
from ..operators.similarity import knn
from ..operators.train import TrainSpec


def top_categories(inferred: DataFrame, pairs_vec: DataFrame, k: int) -> DataFrame:
    """inferred (sent_id, sent_no, vec); pairs_vec (pair_no, cat_no, sent_no, uvec)
    -> (sent_id, rank, cat_no, pair_no, sim)."""
    r = knn(inferred.select(F.col("sent_id").alias("q_id"), unit("vec").alias("uvec")),
            pairs_vec.select(F.col("pair_no").alias("i_id"), F.col("cat_no").alias("grp"), "uvec"),
            k, q_vec="uvec", i_vec="uvec", i_group="grp")
    return r.select(F.col("q_id").alias("sent_id"), "rank", F.col("grp").alias("cat_no"),
                    F.col("i_id").alias("pair_no"), "sim")


def pair_vectors(params: DataFrame, pairs: DataFrame) -> DataFrame:
    sv = params.filter(F.col("kind") == "sent").select(F.col("id").alias("sent_no"), F.col("vec").alias("sv"))
    cv = params.filter(F.col("kind") == "cat").select(F.col("id").alias("cat_no"), F.col("vec").alias("cv"))
    return pairs.join(sv, "sent_no").join(cv, "cat_no").select(
        "pair_no", "cat_no", "sent_no", unit(vadd("sv", "cv")).alias("uvec"))


def stream_infer(stream: DataFrame, params: DataFrame, vocab: DataFrame, pairs: DataFrame,
                 spec: TrainSpec, out_path: str, checkpoint: str, k: int = 1, iterations: int = 5):
    """Infer every arriving document (corpus rows) and write its top-k
    categories to the Parquet table ``out_path`` (partitioned by batch_id)."""
    pv = pair_vectors(params, pairs).checkpoint(eager=True)
    store = frozen_store(params)  # placed once, read by every micro-batch
    vocab = vocab.checkpoint(eager=True)

    def each(batch: DataFrame, batch_id: int):
        if batch.isEmpty():
            return
        inf = infer_vectors(batch, params, vocab, spec, iterations, store=store)
        # one folder per micro-batch, overwritten if the batch is re-executed
        # after a failure: the output stays exactly-once
        top_categories(inf, pv, k).write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    q = (stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q
