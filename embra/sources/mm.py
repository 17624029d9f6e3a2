"""Matrix Market coordinate reader."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import running_max_dense
from .text import WS, read_lines

HEADER = "%%matrixmarket matrix coordinate real general"


def read_mm(spark, source, transposed: bool = True) -> tuple[DataFrame, DataFrame]:
    """-> (documents (doc_no, terms, weights) including implicit empty
    documents up to num_docs, header (num_docs, num_terms, num_nnz)).

    Entries are 1-based ``doc term weight`` lines; ``transposed=False``
    swaps documents and terms.  Document ids must not decrease along the
    file (checked with a bucketed running max over line numbers)."""
    lines = read_lines(spark, source)
    first = lines.filter(F.col("line_no") == 0).select(F.lower(F.trim("value")).alias("h"))
    first = first.select(F.when(F.col("h").startswith(HEADER), F.lit(1))
                         .otherwise(F.raise_error(F.lit("not in Matrix Market coordinate real general format")))
                         .alias("ok"))
    data = lines.filter(~F.col("value").startswith("%"))
    data = data.withColumn("_sl", data.agg(F.min("line_no")).scalar())
    st = data.filter(F.col("line_no") == F.col("_sl")).select(F.split(F.trim("value"), WS).alias("p"))
    a, b = st.p[0].cast("long"), st.p[1].cast("long")
    header = st.select((a if transposed else b).alias("num_docs"), (b if transposed else a).alias("num_terms"),
                       st.p[2].cast("long").alias("num_nnz"))
    header = header.filter(first.select("ok").scalar() == 1)
    ent = data.filter(F.col("line_no") > F.col("_sl")).select("line_no", F.split(F.trim("value"), WS).alias("p"))
    d, t = ent.p[0].cast("long") - 1, ent.p[1].cast("int") - 1
    ent = ent.select("line_no", (d if transposed else t.cast("long")).alias("doc_no"),
                     (t if transposed else d.cast("int")).alias("term_id"),
                     ent.p[2].cast("double").alias("weight"))
    chk = running_max_dense(ent, "line_no", F.col("doc_no"), "_mx")
    ent = chk.withColumn("doc_no", F.when(F.col("doc_no") >= F.col("_mx"), F.col("doc_no")).otherwise(
        F.raise_error(F.lit("matrix columns must come in ascending order")))).drop("_mx")
    docs = (ent.groupBy("doc_no")
            .agg(F.array_sort(F.collect_list(F.struct("line_no", "term_id", "weight"))).alias("_e")))
    # the header's document count sizes a distributed range
    n = header.first()["num_docs"]
    all_docs = spark.range(n).select(F.col("id").alias("doc_no"))
    out = all_docs.join(docs, "doc_no", "left").select(
        "doc_no",
        F.coalesce(F.transform("_e", lambda e: e["term_id"]), F.array().cast("array<int>")).alias("terms"),
        F.coalesce(F.transform("_e", lambda e: e["weight"]), F.array().cast("array<double>")).alias("weights"))
    return out, header
