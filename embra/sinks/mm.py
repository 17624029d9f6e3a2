"""Matrix Market coordinate writer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import write_lines

HEADER_LINE = "%%MatrixMarket matrix coordinate real general"


def write_mm(sparse: DataFrame, path: str, num_terms: int | None = None,
             metadata: DataFrame | None = None, metadata_path: str | None = None) -> None:
    """sparse (doc_no, term_id, weight): entries with |w| <= 1e-12 are
    dropped; lines ``doc+1 term+1 weight`` sorted by (doc, term); the
    header ``docs terms nnz`` is computed first by one aggregation.
    ``metadata`` (doc_no, metadata) is written as a Parquet side table."""
    s = sparse.filter(F.abs("weight") > 1e-12)
    nt = F.lit(int(num_terms)) if num_terms is not None else F.coalesce(F.max("term_id"), F.lit(-1)) + 1
    stats = s.agg((F.coalesce(F.max("doc_no"), F.lit(-1)) + 1).alias("d"), nt.alias("t"),
                  F.count(F.lit(1)).alias("z"))
    hdr = stats.select(F.explode(F.array(F.lit(HEADER_LINE),
                                         F.format_string("%d %d %d", "d", "t", "z"))).alias("value"))
    rows = s.select("doc_no", "term_id", F.format_string("%d %d %s", F.col("doc_no") + 1, F.col("term_id") + 1,
                                                         F.col("weight").cast("string")).alias("value"))
    write_lines(rows, path, ["doc_no", "term_id"], header=hdr)
    if metadata is not None and metadata_path:
        metadata.select("doc_no", "metadata").write.mode("overwrite").parquet(metadata_path)
