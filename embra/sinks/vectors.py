"""Vector-file sinks: word2vec text / vocabulary / binary,
paragraph and category vector text files."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import FolderWrite
from .text import write_lines


def _fmt_vec(vec: str):
    return F.array_join(F.transform(vec, lambda x: F.format_string("%f", x)), " ")


def save_word2vec_text(words: DataFrame, path: str, fvocab: str | None = None) -> None:
    """``V d`` header, then ``word v1 .. vd`` (%f) by descending count.
    words: (word, idx, cnt, vec)."""
    hdr = words.agg(F.format_string("%d %d", F.count(F.lit(1)), F.max(F.size("vec"))).alias("value"))
    rows = words.select(F.col("cnt").alias("_c"), "idx",
                        F.concat_ws(" ", "word", _fmt_vec("vec")).alias("value"))
    rows = rows.withColumn("_nc", -F.col("_c")).drop("_c")
    write_lines(rows, path, ["_nc", "idx"], header=hdr)
    if fvocab:
        save_vocab(words, fvocab)


def save_vocab(words: DataFrame, path: str) -> None:
    """``word count`` lines by descending count."""
    rows = words.select((-F.col("cnt")).alias("_nc"), "idx",
                        F.concat_ws(" ", "word", F.col("cnt").cast("string")).alias("value"))
    write_lines(rows, path, ["_nc", "idx"])


def save_word2vec_binary(words: DataFrame, path: str) -> list:
    """``V d\\n`` then per word ``word<space>`` + d float32 (little endian).

    Rows are range-sorted by descending count and every task writes a part file; the
    first carries the header.  The parts become readable together, by one manifest that
    lists those of the attempts that Spark counts, in order; an earlier write of the folder
    stays readable until then and is dropped afterwards, and a job that fails leaves nothing
    readable of its own (:class:`storage.FolderWrite`).  Put end to end in the manifest's
    order, the parts are one file of the format.  Returns the per-part summary (part, rows)."""
    stats = words.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).first()
    header = f"{stats['n']} {stats['d'] or 0}\n".encode()
    job = FolderWrite(path)

    def write_part(it):
        pid, rows = TaskContext.get().partitionId(), 0
        name, out = job.create()
        with out as f:
            if pid == 0:
                f.write(header)
            for pdf in it:
                for w, v in zip(pdf["word"], pdf["vec"]):
                    f.write(w.encode("utf-8") + b" " + np.asarray(v, dtype="<f4").tobytes())
                rows += len(pdf)
        yield pd.DataFrame({"part": [pid], "rows": [rows], "name": [name]})

    ordered = words.select((-F.col("cnt")).alias("_nc"), "idx", "word", "vec").orderBy("_nc", "idx")
    try:  # the action: one summary row per part file
        parts = ordered.select("word", "vec").mapInPandas(write_part, "part int, rows long, name string").collect()
        parts.sort(key=lambda r: r["part"])
        job.commit([r["name"] for r in parts])
    except Exception:
        job.abort()
        raise
    return [(r["part"], r["rows"]) for r in parts]


def save_doc_vectors(vectors: DataFrame, path: str, kind: str, size: int, sg: int, hs: int,
                     negative: int, cbow_mean: int) -> None:
    """Paragraph (``kind='sents'``) or category (``'cats'``) vectors:
    six ``#key:value`` header lines, then ``id<TAB>v1 v2 ...`` (%f) in id
    order.  vectors: (id string, no long, vec)."""
    n = vectors.agg(F.count(F.lit(1)).alias("n"))
    hdr = n.select(F.explode(F.array(
        F.format_string(f"#{kind}_len: %d", F.col("n")), F.lit(f"#size:{size}"), F.lit(f"#sg:{sg}"),
        F.lit(f"#hs:{hs}"), F.lit(f"#negative:{negative}"), F.lit(f"#cbow_mean:{cbow_mean}"))).alias("value"))
    rows = vectors.select("no", F.concat_ws("\t", "id", _fmt_vec("vec")).alias("value"))
    write_lines(rows, path, ["no"], header=hdr)
