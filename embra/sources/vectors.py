"""Vector-file sources: word2vec text / vocabulary / binary,
paragraph and category vector text files."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import unit
from ..operators.ordering import dense_index
from ..storage import committed_files, open_fs
from .text import WS, read_lines


def read_vocab(spark, source) -> DataFrame:
    """``word count`` lines -> (word, cnt)."""
    lines = read_lines(spark, source)
    p = F.split(F.trim("value"), WS)
    return lines.select(p[0].alias("word"), p[1].cast("long").alias("cnt"))


def _counts(words: DataFrame, vocab: DataFrame | None) -> DataFrame:
    """count from the vocabulary file, else V - line number."""
    if vocab is None:
        return words.withColumn("cnt", F.col("_V") - F.col("idx"))
    return words.join(vocab, "word", "left")


def read_word2vec_text(spark, source, fvocab=None, norm_only: bool = False) -> DataFrame:
    """(word, idx, cnt, vec).  Width other than d+1 raises an error."""
    lines = read_lines(spark, source)
    first = lines.filter(F.col("line_no") == 0)
    v_total = first.select(F.split(F.trim("value"), WS)[0].cast("long")).scalar()
    dim = first.select(F.split(F.trim("value"), WS)[1].cast("int")).scalar()
    body = lines.filter(F.col("line_no") > 0).withColumn("_V", v_total).withColumn("_d", dim)
    parts = F.split(F.trim("value"), WS)
    body = body.withColumn("_p", parts).withColumn(
        "_p", F.when(F.size("_p") == F.col("_d") + 1, F.col("_p")).otherwise(
            F.raise_error(F.concat(F.lit("invalid vector on line "), F.col("line_no").cast("string")))))
    words = body.select(F.col("_p")[0].alias("word"), (F.col("line_no") - 1).alias("idx"), "_V",
                        F.transform(F.slice("_p", 2, F.col("_d")), lambda x: x.cast("double")).alias("vec"))
    out = _counts(words, read_vocab(spark, fvocab) if fvocab else None)
    out = out.select("word", "idx", "cnt", "vec")
    return out.withColumn("vec", unit("vec")) if norm_only else out


READ_BYTES = 8 << 20      # of a binary file held at once
RANGE_RECORDS = 1 << 16   # records that one task reads at a time


def _record_starts(stream, d: int, start: int):
    """Places of the words of a binary file's records, from a stream at ``start``; at last the end of the last one."""
    buf, done, at = b"", False, start
    while not done:
        block = stream.read(READ_BYTES)
        done, buf, pos = not block, buf + block, 0
        while True:
            while buf[pos:pos + 1] == b"\n":
                pos += 1
            space = buf.find(b" ", pos)
            if space < 0 or space + 1 + 4 * d > len(buf):
                break
            yield at + pos
            pos = space + 1 + 4 * d
        buf, at = buf[pos:], at + pos
    if buf.strip(b"\n"):
        raise ValueError("the last vector is cut off")
    yield at


def _records(data: bytes, d: int, n: int):
    """(words, vectors) of n records."""
    words, vecs, pos = [], np.empty((n, d), "<f4"), 0
    for k in range(n):
        while data[pos:pos + 1] == b"\n":
            pos += 1
        space = data.find(b" ", pos)
        words.append(data[pos:space].decode("utf-8"))
        vecs[k] = np.frombuffer(data, "<f4", d, space + 1)
        pos = space + 1 + 4 * d
    return words, vecs.astype("float64")


def binary_ranges(spark, files: DataFrame, first: str, header: int, d: int,
                  records: int = RANGE_RECORDS) -> DataFrame:
    """Where every ``records``-th record of the files begins: (path, rec, n, start, size).  Records have no marks to
    split at, so each file is gone through once, without making vectors."""
    def scan(it):
        for pdf in it:
            for path in pdf["path"]:
                fs, name = open_fs(path)
                skip = header if path == first else 0
                rows, begin, n, rec = [], skip, 0, 0
                with fs.open_input_stream(name, compression=None) as f:
                    f.read(skip)
                    for at in _record_starts(f, d, skip):
                        if n == records:
                            rows.append((path, rec, n, begin, at - begin))
                            begin, rec, n = at, rec + n, 0
                        n += 1
                    n -= 1  # the end isn't a record
                    if n:
                        rows.append((path, rec, n, begin, at - begin))
                yield pd.DataFrame(rows, columns=["path", "rec", "n", "start", "size"])

    count = max(1, files.count())
    return files.repartition(count, "path").mapInPandas(scan, "path string, rec long, n long, start long, size long")


def read_word2vec_binary(spark, source, fvocab=None, records: int = RANGE_RECORDS) -> DataFrame:
    """Binary word2vec: header ``V d\\n`` then ``word<space>`` + d float32, newlines before a word ignored.  One file,
    a folder of part files (header in the first) or a folder that the writer committed.

    One pass notes where every ``records``-th record begins; then the ranges between are read in parallel, so one
    file may be of any size and is decoded by many tasks."""
    names = committed_files(source)
    if names is not None:
        paths = spark.createDataFrame([(n, k) for k, n in enumerate(names)], "path string, file long")
    else:  # paths only: the content column isn't read
        found = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(source).select("path")
        paths = found.withColumn("file", F.row_number().over(Window.orderBy("path")).cast("long"))
    first = paths.orderBy("file").first()["path"]
    fs, name = open_fs(first)
    with fs.open_input_stream(name, compression=None) as f:
        head = f.read(64).split(b"\n", 1)[0]
    n, d = (int(x) for x in head.split())
    ranges = binary_ranges(spark, paths.select("path"), first, len(head) + 1, d, records).checkpoint(eager=True)
    # one row per range: its first record's number over all files
    before = Window.orderBy("file", "rec").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.join(paths, "path").withColumn("idx", F.coalesce(F.sum("n").over(before), F.lit(0)))

    def parse(it):
        for pdf in it:
            for path, k, start, size, idx in zip(pdf["path"], pdf["n"], pdf["start"], pdf["size"], pdf["idx"]):
                fs, name = open_fs(path)
                with fs.open_input_file(name) as f:
                    f.seek(int(start))
                    words, vecs = _records(f.read(int(size)), d, int(k))
                for i in range(0, len(words), 4096):
                    part = words[i:i + 4096]
                    yield pd.DataFrame({"idx": idx + i + np.arange(len(part)), "word": part,
                                        "vec": list(vecs[i:i + 4096])})

    tasks = max(1, min(ranges.count(), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    recs = ranges.repartition(tasks, "idx").mapInPandas(parse, "idx long, word string, vec array<double>")
    out = _counts(recs.withColumn("_V", F.lit(n)), read_vocab(spark, fvocab) if fvocab else None)
    return out.select("word", "idx", "cnt", "vec")


def read_doc_vectors(spark, source) -> tuple[DataFrame, DataFrame]:
    """Paragraph / category vector file -> (vectors (id, no, vec), header (key, value)).

    Lines starting with '#' are ``#key:value`` header lines; the others are
    ``id<TAB>v1 v2 ...``; ``no`` is the row order."""
    lines = read_lines(spark, source)
    head = lines.filter(F.col("value").startswith("#")).select(
        F.trim(F.regexp_extract("value", r"^#([^:]*):", 1)).alias("key"),
        F.trim(F.regexp_extract("value", r"^#[^:]*:(.*)$", 1)).alias("value"))
    rows = lines.filter(~F.col("value").startswith("#"))
    k = F.split(F.regexp_replace("value", r"(?U)\s+$", ""), "\t")
    rows = rows.select("line_no", k[0].alias("id"),
                       F.transform(F.split(F.trim(k[1]), WS), lambda x: x.cast("double")).alias("vec"))
    rows = dense_index(rows, [F.col("line_no")], "no").select("id", "no", "vec")
    return rows, head
