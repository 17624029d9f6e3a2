"""Line-oriented text sources.

Every reader accepts a path, a list of paths / globs, or an existing
DataFrame with a ``value`` column, and numbers lines in file order:
(file path, split start, position inside the split) -> dense ``line_no``.
Compressed files (.gz, .bz2) are decoded by the Hadoop codecs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import keyed_uniform
from ..operators.ordering import dense_index, running_max_dense

WS = r"(?U)\s+"


def read_lines(spark: SparkSession, source, shuffle_files_seed: int | None = None) -> DataFrame:
    """(line_no, file, value) in file order; ``shuffle_files_seed`` orders
    the files by a keyed draw instead of by name (the split reader's rand)."""
    if isinstance(source, DataFrame):
        df = source.select("value", F.lit("").alias("file"), F.spark_partition_id().cast("long").alias("_blk"),
                           F.monotonically_increasing_id().alias("_m"))
    else:
        paths = [source] if isinstance(source, str) else list(source)
        df = (spark.read.text(paths)
              .select("value", F.col("_metadata.file_path").alias("file"),
                      F.col("_metadata.file_block_start").alias("_blk"),
                      F.monotonically_increasing_id().alias("_m")))
    # files are read (and unpacked) once; a split is read in order by one task, so a line's number is its place there
    # and the lines of the splits before, summed over one row per split
    df = df.checkpoint(eager=True)
    splits = df.groupBy("file", "_blk").agg(F.count(F.lit(1)).alias("n"), F.min("_m").alias("_m0"),
                                            F.max("_m").alias("_m1")).checkpoint(eager=True)
    fkey = F.col("file") if shuffle_files_seed is None else keyed_uniform(shuffle_files_seed, F.col("file"))
    if not splits.filter("_m1 - _m0 + 1 <> n").isEmpty():  # a file that is named twice
        return dense_index(df.withColumn("_fk", fkey), [F.col(c) for c in ("_fk", "file", "_blk", "_m")],
                           "line_no").select("line_no", "file", "value")
    before = Window.orderBy(fkey, "file", "_blk").rowsBetween(Window.unboundedPreceding, -1)
    shift = (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("_m0")).alias("_shift")
    return df.join(F.broadcast(splits.select("file", "_blk", shift)), ["file", "_blk"]).select(
        (F.col("_m") + F.col("_shift")).cast("long").alias("line_no"), "file", "value")


def _rstrip(c):
    return F.regexp_replace(c, r"(?U)\s+$", "")


def read_cat_tsv(spark, source, cat_col: int = 0, sent_col: int = 1, cont_col: int = 2,
                 split: bool = False, rand: bool = False, seed: int = 0) -> DataFrame:
    """Labelled TSV: ``cat<TAB>sent<TAB>w1<TAB>w2...`` -> corpus.

    ``split=True`` reads a list of files, or the glob ``source.[a-z][a-z]``;
    ``rand`` shuffles the file order (keyed by ``seed``)."""
    if split and isinstance(source, str):
        source = source + ".[a-z][a-z]"
    lines = read_lines(spark, source, seed if rand else None)
    k = F.split(_rstrip(F.col("value")), "\t")
    return lines.select("line_no", k.getItem(cat_col).alias("cat_id"), k.getItem(sent_col).alias("sent_id"),
                        F.slice(k, cont_col + 1, F.greatest(F.size(k) - cont_col, F.lit(0))).alias("words"))


def read_wiki(spark, source, sample: float | None = None, seed: int = 1120) -> DataFrame:
    """Wiki TSV: sent_id = column 1, categories = column 3 split on ' ',
    words = columns 4...; one row per category without '/'.  With
    ``sample`` a line is kept iff its keyed draw is <= sample (all of its
    categories together, the same lines every pass)."""
    lines = read_lines(spark, source)
    if sample is not None:
        lines = lines.filter(keyed_uniform(seed, F.col("line_no")) <= F.lit(float(sample)))
    k = F.split(_rstrip(F.col("value")), "\t")
    rows = lines.select("line_no", k.getItem(1).alias("sent_id"),
                        F.split(k.getItem(3), " ").alias("cats"),
                        F.slice(k, 5, F.greatest(F.size(k) - 4, F.lit(0))).alias("words"))
    return (rows.select("line_no", "sent_id", "words", F.explode("cats").alias("cat_id"))
            .filter(~F.col("cat_id").contains("/"))
            .select("line_no", "cat_id", "sent_id", "words"))


def _ws_split(c):
    return F.filter(F.split(c, WS), lambda t: t != "")


def read_line_sentences(spark, source) -> DataFrame:
    """One sentence per line, whitespace separated (plain or compressed)."""
    lines = read_lines(spark, source)
    return lines.select("line_no", F.lit(None).cast("string").alias("cat_id"),
                        F.lit(None).cast("string").alias("sent_id"), _ws_split(F.col("value")).alias("words"))


def stream_tokens(spark, source) -> DataFrame:
    """(file, split, m, word): the tokens of a stream, ``m`` ascending within a split.

    Files are cut at single spaces, so one line of any length is read by many tasks."""
    if isinstance(source, DataFrame):
        rows = source.select(F.lit("").alias("file"), F.spark_partition_id().cast("long").alias("split"), "value")
    else:
        paths = [source] if isinstance(source, str) else list(source)
        rows = spark.read.option("lineSep", " ").text(paths).select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")
    toks = rows.select("file", "split", F.explode_outer(_ws_split(F.col("value"))).alias("word"))
    return toks.filter("word is not null").withColumn("m", F.monotonically_increasing_id())


def token_chunks(tokens: DataFrame, size: int) -> DataFrame:
    """(file, split, run, chunk, n, text): the tokens of :func:`stream_tokens` as strings of ``size`` tokens with single
    spaces between, the last one of a split shorter.  ``run`` tells splits apart that are read more than once."""
    def pack(batches):
        run, key, held, n, chunk = TaskContext.get().partitionId() << 32, None, [], 0, 0

        def rows(words: pa.Array, count: int, each: int):
            ends = pa.array(np.arange(count + 1, dtype=np.int32) * each)
            text = pa.compute.binary_join(pa.ListArray.from_arrays(ends, words), " ")
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * count, pa.string()), pa.array([key[1]] * count, pa.int64()),
                 pa.array([run] * count, pa.int64()), pa.array(range(chunk, chunk + count), pa.int64()),
                 pa.array([each] * count, pa.int64()), text.cast(pa.string())],
                names=["file", "split", "run", "chunk", "n", "text"])

        for batch in batches:
            file, split = batch["file"].dictionary_encode(), batch["split"].to_numpy()
            other = (np.diff(split) != 0) | (np.diff(file.indices.to_numpy()) != 0)
            cuts = [0, *(np.flatnonzero(other) + 1).tolist(), len(split)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                here = (file[lo].as_py(), int(split[lo]))
                if here != key:
                    if n:
                        yield rows(pa.concat_arrays(held), 1, n)
                    run, key, held, n, chunk = run + 1, here, [], 0, 0
                held.append(batch["word"].slice(lo, hi - lo))
                n += hi - lo
                if n >= size:
                    words, full = pa.concat_arrays(held), n // size
                    yield rows(words.slice(0, full * size), full, size)
                    held, n, chunk = [words.slice(full * size)], n % size, chunk + full
        if n:
            yield rows(pa.concat_arrays(held), 1, n)

    return tokens.select("file", "split", "word").mapInArrow(
        pack, "file string, split long, run long, chunk long, n long, text string")


def read_text8(spark, source, sentence_len: int = 1000) -> DataFrame:
    """One token stream cut into sentences of ``sentence_len`` tokens.

    Tokens are written and moved as strings of a sentence's length, not one by one.  A string's position is its place
    in its split and the tokens of the splits before, summed over one row per split; it meets two sentences at most."""
    # written once: places within a split must not change between the two uses
    chunks = token_chunks(stream_tokens(spark, source), sentence_len).checkpoint(eager=True)
    splits = chunks.groupBy("file", "split", "run").agg(F.sum("n").alias("n"))
    before = Window.orderBy("file", "split", "run").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    at = chunks.join(splits, "run").select("n", "text", (F.col("start") + F.col("chunk") * sentence_len).alias("pos"))
    line, own = F.floor(F.col("pos") / sentence_len).cast("long"), F.lit(sentence_len) - F.col("pos") % sentence_len
    at = at.select("pos", "text", line.alias("line_no"), F.when(own < F.col("n"), own.cast("int")).alias("own"))
    at = at.withColumn("head", F.when(F.col("own").isNull(), F.col("text")).otherwise(
        F.expr("substring_index(text, ' ', own)")))
    rest = F.struct((F.col("line_no") + 1).alias("line_no"), (F.col("pos") + F.col("own")).alias("pos"),
                    F.expr("substring(text, length(head) + 2)").alias("text"))
    first = F.struct("line_no", "pos", F.col("head").alias("text"))
    g = (at.select(F.explode(F.array(first, F.when(F.col("own").isNotNull(), rest))).alias("p"))
         .filter("p is not null").select("p.*")
         .groupBy("line_no").agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("_t")))
    return g.select("line_no", F.lit(None).cast("string").alias("cat_id"), F.lit(None).cast("string").alias("sent_id"),
                    F.split(F.array_join(F.transform("_t", lambda t: t["text"]), " "), " ").alias("words"))


def read_brown(spark, source) -> DataFrame:
    """Tagged text ``word/TAG``: keep tokens with exactly one '/', whose
    tag starts with two letters; emit ``lower(word)/TAG[:2]``; drop empty
    sentences."""
    lines = read_lines(spark, source)
    toks = F.transform(_ws_split(F.col("value")), lambda t: F.split(t, "/", -1))
    kept = F.filter(toks, lambda p: (F.size(p) == 2)
                    & F.substring(p.getItem(1), 1, 2).rlike(r"^\p{L}+$"))
    words = F.transform(kept, lambda p: F.concat(F.lower(p.getItem(0)), F.lit("/"),
                                                 F.substring(p.getItem(1), 1, 2)))
    out = lines.select("line_no", F.lit(None).cast("string").alias("cat_id"),
                       F.lit(None).cast("string").alias("sent_id"), words.alias("words"))
    return out.filter(F.size("words") > 0)


def read_questions(spark, source) -> DataFrame:
    """Analogy questions: ``: SECTION`` opens a section, other lines are
    four lower-cased words.  A line before any section is an error; a
    malformed line is skipped."""
    lines = read_lines(spark, source)
    is_head = F.col("value").startswith(": ")
    hdr = lines.withColumn("_h", F.when(is_head, F.col("line_no")))
    filled = running_max_dense(hdr, "line_no", F.col("_h"), "_sec_line")
    heads = lines.filter(is_head).select(F.col("line_no").alias("_sec_line"),
                                         F.trim(F.regexp_replace("value", r"^[: ]+", "")).alias("section"))
    q = filled.filter(~is_head).join(heads, "_sec_line", "left")
    q = q.withColumn("section", F.when(F.col("_sec_line").isNull(),
                                       F.raise_error(F.lit("missing section header before a question")))
                     .otherwise(F.col("section")))
    w = F.transform(_ws_split(F.col("value")), lambda t: F.lower(t))
    q = q.withColumn("_w", w).filter(F.size("_w") == 4)
    return q.select("line_no", "section", F.col("_w")[0].alias("wa"), F.col("_w")[1].alias("wb"),
                    F.col("_w")[2].alias("wc"), F.col("_w")[3].alias("expected"))


def repeat_corpus(df: DataFrame, order: list, reps: int) -> DataFrame:
    """Cycle the rows (in ``order``) until exactly ``reps`` rows: each row
    is replicated by a generator (no cross join), then rows past ``reps``
    are cut: (row_no, *columns)."""
    ix = dense_index(df, order, "_ix")
    n = df.agg(F.count(F.lit(1))).scalar()
    j = ix.withColumn("_n", n)
    copies = F.ceil(F.lit(float(reps)) / F.col("_n")).cast("int")
    r = j.withColumn("_rep", F.explode(F.sequence(F.lit(0), copies - 1)))
    r = r.withColumn("row_no", (F.col("_rep") * F.col("_n") + F.col("_ix")).cast("long"))
    return r.filter(F.col("row_no") < reps).drop("_ix", "_n", "_rep")
