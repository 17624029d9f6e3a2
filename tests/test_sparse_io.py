import os
import struct
import tempfile

from pyspark.sql import functions as F

from embra.operators import sparse as S
from embra.sources.text import repeat_corpus
from embra.sources.vectors import read_word2vec_binary


def test_chunk_rows_docstring(spark):
    df = spark.range(0, 10).select(F.col("id").alias("x"))
    got = sorted((r["chunk"], r["ids"]) for r in S.chunk_rows(df, [F.col("x")], 3, "x").collect())
    assert [ids for _, ids in got] == [[0, 1, 2], [3, 4, 5], [6, 7, 8], [9]]


def test_repeat_corpus_docstring(spark):
    df = spark.createDataFrame([(0, [(1, 0.5)]), (1, [])], "d long, doc array<struct<t:int,w:double>>")
    got = repeat_corpus(df, [F.col("d")], 5).orderBy("row_no").collect()
    assert [len(r["doc"]) for r in got] == [1, 0, 1, 0, 1]
    assert [r["row_no"] for r in got] == [0, 1, 2, 3, 4]


def test_clip_value_vs_magnitude(spark):
    df = spark.createDataFrame([([0.5, -3.0, 2.0, 0.0, 1.0],)], "v array<double>")
    by_val = df.select(S.clip_top(F.col("v"), 2)).first()[0]
    by_abs = df.select(S.clip_top(F.col("v"), 2, by="abs")).first()[0]
    assert [(e["i"], e["x"]) for e in by_val] == [(2, 2.0), (4, 1.0)]
    assert [(e["i"], e["x"]) for e in by_abs] == [(1, -3.0), (2, 2.0)]


def test_sparse_cosine_empty_is_zero(spark):
    sp = spark.createDataFrame([(0, 1, 1.0), (0, 2, 1.0), (1, 1, 2.0)], "doc_no long, term_id int, weight double")
    pairs = spark.createDataFrame([(0, 1), (0, 5)], "doc_a long, doc_b long")
    got = {(r["doc_a"], r["doc_b"]): r["sim"] for r in S.cossim(pairs, sp).collect()}
    assert abs(got[(0, 1)] - 2 ** -0.5) < 1e-12 and got[(0, 5)] == 0.0


def test_binary_reader_reference_layout(spark):
    # a single file as the reference writes it: header, then word + float32s,
    # some records preceded by a newline
    d = tempfile.mkdtemp(prefix="embra-bin-")
    path = os.path.join(d, "vectors.bin")
    with open(path, "wb") as f:
        f.write(b"3 2\n")
        f.write(b"alpha " + struct.pack("<2f", 1.5, -2.0))
        f.write(b"\nbeta " + struct.pack("<2f", 0.25, 4.0))
        f.write("gammaé ".encode() + struct.pack("<2f", 0.0, 1.0))
    got = read_word2vec_binary(spark, path).orderBy("idx").collect()
    assert [(r["word"], r["idx"], r["cnt"], r["vec"]) for r in got] == [
        ("alpha", 0, 3, [1.5, -2.0]), ("beta", 1, 2, [0.25, 4.0]), ("gammaé", 2, 1, [0.0, 1.0])]


def test_is_corpus(spark):
    sp = spark.createDataFrame([(0, 1, 1.0)], "doc_no long, term_id int, weight double")
    assert S.is_corpus(sp)
    assert not S.is_corpus(sp.limit(0))
    assert not S.is_corpus(spark.createDataFrame([("a", 1, 1.0)], "doc_no string, term_id int, weight double"))


def test_mm_metadata_side_table(spark):
    from embra.sinks.mm import write_mm
    from embra.sources.mm import read_mm
    d = tempfile.mkdtemp(prefix="embra-mm-")
    sp = spark.createDataFrame([(0, 2, 1.5), (2, 0, -2.0), (2, 1, 1e-13)], "doc_no long, term_id int, weight double")
    meta = spark.createDataFrame([(0, "first"), (2, "third")], "doc_no long, metadata string")
    write_mm(sp, d + "/m", metadata=meta, metadata_path=d + "/meta")
    docs, head = read_mm(spark, d + "/m")
    assert head.first().asDict() == {"num_docs": 3, "num_terms": 3, "num_nnz": 2}
    assert [(r["doc_no"], r["terms"], r["weights"]) for r in docs.orderBy("doc_no").collect()] == \
        [(0, [2], [1.5]), (1, [], []), (2, [0], [-2.0])]
    assert sorted(tuple(r) for r in spark.read.parquet(d + "/meta").collect()) == [(0, "first"), (2, "third")]


def _write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_word2vec_text_width_error(spark):
    import pytest
    from embra.sources.vectors import read_word2vec_text
    d = tempfile.mkdtemp(prefix="embra-w2v-")
    _write(os.path.join(d, "v.txt"), "2 3\nalpha 1.0 2.0 3.0\nbeta 1.0 2.0\n")
    with pytest.raises(Exception, match="invalid vector on line"):
        read_word2vec_text(spark, os.path.join(d, "v.txt")).collect()
    _write(os.path.join(d, "ok.txt"), "2 2\nalpha 1.0 2.0\nbeta 3.0 4.0\n")
    got = read_word2vec_text(spark, os.path.join(d, "ok.txt")).orderBy("idx").collect()
    assert [(r["word"], r["cnt"], r["vec"]) for r in got] == [("alpha", 2, [1.0, 2.0]), ("beta", 1, [3.0, 4.0])]


def test_questions_need_a_section(spark):
    import pytest
    from embra.sources.text import read_questions
    d = tempfile.mkdtemp(prefix="embra-q-")
    _write(os.path.join(d, "bad.txt"), "a b c d\n: s1\nA B C D\n")
    with pytest.raises(Exception, match="missing section header"):
        read_questions(spark, os.path.join(d, "bad.txt")).collect()
    _write(os.path.join(d, "ok.txt"), ": s1\nA B C D\nbroken line\n: s2\ne f g h\n")
    got = read_questions(spark, os.path.join(d, "ok.txt")).orderBy("line_no").collect()
    assert [(r["section"], r["wa"], r["expected"]) for r in got] == [("s1", "a", "d"), ("s2", "e", "h")]


def test_split_reader_file_order(spark):
    from embra.sources.text import read_cat_tsv
    d = tempfile.mkdtemp(prefix="embra-split-")
    _write(os.path.join(d, "src.aa"), "c1\ts1\tx\ty\n")
    _write(os.path.join(d, "src.ab"), "c2\ts2\tz\n")
    _write(os.path.join(d, "src.txt"), "c3\ts3\tnot part of the split\n")
    plain = read_cat_tsv(spark, os.path.join(d, "src"), split=True).orderBy("line_no").collect()
    assert [(r["cat_id"], r["words"]) for r in plain] == [("c1", ["x", "y"]), ("c2", ["z"])]
    shuffled = read_cat_tsv(spark, os.path.join(d, "src"), split=True, rand=True, seed=3).collect()
    assert sorted(r["sent_id"] for r in shuffled) == ["s1", "s2"]


def test_explicit_zeros_are_rejected(spark):
    import pytest
    sp = spark.createDataFrame([(0, 1, 3.0), (0, 2, 4.0), (1, 0, 0.0)], "doc_no long, term_id int, weight double")
    assert S.veclen(sp.filter("doc_no = 0")).collect()[0]["len"] == 5.0
    with pytest.raises(Exception, match="explicit zero"):
        S.veclen(sp).collect()
    with pytest.raises(Exception, match="explicit zero"):
        S.unitvec(sp).collect()


def test_binary_vectors_across_blocks(spark, tmp_path, monkeypatch):
    """A file is streamed: records may lie on block borders; line ends before words and
    spaces inside vectors do no harm; a cut-off record is an error."""
    import io

    import numpy as np
    import pytest

    from embra.sinks.vectors import save_word2vec_binary
    from embra.sources import vectors as R
    rng = np.random.default_rng(5)
    words = [(f"wörd{i}", i, 100 - i, rng.standard_normal(3).astype("float32").astype(float).tolist()) for i in range(40)]
    words[7] = ("seven", 7, 93, np.frombuffer(b"    \n\n\n\n    ", "<f4").astype(float).tolist())
    df = spark.createDataFrame(words, "word string, idx long, cnt long, vec array<double>")
    folder = str(tmp_path / "w2v")
    parts = save_word2vec_binary(df, folder)
    assert sum(r for _, r in parts) == 40
    got = [(r["word"], r["vec"]) for r in R.read_word2vec_binary(spark, folder).orderBy("idx").collect()]
    assert got == [(w, v) for w, _, _, v in words]
    data = b"40 3\n" + b"".join(b"\n" * (i % 2) + w.encode() + b" " + np.array(v, "<f4").tobytes() for w, i, _, v in words)
    one = tmp_path / "one.bin"
    one.write_bytes(data)
    monkeypatch.setattr(R, "READ_BYTES", 7)
    starts = list(R._record_starts(io.BytesIO(data[5:]), 3, 5))
    assert len(starts) == 41 and starts[-1] == len(data)
    assert all(data[a:].startswith(w.encode()) for a, (w, *_) in zip(starts, words))
    with pytest.raises(ValueError, match="cut off"):
        list(R._record_starts(io.BytesIO(data[5:-1]), 3, 5))
    # one file, read by several tasks
    found = R.read_word2vec_binary(spark, str(one), records=6)
    assert found.rdd.getNumPartitions() == 7
    assert [(r["word"], r["vec"]) for r in found.orderBy("idx").collect()] == [(w, v) for w, _, _, v in words]


def test_binary_writes_are_all_or_nothing(spark, tmp_path):
    import pytest
    from pyspark.sql import functions as F

    from embra.sinks.vectors import save_word2vec_binary
    from embra.sources.vectors import read_word2vec_binary
    folder = str(tmp_path / "w2v")

    def words(n):
        return spark.range(n).select(F.format_string("w%04d", "id").alias("word"), F.col("id").alias("idx"),
                                     (n - F.col("id")).alias("cnt"), F.array(F.col("id").cast("double")).alias("vec"))

    lost = F.array(F.raise_error(F.lit("lost")).cast("double"))
    bad = words(500).withColumn("vec", F.when(F.col("idx") == 450, lost).otherwise(F.col("vec")))
    with pytest.raises(Exception, match="lost"):
        save_word2vec_binary(bad, folder)
    assert not (tmp_path / "w2v" / "_manifest.json").exists()
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert len(save_word2vec_binary(words(500), folder)) == 8
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    with pytest.raises(Exception, match="lost"):
        save_word2vec_binary(bad, folder)
    assert read_word2vec_binary(spark, folder).count() == 500   # the earlier write is still there
    parts = save_word2vec_binary(words(30), folder)
    assert len(parts) < 8 and read_word2vec_binary(spark, folder).count() == 30
    (left,) = [p for p in (tmp_path / "w2v").iterdir() if p.is_dir()]
    assert len(list(left.iterdir())) == len(parts)


def test_one_line_token_stream_is_read_by_many_tasks(spark, tmp_path):
    from embra.sources.text import read_text8, stream_tokens
    words = [f"w{i}" for i in range(5000)]
    path = tmp_path / "stream"
    path.write_text(" ".join(words[:2000]) + "  \t" + " ".join(words[2000:]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert stream_tokens(spark, str(path)).select("split").distinct().count() > 4
        got = read_text8(spark, str(path), 300).orderBy("line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert [w for r in got for w in r["words"]] == words
    assert [len(r["words"]) for r in got] == [300] * 16 + [200] and [r["line_no"] for r in got] == list(range(17))


def test_token_streams_are_written_as_strings_of_a_sentence(spark, tmp_path):
    """Not a row for every token: full strings and a shorter one per split, whatever the batches, files and splits."""
    from embra.sources.text import read_text8, stream_tokens, token_chunks
    words = [f"wörd{i}" for i in range(1000)]
    for name, some in (("a", words[:310]), ("b", []), ("c", words[310:])):
        (tmp_path / name).write_text(" ".join(some))
    conf = {"spark.sql.files.maxPartitionBytes": "2500", "spark.sql.files.openCostInBytes": "1",
            "spark.sql.execution.arrow.maxRecordsPerBatch": "37"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        paths = [f"{tmp_path}/{x}" for x in "cab"]
        rows = token_chunks(stream_tokens(spark, paths), 50).collect()
        assert len({(r["file"], r["split"]) for r in rows}) > 3
        assert len(rows) <= 20 + len({r["run"] for r in rows}) and all(r["n"] == len(r["text"].split(" ")) for r in rows)
        for size in (7, 50, 5000):
            got = read_text8(spark, paths, size).orderBy("line_no").collect()
            assert [r["words"] for r in got] == [words[k:k + size] for k in range(0, 1000, size)]
            assert [r["line_no"] for r in got] == list(range(len(got)))
        twice = read_text8(spark, [f"{tmp_path}/a", f"{tmp_path}/a"], 50).collect()
        assert sorted(w for r in twice for w in r["words"]) == sorted(2 * words[:310]) and len(twice) == 13
        assert read_text8(spark, [f"{tmp_path}/b"], 50).count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_lines_sorted_before_and_numbered_without_a_sort(spark, tmp_path):
    """Lines are made after the sort and numbered by split; a file that is named twice is read twice."""
    from pyspark.sql import functions as F

    from embra.sinks.text import write_lines
    from embra.sources.text import read_lines
    path = f"{tmp_path}/bz2"
    write_lines(spark.range(500).select((499 - F.col("id")).alias("k")), path, ["k"], compression="bzip2",
                value=F.concat(F.lit("w"), F.col("k")))
    assert [(r["line_no"], r["value"]) for r in read_lines(spark, path).orderBy("line_no").collect()] == [
        (k, f"w{k}") for k in range(500)]
    for name in "ab":
        (tmp_path / name).write_text(f"{name}1\n{name}2\n")
    got = read_lines(spark, [f"{tmp_path}/b", f"{tmp_path}/a", f"{tmp_path}/b"]).orderBy("line_no").collect()
    assert [r["line_no"] for r in got] == list(range(6))
    assert [r["value"] for r in got] == ["a1", "a2", "b1", "b2", "b1", "b2"]
