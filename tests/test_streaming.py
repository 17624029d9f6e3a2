import os

from embra.streaming import word_count as W


def arrive(spark, path, texts):
    spark.createDataFrame([(t.split(),) for t in texts], "words array<string>").coalesce(1).write.mode("append").parquet(path)


def run(spark, tmp_path, every):
    path = str(tmp_path / "in")
    stream = spark.readStream.schema("words array<string>").option("maxFilesPerTrigger", 1).parquet(path)
    return W.run_to_table(W.stream_word_count(stream), str(tmp_path / "out"), str(tmp_path / "ckpt"), every)


def counts(spark, tmp_path):
    return {r["word"]: r["cnt"] for r in W.read_counts(spark, str(tmp_path / "out")).collect()}


def test_triggers_write_what_changed(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    arrive(spark, path, ["a b c d e f", "a b"])
    run(spark, tmp_path, 100)
    arrive(spark, path, ["a z"])
    run(spark, tmp_path, 100)
    arrive(spark, path, ["z z q"])
    run(spark, tmp_path, 100)
    assert counts(spark, tmp_path) == {"a": 3, "b": 2, "c": 1, "d": 1, "e": 1, "f": 1, "z": 3, "q": 1}
    # the words that each trigger changed, with their new counts
    got = [{r["word"]: r["cnt"] for r in spark.read.parquet(f"{out}/deltas/{n}").collect()} for n in range(3)]
    assert got == [{"a": 2, "b": 2, "c": 1, "d": 1, "e": 1, "f": 1}, {"a": 3, "z": 1}, {"z": 3, "q": 1}]
    # a trigger that is run again replaces its folders by the same rows
    W._mark(spark, out, "markers", 2)
    spark.createDataFrame([("z", 3), ("q", 1)], "word string, cnt long").write.mode("overwrite").parquet(f"{out}/deltas/2")
    assert counts(spark, tmp_path)["z"] == 3
    # a trigger without a marker isn't read
    spark.createDataFrame([("z", 99)], "word string, cnt long").write.parquet(f"{out}/deltas/3")
    assert counts(spark, tmp_path)["z"] == 3


def test_deltas_are_folded_into_bases(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(5):
        arrive(spark, path, [f"a b{k} c{k % 2}"])
    run(spark, tmp_path, 2)
    assert sorted(os.listdir(f"{out}/bases")) == ["1", "3"]
    assert counts(spark, tmp_path) == {"a": 5, "b0": 1, "b1": 1, "b2": 1, "b3": 1, "b4": 1, "c0": 3, "c1": 2}
    # the base stands for what came before
    spark.createDataFrame([("a", 1000)], "word string, cnt long").write.mode("overwrite").parquet(f"{out}/deltas/0")
    assert counts(spark, tmp_path)["a"] == 5


def test_inference_places_the_model_once(spark, sf, tmp_path, monkeypatch):
    from embra.operators import infer as I
    from embra.operators import train as T
    from embra.operators import vocab as V
    from embra.streaming import infer as S
    from embra.tables import benchmark_corpus
    corpus = benchmark_corpus(spark, sf).withColumn("cat_id", __import__("pyspark").sql.functions.lit("c")).checkpoint()
    spec = T.TrainSpec(family="cat", size=4, window=2, min_count=2, hs=True)
    params, vocab, docs, cats = T.train(corpus, spec)
    pairs = V.sent_cat_pairs(corpus, docs, cats)
    path = str(tmp_path / "new")
    corpus.limit(9).repartition(3).write.parquet(path)
    made, calls = [], []
    real, real_infer = I.ParamStore, S.infer_vectors

    class Counted(real):
        def __init__(self, *a):
            made.append(1)
            super().__init__(*a)

    monkeypatch.setattr(I, "ParamStore", Counted)
    monkeypatch.setattr(S, "infer_vectors", lambda *a, **k: calls.append(1) or real_infer(*a, **k))
    stream = spark.readStream.schema(corpus.schema).option("maxFilesPerTrigger", 1).parquet(path)
    S.stream_infer(stream, params, vocab, pairs, spec, str(tmp_path / "out"), str(tmp_path / "ckpt"), iterations=2)
    assert len(calls) == 3 and len(made) == 1  # three triggers, one placing
    assert spark.read.parquet(str(tmp_path / "out")).select("sent_id").distinct().count() == 9


def test_stream_files_follow_the_size_of_the_table(spark, tmp_path):
    """A trigger takes several files, as many as the table has splits over the triggers: none is a third of it."""
    from pyspark.sql import functions as F

    from embra.plans.stream_queries import _file_stream
    spark.range(9000).repartition(9).write.parquet(f"{tmp_path}/documents.parquet")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        s = _file_stream(spark, str(tmp_path), "documents", 3)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    seen = []
    q = s.select(F.input_file_name().alias("file")).writeStream.foreachBatch(
        lambda d, i: seen.append((d.distinct().count(), d.count()))).option(
        "checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(seen) == 3 and min(f for f, _ in seen) >= 3 and sum(n for _, n in seen) == 9000
