import os

from pyspark.sql import functions as F

from embra.operators.param_store import MAX_LAYERS, ParamStore
from embra.session import ensure_checkpoint_dir


def written(spark):
    top = ensure_checkpoint_dir(spark).removeprefix("file:")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(top) for f in names)


def rows(spark, ids, value):
    return spark.createDataFrame([("syn0", i, [value] * 50, []) for i in ids],
                                 "kind string, id long, vec array<double>, state array<double>")


def test_latest_version_wins_over_several_layers(spark):
    store = ParamStore(rows(spark, range(200), 0.0), blocks=5)
    want = dict.fromkeys(range(200), 0.0)
    for k in range(1, 2 * MAX_LAYERS + 2):
        ids = range(k, 200, k + 3)
        store.append(rows(spark, ids, float(k)))
        want.update(dict.fromkeys(ids, float(k)))
        assert len(store.layers) <= MAX_LAYERS
    assert {r["id"]: r["vec"][0] for r in store.latest().collect()} == want
    keys = spark.createDataFrame([(7, "syn0", 3), (8, "syn0", 3), (9, "syn0", 150), (9, "syn1", 3), (9, "syn0", 999)],
                                 "part int, kind string, id long")
    got = sorted((r["part"], r["id"], r["vec"][0]) for r in store.read(store.place(keys)).collect())
    assert got == [(7, 3, want[3]), (8, 3, want[3]), (9, 150, want[150])]


def test_an_update_writes_what_it_touched(spark):
    store = ParamStore(rows(spark, range(20000), 0.0), blocks=4)
    base = written(spark)
    store.append(rows(spark, range(2000), 1.0))
    large = written(spark) - base
    base += large
    store.append(rows(spark, range(200), 2.0))
    small = written(spark) - base
    assert 5 * small < large < 2000 * 50 * 8 * 2


def test_a_mini_batch_moves_only_the_rows_that_groups_read(spark, sf):
    """The plan of a mini-batch shuffles no whole layer: its layers are read in place."""
    from embra.operators import train as T
    from embra.operators import train_vec as X
    from embra.operators import vocab as V
    from embra.tables import benchmark_corpus
    spec = T.TrainSpec(family="sent", arch="cbow", hs=True, size=4, window=2, min_count=2, batches=2).validate()
    corpus = benchmark_corpus(spark, sf)
    vocab = V.build_vocab(corpus, spec.min_count).checkpoint(eager=True)
    docs = V.doc_ids(corpus)
    lines = T.with_segment_cols(T.prepare_lines(corpus, vocab, spec, 0, docs)).checkpoint(eager=True)
    store = ParamStore(T.init_params(spec, vocab, docs))
    lines, _ = X.spread_lines(lines, spec, 4)
    keys, side = X.group_keys(lines, vocab, spec, [0], store)
    read = store.read(keys.filter(F.col("batch") == 0))
    assert "Exchange hashpartitioning" not in read._jdf.queryExecution().executedPlan().toString()
    n = keys.filter("batch = 0 and kind = 'syn0'").groupBy("part").count().agg(F.max("count")).first()[0]
    assert n < vocab.count()


def test_little_data_has_few_tasks(spark):
    """Blocks and ranges follow the rows, not the number of shuffle partitions."""
    from embra.operators.ordering import dense_index
    from embra.operators.param_store import ParamStore
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, "150")
    try:
        rows = spark.range(300).select(F.lit("syn0").alias("kind"), "id", F.array(F.lit(1.0)).alias("vec"),
                                       F.array().cast("array<double>").alias("state"))
        store = ParamStore(rows)
        grads = rows.repartition(3).select("kind", "id", F.array(F.lit(0.5)).alias("grad"))
        store.append(store.read(store.place(grads), state=True))
        assert [x.rdd.getNumPartitions() for x in store.layers] == 2 * [spark.sparkContext.defaultParallelism]
        ix = dense_index(rows, [F.col("id").desc()])
        assert ix.rdd.getNumPartitions() < 10
        assert [(r["id"], r["idx"]) for r in ix.orderBy("idx").collect()] == [(299 - k, k) for k in range(300)]
        assert dense_index(rows.filter("id < 0"), [F.col("id")]).count() == 0
    finally:
        spark.conf.set(name, before)
