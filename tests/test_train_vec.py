import pytest
from pyspark.sql import functions as F

from embra.functions.vectors import r6_array
from embra.operators import train as T
from embra.operators import vocab as V
from embra.operators.train_vec import train_epoch_vec
from embra.tables import benchmark_corpus, conversations_corpus

SPECS = [
    dict(family="cat", arch="sg", hs=True, negative=0, optimizer="sgd"),
    dict(family="cat", arch="cbow", hs=True, negative=2, optimizer="adagrad", cbow_mean=True),
    dict(family="sent", arch="sg", hs=False, negative=3, optimizer="adam", combine="mean"),
    dict(family="sent", arch="cbow", hs=True, negative=0, optimizer="adadelta"),
    dict(family="word", arch="sg", hs=True, negative=2, optimizer="sgd"),
    dict(family="word", arch="cbow", hs=False, negative=2, optimizer="sgd", cbow_mean=True),
]


def _rows(p):
    return sorted((r["kind"], r["id"], tuple(r["v"]))
                  for r in p.select("kind", "id", r6_array("vec").alias("v")).collect())


@pytest.mark.parametrize("kw", SPECS, ids=lambda k: f"{k['family']}-{k['arch']}-{k['optimizer']}")
def test_vectorised_equals_relational(spark, sf, kw):
    spec = T.TrainSpec(size=4, window=2, min_count=3, batches=2, slice_len=7, seed=11, **kw).validate()
    corpus = (conversations_corpus if spec.family == "cat" else benchmark_corpus)(spark, sf)
    vocab = V.build_vocab(corpus, spec.min_count, hs=spec.hs, negative=spec.negative).checkpoint(eager=True)
    docs = V.doc_ids(corpus) if spec.family != "word" else None
    cats = V.cat_ids(corpus) if spec.family == "cat" else None
    lines = T.prepare_lines(corpus, vocab, spec, 0, docs, cats).checkpoint(eager=True)
    p0 = T.init_params(spec, vocab, docs, cats).checkpoint(eager=True)
    rel = T.train_epoch(p0, lines, vocab, spec, 0)
    vec = train_epoch_vec(p0, lines, vocab, spec, 0)
    assert _rows(rel) == _rows(vec)


@pytest.mark.parametrize("kw", [SPECS[1], SPECS[2], SPECS[4]], ids=["cat-cbow", "sent-sg", "word-sg"])
def test_groups_and_blocks_do_not_change_the_step(spark, sf, kw):
    spec = T.TrainSpec(size=4, window=2, min_count=3, batches=3, slice_len=5, seed=11, **kw).validate()
    corpus = (conversations_corpus if spec.family == "cat" else benchmark_corpus)(spark, sf)
    vocab = V.build_vocab(corpus, spec.min_count, hs=spec.hs, negative=spec.negative).checkpoint(eager=True)
    docs = V.doc_ids(corpus) if spec.family != "word" else None
    cats = V.cat_ids(corpus) if spec.family == "cat" else None
    lines = T.prepare_lines(corpus, vocab, spec, 0, docs, cats, segment_len=T.SEGMENT_LEN).checkpoint(eager=True)
    p0 = T.init_params(spec, vocab, docs, cats).checkpoint(eager=True)
    one = _rows(train_epoch_vec(p0, lines, vocab, spec, 0, groups=1, blocks=1))
    assert one == _rows(train_epoch_vec(p0, lines, vocab, spec, 0, groups=50, blocks=50))
    assert one == _rows(T.train_epoch(p0, lines, vocab, spec, 0))


@pytest.mark.parametrize("kw", [SPECS[0], SPECS[1], SPECS[5]], ids=["cat-sg", "cat-cbow", "word-cbow"])
def test_segmented_lines_give_the_same_step(spark, sf, kw):
    """Long lines cut into segments (with window margins) train exactly like whole lines."""
    spec = T.TrainSpec(size=4, window=2, min_count=3, batches=2, slice_len=7, seed=11, **kw).validate()
    corpus = (conversations_corpus if spec.family == "cat" else benchmark_corpus)(spark, sf)
    vocab = V.build_vocab(corpus, spec.min_count, hs=spec.hs, negative=spec.negative).checkpoint(eager=True)
    docs = V.doc_ids(corpus) if spec.family != "word" else None
    cats = V.cat_ids(corpus) if spec.family == "cat" else None
    whole = T.prepare_lines(corpus, vocab, spec, 0, docs, cats).checkpoint(eager=True)
    segs = T.prepare_lines(corpus, vocab, spec, 0, docs, cats, segment_len=5).checkpoint(eager=True)
    assert segs.count() > whole.count()
    p0 = T.init_params(spec, vocab, docs, cats).checkpoint(eager=True)
    ref = _rows(T.train_epoch(p0, whole, vocab, spec, 0))
    assert _rows(T.train_epoch(p0, segs, vocab, spec, 0)) == ref
    assert _rows(train_epoch_vec(p0, segs, vocab, spec, 0)) == ref


def _one_line_step(n_tokens, v=2000, size=100, negative=5):
    """Gradients of one long line against random matrices -> rows, peak bytes."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from embra.operators import train_vec as X
    rng = np.random.default_rng(1)
    spec = T.TrainSpec(family="sent", arch="sg", hs=True, negative=negative, size=size, window=5, seed=3).validate()
    words = {"hs_len": np.full(v, 14), "hs_pts": rng.integers(0, v - 1, (v, 14)),
             "hs_codes": rng.integers(0, 2, (v, 14)).astype(float), "noise_lo": np.arange(v) / v,
             "noise_hi": np.arange(1, v + 1) / v, "noise_word": np.arange(v)}
    have = X.Fetched.__new__(X.Fetched)
    have.mats = {k: rng.standard_normal((1 if k in ("sent", "cat") else v, size)) / 10 for k in X.KINDS}
    have.ids = {c: np.arange(v) for c in range(5)} | {X.SENT: np.array([9]), X.CAT: np.array([0])}
    line = pa.table({"line_no": [4], "sent_no": [9], "cat_no": pa.array([None], pa.int64()),
                     "idxs": [rng.integers(0, v, n_tokens).tolist()], "base": [0], "c_lo": [0], "c_hi": [n_tokens],
                     "n": [n_tokens]})
    tracemalloc.start()
    step = X._Step(words, have.mats, spec, 0)
    X.Lines(line).feed(step, spec, None, have)
    out = X._gradient_rows(step, have).to_pandas()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out.set_index(["kind", "id"]).sort_index(), peak


def test_memory_does_not_grow_with_the_line():
    _, small = _one_line_step(2000)
    _, large = _one_line_step(12000)
    assert large < small + 20e6 and large < 500e6


def test_pieces_give_the_gradients_of_the_whole_line(monkeypatch):
    import numpy as np

    from embra.operators import train_vec as X
    whole, _ = _one_line_step(300, v=50, size=8)
    monkeypatch.setattr(X, "PIECE_BYTES", 20_000)
    cut, _ = _one_line_step(300, v=50, size=8)
    assert whole.index.equals(cut.index) and (whole["n"] == cut["n"]).all()
    assert np.allclose(np.stack(whole["grad"]), np.stack(cut["grad"]), atol=1e-9)


def test_keyed_draws_agree_and_are_uniform(spark):
    import duckdb
    import numpy as np
    from pyspark.sql import functions as F

    from embra.functions.vectors import keyed_draw, keyed_draw_np, keyed_draw_sql
    keys = [(i * 10**11 + 5, i, -1, i % 5) for i in range(50)]
    a = keyed_draw_np(7, "neg", 2, *np.array(keys).T)
    df = spark.createDataFrame(keys, "a long, b long, c long, d int")
    b = [r[0] for r in df.select(keyed_draw(7, "neg", 2, *map(F.col, "abcd"))).collect()]
    c = [duckdb.sql(f"SELECT {keyed_draw_sql(7, 'neg', 2, *map(str, k))}").fetchall()[0][0] for k in keys[:5]]
    assert a.tolist() == b and a[:5].tolist() == c
    u = keyed_draw_np(7, "win", 0, np.arange(300)[:, None], np.arange(500)[None, :]).ravel()
    assert 0 <= u.min() and u.max() < 1
    h = np.histogram(u, 100, (0, 1))[0]
    assert ((h - 1500) ** 2 / 1500).sum() < 160 and abs(np.corrcoef(u[:-1], u[1:])[0, 1]) < 0.01


def test_hot_documents_are_dealt_over_partitions(spark, sf, monkeypatch):
    from embra.operators import train_vec as X
    spec = T.TrainSpec(family="cat", arch="cbow", hs=True, size=4, window=2, min_count=3, batches=2, slice_len=7,
                       seed=11).validate()
    corpus = conversations_corpus(spark, sf)
    vocab = V.build_vocab(corpus, spec.min_count).checkpoint(eager=True)
    docs, cats = V.doc_ids(corpus), V.cat_ids(corpus)
    lines = T.prepare_lines(corpus, vocab, spec, 0, docs, cats, segment_len=T.SEGMENT_LEN).checkpoint(eager=True)
    p0 = T.init_params(spec, vocab, docs, cats).checkpoint(eager=True)
    ref = _rows(train_epoch_vec(p0, lines, vocab, spec, 0))
    monkeypatch.setattr(X, "HOT_TOKENS", 40)
    spread, _ = X.spread_lines(lines, spec, 4)
    groups = spread.select("sent_no", "part").distinct().groupBy("sent_no").count()
    assert groups.filter("count > 1").count() > 3
    assert _rows(train_epoch_vec(p0, lines, vocab, spec, 0)) == ref


def test_centres_of_many_lines_go_together():
    """Short lines don't cost a call each, and equal outputs of a document are scored as one row with a count."""
    import numpy as np
    import pyarrow as pa

    from embra.operators import train as T
    from embra.operators import train_vec as X
    n, spec = 500, T.TrainSpec(family="sent", arch="sg", hs=False, negative=2, size=4, window=2)
    rng = np.random.default_rng(5)
    words = rng.integers(0, 6, (n, 7))
    long = pa.int64()
    table = pa.table({"line_no": pa.array(range(n), long), "sent_no": pa.array([k % 10 for k in range(n)], long),
                      "cat_no": pa.nulls(n, long), "idxs": pa.array(words.tolist(), pa.list_(long)),
                      "base": pa.array([0] * n, long), "c_lo": pa.array([0] * n, long),
                      "c_hi": pa.array([7] * n, long), "n": pa.array([7] * n, long)})

    class Count:
        piece, calls, centres = 1_000, 0, 0

        def add(self, lines, at, ii, *rest):
            self.calls, self.centres = self.calls + 1, self.centres + len(ii)

    step = Count()
    X.Lines(table).feed(step, spec, None)
    assert (step.calls, step.centres) == (4, 7 * n)


def test_columns_are_added_with_repeated_ids():
    import numpy as np

    from embra.operators import train_vec as X
    rng = np.random.default_rng(2)
    a = rng.standard_normal((3, 20))
    for rows in (7, 5_000):  # more and fewer ids than rows
        ids, at, weight = rng.integers(0, 7, 300), rng.integers(0, 20, 300), rng.standard_normal(300)
        got, want = np.ones((3, rows)), np.ones((rows, 3))
        X._add_columns(got, ids, a, at, weight)
        np.add.at(want, ids, weight[:, None] * a[:, at].T)
        assert np.allclose(got, want.T)


def test_step_measures_no_batches_and_sums_without_objects(spark, sf):
    """Spark's check of a batch's bytes after every row, and sums of vectors as objects, took most of a step's time."""
    from embra.operators import train_vec as X
    from embra.operators.param_store import ParamStore, written
    name, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []

    class Rows:
        sparkSession = spark

        def checkpoint(self, eager):
            seen.append(spark.conf.get(name))

    before = spark.conf.get(name)
    written(Rows())
    assert seen == [str((1 << 31) - 1)] and spark.conf.get(name) == before

    spec = T.TrainSpec(family="sent", arch="cbow", hs=True, size=4, window=2, min_count=3, seed=11).validate()
    corpus = benchmark_corpus(spark, sf)
    vocab, docs = V.build_vocab(corpus, spec.min_count).checkpoint(eager=True), V.doc_ids(corpus)
    lines = T.prepare_lines(corpus, vocab, spec, 0, docs, segment_len=T.SEGMENT_LEN).checkpoint(eager=True)
    store = ParamStore(T.init_params(spec, vocab, docs))
    dealt, _ = X.spread_lines(lines, spec, 2)
    keys, side = X.group_keys(dealt, vocab, spec, [0], store)
    plan = X.gradients_vec(store, dealt, keys, side, spec)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "ObjectHashAggregate" not in plan and "SortAggregate" not in plan


def test_groups_are_as_large_as_their_different_rows_allow(spark, monkeypatch):
    """A token was taken to bring new rows always: a vocabulary of more than GROUP_BYTES made groups many times smaller."""
    from embra.operators import train_vec as X
    n = 100_000
    vocab = spark.range(n).select(F.col("id").alias("idx"), (1 + F.floor(10_000_000 / (F.col("id") + 1))).alias("cnt"))
    spec = T.TrainSpec(family="sent", arch="cbow", hs=True, size=16, batches=2).validate()
    monkeypatch.setattr(X, "GROUP_BYTES", n * 16 * 8)  # half of all rows
    tokens = X._group_tokens(vocab, spec)
    counts = [1 + 10_000_000 // (k + 1) for k in range(n)]

    def rows(tokens):
        return 2 * sum(min(1.0, tokens * c / sum(counts)) for c in counts)

    assert rows(tokens) <= n < rows(2 * tokens) and tokens > 5 * (n // 5)
    # the tokens of the largest mini-batch count, the others aren't there at the same time
    lines = T.with_segment_cols(spark.range(40).select(F.col("id").alias("line_no"), F.lit(1).cast("long").alias("sent_no"),
                                                       F.array_repeat(F.lit(0).cast("long"), 100).alias("idxs")))
    monkeypatch.setattr(X, "GROUP_TOKENS", 100)
    assert X.group_count(lines, vocab, spec) == 20


def test_the_kernel_gets_the_lines_of_its_batch(spark):
    from embra.operators import train_vec as X
    spec = T.TrainSpec(family="sent", batches=3, slice_len=10)
    rows = [(k, c, c + 15) for k in range(6) for c in (0, 10, 25)]
    lines = spark.createDataFrame(rows, "line_no long, c_lo long, c_hi long")
    for b in range(3):
        want = sorted(r for r in rows if b in {(r[0] + i // 10) % 3 for i in range(r[1], r[2])})
        assert sorted(map(tuple, X.in_batch(lines, spec, b).collect())) == want
