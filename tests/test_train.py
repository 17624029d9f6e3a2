import pytest
from pyspark.sql import functions as F

from embra.functions.vectors import keyed_draw_np, r6_array
from embra.operators import train as T
from embra.operators import vocab as V
from embra.operators.infer import infer_vectors
from embra.tables import benchmark_corpus, conversations_corpus


def _run(spark, sf, spec, corpus_fn):
    params, vocab, docs, cats = T.train(corpus_fn(spark, sf), spec)
    return sorted((r["kind"], r["id"], tuple(r["v"])) for r in
                  params.select("kind", "id", r6_array("vec").alias("v")).collect())


def test_step_is_partition_independent(spark, sf):
    spec = T.TrainSpec(family="cat", arch="cbow", hs=True, negative=2, size=4, window=2, min_count=3,
                       batches=2, seed=3, cbow_mean=True, optimizer="adagrad")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        a = _run(spark, sf, spec, conversations_corpus)
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        b = _run(spark, sf, spec, conversations_corpus)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == b


def test_loss_falls_over_epochs(spark, sf):
    spec = T.TrainSpec(family="sent", arch="sg", hs=True, size=8, window=3, min_count=2, batches=4,
                       slice_len=8, seed=5, alpha=0.5, combine="mean")
    corpus = benchmark_corpus(spark, sf)
    vocab = V.build_vocab(corpus, spec.min_count, hs=True).checkpoint(eager=True)
    docs = V.doc_ids(corpus)
    lines = T.prepare_lines(corpus, vocab, spec, 0, docs, None).checkpoint(eager=True)
    ins, tg = T.examples(T.positions(lines, spec), spec)
    outs = T.targets_out(tg, vocab, spec)
    params = T.init_params(spec, vocab, docs)
    losses = [T.batch_loss(params, ins, outs).first()["loss"]]
    for ep in range(3):
        params = T.train_epoch(params, lines, vocab, spec, ep)
        losses.append(T.batch_loss(params, ins, outs).first()["loss"])
    assert losses[-1] < losses[0]
    assert all(b <= a + 1e-9 for a, b in zip(losses, losses[1:]))


def test_both_objectives_required():
    import pytest
    with pytest.raises(ValueError):
        T.TrainSpec(hs=False, negative=0).validate()


def test_identifier():
    assert T.TrainSpec(family="cat", size=300, arch="cbow", hs=True, alpha=0.025, epochs=20).identifier() \
        == "cat300_cb_hs_a0.025_it20_sgd"
    assert T.TrainSpec(family="sent", size=100, hs=False, negative=5, optimizer="adadelta",
                       normalize_each_epoch=True).identifier() == "sent100_sg_neg5_a0.025_it1_n_adadel"


def test_inference_freezes_model_and_is_batch_free(spark, sf):
    spec = T.TrainSpec(family="cat", arch="sg", hs=True, size=4, window=2, min_count=3, batches=1, seed=3)
    corpus = conversations_corpus(spark, sf)
    params, vocab, docs, cats = T.train(corpus, spec)
    new = benchmark_corpus(spark, sf)
    whole = {r["sent_id"]: r["vec"] for r in infer_vectors(new, params, vocab, spec, 2).collect()}
    part = new.filter(F.col("line_no") < 20)
    some = {r["sent_id"]: r["vec"] for r in infer_vectors(part, params, vocab, spec, 2).collect()}
    assert some and all(abs(a - b) < 1e-12 for k in some for a, b in zip(some[k], whole[k]))


def test_frequent_words_do_not_gather_in_one_partition(spark):
    """One word in the vocabulary and one outside it each make up 30% of the tokens; broadcasts by size are off."""
    from pyspark.sql import functions as F

    from embra.operators import vocab as V
    rows = [(i, "c", str(i), [x for k in range(40) for x in ("the", "unseen", f"w{(i * 40 + k) % 3000}")]) for i in range(300)]
    corpus = spark.createDataFrame(rows, "line_no long, cat_id string, sent_id string, words array<string>")
    vocab = V.build_vocab(corpus, 2).filter("word <> 'unseen'").checkpoint()
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"]
    before = {n: spark.conf.get(n) for n in names}
    try:
        spark.conf.set(names[0], "-1")
        spark.conf.set(names[1], "false")
        toks = V.explode_tokens(corpus.select("line_no", "words"), "words", pos="opos")
        v = vocab.select("word", "idx", "sample_prob")
        many = toks.groupBy("word").count().orderBy(F.col("count").desc(), "word").limit(T.HOT_WORDS).select("word")
        for frequent in (v.filter(F.col("idx") < T.HOT_WORDS), many.join(v, "word", "left")):
            j = T.lookup_words(toks, v, frequent)
            sizes = [r["count"] for r in j.groupBy(F.spark_partition_id()).count().collect()]
            if frequent.filter("word = 'unseen'").count():
                assert len(sizes) == 8 and max(sizes) < 2 * sum(sizes) / 8
            got = {(r["word"], r["idx"]) for r in j.select("word", "idx").distinct().collect()}
            assert got == {(r["word"], r["idx"]) for r in v.collect()} | {("unseen", None)}
            assert sum(sizes) == 36000
    finally:
        for n, x in before.items():
            spark.conf.set(n, x)


@pytest.mark.parametrize("segment_len", [None, 4])
def test_lines_bring_each_word_to_the_vocabulary_once_a_chunk(spark, monkeypatch, segment_len):
    """Not a row for every token; lines of equal keys are one, null words keep their place, in chunks of any size."""
    seen = []
    look_up = T.lookup_words
    monkeypatch.setattr(T, "lookup_words", lambda tokens, *a: seen.append(tokens.count()) or look_up(tokens, *a))
    lines = [(1, "d", ["a", "b"] * 30 + ["x"]), (1, "d", ["b", "c", "a"]), (None, "e", ["c", None, "zz", "a"]), (3, "f", None),
             (4, None, ["zz"]), (5, "g", [])]
    corpus = spark.createDataFrame(lines, "line_no long, sent_id string, words array<string>").withColumn(
        "cat_id", F.lit("k")).coalesce(1)
    vocab = spark.createDataFrame([("a", 0, 9, 1.0), ("b", 1, 5, 0.4), ("c", 2, 3, 0.9)],
                                  "word string, idx long, cnt long, sample_prob double")
    ids = {"a": 0, "b": 1, "c": 2}
    spec = T.TrainSpec(family="cat", window=2, sample=0.1, seed=3)
    merged = sorted(((p, ids.get(w, -1)) for _, _, words in lines[:2] for p, w in enumerate(words)),
                    key=lambda x: (x[0], x[1]))
    for chunk, step in ((1, 1), (1 << 20, 64)):
        monkeypatch.setattr(T, "CHUNK_TOKENS", chunk)
        monkeypatch.setattr(T, "CHUNK_LINES", step)
        got = T.prepare_lines(corpus, vocab, spec, keep_oov=True).collect()
        assert {r["line_no"]: r["idxs"] for r in got} == {1: [i if i >= 0 else None for _, i in merged],
                                                          None: [2, None, 0], 4: [None]}
        seen.clear()
        got = T.prepare_lines(corpus, vocab, spec, 1, segment_len=segment_len).collect()
        assert sum(seen) <= 6 or step == 1
        u = [float(keyed_draw_np(3, "sub", 1, 1, p)) for p in range(61)]
        want = [i for p, i in merged if i == 0 or i > 0 and (0.4, 0.9)[i - 1] >= u[p]]
        if not segment_len:
            # a draw without a line number keeps only what is always kept
            assert {r["line_no"]: r["idxs"] for r in got} == {1: want, None: [0]}
        else:
            own = sorted((r["c_lo"], r["idxs"][r["c_lo"] - r["base"]:r["c_hi"] - r["base"]]) for r in got if r["line_no"] == 1)
            assert [i for _, x in own for i in x] == want


@pytest.mark.parametrize("arch,sums", [("sg", 1), ("cbow", 2)])
def test_the_relational_step_moves_only_partial_sums(spark, monkeypatch, arch, sums):
    """Examples are joined with vectors where they are made: no shuffle but those of the summed gradients."""
    moves, gradients, name = [], T.gradients, "spark.sql.requireAllClusterKeysForCoPartition"

    def watched(*args):
        g = gradients(*args)
        spark.conf.set(name, "false")
        moves.append(g._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        spark.conf.set(name, "true")
        return g

    monkeypatch.setattr(T, "gradients", watched)
    rows = [(i, "k", str(i % 7), [f"w{(i * 3 + k * k) % 11}" for k in range(9)]) for i in range(30)]
    corpus = spark.createDataFrame(rows, "line_no long, cat_id string, sent_id string, words array<string>")
    spec = T.TrainSpec(family="cat", arch=arch, hs=True, negative=2, size=4, window=2, min_count=1, batches=1).validate()
    vocab = V.build_vocab(corpus, 1, hs=True, negative=2).checkpoint(eager=True)
    docs, cats = V.doc_ids(corpus), V.cat_ids(corpus)
    lines = T.prepare_lines(corpus, vocab, spec, 0, docs, cats).checkpoint(eager=True)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert T.train_epoch(T.init_params(spec, vocab, docs, cats), lines, vocab, spec).count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert moves == [sums]


def test_noise_draws_are_not_computed_again_by_filters(spark):
    """A null check on a draw would repeat its steps, each squaring the one before, term by term."""
    spec = T.TrainSpec(family="cat", arch="sg", hs=False, negative=2, window=2)
    tg = spark.createDataFrame([(0, 7, 1, 1, 2, 0, 0), (0, None, 1, 1, 2, 0, 0)],
                               "part int, line_no long, i long, j long, target long, sent_no long, cat_no long")
    words = spark.createDataFrame([(0, k, k / 8, (k + 1) / 8) for k in range(8)],
                                  "part int, idx long, noise_lo double, noise_hi double")
    out = T.targets_out(tg, words, spec)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "48271" in plan and not [x for x in plan.splitlines() if "Filter" in x and "48271" in x]
    u = keyed_draw_np(1, "neg", 0, 7, 1, 1, [1, 2])
    want = sorted({(int(x * 8), 0.0) for x in u if int(x * 8) != 2} | {(2, 1.0)})
    got = out.filter("line_no is not null").select("out_id", "label").distinct().collect()
    assert sorted((r["out_id"], r["label"]) for r in got) == want
    assert [r["out_id"] for r in out.filter("line_no is null").collect()] == [2]  # a line without a number draws nothing
