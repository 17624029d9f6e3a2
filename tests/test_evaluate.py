"""From texts to accuracy, against plain steps: the relational training step, inference pass by pass with the
relational step, and a full scan for the nearest categories."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from embra.operators import infer as I
from embra.operators import train as T
from embra.operators import train_vec as X
from embra.operators import vocab as V
from embra.plans.eval_queries import trained_accuracy

CAT = T.TrainSpec(family="cat", arch="cbow", hs=True, cbow_mean=True, size=6, window=2, min_count=2, batches=2,
                  slice_len=6, alpha=0.3, combine="mean", seed=5).validate()
NEG = T.with_spec(CAT, arch="sg", hs=False, negative=2, optimizer="adagrad")
SENT = T.with_spec(CAT, family="sent", cbow_mean=False, optimizer="adam")


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(60):
        cat = "abc"[i % 3]
        own = [f"{cat}{x}" for x in range(12)] + ["the", "of"]
        rows.append((i, cat, str(i), [own[k] for k in rng.integers(0, len(own), 5 + i % 17)]))
    rows.append((60, "a", "12", ["the", "a1", "a2"]))   # a document of two lines
    rows.append((61, "b", "61", ["unknown"]))
    rows.append((62, "b", "65", []))                    # a test document without words
    return spark.createDataFrame(rows, "line_no long, cat_id string, sent_id string, words array<string>").checkpoint()


def plain_infer(new, params, vocab, spec, passes):
    spec = I.inference_spec(spec)
    docs = V.doc_ids(new)
    lines = T.prepare_lines(new, vocab, spec, 0, docs, None, keep_oov=True).checkpoint()
    frozen = params.filter("kind <> 'sent'")
    rows = docs.select(F.lit("sent").alias("kind"), F.col("sent_no").alias("id"), T._init_vec(
        "inf", F.col("sent_id"), spec.size, spec.seed, T.doc_denominator(spec)).alias("vec"),
        T.init_state(spec).alias("state")).checkpoint()
    for i, a in enumerate(I.pass_alphas(spec, passes)):
        ins, tg = T.examples(T.positions(lines, spec, epoch=i), spec)
        grads = T.gradients(frozen.unionByName(rows), ins, T.targets_out(tg, vocab, spec, epoch=i), spec, lines)
        rows = T.apply_update(rows, grads, spec, a).checkpoint()
    return {r["sent_id"]: np.array(r["vec"]) for r in docs.join(rows.select(F.col("id").alias("sent_no"), "vec"),
                                                                "sent_no").collect()}


def plain_model(train, test, spec, passes):
    vocab = V.build_vocab(train, spec.min_count, spec.sample, hs=spec.hs, negative=spec.negative).checkpoint()
    docs, cats = V.doc_ids(train), V.cat_ids(train) if spec.family == "cat" else None
    params = T.init_params(spec, vocab, docs, cats)
    for ep in range(spec.epochs):
        lines = T.prepare_lines(train, vocab, spec, ep, docs, cats).checkpoint()
        params = T.train_epoch(params, lines, vocab, spec, ep)
    vec = {(r["kind"], r["id"]): np.array(r["vec"]) for r in params.collect()}
    sn = {r["sent_id"]: r["sent_no"] for r in docs.collect()}
    cn = {r["cat_id"]: r["cat_no"] for r in cats.collect()} if cats else None
    pairs = {}
    for r in train.select("sent_id", "cat_id").distinct().collect():
        s = vec["sent", sn[r["sent_id"]]]
        c = vec["cat", cn[r["cat_id"]]] if cats else 0 * s
        pairs[r["sent_id"], r["cat_id"]] = (s + c) / np.linalg.norm(s + c), s / np.linalg.norm(s)
    return pairs, {k: v / np.linalg.norm(v) for k, v in plain_infer(test, params, vocab, spec, passes).items()}


@pytest.mark.parametrize("specs,by", [([SENT], "sent"), ([CAT, NEG], "pair")], ids=["sent", "joint-cat"])
def test_flow_as_plain_steps(corpus, specs, by):
    test = F.col("sent_id").cast("long") % 5 == 0
    models = [plain_model(corpus.filter(~test), corpus.filter(test), s, 3) for s in specs]
    gold = {r["sent_id"]: r["cat_id"] for r in corpus.filter(test).collect()}
    want = {k: 0 for k in (1, 2)}
    for q, g in gold.items():
        best = {}
        for key in models[0][0]:
            sim = sum(m[0][key][by == "sent"] @ m[1][q] for m in models)
            best[key[1]] = max(best.get(key[1], -9), sim)
        ranked = sorted(best, key=lambda c: -best[c])
        for k in want:
            want[k] += g in ranked[:k]
    got = {r["k"]: (r["n"], r["correct"]) for r in trained_accuracy(corpus, specs, by, ks=[1, 2], passes=3).collect()}
    assert got == {k: (len(gold), n) for k, n in want.items()}


@pytest.mark.parametrize("spec", [NEG, T.with_spec(SENT, optimizer="adadelta"), SENT],
                         ids=["adagrad", "adadelta", "adam"])
def test_fused_passes_as_single_passes(spark, corpus, spec, monkeypatch):
    train, new = corpus.filter("line_no % 2 = 0"), corpus.filter("line_no % 2 = 1")
    params, vocab, _, _ = T.train(train, T.with_spec(spec, epochs=1))
    want = plain_infer(new, params, vocab, spec, 3)
    for hot in (1 << 20, 8):  # some documents dealt over several groups
        monkeypatch.setattr(X, "HOT_TOKENS", hot)
        got = {r["sent_id"]: r["vec"] for r in I.infer_vectors(new, params, vocab, spec, 3, groups=3).collect()}
        assert got.keys() == want.keys()
        for k in want:
            np.testing.assert_allclose(got[k], want[k], atol=1e-9)
