import random

import numpy as np

from embra.llm import substring

from . import brute

DOC = "doc_id long, text string, key string, batch int, bucket int, back string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1, 2, "b") for i, t in rows], DOC)


def cases():
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(30)] + ["É", "a\x1cb", "x\xa0y"]
    passage = [rng.choice(vocab) for _ in range(60)]
    line = [rng.choice(vocab) for _ in range(8)]
    d = []
    for i in range(80):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            at = rng.randint(0, len(w))
            w[at:at] = passage[rng.randint(0, 20):rng.randint(30, 60)]
        if i % 2:
            w = line + w + line
        d.append((i * 7 % 80, " ".join(w) if i % 5 else "\n".join(w) + "  \t"))
    d += [(200, " ".join(passage)), (201, " ".join(passage)), (200, " ".join(passage)), (None, " ".join(passage)),
          (None, " ".join(passage)), (202, None), (203, ""), (204, " \n\t "), (205, "a " * 500), (206, "a " * 40),
          (207, " ".join(passage[:12])), (208, " ".join(passage) + " " + " ".join(f"u{i}" for i in range(30000)))]
    return d


def result(df):
    return sorted(((r["key"], r["n_words"], r["n_removed"], r["kept"]) for r in df.collect()), key=str)


def test_matches_brute_force(spark):
    d = cases()
    got = substring.remove_repeats(docs(spark, d).repartition(4))
    assert result(got) == sorted(brute.repeats(d), key=str)
    for r in got.collect():
        assert r["n_removed"] == sum(x["end"] - x["start"] for x in r["removed"])


def test_small_batches_buckets_and_colliding_hashes_give_the_same(spark, monkeypatch):
    d = cases()
    monkeypatch.setattr(substring, "BATCH_WORDS", 200)
    monkeypatch.setattr(substring, "RUN_WINDOWS", 3)
    got = substring.remove_repeats(docs(spark, d), bucket_words=50)
    assert result(got) == sorted(brute.repeats(d), key=str)


def test_bucket_compares_words_when_hashes_collide(monkeypatch):
    monkeypatch.setattr(substring, "_range_hash", lambda v, s, e, b: np.zeros(len(s), np.uint64))
    import pandas as pd
    import zstandard
    texts = [b"a b c d", b"a b c e", b"z b c d"]
    pack = zstandard.ZstdCompressor().compress
    g = pd.DataFrame({"batch": [1, 2, 3], "packed": [pack(t) for t in texts],
                      "strings": [substring._pack(np.array([0]))] * 3,
                      "keys": [substring._pack(np.array([k])) for k in (5, 3, 4)]})
    out = substring._count(3)(g)
    lows = {b: substring._unpack(x).tolist()
            for b, x in zip(out["batch"], out["lows"])}
    # "a b c" belongs to 3, "b c d" to 4: only batch 1 has windows that others own
    assert lows == {1: [3, 4]}


def test_hot_runs_rank_last(spark):
    d = docs(spark, [(i, " ".join(f"x{i}_{j}" for j in range(30)) + " one two three four five six seven eight")
                     for i in range(50)])
    packed = substring.batches(d)
    hot = substring.hot_runs(packed, 3, 50 * 38)
    assert 0 < len(hot) <= 1 / substring.HOT_SHARE


def test_empty_table(spark):
    assert substring.remove_repeats(docs(spark, [])).count() == 0
    only = substring.remove_repeats(docs(spark, [(1, None)])).collect()
    assert [(r["key"], r["n_words"], r["kept"]) for r in only] == [(1, 0, "")]
