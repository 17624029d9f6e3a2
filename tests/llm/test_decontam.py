import random

from pyspark.sql import functions as F

from embra.llm import decontam

from . import brute

DOC = "doc_id long, text string, key string, block int, term string, words int, items int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1, "t", 2, 3) for i, t in rows], DOC)


def items(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "item_id long, text string, item string")


def cases():
    rng = random.Random(1)
    vocab = ["the", "a", "of", *[f"w{i}" for i in range(40)], "naïve", "日本"]
    passage = [rng.choice(vocab) for _ in range(30)]
    bench = [(1, " ".join(passage)), (2, " ".join(rng.choice(vocab) for _ in range(20))), (10, "short item only"),
             (3, None), (4, "  ...  "), (5, " ".join(passage[:15])), (None, " ".join(passage[3:20])),
             (1, " ".join(passage)), (6, "a " * 13)]
    d = []
    for i in range(60):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 120))]
        if i % 3 == 0:
            at = rng.randint(0, len(w))
            lo = rng.randint(0, 15)
            w[at:at] = passage[lo:lo + rng.randint(8, 30)]
        if i % 7 == 0:
            w += ["Short,", "ITEM", "only!"]
        d.append((i, " ".join(w)))
    d += [(100, None), (101, ""), (102, "?! --"), (103, "a-a.a " * 20), (None, " ".join(passage)), (104, passage[0]),
          (7, d[7][1]), (105, " ".join(passage[:12]).upper()), (106, " ".join(passage).upper() + " x" * 100000)]
    return d, bench


def test_matches_brute_force_with_nulls_repeats_and_long_texts(spark):
    d, bench = cases()
    got = decontam.contamination(docs(spark, d).repartition(3), items(spark, bench))
    got = sorted(((r["key"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"])
                  for r in got.collect()), key=str)
    assert got == sorted(brute.contamination(d, bench), key=str)
    assert any(r[4] for r in got) and not all(r[4] for r in got)


def test_small_blocks_and_several_passes_give_the_same(spark, monkeypatch):
    d, bench = cases()
    monkeypatch.setattr(decontam, "BLOCK_TOKENS", 100)
    monkeypatch.setattr(decontam, "WINDOW_BLOCK", 9)
    got = decontam.contamination(docs(spark, d), items(spark, bench))
    got = sorted(((r["key"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"])
                  for r in got.collect()), key=str)
    assert got == sorted(brute.contamination(d, bench), key=str)


def test_clean_documents_keep_their_columns(spark):
    d, bench = cases()
    left = decontam.clean_documents(docs(spark, d), items(spark, bench))
    assert left.schema.names == docs(spark, []).schema.names
    bad = [r[:1] + (t,) for r, (_, t) in zip(brute.contamination(d, bench), d) if r[4]]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in left.collect()))) == sorted(
        str(x) for x in d if x not in bad)


def test_proximity(spark):
    d = docs(spark, [(1, "red x x green blue"), (2, "red x x x green blue"), (3, "blue green red"),
                     (4, "red green"), (5, "green red red blue"), (6, None)])
    index = decontam.build_index(d)
    q = spark.createDataFrame([("q", ["red", "green", "blue"])], "item string, words array<string>")
    near = {r["key"]: [(s["start"], s["end"]) for s in r["spans"]]
            for r in decontam.search(index, q, slop=2).collect()}
    assert near == {1: [(0, 5)], 2: [], 3: [(0, 3)], 4: [], 5: [(0, 4)], 6: []}
    exact = decontam.search(index, q.withColumn("words", F.array(F.lit("green"), F.lit("blue"))))
    assert {r["key"] for r in exact.collect() if r["items"]} == {1, 2}


def test_empty_tables(spark):
    none = decontam.contamination(docs(spark, []), items(spark, [(1, "a b")]))
    assert none.count() == 0
    clean = decontam.contamination(docs(spark, [(1, "a b c")]), items(spark, []))
    assert [(r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in clean.collect()] == [(3, 0, [], False)]


def test_clean_documents_keep_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c", 5), (2, "x y z", 6)], "doc_id long, text string, `a.b` long")
    items = spark.createDataFrame([(1, "x y z")], "item_id long, text string")
    out = decontam.clean_documents(docs, items, length=3, share=20)
    assert out.columns == docs.columns and [tuple(r) for r in out.collect()] == [(1, "a b c", 5)]
