from fractions import Fraction

from pyspark.sql import functions as F

from embra.operators import vocab as V
from embra.operators.ordering import dense_index, running_sum
from embra.tables import documents_corpus


def test_huffman_invariants(spark, sf):
    corpus = documents_corpus(spark, sf)
    v = V.huffman(V.vocab_prune(V.word_count(corpus), 5)).collect()
    n = len(v)
    assert n > 10
    kraft = sum(Fraction(1, 2 ** len(r["code"])) for r in v)
    assert kraft == 1
    for r in v:
        assert len(r["code"]) == len(r["point"])
        assert all(0 <= p < n - 1 for p in r["point"])
    # every word has the root as first inner node, and frequent words have short codes
    roots = {r["point"][0] for r in v}
    assert roots == {n - 2}
    by_cnt = sorted(v, key=lambda r: -r["cnt"])
    assert len(by_cnt[0]["code"]) <= len(by_cnt[-1]["code"])
    # codes form a prefix-free set
    codes = sorted("".join(map(str, r["code"])) for r in v)
    assert all(not b.startswith(a) for a, b in zip(codes, codes[1:]))


def test_noise_intervals_cover_unit(spark, sf):
    corpus = documents_corpus(spark, sf)
    v = V.noise_dist(V.vocab_prune(V.word_count(corpus), 5)).orderBy("idx").collect()
    assert v[0]["noise_lo"] == 0.0 and v[-1]["noise_hi"] == 1.0
    for a, b in zip(v, v[1:]):
        assert abs(a["noise_hi"] - b["noise_lo"]) < 1e-12
        assert b["noise_hi"] > b["noise_lo"]


def test_dense_index_matches_row_number(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("k"))
    for parts in (1, 3, 16):
        got = dense_index(df, [F.col("k")], "ix", num_partitions=parts).orderBy("k").collect()
        assert [r["ix"] for r in got] == list(range(5000))


def test_running_sum_partition_independent(spark):
    df = spark.range(0, 3000).select("id", (F.col("id") % 7).alias("v"))
    want = []
    acc = 0
    for i in range(3000):
        acc += i % 7
        want.append(acc)
    for parts in (1, 5):
        got = running_sum(df, [F.col("id")], F.col("v"), "c", num_partitions=parts).orderBy("id").collect()
        assert [r["c"] for r in got] == want


def test_subsample_prob_formula(spark):
    df = spark.createDataFrame([("a", 0, 900), ("b", 1, 100)], "word string, idx long, cnt long")
    got = {r["word"]: r["sample_prob"] for r in V.subsample_prob(df, 0.01).collect()}
    t = 0.01 * 1000
    for w, c in (("a", 900), ("b", 100)):
        assert abs(got[w] - min(1.0, ((c / t) ** 0.5 + 1) * t / c)) < 1e-12
    assert V.subsample_prob(df, 0.0).first()["sample_prob"] == 1.0


def test_huffman_codes_equal_those_of_single_merges():
    import heapq
    import random

    import numpy as np

    from embra.operators.vocab import HuffmanRuns
    rng = random.Random(1)
    for _ in range(300):
        v = rng.choice([0, 1, 2, 3, 7, 40])
        cnt = sorted((rng.choice([1, 1, 2, 3, rng.randint(1, 30)]) for _ in range(v)), reverse=True)
        heap = sorted((c, i) for i, c in enumerate(cnt))
        parent = {}
        for node in range(v, 2 * v - 1):
            (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
            parent[x], parent[y] = (node, 0), (node, 1)
            heapq.heappush(heap, (a + b, node))
        want = []
        for node in range(v):
            code, path = [], []
            while node in parent:
                node, bit = parent[node]
                code.insert(0, bit)
                path.insert(0, node - v)
            want.append((code, path))
        first = {c: cnt.index(c) for c in cnt}
        runs = HuffmanRuns([(c, i, cnt.count(c)) for c, i in first.items()])
        assert list(zip(*runs.codes(np.arange(v)))) == want
