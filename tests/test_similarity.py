import numpy as np
import pytest
from pyspark.sql import functions as F

from embra.functions.vectors import unit
from embra.operators.similarity import knn
from embra.tables import embedding_vectors


def _brute(q, items, k, exclude_self):
    out = {}
    for qi, qv in q.items():
        sims = sorted(((-round(float(np.dot(qv, iv)), 9), ii, float(np.dot(qv, iv)))
                       for ii, iv in items.items() if not (exclude_self and ii == qi)))
        out[qi] = [(ii, s) for _, ii, s in sims[:k]]
    return out


def test_knn_equals_brute_force_with_blocks(spark, sf):
    e = embedding_vectors(spark, sf).select("vec_id", "label", unit("vec").alias("uvec"))
    rows = e.collect()
    vecs = {r["vec_id"]: np.array(r["uvec"]) for r in rows}
    want = _brute(vecs, vecs, 4, True)
    # small blocks force several query and item blocks
    r = knn(e.select(F.col("vec_id").alias("q_id"), "uvec"), e.select(F.col("vec_id").alias("i_id"), "uvec"),
            4, q_vec="uvec", i_vec="uvec", exclude_self=True, item_block_rows=37, query_block_rows=53)
    got = {}
    for x in r.orderBy("q_id", "rank").collect():
        got.setdefault(x["q_id"], []).append((x["i_id"], x["sim"]))
    assert set(got) == set(want)
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert all(abs(a - b) < 1e-9 for (_, a), (_, b) in zip(got[q], want[q]))


def test_grouped_knn_best_per_group(spark, sf):
    e = embedding_vectors(spark, sf).select("vec_id", "label", unit("vec").alias("uvec"))
    rows = e.collect()
    vecs = {r["vec_id"]: np.array(r["uvec"]) for r in rows}
    lab = {r["vec_id"]: r["label"] for r in rows}
    r = knn(e.select(F.col("vec_id").alias("q_id"), "uvec"),
            e.select(F.col("vec_id").alias("i_id"), "label", "uvec"), 3, q_vec="uvec", i_vec="uvec",
            exclude_self=True, i_group="label", item_block_rows=50)
    got = {}
    for x in r.orderBy("q_id", "rank").collect():
        got.setdefault(x["q_id"], []).append(x["label"])
    for q in list(vecs)[:40]:
        best = {}
        for i, v in vecs.items():
            if i == q:
                continue
            s = round(float(np.dot(vecs[q], v)), 9)
            key = (-s, i)
            if lab[i] not in best or key < best[lab[i]]:
                best[lab[i]] = key
        want = [g for g, _ in sorted(best.items(), key=lambda t: t[1])[:3]]
        assert got[q] == want


def test_grouped_candidates_per_block_are_bounded(spark):
    """A block sends the best items of its k best groups, not one of every group."""
    import numpy as np

    from embra.operators.similarity import knn
    rng = np.random.default_rng(3)
    items = spark.createDataFrame([(i, rng.standard_normal(4).tolist(), i % 200) for i in range(1000)],
                                  "i_id long, vec array<double>, grp long")
    queries = spark.createDataFrame([(i, rng.standard_normal(4).tolist()) for i in range(20)], "q_id long, vec array<double>")
    got = knn(queries, items, 5, i_group="grp", item_block_rows=250, query_block_rows=10)
    rows = {(r["q_id"], r["rank"]): (r["i_id"], r["grp"]) for r in got.collect()}
    iv = {r["i_id"]: (np.array(r["vec"]), r["grp"]) for r in items.collect()}
    for q in queries.collect():
        best = {}
        for i, (v, g) in iv.items():
            s = round(float(v @ np.array(q["vec"])), 9)
            if g not in best or (s, -i) > (best[g][0], -best[g][1]):
                best[g] = (s, i)
        order = sorted(best.items(), key=lambda x: (-x[1][0], x[1][1]))[:5]
        assert [rows[q["q_id"], k + 1] for k in range(5)] == [(i, g) for g, (_, i) in order]
    assert len(rows) == 100


def test_unknown_words_keep_their_rows(spark):
    from embra.operators.words import doesnt_match, most_similar, word_similarity
    words = spark.createDataFrame([("a", 0, 1, [1.0, 0.0]), ("b", 1, 1, [0.6, 0.8]), ("c", 2, 1, [0.0, 1.0])],
                                  "word string, idx long, cnt long, uvec array<double>")
    pairs = spark.createDataFrame([("a", "b"), ("a", "x"), ("y", "x")], "w1 string, w2 string")
    got = {(r["w1"], r["w2"]): (r["sim"], r["missing"]) for r in word_similarity(pairs, words).collect()}
    assert got == {("a", "b"): (0.6, []), ("a", "x"): (None, ["x"]), ("y", "x"): (None, ["y", "x"])}
    lines = spark.createDataFrame([(1, "a"), (1, "b"), (1, "x"), (2, "x")], "line_no long, word string")
    assert {r[0]: r[1] for r in doesnt_match(lines, words).collect()}[2] is None
    terms = spark.createDataFrame([(1, "a", None, 1.0), (1, None, [0.0, 5.0], 2.0), (2, "x", None, 1.0), (2, "a", None, 1.0)],
                                  "q_id long, word string, vec array<double>, weight double")
    got = sorted((r["q_id"], r["nbr"], r["rank"], r["missing"]) for r in most_similar(terms, words, 2).collect())
    assert got == [(1, "b", 1, []), (1, "c", 2, []), (2, None, None, ["x"])]


def _clustered(rng, n, clusters, dims, scale):
    centre = rng.standard_normal((clusters, dims)) * scale
    v = centre[np.arange(n) % clusters] + 0.1 * rng.standard_normal((n, dims))
    v[n // 2:n // 2 + 30] = v[7]  # ties: many equal items
    return v


VARIANTS = [({}, lambda q: (), False), ({"exclude_self": True}, lambda q: (q,), False),
            ({"exclude": "ex"}, lambda q: (q, (q + 24) % 1200), False),
            ({"i_group": "grp", "exclude_self": True}, lambda q: (q,), True)]


@pytest.mark.parametrize("unit_length", [True, False])
def test_cells_give_the_exact_result(spark, monkeypatch, unit_length):
    """On clustered unit vectors a query goes to few of 50 cells."""
    from embra.operators import similarity as S
    rng = np.random.default_rng(6)
    v = _clustered(rng, 1200, 24, 6, 3.0)
    v = v / np.linalg.norm(v, axis=1)[:, None] if unit_length else v * rng.uniform(0.5, 2, (1200, 1))
    items = spark.createDataFrame([(i, x.tolist(), int(i % 7)) for i, x in enumerate(v)],
                                  "i_id long, vec array<double>, grp long").checkpoint()
    ask = list(range(0, 1200, 9)) + [607]
    queries = spark.createDataFrame([(i, v[i].tolist(), [int(i), (i + 24) % 1200]) for i in ask],
                                    "q_id long, vec array<double>, ex array<long>").checkpoint()
    sims = np.round(v[ask] @ v.T, 9)
    seen = []
    real = S._visits
    monkeypatch.setattr(S, "_visits", lambda *a: seen.append(real(*a)) or seen[-1])

    def best(row, left, by_group):
        order = sorted((i for i in range(1200) if i not in left), key=lambda i: (-row[i], i))
        if by_group:
            first = {}
            for i in order:
                first.setdefault(i % 7, i)
            order = list(first.values())
        return order[:5]

    for kw, left, grouped in VARIANTS if unit_length else VARIANTS[1::2]:
        got = {}
        r = S.knn(queries, items, 5, cell_rows=24, item_block_rows=40, query_block_rows=30, **kw)
        for x in r.orderBy("q_id", "rank").collect():
            got.setdefault(x["q_id"], []).append(x["i_id"])
        assert got == {q: best(row, left(q), grouped) for q, row in zip(ask, sims)}
    if unit_length:
        copies = [s.agg(F.avg(F.size("cells"))).first()[0] for s in seen]
        assert max(copies) < 15 and copies[0] < 10, copies


def test_cells_with_few_or_no_rows(spark):
    schema = "i_id long, vec array<double>"
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [0.0, 1.0])], schema)
    q = items.withColumnRenamed("i_id", "q_id")
    empty = spark.createDataFrame([], schema)
    for cell_rows in (1, 4096):
        got = knn(q, items, 2, exclude_self=True, cell_rows=cell_rows).collect()
        assert {(r["q_id"], r["rank"]): r["i_id"] for r in got} == {
            (1, 1): 2, (1, 2): 3, (2, 1): 1, (2, 2): 3, (3, 1): 1, (3, 2): 2}
        assert knn(q, empty, 2, cell_rows=cell_rows).collect() == []
        assert knn(empty.withColumnRenamed("i_id", "q_id"), items, 2, cell_rows=cell_rows).collect() == []
    assert knn(q, items, None).count() == 9


def test_analogy_questions_with_unknown_words(spark):
    from embra.operators.words import analogy_accuracy, analogy_vectors
    words = spark.createDataFrame([("a", 0, 1, [1.0, 0.0]), ("b", 1, 1, [0.6, 0.8]), ("c", 2, 1, [0.0, 1.0]),
                                   ("d", 3, 1, [-0.6, 0.8])], "word string, idx long, cnt long, uvec array<double>")
    q = spark.createDataFrame([(1, "s1", "a", "b", "c", "d"), (2, "s1", "a", "x", "c", "d"), (3, "s2", "c", "b", "a", "d"),
                               (4, "s2", "a", "b", "c", "x")],
                              "q_id long, section string, wa string, wb string, wc string, expected string")
    got = {r["q_id"]: (r["uvec"] is None, r["ex"]) for r in analogy_vectors(q, words).collect()}
    assert got == {1: (False, [0, 1, 2]), 2: (True, None), 3: (False, [2, 1, 0]), 4: (False, [0, 1, 2])}
    acc = analogy_accuracy(q, words)
    assert {r["section"]: (r["correct"], r["incorrect"]) for r in acc.collect()} == {
        "s1": (1, 0), "s2": (1, 0), "total": (2, 0)}


def test_blocks_hold_many_cells(spark):
    """A query is copied once per block, not once per cell it visits; copies of an item don't all become candidates."""
    from embra.operators import similarity as S
    rng = np.random.default_rng(8)
    v = rng.standard_normal((900, 24))
    v[300:] = np.tile(v[:100], (6, 1))  # seven of the first hundred
    v /= np.linalg.norm(v, axis=1)[:, None]
    items = spark.createDataFrame([(i, x.tolist(), int(i % 7)) for i, x in enumerate(v)],
                                  "i_id long, vec array<double>, grp long").checkpoint()
    cells, placed = S._make_cells(items.select("i_id", F.col("vec").alias("iv"), "grp"), 3, False, 30)
    span = S._pack(cells, 900, 300)
    assert len(span) == 30 and max(b for _, b in span) + 1 <= 4
    size = {}
    for r in placed.groupBy("cell").count().collect():
        a, b = span[r["cell"]]
        for x in range(a, b + 1):
            size[x] = size.get(x, 0) + r["count"] / (b - a + 1)
    assert max(size.values()) <= 300
    grp = np.arange(900) % 7
    for by_group in (None, grp):
        best = S._Best(10, 3, by_group if by_group is None else np.sort(by_group), np.arange(900))
        best.add(np.arange(10), 0, np.ones((10, 900)))
        assert len(best.row) <= 70
    sims = np.round(v @ v.T, 9)
    queries = items.filter("i_id % 20 = 0").select(F.col("i_id").alias("q_id"), "vec")
    got = {}
    r = S.knn(queries, items, 3, exclude_self=True, cell_rows=30, item_block_rows=300)
    for x in r.orderBy("q_id", "rank").collect():
        got.setdefault(x["q_id"], []).append(x["i_id"])
    assert got == {q: sorted((i for i in range(900) if i != q), key=lambda i: (-sims[q, i], i))[:3]
                   for q in range(0, 900, 20)}
