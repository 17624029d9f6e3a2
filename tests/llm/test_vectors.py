import numpy as np
import pytest

from embra.llm import vectors

from . import brute

SCHEMA = "vec_id long, embedding array<float>, label int, cid string, mult int, id int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, lab, "c", 1, 2) for i, v, lab in rows], SCHEMA)


def cases(n=160, dims=24):
    rng = np.random.default_rng(7)
    base = rng.standard_normal((12, dims))
    rows = []
    for i in range(n):
        v = base[i % 12] + (0.12 if i % 3 else 0.18) * rng.standard_normal(dims)
        rows.append((i, v.astype(np.float32).tolist(), int(i % 4) if i % 9 else 7))
    rows += [(500, rows[3][1], rows[3][2]), (501, [2 * x for x in rows[3][1]], rows[3][2]), (3, rows[3][1], rows[3][2]),
             (None, rows[4][1], rows[4][2]), (502, rows[5][1], None), (503, None, 1), (504, [], 1),
             (505, [0.0] * dims, 1), (506, [None] + rows[1][1][1:], 1), (507, [float("nan")] * dims, 1),
             (508, [float("inf")] + rows[1][1][1:], 1), (509, [1.0, 2.0], 1), (510, [2.0, 4.0], 1), (511, [3.0], 1),
             (512, [5.0], 1), (513, [-5.0], 1), (514, [1e-30] * dims, 1), (515, [3e38] * dims, 1)]
    return rows


def expected(rows, cosine):
    ok = [i for i, (_, v, lab) in enumerate(rows) if lab is not None and v and all(
        x is not None and np.isfinite(np.float32(x)) for x in v) and any(v)]
    links = []
    for p, a in enumerate(ok):
        for b in ok[:p]:
            (_, u, x), (_, v, y) = rows[a], rows[b]
            if x == y and len(u) == len(v):
                u, v = np.array(u, np.float32).astype(float), np.array(v, np.float32).astype(float)
                if u @ v / (np.sqrt(u @ u) * np.sqrt(v @ v)) >= cosine:
                    links.append((a, b))
    root = brute.roots(len(rows), links)
    n = [sum(i in p for p in links) for i in range(len(rows))]
    low = {}
    for r, (k, _, _) in zip(root, rows):
        if k is not None:
            low[r] = min(low.get(r, k), k)
    return sorted(((k, n[i], low.get(root[i]), k is not None and k == low.get(root[i]))
                   for i, (k, _, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("options", [{}, {"tile": 3}, {"grid": 3, "blocks": 2}, {"blocks": 7}])
def test_matches_brute_force(spark, options):
    rows = cases()
    got = vectors.near_duplicate_vectors(table(spark, rows), cosine=0.9, **options).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(rows, 0.9)


def test_high_threshold_and_empty_table(spark):
    rows = cases(40)
    got = vectors.near_duplicate_vectors(table(spark, rows), cosine=0.98).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(rows, 0.98)
    assert vectors.near_duplicate_vectors(table(spark, [])).count() == 0
