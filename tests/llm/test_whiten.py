import math
from collections import Counter

import numpy as np
import pytest

from embra.llm import whiten

SCHEMA = "vec_id long, embedding array<double>, label int, x int, m int, d int, n string"


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 1, 2, 3, 4, "n") for i, v in rows], SCHEMA)
    out = whiten.whiten_vectors(df, **kw).collect()
    return sorted(out, key=lambda r: (r["key"] is None, r["key"], r["deviation"]))


def expected(rows, components=32, distinct=False):
    """Plain fit of vectors of one length -> n, [(key, deviation)], whitened matrix, explained."""
    keep = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows
            if v and all(c is not None and math.isfinite(c) and abs(64 * c) < 2.0**60 for c in v)]
    keep.sort(key=lambda r: (r[0] is None, r[0] or 0))
    fit = sorted(set(tuple(x) for _, x in keep)) if distinct else [x for _, x in keep]
    n, d = len(fit), len(fit[0])
    s = [sum(x[j] for x in fit) for j in range(d)]

    def centred(x):
        return [(n * a - b) / n for a, b in zip(x, s)]

    c = np.array([centred(x) for x in fit])
    v = c.T @ c / n
    e, p = np.linalg.eigh(v)
    e, p = e[::-1], p[:, ::-1]
    k = min(components, d)
    live = e[:k] > 1e-12 * np.trace(v)
    z = np.array([centred(x) for _, x in keep]) @ p[:, :k]
    z = np.where(live, z / np.sqrt(np.where(live, e[:k], 1)), 0)
    dev = [sum((n * a - b) ** 2 for a, b in zip(x, s)) for _, x in keep]
    return n, [i for i, _ in keep], dev, z, np.where(live, e[:k] / (np.trace(v) or 1), 0)


def compare(got, want):
    n, keys, dev, z, share = want
    assert [r["key"] for r in got] == keys
    assert all(r["n"] == n for r in got)
    assert [r["deviation"] for r in got] == [x if x < 2**63 else None for x in dev]
    mine = np.array([r["z"] for r in got])
    for c in range(z.shape[1]):
        sign = 1 if np.abs(mine[:, c] - z[:, c]).max() <= np.abs(mine[:, c] + z[:, c]).max() else -1
        np.testing.assert_allclose(mine[:, c], sign * z[:, c], atol=1e-6)
    np.testing.assert_allclose([r["explained"] for r in got], np.tile(share, (len(got), 1)), rtol=1e-6, atol=1e-15)
    assert max(r["identity_error"] for r in got) < 1e-9


def vectors(n=300, d=12, seed=3):
    rng = np.random.default_rng(seed)
    m = rng.standard_normal((n, d)) * np.geomspace(4, 0.2, d) @ np.linalg.qr(rng.standard_normal((d, d)))[0]
    return [(i, (m[i % (n - 40)] if i % 5 else m[7]).tolist()) for i in range(n)]  # a fifth are one vector


BAD = [(900, None), (901, []), (902, [None] + [0.0] * 11), (903, [float("nan")] * 12),
       (904, [float("inf")] + [0.0] * 11), (905, [1e300] * 12)]


@pytest.mark.parametrize("weights", ["counts", "one"])
def test_as_brute_force(spark, weights):
    rows = vectors() + BAD
    compare(run(spark, rows, weights=weights, components=5), expected(rows, 5, weights == "one"))


def test_null_and_repeated_keys(spark):
    rows = vectors(80) + [(3, vectors(80)[9][1]), (None, vectors(80)[11][1])]
    got = run(spark, rows)
    assert len(got) == 82 and sum(r["key"] is None for r in got) == 1
    n, keys, dev, *_ = expected(rows)
    assert Counter((r["key"], r["deviation"]) for r in got) == Counter(zip(keys, dev))


def test_large_numbers_stay_exact(spark):
    rows = [(i, [1e9 * i, -3.0 * i * i, 1e15 if i == 3 else 7.0]) for i in range(20)]
    got, (n, keys, dev, *_) = run(spark, rows), expected(rows)
    assert [r["deviation"] for r in got] == [x if x < 2**63 else None for x in dev]
    assert any(r["deviation"] is None for r in got)


def test_components_without_variance_and_lengths(spark):
    flat = [(i, [0.5, float(i % 3), 2.0 * (i % 3)]) for i in range(30)]   # one varying direction
    short = [(100 + i, [float(i), float(i * i % 7)]) for i in range(9)]
    alone = [(200, [1.0])]
    got = run(spark, flat + short + alone)
    compare([r for r in got if r["key"] < 100], expected(flat))
    compare([r for r in got if 100 <= r["key"] < 200], expected(short))
    (one,) = [r for r in got if r["key"] == 200]
    assert (one["n"], one["deviation"], one["z"], one["explained"], one["identity_error"]) == (1, 0, [0.0], [0.0], 0.0)


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, BAD) == []
    with pytest.raises(ValueError):
        run(spark, [], weights="two")


def test_query_over_the_whole_table(spark, sf):
    from embra.llm.queries import QUERIES
    from embra.tables import table
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, sf, "embeddings").collect()]
    n, keys, dev, z, share = expected(rows)
    got = QUERIES["op12_embedding_whitening"](spark, sf).orderBy("vec_id", "component").collect()
    assert len(got) == 32 * len(rows)
    assert [r["vec_id"] for r in got[::32]] == keys and [r["deviation"] for r in got[::32]] == dev
    np.testing.assert_allclose([r["explained"] for r in got[:32]], share, rtol=1e-6)
    mine = np.array([r["whitened"] for r in got]).reshape(-1, 32)
    np.testing.assert_allclose(np.abs(mine), np.abs(z), atol=1e-6)
    assert got[0]["identity_error"] < 1e-9
