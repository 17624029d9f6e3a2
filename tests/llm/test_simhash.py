import random

import numpy as np
import pytest

from embra.llm import simhash
from embra.llm.components import connected_components

from . import brute

DOC = "doc_id long, text string, key string, fp long, component string, root int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1, "c", 2) for i, t in rows], DOC)


def cases():
    rng = random.Random(3)
    base = [[f"w{rng.randint(0, 500)}" for _ in range(150)] for _ in range(12)]
    d = []
    for i in range(90):
        w = list(base[i % 12])
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "edit"
        d.append((i, " ".join(w)))
    d += [(200, None), (201, ""), (202, " \n"), (203, "one"), (204, "ONE"), (205, "one two"), (5, d[5][1]),
          (None, d[8][1]), (None, "no key here at all"), (None, "no key here at all"), (206, "É x É x É x"),
          (207, "lang " * 30000)]
    return d


def expected(d, bits=3):
    f = [brute.fingerprint(t) for _, t in d]
    links = [(a, b) for a in range(len(f)) for b in range(a) if bin(f[a] ^ f[b]).count("1") <= bits]
    r = brute.roots(len(d), links)
    low = {}
    for x, (k, _) in zip(r, d):
        if k is not None:
            low[x] = min(low.get(x, k), k)
    return [(k, np.uint64(x).astype(np.int64).item(), low.get(y)) for (k, _), x, y in zip(d, f, r)]


def test_matches_brute_force(spark):
    d = cases()
    got = [(r["key"], r["fp"], r["component"]) for r in simhash.near_duplicates(docs(spark, d)).collect()]
    assert sorted(got, key=str) == sorted(expected(d), key=str)


def test_one_document_of_each_group_stays(spark):
    d = cases()
    out = simhash.representatives(docs(spark, d).repartition(3))
    assert out.schema.names == docs(spark, []).schema.names
    ids = [r["doc_id"] for r in out.collect()]
    groups = {c for _, _, c in expected(d)}
    assert sorted(map(str, ids)) == sorted(map(str, groups))


def test_groups_that_share_a_key_and_groups_without_keys_keep_one_row_each(spark):
    rng = random.Random(8)
    long = [[f"v{rng.randint(0, 900)}" for _ in range(400)] for _ in range(4)]
    texts = [" ".join(w) for w in long]
    edited = [" ".join(w[:j] + ["edit"] + w[j + 1:]) for w in (long[3],) for j in range(0, 400, 7)]
    other = [t for t in edited if 0 < bin(brute.fingerprint(t) ^ brute.fingerprint(texts[3])).count("1") <= 3][:5]
    assert len(other) == 5  # near copies with other fingerprints
    # 7 stands for two groups; for the third it isn't the smallest key
    d = [(7, texts[0]), (7, texts[1]), (9, texts[1]), (7, texts[2]), (3, texts[2]), (7, texts[0])]
    d += [(None, t) for t in [texts[3], *other]]
    want = [(3, texts[2]), (7, texts[0]), (7, texts[1])]
    runs = []
    for n in (1, 5):
        runs.append(sorted(((r["doc_id"], r["text"]) for r in simhash.representatives(docs(spark, d).repartition(n))
                            .collect()), key=str))
        assert [r for r in runs[-1] if r[0] is not None] == want
        assert len(runs[-1]) == 4 and runs[-1][-1][1] in [texts[3], *other]
    assert runs[0] == runs[1]


def test_the_kept_row_does_not_depend_on_the_order_of_rows(spark):
    rows = [(1, "same words in a row", f"k{i}", None if i % 2 else i, "c", i) for i in range(20)]
    kept = {tuple(simhash.representatives(spark.createDataFrame(r, DOC).repartition(n)).collect()[0])
            for r, n in ((rows, 1), (rows[::-1], 1), (rows[7:] + rows[:7], 4))}
    assert len(kept) == 1


@pytest.mark.parametrize("limit", [4, 50, 100000])
def test_trie_join_finds_the_components_of_all_pairs(spark, limit):
    rng = np.random.default_rng(4)
    v = rng.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2)
    near = v[:150] ^ (np.uint64(1) << rng.integers(0, 64, 150, dtype=np.uint64))
    v = np.unique(np.concatenate((v, near, near[:50] ^ np.uint64(6), np.arange(40, dtype=np.uint64),
                                  [np.uint64(0), np.uint64((1 << 64) - 1)])))
    links = [(a, b) for a in range(len(v)) for b in range(a) if bin(int(v[a]) ^ int(v[b])).count("1") <= 3]
    want = brute.roots(len(v), links)
    fps = spark.createDataFrame([(x,) for x in v.view(np.int64).tolist()], "fp long")
    edges = simhash.fingerprint_links(fps, 3, limit)
    got = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    groups = {}
    for x, r in zip(v.view(np.int64).tolist(), want):
        groups.setdefault(r, set()).add(x)
    assert {frozenset(g) for g in groups.values() if len(g) > 1} == {
        frozenset(n for n in got if got[n] == r) for r in set(got.values())}
    assert all(root == min(g) for g in groups.values() if len(g) > 1 for root in [got[next(iter(g))]])


def test_trie_pairs_are_exactly_the_near_pairs():
    rng = np.random.default_rng(5)
    a = np.unique(rng.integers(0, 4096, 200).astype(np.uint64) << np.uint64(20))
    b = np.unique(rng.integers(0, 4096, 200).astype(np.uint64) << np.uint64(20))
    found = {(int(x), int(y)) for i, j in simhash.trie_pairs(simhash.Trie(a), simhash.Trie(b), 2, False)
             for x, y in zip(a[i], b[j])}
    assert found == {(int(x), int(y)) for x in a for y in b if bin(int(x) ^ int(y)).count("1") <= 2}
    t = simhash.Trie(a)
    same = [(int(x), int(y)) for i, j in simhash.trie_pairs(t, t, 2, True) for x, y in zip(i, j)]
    assert len(same) == len(set(same)) and all(i < j for i, j in same)
    assert len(same) == sum(bin(int(a[i]) ^ int(a[j])).count("1") <= 2 for j in range(len(a)) for i in range(j))


def test_components(spark):
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)]
    links += [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(50)] + [(300, 300), (301, None), (310, 305)]
    e = spark.createDataFrame(links, "u long, v long")
    got = {r["node"]: r["root"] for r in connected_components(e).collect()}
    nodes = sorted({x for p in links for x in p if x is not None})
    at = {x: i for i, x in enumerate(nodes)}
    want = brute.roots(len(nodes), [(at[a], at[b]) for a, b in links if b is not None])
    linked = {x for a, b in links if b is not None and a != b for x in (a, b)}
    assert got == {x: nodes[want[at[x]]] for x in linked}
    assert connected_components(e.limit(0)).count() == 0


def test_empty_table(spark):
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    assert simhash.representatives(docs(spark, [])).count() == 0
