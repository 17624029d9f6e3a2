import random
from collections import Counter

import numpy as np
import pytest

from embra.llm import quality as q

from . import brute

SPACE = " \t\n\r\x0b\x0c"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measures(text):
    """Plain versions of all measures."""
    t = text or ""
    w = brute.words(t)
    lines = [x for x in t.split("\n") if brute.words(x)]
    grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    hit = {p for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for p in range(i, i + 5)}
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t),
            "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)),
            "n_cut_lines": sum(x.rstrip(SPACE).endswith(("...", "…")) for x in lines), "n_repeat_words": len(hit),
            "n_alpha_words": sum(any(c.isascii() and c.isalpha() or ord(c) > 127 for c in x) for x in w)}


def failing(m):
    out = set()
    n, lines = m["n_words"], m["n_lines"]
    for name, bad in (("length", n < 10), ("repeated_windows", 100 * m["n_repeat_words"] > 20 * n),
                      ("word_length", not 2 * n <= m["word_chars"] <= 15 * n), ("symbols", m["n_symbols"] > n),
                      ("repeated_lines", 2 * m["n_dup_lines"] > lines),
                      ("cut_lines", 10 * m["n_cut_lines"] > 3 * lines), ("letters", 2 * m["n_alpha_words"] < n)):
        if bad:
            out.add(name)
    return out


def texts():
    rnd = random.Random(5)
    vocab = ["ab", "cde", "f", "ü", "日本語", "12", "a.b", "…", "#", "x" * 40, " ", " ", "\x1c"]
    out = [None, "", " \n\t ", "one", "a b c d e f g h i j", "same line of words\n" * 9, "1 2 3 4 5 6 7 8 9 10 11",
           "# * $ % & | < > ## ** word word", "cut off here...\n" + "and here …  \nfine line of seven or eight words",
           "a\r\na\na \na\n\n\nb c", " ".join(f"w{i}" for i in range(500)), "tail " * 3000, "x" * 30000]
    for _ in range(150):
        n = rnd.choice([3, 12, 40, 200])
        out.append("".join(rnd.choice(vocab[:rnd.randint(2, len(vocab))]) + rnd.choice(" \t\n\r\x0b\x0c  ")
                           for _ in range(n)))
    return out


SCHEMA = "doc_id long, text string, key string, kept int, t long, n_words string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", 0, 1, "n") for i, t in rows], SCHEMA)


def test_measures_and_verdicts(spark):
    rows = [*enumerate(texts()), (3, "one"), (None, "no key"), (None, None), (7, texts()[7])]
    got = q.quality_cascade(frame(spark, rows), report=BASE).collect()
    assert len(got) == len(rows)
    want = Counter()
    for i, t in rows:
        m = measures(t)
        want[(i, *(m[x] for x in BASE), not failing(m))] += 1
    assert Counter((r["key"], *(r[x] for x in BASE), r["kept"]) for r in got) == want
    for r in got:
        assert r["kept"] == (r["rejected_by"] is None)
    assert {r["n_judged"] for r in got if r["kept"]} == {len(q.RULES)}


def test_every_measure_of_a_subset():
    group = [(t or "").encode() for t in texts()]
    for first in ("words", "lines", "n_repeat_words"):
        whole = q.Texts(group)
        q._take(whole, first)
        at = np.array([0, 4, 5, 9, 12, 20, 77])
        part = whole.subset(at)
        for m in q.MEASURES:
            q._take(part, m)
        for place, i in enumerate(at):
            want = measures(texts()[i])
            assert {m: part.taken[m][place] for m in want} == want


@pytest.mark.parametrize("seed", range(4))
def test_verdict_does_not_depend_on_the_order(seed):
    group = [(t or "").encode() for t in texts()]
    order = list(range(len(q.RULES)))
    random.Random(seed).shuffle(order)
    _, rejected, judged = q.run_cascade(group, q.RULES, order)
    for t, r, n in zip(texts(), rejected, judged):
        bad = failing(measures(t))
        assert (r < 0) == (not bad)
        if bad:  # the first of the order that fails, and no rule after it was judged
            first = next(k for k, x in enumerate(order) if q.RULES[x].name in bad)
            assert (r, n) == (order[first], first + 1)


def test_later_rules_see_only_what_stands(monkeypatch):
    seen = Counter()

    def counted(name, run):
        def inner(t):
            seen[name] += len(t)
            return run(t)
        return inner

    for m, (needs, run) in list(q.MEASURES.items()):
        monkeypatch.setitem(q.MEASURES, m, (needs, counted(m, run)))
    group = [b"too short"] * 90 + [" ".join(f"word{i}" for i in range(30)).encode()] * 10
    q.run_cascade(group, q.RULES, list(range(len(q.RULES))))
    assert seen["n_words"] == 100 and seen["n_repeat_words"] == 10 and seen["n_alpha_words"] == 10


def test_order_by_rejection_per_cost():
    rules = tuple(q.Rule(n, (m,), None) for n, m in (("a", "n_repeat_words"), ("b", "n_symbols"), ("c", "n_dup_lines")))
    costs = {"words": 1.0, "n_repeat_words": 9.0, "n_symbols": 1.0, "lines": 2.0, "n_dup_lines": 2.0}
    passed = np.ones((100, 3), bool)
    passed[:60, 0] = False    # 60 rejected for 10 s: 6 a second
    passed[40:60, 1] = False  # 20 for 1 s, all of them rejected by a as well
    passed[60:90, 2] = False  # 30 for 4 s
    assert q.order_rules(rules, costs, passed) == [1, 2, 0]
    assert q.order_rules(rules, costs, passed, taken=("n_repeat_words",)) == [0, 2, 1]
    assert q.order_rules(rules, costs, np.ones((0, 3), bool)) == [1, 2, 0]  # nothing known: cheapest first


def test_sample_is_bounded_and_counts(spark):
    df = frame(spark, [(i, "short" if i % 4 else " ".join(f"w{k}" for k in range(20))) for i in range(400)])
    costs, passed = q.sample_statistics(df, sample_rows=100)
    assert set(costs) == set(q.MEASURES) and passed.shape == (100, len(q.RULES))
    assert abs(passed[:, 0].mean() - 0.25) < 0.15


def test_kept_rows_have_all_columns(spark):
    rows = list(enumerate(texts()))
    df = frame(spark, rows)
    got = q.keep_good(df)
    assert got.columns == df.columns
    assert sorted(r["doc_id"] for r in got.collect()) == [i for i, t in rows if not failing(measures(t))]


def test_empty_table(spark):
    df = frame(spark, [])
    assert q.quality_cascade(df, report=BASE).columns == ["key", *BASE, "rejected_by", "n_judged", "kept"]
    assert q.quality_cascade(df).collect() == [] and q.keep_good(df).collect() == []


def test_long_texts_are_split_between_words(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(5000)).encode()
    want = q.Texts([text]).words()[0].tolist()
    monkeypatch.setattr(q, "SPLIT_BYTES", 50)
    assert q.Texts([text]).words()[0].tolist() == want
    assert q.Texts([b"x" * 1000]).words()[1].tolist() == [1]
