from embra.llm import rollup

ROW = "source string, lang string, tokenizer string, tokens long, n_docs string, extra int"


def rows(spark, *r):
    return spark.createDataFrame([(*x, "clash", 1) for x in r], ROW)


def totals(store):
    return sorted((tuple(r) for r in store.totals().collect()), key=str)


def test_inserts_deletes_and_revisions(spark, tmp_path):
    s = rollup.TokenRollup(spark, str(tmp_path / "s"))
    assert totals(s) == []
    assert s.apply("b 1/x", rollup.inserts(rows(spark, ("a", "en", "v1", 10), ("a", "en", "v1", 5), (None, None, "v1", None))))
    assert totals(s) == [("a", "en", "v1", 2, 15), (None, None, "v1", 1, 0)]
    gone = rollup.deletes(rows(spark, ("a", "en", "v1", 10)))
    assert s.apply("b2", gone) and not s.apply("b2", gone)  # a batch counts once
    assert totals(s) == [("a", "en", "v1", 1, 5), (None, None, "v1", 1, 0)]
    s.apply("b3", rollup.revisions(rows(spark, ("a", "en", "v1", 5)), rows(spark, ("a", "en", "v2", 7))))
    assert totals(s) == [("a", "en", "v2", 1, 7), (None, None, "v1", 1, 0)]


def test_attempts_without_commit_are_never_read(spark, tmp_path):
    s = rollup.TokenRollup(spark, str(tmp_path / "s"))
    batch = rollup.inserts(rows(spark, ("a", "en", "v1", 10)))
    commit, s._commit = s._commit, lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    try:
        s.apply("b", batch)
    except RuntimeError:
        pass
    s._commit = commit
    assert totals(s) == [] and s.apply("b", batch)
    assert totals(s) == [("a", "en", "v1", 1, 10)]


def test_order_and_compaction_change_nothing(spark, tmp_path):
    batches = {f"b{i}": rollup.inserts(rows(spark, ("a", "en", "v1", i), ("b", "fr", "v1", 2 * i))) for i in range(4)}
    a, b = (rollup.TokenRollup(spark, str(tmp_path / x)) for x in "ab")
    for k in batches:
        a.apply(k, batches[k])
    for k in reversed(batches):
        b.apply(k, batches[k])
        b.compact()
    assert totals(a) == totals(b) == [("a", "en", "v1", 4, 6), ("b", "fr", "v1", 4, 12)]
    assert not b.apply("b2", batches["b2"]) and len(b._live()) == 1
    assert a.apply("empty", batches["b0"].limit(0)) and totals(a) == totals(b)
