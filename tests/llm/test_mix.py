import pytest
from pyspark.sql import functions as F

from embra.llm import mix

SCHEMA = "doc_id long, text string, source string, size string, h int, copies int, b string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 7, 9, None) for i, t, s in rows], SCHEMA)


def taken(df):
    return df.select("row.doc_id", "row.source", "size", "source_size", "target", "copies").collect()


def test_targets_fill_by_weight_and_stop_at_the_cap(spark):
    # weights 3, 1, 2 in code point order, null last; 150 % of 200 words
    sizes = spark.createDataFrame([("b", 100), ("B", 10), (None, 40), ("é", 50)], "source string, size long")
    got = {r["source"]: r["target"] for r in mix.source_targets(sizes).collect()}
    # level 300 / 9: B and é, then the null source are capped, b takes the rest
    assert got == {"B": 20.0, "b": pytest.approx(100.0), "é": 100.0, None: 80.0}
    even = spark.createDataFrame([("a", 100), ("b", 100), ("c", 100)], "source string, size long")
    got = {r["source"]: r["target"] for r in mix.source_targets(even).collect()}
    assert got == {"a": 200.0, "b": pytest.approx(250 / 3), "c": pytest.approx(500 / 3)}


def test_mix_reaches_targets_with_nulls_and_clashing_columns(spark):
    rows = [(i, "w " * (1 + i % 7), ["a", "b", "c", None][i % 4]) for i in range(400)]
    rows += [(1000, None, "a"), (1001, "", "b"), (None, "x y z", "c"), (1002, " \t\n", None), (1003, "v " * 900, "d")]
    rows += [rows[5], rows[5]]  # repeated rows are taken or left together
    out = taken(mix.mix(docs(spark, rows)))
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r["source"], []).append(r)
        assert r["copies"] in (0, 1, 2)
    total = sum(r["size"] for r in out)
    assert sum(g[0]["target"] for g in by.values()) == pytest.approx(min(1.5 * total, 2 * total))
    for g in by.values():
        assert sum(r["size"] for r in g) == g[0]["source_size"]
        got = sum(r["size"] * r["copies"] for r in g)
        assert abs(got - g[0]["target"]) <= max(r["size"] for r in g) * 1.5
        assert g[0]["target"] <= 2 * g[0]["source_size"]
    again = taken(mix.mix(docs(spark, rows[::-1]).repartition(3)))
    assert sorted(map(str, again)) == sorted(map(str, out))
    repeated = [r["copies"] for r in out if r["doc_id"] == 5]
    assert len(repeated) == 3 and len(set(repeated)) == 1


def test_smaller_budget_takes_a_subset(spark):
    d = docs(spark, [(i, "w " * (1 + i % 5), "ab"[i % 2]) for i in range(300)])
    kept = []
    for share in (0.3, 0.6, 0.9):
        m = mix.mix(d, share=share)
        kept.append({r[0] for r in m.filter("copies > 0").select("row.doc_id").collect()})
    assert kept[0] < kept[1] < kept[2]


def test_mixed_rows_repeat_and_keep_columns(spark):
    d = docs(spark, [(i, "w w", "ab"[i % 2]) for i in range(50)])
    out = mix.mixed_rows(d)
    assert out.schema.names == d.schema.names
    times = {r["row"]["doc_id"]: r["copies"] for r in mix.mix(d).collect()}
    got = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == {k: v for k, v in times.items() if v}


def test_empty_table(spark):
    assert mix.mix(docs(spark, [])).count() == 0
    assert mix.mixed_rows(docs(spark, [(1, None, None)])).count() >= 0
