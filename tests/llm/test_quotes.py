from embra.llm import quotes

SCHEMA = "conv_id string, turn long, text string, scope int, depth int, own int, level int"


def table(spark, rows):
    return spark.createDataFrame([(c, t, x, 1, 2, 3, 4) for c, t, x in rows], SCHEMA)


def linked(df):
    return {(r["scope"], r["order"]): r.asDict() for r in quotes.link_quotes(df).collect()}


def test_threads_from_nested_quotes(spark):
    rows = [
        ("a", 1, "Shall we meet?\nTuesday suits me."),
        ("a", 2, "On Monday, Ann wrote:\n> Tuesday  SUITS me.\n\nFine with me."),
        ("a", 3, ">> Tuesday suits me.\n> Fine with me.\nWhere?\n"),
        ("a", 4, "> > Tuesday suits me.\n> Nobody wrote this line\nNo answer to the last one"),
        ("a", 5, "New subject"), ("a", 6, "> New subject\r\n> Where?\r\nThe longer quote wins"),
        ("a", 7, None), ("a", 8, "> \n>\n"), ("a", None, "no place"),
        ("b", 1, "> Shall we meet?\nOther conversation"), (None, 1, "x"), (None, 2, "> x\ny"), ("b", 1, "zzz"),
        ("c", 5, "> later\nfirst"), ("c", 6, "later"),
    ]
    got = linked(table(spark, rows))
    assert len(got) == 13

    def brief(k):
        r = got[k]
        return (r["reply_to"], r["thread"], r["depth"], r["position"], r["quote_levels"], r["n_quoted"], r["n_linked"])

    assert brief(("a", 1)) == (None, 1, 0, 0, 0, 0, 0)
    assert brief(("a", 2)) == (1, 1, 1, 1, 1, 1, 1) and got["a", 2]["own"] == "Fine with me."
    assert brief(("a", 3)) == (2, 1, 2, 3, 2, 2, 2) and got["a", 3]["own"] == "Where?"
    # the nearest level has no origin: the next one names the thread
    assert brief(("a", 4)) == (1, 1, 1, 2, 2, 2, 1)
    assert brief(("a", 6)) == (5, 5, 1, 1, 1, 2, 2)
    assert brief(("a", 7)) == (None, 7, 0, 0, 0, 0, 0) and got["a", 7]["own"] == ""
    assert brief(("a", 8)) == (None, 8, 0, 0, 0, 0, 0)
    assert brief(("b", 1)) == (None, 1, 0, 0, 1, 1, 0)  # rows of one place: smallest text
    assert got[None, 2]["reply_to"] == 1
    assert brief(("c", 5)) == (None, 5, 0, 0, 1, 1, 0)  # nobody can quote what comes later


def test_long_chains_and_common_lines(spark):
    rows = [("a", 0, "start 0\nthanks")] + [("a", i, f"> start {i - 1}\nstart {i}\nthanks") for i in range(1, 70)]
    rows += [(f"h{i}", 0, "thanks") for i in range(50)]
    got = linked(table(spark, rows))
    for i in range(70):
        r = got["a", i]
        assert (r["depth"], r["position"], r["thread"]) == (i, i, 0)
    assert all(got[f"h{i}", 0]["reply_to"] is None for i in range(50))


def test_parsing_of_lines(spark):
    text = ">a\n> b\n> > c\n>>d\n > e\n\\> f\nx > y\n>"
    df = table(spark, [("a", 1, text)])
    from pyspark.sql import functions as F
    lines = df.select(quotes.quoted_lines(F.col("text")).alias("l")).first()["l"]
    assert [tuple(x) for x in lines] == [(1, "a"), (1, "b"), (2, "c"), (2, "d"), (1, "e"), (0, "\\> f"), (0, "x > y"),
                                         (1, "")]


def test_empty_table(spark):
    assert quotes.link_quotes(table(spark, [])).count() == 0
    assert quotes.as_quoted_mail(table(spark, [])).count() == 0
