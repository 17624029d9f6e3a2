from pyspark.sql import functions as F

from embra.functions.text import (decode_html, decode_html_py, deaccent, deaccent_py, simple_preprocess,
                                  tokenize)


def test_deaccent_docstring(spark):
    assert deaccent_py("Šéf chomutovských komunistů dostal poštou bílý prášek") == \
        "Sef chomutovskych komunistu dostal postou bily prasek"
    df = spark.createDataFrame([("Šéf chomutovských komunistů dostal poštou bílý prášek",)], "t string")
    assert df.select(deaccent("t")).first()[0] == "Sef chomutovskych komunistu dostal postou bily prasek"


def test_tokenize_docstring(spark):
    df = spark.createDataFrame([("Nic nemůže letět rychlostí vyšší, než 300 tisíc kilometrů za sekundu!",)],
                               "t string")
    got = df.select(tokenize("t", deacc=True)).first()[0]
    assert got == ["Nic", "nemuze", "letet", "rychlosti", "vyssi", "nez", "tisic", "kilometru", "za", "sekundu"]


def test_tokenize_keeps_non_decimal_numerics_and_underscore(spark):
    df = spark.createDataFrame([("a1b x_y ½ 42",)], "t string")
    assert df.select(tokenize("t")).first()[0] == ["a", "b", "x_y", "½"]


def test_simple_preprocess_lengths(spark):
    df = spark.createDataFrame([("A bb _cc " + "d" * 16 + " Éé",)], "t string")
    assert df.select(simple_preprocess("t")).first()[0] == ["bb", "éé"]


def test_decode_html_docstring(spark):
    assert decode_html_py("l&#39;eau") == "l'eau"
    assert decode_html_py("foo &lt; bar") == "foo < bar"
    assert decode_html_py("E tu vivrai nel terrore - L&#x27;aldil&#xE0; (1981)") == \
        "E tu vivrai nel terrore - L'aldilà (1981)"
    # quirks kept from the reference: '&xi;' stays; an upper-case hex marker returns the input whole
    assert decode_html_py("&xi; &amp;") == "&xi; &"
    assert decode_html_py("&#X41; &amp;") == "&#X41; &amp;"
    assert decode_html_py("&unknown;") == "&unknown;"
    df = spark.createDataFrame([("l&#39;eau",), (None,)], "t string")
    assert [r[0] for r in df.select(decode_html("t")).collect()] == ["l'eau", None]


def test_entities_that_are_no_characters_leave_the_text_alone():
    from embra.functions.text import decode_html_py as d
    assert d("&#65;&#x42;&#0067;") == "ABC"
    assert d("&lt;&#99999999999;") == "&lt;&#99999999999;"
    assert d("&lt;&#x;") == "&lt;&#x;"
    assert d("&lt;&#xD800;") == "&lt;&#xD800;"
    assert d("&# 65; &#; & a;b &&amp;; &ampx; &xamp;") == "&# 65; &#; & a;b &&; &ampx; &"
    assert d("&amp;lt;") == "&lt;"
    assert d("") == "" and d(None) is None and d("no mark-up; at all") == "no mark-up; at all"


def test_to_unicode_policies(spark):
    import pytest
    from pyspark.sql import functions as F

    from embra.functions.text import to_unicode, to_utf8
    df = spark.createDataFrame([(bytearray(b"ab\xffcd"),), (bytearray("é€".encode()),), (None,)], "b binary")
    assert [r[0] for r in df.select(to_unicode("b", "ignore")).collect()] == ["abcd", "é€", None]
    assert [r[0] for r in df.select(to_unicode("b", "replace")).collect()] == ["ab�cd", "é€", None]
    assert [r[0] for r in df.select(to_unicode("b", encoding="latin-1")).collect()][0] == "abÿcd"
    assert bytes(df.select(to_utf8("b", "strict", "latin-1")).collect()[0][0]) == "abÿcd".encode()
    assert bytes(df.limit(1).select(to_utf8(F.lit("é"))).collect()[0][0]) == "é".encode()
    with pytest.raises(Exception):
        df.select(to_unicode("b")).collect()
    with pytest.raises(ValueError):
        to_unicode("b", "other")
