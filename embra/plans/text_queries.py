"""Text preprocessing queries."""

from __future__ import annotations

import html.entities

from pyspark.sql import functions as F

from ..functions.text import (decode_html, deaccent, simple_preprocess, simple_preprocess_sql,
                              to_unicode, to_utf8, tokenize, tokenize_sql)
from ..tables import table
from .registry import register


@register("tokenize", sql=f"SELECT doc_id, {tokenize_sql('text', lower=False)} AS tokens FROM documents")
def q_tokenize(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", tokenize("text").alias("tokens"))


@register("simple_preprocess",
          sql=f"SELECT doc_id, {simple_preprocess_sql('text')} AS words FROM documents")
def q_simple_preprocess(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", simple_preprocess("text").alias("words"))


@register("simple_preprocess_deacc",
          sql=f"SELECT doc_id, {simple_preprocess_sql('strip_accents(text)')} AS words FROM documents")
def q_simple_preprocess_deacc(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", simple_preprocess("text", deacc=True).alias("words"))


@register("deaccent", sql="SELECT doc_id, strip_accents(text) AS text FROM documents")
def q_deaccent(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", deaccent("text").alias("text"))


def _decode_sql(expr: str) -> str:
    """The named entities by replacement ('&' last, so that nothing is decoded twice); the
    pages have no numeric ones, which unit tests cover."""
    names = {n: chr(cp) for n, cp in html.entities.name2codepoint.items() if not n.startswith("x") and n != "amp"}
    for n, c in names.items():
        quoted = c.replace("'", "''")
        expr = f"replace({expr}, '&{n};', '{quoted}')"
    return f"replace({expr}, '&amp;', '&')"


@register("decode_html", sql=f"SELECT page_id, {_decode_sql('html')} AS text FROM pages")
def q_decode_html(spark, sf):
    """Entity decoding of raw pages."""
    p = table(spark, sf, "pages")
    return p.select("page_id", decode_html("html").alias("text"))


@register("to_unicode", sql="SELECT page_id, html AS text, octet_length(encode(html)) AS n_bytes FROM pages")
def q_to_unicode(spark, sf):
    """bytes -> text -> bytes round trip with strict UTF-8 validation."""
    p = table(spark, sf, "pages").select("page_id", to_utf8("html").alias("b"))
    return p.select("page_id", to_unicode("b").alias("text"), F.octet_length("b").alias("n_bytes"))


@register("to_unicode_policies", sql="""
SELECT doc_id, text AS ignored, text[1:9] || chr(65533) || text[10:] AS replaced,
    octet_length(encode(text)) AS utf16_to_utf8 FROM documents""")
def q_to_unicode_policies(spark, sf):
    """Bytes with an invalid one among them: dropped or replaced; other encodings."""
    d = table(spark, sf, "documents")
    bad = F.concat(F.encode(F.substring("text", 1, 9), "UTF-8"), F.unhex(F.lit("FF")),
                   F.encode(F.substring("text", 10, 2147483647), "UTF-8"))
    return d.select("doc_id", to_unicode(bad, "ignore").alias("ignored"), to_unicode(bad, "replace").alias("replaced"),
                    F.octet_length(to_utf8(F.encode("text", "UTF-16LE"), encoding="utf-16-le")).alias("utf16_to_utf8"))


@register("preprocess_docs", sql=f"""
SELECT doc_id, lang, source, n_chars, {simple_preprocess_sql('text')} AS tokens FROM documents""")
def q_preprocess_docs(spark, sf):
    d = table(spark, sf, "documents")
    return d.withColumn("tokens", simple_preprocess("text")).drop("text")
