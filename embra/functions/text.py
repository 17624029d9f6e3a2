"""Text preprocessing as column expressions.

``tokenize``/``simple_preprocess`` are pure JVM expressions (regex +
higher-order ``filter``).  ``deaccent`` and ``decode_html`` need Unicode
normalisation / entity tables that Spark has no built-in for, so they are
pandas UDFs over Arrow batches.
"""

from __future__ import annotations

import codecs
import functools
import html.entities
import re
import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values that must equal the reference's behaviour:
# a token is a maximal run of word characters that are not decimal digits,
# i.e. letters, non-decimal numerics (Nl, No) and the underscore.
TOKEN_PATTERN = r"([\p{L}\p{Nl}\p{No}_]+)"
MIN_TOKEN_LEN = 2
MAX_TOKEN_LEN = 15
# what may stand between '&#' and ';'
ENTITY_NUMBER = re.compile(r"\w+")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokenize(text, lower: bool = False, deacc: bool = False) -> Column:
    t = _c(text)
    if lower:
        t = F.lower(t)
    if deacc:
        t = deaccent(t)
    return F.regexp_extract_all(t, F.lit(TOKEN_PATTERN), 1)


def simple_preprocess(text, deacc: bool = False, min_len: int = MIN_TOKEN_LEN,
                      max_len: int = MAX_TOKEN_LEN) -> Column:
    toks = tokenize(text, lower=True, deacc=deacc)
    return F.filter(toks, lambda t: (F.length(t) >= min_len) & (F.length(t) <= max_len)
                    & ~t.startswith("_"))


def tokenize_sql(expr: str, lower: bool = True) -> str:
    e = f"lower({expr})" if lower else expr
    return f"regexp_extract_all({e}, '{TOKEN_PATTERN}', 1)"


def simple_preprocess_sql(expr: str, min_len: int = MIN_TOKEN_LEN,
                          max_len: int = MAX_TOKEN_LEN) -> str:
    return (f"list_filter({tokenize_sql(expr)}, lambda t: length(t) BETWEEN {min_len} "
            f"AND {max_len} AND NOT starts_with(t, '_'))")


# --- Python helpers (used inside pandas UDFs and unit tests) -----------------

@functools.cache
def _combining_marks() -> dict[int, None]:
    """Translation table that deletes every non-spacing mark."""
    marks = filter(lambda cp: unicodedata.category(chr(cp)) == "Mn", range(sys.maxunicode + 1))
    return dict.fromkeys(marks)


def deaccent_py(text: str | None) -> str | None:
    """Text without non-spacing marks, composed again."""
    if text is None or text.isascii():
        return text
    bare = unicodedata.normalize("NFD", text).translate(_combining_marks())
    return unicodedata.normalize("NFC", bare)


@functools.cache
def _entity_names() -> dict[str, str]:
    """What stands between '&' and ';' -> character.  A leading 'x' belongs to the
    mark-up, not to the name: names that begin with it aren't known, and a known
    name may carry one in front."""
    table = {n: chr(cp) for n, cp in html.entities.name2codepoint.items() if not n.startswith("x")}
    return table | {"x" + n: c for n, c in table.items()}


def _numeric_entity(digits: str) -> str:
    """Character of the part after '#'; ValueError if there is none."""
    hexadecimal = len(digits) > 1 and digits[0] == "x"
    cp = int(digits[1:], 16) if hexadecimal else int(digits)
    if not 0 <= cp <= sys.maxunicode or 0xD800 <= cp < 0xE000:
        raise ValueError(digits)
    return chr(cp)


def decode_html_py(text: str | None) -> str | None:
    """Text with its entities decoded.  Unknown names stay as they are; one number
    that is no character leaves the whole text as it was."""
    if text is None or "&" not in text:
        return text
    names = _entity_names()
    pieces = text.split("&")
    out = pieces[:1]
    for piece in pieces[1:]:
        body, end, rest = piece.partition(";")
        char = names.get(body) if end else None
        if end and body[:1] == "#" and ENTITY_NUMBER.fullmatch(body, 1):
            try:
                char = _numeric_entity(body[1:])
            except ValueError:
                return text
        out.append("&" + piece if char is None else char + rest)
    return "".join(out)


@F.pandas_udf(T.StringType())
def _deaccent_udf(s: pd.Series) -> pd.Series:
    return s.map(deaccent_py, na_action="ignore")


@F.pandas_udf(T.StringType())
def _decode_html_udf(s: pd.Series) -> pd.Series:
    return s.map(decode_html_py, na_action="ignore")


def deaccent(text) -> Column:
    return _deaccent_udf(_c(text))


def decode_html(text) -> Column:
    return _decode_html_udf(_c(text))


def to_unicode(binary_col, errors: str = "strict", encoding: str = "utf8") -> Column:
    """bytes -> string.

    ``errors``: ``'strict'`` fails on invalid bytes, ``'ignore'`` drops them,
    ``'replace'`` puts U+FFFD in their place.  ``encoding`` is any codec name.
    Strict UTF-8 is a JVM expression; the other policies and codecs, which Spark
    has no expression for, decode Arrow batches.
    """
    if errors not in ("strict", "ignore", "replace"):
        raise ValueError(f"unknown policy {errors!r}")
    codec = codecs.lookup(encoding).name
    if codec == "utf-8" and errors == "strict":
        return F.validate_utf8(F.decode(_c(binary_col), "UTF-8"))

    @F.pandas_udf(T.StringType())
    def decode(s: pd.Series) -> pd.Series:
        return s.map(lambda b: bytes(b).decode(codec, errors), na_action="ignore")

    return decode(_c(binary_col))


def to_utf8(col, errors: str = "strict", encoding: str | None = None) -> Column:
    """UTF-8 bytes of a string or, with ``encoding``, of bytes in that encoding
    (``errors`` as in :func:`to_unicode`)."""
    text = _c(col) if encoding is None else to_unicode(col, errors, encoding)
    return F.encode(text, "UTF-8")
