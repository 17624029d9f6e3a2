"""Dense-vector column expressions (array<double>), all JVM-side.

Every helper returns a Column built from higher-order functions so that
the work stays inside whole-stage code generation.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def to_double_array(x) -> Column:
    return _c(x).cast("array<double>")


def dot(a, b) -> Column:
    """Sum of products, folded left to right."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y),
                       F.lit(0.0), lambda acc, v: acc + v)


def sqnorm(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x * x)


def norm(a) -> Column:
    return F.sqrt(sqnorm(a))


def unit(a) -> Column:
    """Scale to unit length; a zero vector is returned unchanged."""
    n = norm(a)
    return F.when(n > 0, F.transform(_c(a), lambda x: x / n)).otherwise(_c(a))


def vadd(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def vsub(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x - y)


def vscale(a, s) -> Column:
    s = s if isinstance(s, Column) else F.lit(float(s))
    return F.transform(_c(a), lambda x: x * s)


def zeros(d: int) -> Column:
    return F.array_repeat(F.lit(0.0), d)


def r6(x) -> Column:
    """Round to 6 decimals and normalise negative zero (the output policy)."""
    r = F.round(_c(x), 6)
    return F.when(r == 0, F.lit(0.0)).otherwise(r)


def r6_array(a) -> Column:
    return F.transform(_c(a), lambda x: F.when(F.round(x, 6) == 0, F.lit(0.0))
                       .otherwise(F.round(x, 6)))


def keyed_uniform(seed, *keys) -> Column:
    """Deterministic uniform in [0,1) from md5 of ``seed|key1|key2...``.

    The same arithmetic is available in DuckDB, so every random draw can be
    reproduced by the SQL twins and does not depend on partitioning.
    """
    def key(k):
        if isinstance(k, Column):
            return k.cast("string")
        if isinstance(k, str):
            return F.col(k).cast("string")
        return F.lit(str(k))

    parts = [F.lit(str(seed))] + [key(k) for k in keys]
    h = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8)
    return F.conv(h, 16, 10).cast("bigint") / F.lit(4294967296.0)


def keyed_uniform_sql(seed, *keys: str) -> str:
    """DuckDB twin of :func:`keyed_uniform`; ``keys`` are SQL expressions."""
    inner = ", ".join([f"'{seed}'"] + [f"CAST({k} AS VARCHAR)" for k in keys])
    return f"(('0x' || substr(md5(concat_ws('|', {inner})), 1, 8))::UBIGINT / 4294967296.0)"


# Keyed draws over whole numbers: one quadratic step modulo a prime per key.
# All intermediate values stay below 2^63, so Spark, numpy and DuckDB agree,
# and numpy draws whole arrays at once.
_PRIME, _MUL, _ADD = (1 << 31) - 1, 48271, 1013904223


def _fold(h, k):
    """One step for the running value h and a key k (both below the prime)."""
    return (h * h + k * _MUL + _ADD) % _PRIME


def _draw_start(seed: int, kind: str, epoch: int) -> int:
    h = 0
    for k in (seed, *kind.encode(), epoch):
        h = _fold(h, k % _PRIME)
    return h


def keyed_draw(seed: int, kind: str, epoch: int, *keys) -> Column:
    """Deterministic uniform in [0, 1) from whole numbers (columns); see :func:`keyed_draw_np`."""
    h = F.lit(_draw_start(seed, kind, epoch)).cast("long")
    for k in (*keys, F.lit(0)):
        h = _fold(h, F.pmod(_c(k).cast("long"), F.lit(_PRIME).cast("long")))
    return h / F.lit(float(_PRIME))


def keyed_draw_np(seed: int, kind: str, epoch: int, *keys) -> np.ndarray:
    """The same draws for numpy arrays (or numbers) of keys, broadcast together."""
    h = np.int64(_draw_start(seed, kind, epoch))
    for k in (*keys, 0):
        h = _fold(h, np.mod(np.asarray(k, dtype=np.int64), _PRIME))
    return h / float(_PRIME)


def keyed_draw_sql(seed: int, kind: str, epoch: int, *keys: str) -> str:
    """The same draws in DuckDB; ``keys`` are SQL expressions of whole numbers."""
    h = f"{_draw_start(seed, kind, epoch)}::BIGINT"
    for k in (*keys, "0"):
        m = f"(((CAST({k} AS BIGINT) % {_PRIME}) + {_PRIME}) % {_PRIME})"
        h = f"(({h} * {h} + {m} * {_MUL} + {_ADD}) % {_PRIME})"
    return f"({h} / {float(_PRIME)!r}::DOUBLE)"
