"""Whitening of vectors by a weighted multiplicity covariance.

Every entry c becomes the integer ``x = floor(scale * c) + offset``.  Identical
x-vectors are one class with a count; the classes are the fit list, weighted by
their counts or by one each.  Tasks add up exact weighted sums, then weighted
products of the centred classes (one matrix product a batch), which Spark sums
row by row.  Each class is whitened once with the eigenvectors of the
covariance and joined back to its rows: the few classes that hold a thousandth
of the rows or more are broadcast (at most a thousand), the others meet their
rows by a shuffle in which no key can be hot.

Vectors of one length are a fit of their own.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.similarity import sum_vectors
from .common import stage

HOT_SHARE = 1000        # a class with more than 1/HOT_SHARE of the rows is broadcast for the join back
MODEL_BYTES = 64 << 20  # models (of different lengths) that a task holds at once
LIVE = 1e-13            # share of the trace below which an eigenvalue counts as zero
LIMIT = float(1 << 60)  # entries beyond this don't fit the integer form


def integer_vectors(rows: DataFrame, key: str, vector: str, scale: int, offset: int) -> DataFrame:
    """Valid rows as ``(id, x)``."""
    v = rows.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    fits = F.forall("v", lambda c: F.coalesce(F.abs(c) * scale < F.lit(LIMIT), F.lit(False)))
    return v.filter(F.col("v").isNotNull() & fits & (F.size("v") > 0)).select(
        "id", F.transform("v", lambda c: F.floor(c * F.lit(float(scale))) + F.lit(offset).cast("long")).alias("x"))


def _by_length(batches: Iterator[pa.RecordBatch], *names: str):
    """-> (length, x as a matrix, the other columns) of every length in every batch."""
    for b in batches:
        t = pa.Table.from_batches([b])
        sizes = pa.compute.list_value_length(t["x"]).to_numpy()
        for d in np.unique(sizes):
            part = t.filter(pa.array(sizes == d))
            x = part["x"].combine_chunks().flatten().to_numpy().reshape(-1, d)
            yield int(d), x, [part[c].combine_chunks() for c in names]


class Centre:
    """Weight total n and exact sums S of one length: x - S/n and n*x - S of whole matrices."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        whole = [s // n for s in sums]
        self.whole = np.array(whole, np.int64)
        self.rest = [s - n * w for s, w in zip(sums, whole)]  # 0 <= rest < n
        self.part = np.array([r / n for r in self.rest])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.part

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n*x - S)^2 of every row, exactly; None beyond 64 bits."""
        near = x - self.whole
        reach = (int(np.abs(near).max(initial=0)) + 1) * self.n
        if reach * reach * x.shape[1] < 1 << 63:
            d = near * self.n - np.array(self.rest, np.int64)
            return np.einsum("ij,ij->i", d, d).tolist()
        d = near.astype(object) * self.n - np.array(self.rest, object)
        return [s if s < 1 << 63 else None for s in (int(q) for q in (d * d).sum(axis=1))]


def _sums(classes: DataFrame) -> dict[int, Centre]:
    """Exact weight totals and weighted sums, by length: as many numbers as a vector has entries."""

    def run(batches):
        total: dict[int, list] = {}
        for d, x, (m,) in _by_length(batches, "m"):
            m = m.to_numpy()
            if int(np.abs(x).max()) * int(m.sum()) < 1 << 62:
                s = m @ x
            else:
                s = m.astype(object) @ x.astype(object)
            have = total.setdefault(d, [0, [0] * d])
            have[0] += int(m.sum())
            have[1] = [a + int(b) for a, b in zip(have[1], s)]
        for d, (n, s) in total.items():
            yield pa.RecordBatch.from_pydict(
                {"d": [d] * d, "j": list(range(d)), "n": [n] * d, "s": [decimal.Decimal(v) for v in s]},
                schema=pa.schema([("d", pa.int32()), ("j", pa.int32()), ("n", pa.int64()),
                                  ("s", pa.decimal128(38, 0))]))

    parts = classes.select("x", "m").mapInArrow(run, "d int, j int, n long, s decimal(38,0)")
    rows = parts.groupBy("d", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    found: dict[int, dict] = {}
    for r in rows:
        found.setdefault(r["d"], {})[r["j"]] = r
    return {d: Centre(by[0]["n"], [int(by[j]["s"]) for j in range(d)]) for d, by in found.items()}


ROW_SCHEMA = pa.schema([("d", pa.int32()), ("j", pa.int32()), ("g", pa.list_(pa.float64()))])


def _matrix_rows(by_length: dict[int, np.ndarray]):
    for d, g in by_length.items():
        yield pa.RecordBatch.from_pydict({"d": [d] * len(g), "j": list(range(len(g))), "g": list(g)},
                                         schema=ROW_SCHEMA)


def _models(classes: DataFrame, centres: dict[int, Centre], components: int) -> dict[int, tuple]:
    """Covariance and its leading eigenvectors, by length -> {length: (values, trace, vectors)}."""
    spark = classes.sparkSession
    shared = spark.sparkContext.broadcast(centres)

    def products(batches):
        out: dict[int, np.ndarray] = {}
        for d, x, (m,) in _by_length(batches, "m"):
            c = shared.value[d].centred(x)
            out[d] = out.get(d, 0) + (c * m.to_numpy()[:, None]).T @ c
        yield from _matrix_rows(out)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        d = int(pdf["d"].iloc[0])
        v = np.stack(pdf.sort_values("j")["g"].to_numpy()) / shared.value[d].n
        e, p = np.linalg.eigh((v + v.T) / 2)
        k = min(components, d)
        e, p = e[::-1][:k], p[:, ::-1][:, :k]
        return pd.DataFrame({"d": d, "trace": float(np.trace(v)), "e": [e], "p": [p.ravel()]})

    rows = sum_vectors(classes.select("x", "m").mapInArrow(products, "d int, j int, g array<double>"),
                       ["d", "j"], "g", out="g")
    solved = rows.groupBy("d").applyInPandas(solve, "d int, trace double, e array<double>, p array<double>")
    out = {}
    for r in solved.collect():
        e = np.maximum(np.array(r["e"]), 0.0)
        out[r["d"]] = (e, r["trace"], np.array(r["p"]).reshape(r["d"], -1))
    shared.unpersist()
    return out


def _length_groups(lengths: list[int], components: int) -> list[list[int]]:
    """Lengths whose matrices fit MODEL_BYTES together."""
    groups, held = [[]], 0
    for d in sorted(lengths):
        size = 8 * d * (d + components)
        if groups[-1] and held + size > MODEL_BYTES:
            groups.append([])
            held = 0
        groups[-1].append(d)
        held += size
    return [g for g in groups if g]


def _whitened(classes: DataFrame, centres: dict[int, Centre], models: dict[int, tuple]) -> DataFrame:
    """Classes -> ``(x, m, d, deviation, z, explained)``, z and explained by component."""
    shared = classes.sparkSession.sparkContext.broadcast((centres, models))
    schema = classes.schema
    out_schema = pa.schema([("x", pa.list_(pa.int64())), ("m", pa.int64()), ("d", pa.int32()), ("n", pa.int64()),
                            ("deviation", pa.int64()), ("z", pa.list_(pa.float64())),
                            ("explained", pa.list_(pa.float64()))])

    def run(batches):
        centre_of, model_of = shared.value
        for d, x, (m,) in _by_length(batches, "m"):
            centre, (e, trace, p) = centre_of[d], model_of[d]
            live = e > LIVE * trace
            z = centre.centred(x) @ (p * np.where(live, 1 / np.sqrt(np.where(live, e, 1.0)), 0.0))
            share = np.where(live, e / (trace or 1.0), 0.0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(x), pa.list_(pa.int64())), m.cast(pa.int64()), pa.array([d] * len(x), pa.int32()),
                 pa.array([centre.n] * len(x), pa.int64()), pa.array(centre.deviation(x), pa.int64()),
                 pa.array(list(z), pa.list_(pa.float64())), pa.array([share] * len(x), pa.list_(pa.float64()))],
                schema=out_schema)

    return classes.select(*schema.names).mapInArrow(
        run, "x array<long>, m long, d int, n long, deviation long, z array<double>, explained array<double>")


def _identity_errors(done: DataFrame) -> DataFrame:
    """``(d, identity_error)``: the covariance of the whitened classes, centred first, against the identity over
    the components that vary."""
    w = done.select("d", F.col("m").alias("w"), "z", "explained")
    means = sum_vectors(w.select("d", F.transform("z", lambda a: a * F.col("w")).alias("z")), ["d"], "z", out="s")
    totals = w.groupBy("d").agg(F.sum("w").alias("n"))
    mean = {r["d"]: np.array(r["s"]) / r["n"] for r in means.join(totals, "d").collect()}
    shared = done.sparkSession.sparkContext.broadcast(mean)

    def products(batches):
        out: dict[int, np.ndarray] = {}
        for b in batches:
            ds, ws = b.column("d").to_numpy(), b.column("w").to_numpy()
            for d in np.unique(ds):
                at = np.flatnonzero(ds == d)
                z = b.column("z").take(pa.array(at)).flatten().to_numpy().reshape(len(at), -1) - shared.value[int(d)]
                out[int(d)] = out.get(int(d), 0) + (z * ws[at, None]).T @ z
        yield from _matrix_rows(out)

    rows = sum_vectors(w.select("d", "w", "z").mapInArrow(products, "d int, j int, g array<double>"),
                       ["d", "j"], "g", out="g")
    alive = w.groupBy("d").agg(F.first("explained").alias("explained"))
    off = F.aggregate(F.sequence(F.lit(0), F.size("g") - 1), F.lit(0.0), lambda worst, k: F.greatest(
        worst, F.when(F.element_at("explained", k + 1) > 0,
                      F.abs(F.element_at("g", k + 1) / F.col("n") - F.when(k == F.col("j"), 1.0).otherwise(0.0)))
        .otherwise(0.0)))
    return (rows.join(totals, "d").join(alive, "d").filter(F.element_at("explained", F.col("j") + 1) > 0)
            .groupBy("d").agg(F.max(off).alias("identity_error")))


def whiten_vectors(rows: DataFrame, *, key: str = "vec_id", vector: str = "embedding", scale: int = 64,
                   offset: int = 1_000_000, components: int = 32, weights: str = "counts") -> DataFrame:
    """-> one row per valid row: ``key``, ``n`` (total weight of the fit), ``deviation`` (sum of (n*x - S)^2, exact;
    null beyond 64 bits), ``z`` and ``explained`` (arrays by component), ``identity_error``.

    ``weights``: "counts" fits on all rows, "one" on the distinct x-vectors.

    Defined cases: rows whose vector is null, empty, holds a null or non-finite entry, or one of which
    ``scale * c`` reaches 2^60, are left out; vectors of different lengths are fitted apart; a component without
    variance (constant or dependent entries, one distinct vector) has ``z`` and ``explained`` 0 and doesn't count
    in ``identity_error``, which is 0 where no component varies; rows with null or repeated keys stay, each on its
    own; an empty table gives an empty result.  Other columns are not read.
    """
    if weights not in ("counts", "one"):
        raise ValueError("weights: 'counts' or 'one'")
    spark = rows.sparkSession
    ids = integer_vectors(rows, key, vector, scale, offset)
    weight = F.count(F.lit(1)) if weights == "counts" else F.lit(1).cast("long")
    classes = stage(ids.groupBy("x").agg(weight.alias("m"), F.count(F.lit(1)).alias("rows")), "whiten-classes")
    centres = _sums(classes)
    if not centres:
        return spark.createDataFrame([], f"key {ids.schema['id'].dataType.simpleString()}, n long, deviation long, "
                                     "z array<double>, explained array<double>, identity_error double")
    done = None
    for lengths in _length_groups(list(centres), components):
        part = classes.filter(F.size("x").isin(lengths)).select("x", "m")
        some = {d: centres[d] for d in lengths}
        w = _whitened(part, some, _models(part, some, components))
        done = w if done is None else done.unionByName(w)
    done = stage(done, "whiten-done")
    errors = stage(_identity_errors(done), "whiten-errors")
    errors = done.select("d").distinct().join(errors, "d", "left").select(
        "d", F.coalesce("identity_error", F.lit(0.0)).alias("identity_error"))
    whole = done.drop("m").join(errors, "d").drop("d")

    total = classes.agg(F.sum("rows")).first()[0]
    hot = classes.filter(F.col("rows") * HOT_SHARE > total).select("x")  # fewer than HOT_SHARE classes
    if hot.isEmpty():
        out = ids.join(whole, "x")
    else:
        marked = ids.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "x", "left")
        frequent = whole.join(F.broadcast(hot), "x")
        out = marked.filter("hot").drop("hot").join(F.broadcast(frequent), "x").unionByName(
            marked.filter("hot is null").drop("hot").join(whole, "x"))
    return out.select(F.col("id").alias("key"), "n", "deviation", "z", "explained", "identity_error")
