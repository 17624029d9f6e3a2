"""Near-duplicate vectors by a subspace pigeonhole join.

``cosine >= c`` means a squared distance of unit vectors of at most ``2 - 2c``.
A random rotation spreads every vector over all coordinates, and the rotated
coordinates are split into blocks.  If a pair is within the whole budget, at
least one block is within its share (in proportion to its dimensions).  Each
block is a range join: a grid over its first coordinates brings together what
can be within the share, then the distance in the block decides, and every
candidate is verified on the original vectors in double precision.  A pair is
counted only in the first block that proposes it and only in the home cell of
each end, so the union needs no pair table.

A cell with many members is cut into tiles that meet pairwise, so no task
holds more than two tiles; groups emit link counts and a star over each
cluster, never the pairs.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .components import Forest, connected_components

TILE = 4096          # members of a tile of a large cell
ROWS_AT_ONCE = 256   # rows of a tile compared with the other tile at once
SLACK = 1e-9         # widens ranges, so that rounding never loses a candidate


def rotation(dims: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, dims]).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def block_edges(dims: int, blocks: int) -> list[tuple[int, int]]:
    n = max(1, min(blocks, dims))
    at = [dims * k // n for k in range(n + 1)]
    return list(zip(at[:-1], at[1:]))


def _units(raw: np.ndarray) -> np.ndarray:
    return raw / np.sqrt(np.einsum("ij,ij->i", raw, raw))[:, None]


def _rotate(unit: np.ndarray, seed: int) -> np.ndarray:
    # einsum, not a BLAS product: a row's result doesn't depend on the rows beside it
    return np.einsum("ij,jk->ik", unit, rotation(unit.shape[1], seed))


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of rows of a with rows of b, in double precision."""
    dots = np.einsum("ij,ij->i", a, b)
    return dots / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def classes_of(rows: DataFrame) -> DataFrame:
    """Valid ``(id, vec, label)`` rows -> one row per distinct (label, vector):
    ``cid`` (128-bit hash as text), ``label``, ``vec``, ``low`` (smallest id), ``mult``."""
    return rows.groupBy("label", "vec").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("mult")) \
        .withColumn("cid", class_id())


def class_id():
    return F.concat(F.hex(F.xxhash64("label", "vec")), F.lit("-"),
                    F.hex(F.xxhash64(F.lit("embra"), F.col("label"), F.col("vec"))))


def _cells(x: np.ndarray, blocks: list, grid: int, budget: float):
    """Rotated unit vectors -> for each block the cells that its rows reach:
    yields (block, cell of every row, is home)."""
    dims = x.shape[1]
    for j, (lo, hi) in enumerate(blocks):
        r = math.sqrt(budget * (hi - lo) / dims) + SLACK
        g = min(grid, hi - lo)
        y = x[:, lo:lo + g] / (2 * r)
        home = np.floor(y).astype(np.int64)
        # a cell is twice the radius wide: the ball reaches one neighbour at most
        side = np.where(y - home < 0.5, -1, 1)
        for step in itertools.product((0, 1), repeat=g):
            cell = home + side * np.array(step)
            yield j, cell, not any(step)


def pigeonhole_links(classes: DataFrame, *, cosine: float = 0.98, blocks: int = 4,
                     grid: int | None = None, seed: int = 42, tile: int = TILE):
    """Classes ``(cid, label, vec, mult)`` -> ``(cid, links)`` (linked rows of other
    classes, only where there are any) and star edges ``(u, v)`` over the classes."""
    budget = 2 - 2 * cosine + SLACK
    spark = classes.sparkSession
    if grid is None:  # about a thousand members in a cell, four cells a coordinate
        most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 1
        grid = max(1, min(6, round(math.log(max(most, 1) / 1000 + 1, 4)) + 1))

    def place(with_vector: bool):
        def run(batches):
            for b in batches:
                t = pa.Table.from_batches([b])
                sizes = np.array([len(v) for v in t["vec"]])
                for dims in np.unique(sizes):
                    part = t.filter(pa.array(sizes == dims))
                    raw = part["vec"].combine_chunks().flatten().to_numpy().reshape(-1, dims)
                    x = _rotate(_units(raw.astype(np.float64)), seed)
                    for j, cell, home in _cells(x, block_edges(int(dims), blocks), grid, budget):
                        n = len(cell)
                        keys = [f"{int(dims)}:{j}:" + ",".join(map(str, c)) for c in cell.tolist()]
                        cols = {"label": part["label"], "cell": pa.array(keys, pa.string()),
                                "home": pa.array(np.full(n, home))}
                        if with_vector:
                            cols |= {"cid": part["cid"], "mult": part["mult"], "vec": part["vec"]}
                        yield from pa.table(cols).to_batches(max_chunksize=2000)
        return run

    counts = classes.select("cid", "label", "vec", "mult").mapInArrow(
        place(False), "label string, cell string, home boolean").groupBy("label", "cell").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("home").alias("homes"))
    counts = stage(counts, "vec-cells")
    placed = classes.select("cid", "label", "vec", "mult").mapInArrow(
        place(True), "label string, cell string, home boolean, cid string, mult long, vec array<float>")
    # cells without a pair vanish here; the others get their number of tiles
    tiles = counts.filter("homes > 0 and n > 1").select(
        "label", "cell", F.ceil(F.col("n") / F.lit(tile)).cast("int").alias("tiles"))
    t = placed.join(tiles, ["label", "cell"]) \
        .withColumn("own", F.pmod(F.xxhash64("cid"), F.col("tiles")).cast("int"))
    # row tile x other tile: a member is the row side of its own row tile (if it is
    # at home) and the other side of its own column
    one = F.array(F.struct(F.col("own").alias("r"), F.col("own").alias("c"), F.col("home").alias("rows"),
                           F.lit(True).alias("cols")))
    other = F.filter(F.sequence(F.lit(0), F.col("tiles") - 1), lambda k: k != F.col("own"))
    as_col = F.transform(other, lambda k: F.struct(k.alias("r"), F.col("own").alias("c"),
                                                   F.lit(False).alias("rows"), F.lit(True).alias("cols")))
    as_row = F.when(F.col("home"), F.transform(other, lambda k: F.struct(
        F.col("own").alias("r"), k.alias("c"), F.lit(True).alias("rows"), F.lit(False).alias("cols"))))
    spots = F.when(F.col("tiles") == 1, one).otherwise(
        F.concat(one, as_col, F.coalesce(as_row, F.array().cast(
            "array<struct<r:int,c:int,rows:boolean,cols:boolean>>"))))
    t = t.withColumn("spot", F.explode(spots)).select(
        "label", "cell", "spot.r", "spot.c", "spot.rows", "spot.cols", "cid", "mult", "vec")

    def join(g: pd.DataFrame) -> pd.DataFrame:
        g = g.drop_duplicates("cid").reset_index(drop=True)
        dims, j = (int(p) for p in g["cell"].iloc[0].split(":")[:2])
        raw = np.stack(g["vec"].to_numpy()).astype(np.float64)
        unit = _units(raw)
        x = _rotate(unit, seed)
        edges = block_edges(dims, blocks)[:j + 1]
        share = [budget * (hi - lo) / dims for lo, hi in edges]
        mult = g["mult"].to_numpy()
        home, col = np.flatnonzero(g["rows"]), np.flatnonzero(g["cols"])
        links = np.zeros(len(g), np.int64)
        forest = Forest(len(g))
        for k in range(0, len(home), ROWS_AT_ONCE):
            i = home[k:k + ROWS_AT_ONCE]
            lo, hi = edges[j]
            hit = _near(x[i, lo:hi], x[col, lo:hi], share[j])
            near = unit[i] @ unit[col].T
            hit &= near >= cosine - 1e-9
            a, b = np.nonzero(hit & (near <= cosine + 1e-9))
            hit[a, b] = _cosines(raw[i[a]], raw[col[b]]) >= cosine
            for (lo, hi), s in zip(edges[:j], share):  # an earlier block has counted the pair
                if not hit.any():
                    break
                hit &= ~_near(x[i, lo:hi], x[col, lo:hi], s)
            hit &= i[:, None] != col[None, :]
            links[i] += hit @ mult[col]
            a, b = np.nonzero(hit)
            forest.link(i[a], col[b])
        out = np.flatnonzero((links > 0) | (forest.parent != np.arange(len(g))))
        names = g["cid"].to_numpy()
        return pd.DataFrame({"cid": names[out], "links": links[out], "root": names[forest.parent[out]]})

    found = stage(t.groupBy("label", "cell", "r", "c").applyInPandas(
        join, "cid string, links long, root string"), "vec-links")
    return (found.groupBy("cid").agg(F.sum("links").alias("links")),
            found.select(F.col("cid").alias("u"), F.col("root").alias("v")))


def _within(square: np.ndarray, share: float) -> np.ndarray:
    return square <= share


def _near(a: np.ndarray, b: np.ndarray, share: float) -> np.ndarray:
    """Pairs within a squared distance; exact differences near the border, so that
    every group decides a pair alike."""
    square = (np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :]
              - 2 * (a @ b.T))
    near = square <= share + 1e-7
    i, j = np.nonzero(near & (square >= share - 1e-7))
    d = a[i] - b[j]
    near[i, j] = _within(np.einsum("ij,ij->i", d, d), share)
    return near


def near_duplicate_vectors(rows: DataFrame, *, key: str = "vec_id", vector: str = "embedding",
                           label: str = "label", cosine: float = 0.98, **options) -> DataFrame:
    """-> ``(key, n_links, component, kept)`` for every row.

    Defined cases: rows whose label is null or whose vector is null, empty, zero or
    holds a null, NaN or infinite component link with nothing (0 links, their own
    component); vectors of different length never link; equal vectors under one
    label link with each other whatever their ids; null keys count as vectors but
    never name a component (``kept`` is false for them); an empty table gives an
    empty result.  Other columns are not read.
    """
    r = rows.select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").cast("string").alias("label"),
                    F.col(f"`{vector}`").cast("array<float>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    valid = F.coalesce(F.col("label").isNotNull() & finite
                       & F.exists("vec", lambda x: x != F.lit(0.0).cast("float")), F.lit(False))
    classes = stage(classes_of(r.filter(valid)), "vec-classes")
    links, edges = pigeonhole_links(classes, cosine=cosine, **options)
    roots = connected_components(edges).withColumnRenamed("node", "cid")
    info = classes.select("cid", "low", "mult").join(roots, "cid", "left") \
        .withColumn("root", F.coalesce("root", "cid"))
    low = info.groupBy("root").agg(F.min("low").alias("component"))
    info = info.join(low, "root").join(links, "cid", "left").select(
        "cid", "component", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    linked = r.filter(valid).select("id", class_id().alias("cid")).join(info, "cid") \
        .select("id", "n_links", "component")
    alone = r.filter(~valid).select("id", F.lit(0).cast("long").alias("n_links"),
                                    F.col("id").alias("component"))
    return linked.unionByName(alone).select(
        F.col("id").alias("key"), "n_links", "component",
        F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))
