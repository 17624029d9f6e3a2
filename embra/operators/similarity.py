"""Top-k search by dot product and the vector lookups built on it.

Exact search over Voronoi cells.  Items are cut into cells around pivots (items
drawn by a hash of their id); with one more coordinate all items have the same
length, so the nearest items are those of largest dot product and the triangle
inequality holds.  From its distances to the pivots and the cells' radii a query
knows how near its k-th item must be at the latest, and which cells can't hold
one so near; it is compared with the others only.  Neighbouring cells travel
together as blocks of a fixed number of bytes (a large cell is cut into several),
so a query is copied once per block, whatever the number of cells it visits.  In
a co-grouped task a block of queries and a block of items are multiplied cell by
cell, against the k-th best score so far; the block's top-k is emitted, with ties.
A final ``row_number`` window (planned as a WindowGroupLimit) keeps the global
top-k.  Ties are broken by item id, after rounding the score to 9 decimals so
that summation order does not change the ranking.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StructField, StructType

from ..functions.vectors import dot, r6, unit, vadd

CELL_ROWS = 4_096          # items of a cell, about
MAX_PIVOTS = 1_024         # pivots and cell statistics are broadcast: this many vectors at most
CELL_GROUPS = 32           # groups of a cell whose radius is kept
BLOCK_BYTES = 96 << 20     # vectors of a block of items or queries at most
ITEM_BLOCK_ROWS = 20_000   # blocks aren't cut smaller than this to give every core some
QUERY_BLOCK_ROWS = 2_000
TASKS_PER_CORE = 3
_CHUNK = 256
_SLICE = 8_192
_TIE = 1e-9


def sum_vectors(df: DataFrame, keys: list[str], vec: str, out: str = "vec",
                how: str = "sum") -> DataFrame:
    """Element-wise sum (or mean) of ``array<double>`` per key.

    Uses the ML Summarizer, a true aggregate with map-side partial
    aggregation, so a hot key is combined before the shuffle.
    """
    metric = Summarizer.sum if how == "sum" else Summarizer.mean
    return (df.groupBy(*keys)
              .agg(metric(array_to_vector(F.col(vec))).alias("_v"))
              .withColumn(out, vector_to_array("_v", "float64")).drop("_v"))


def top_k(df: DataFrame, part: list[str], order: list[Column], k: int | None,
          rank_col: str = "rank") -> DataFrame:
    w = Window.partitionBy(*part).orderBy(*order)
    ranked = df.withColumn(rank_col, F.row_number().over(w))
    return ranked if k is None else ranked.filter(F.col(rank_col) <= k)


class Cells:
    """Pivots and, per cell, its items' number and distances from the pivot; with groups also those of (some of) its
    groups.  ``length``: the length that all items have with their extra coordinate."""

    def __init__(self, pivots: np.ndarray, length: float):
        self.pivots, self.length = pivots, length
        # the extra coordinate of the pivots, which are items
        self.rest = np.sqrt(np.maximum(length**2 - (pivots**2).sum(axis=1), 0.0))

    def distances(self, v: np.ndarray, items: bool) -> np.ndarray:
        """Rows x pivots; queries have 0 as extra coordinate."""
        own = (v**2).sum(axis=1)
        dots = v @ self.pivots.T
        if items:
            dots += np.sqrt(np.maximum(self.length**2 - own, 0.0))[:, None] * self.rest[None, :]
            own = self.length**2
        else:
            own = own[:, None]
        return np.sqrt(np.maximum(own + self.length**2 - 2 * dots, 0.0))

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = self.distances(v, True)
        cell = d.argmin(axis=1)
        return cell, d[np.arange(len(v)), cell]

    def describe(self, cells: pd.DataFrame, groups: pd.DataFrame | None) -> None:
        """``cells``: cell, n, low, high; ``groups``: cell, grp, n, high."""
        self.n, self.low, self.high = (np.zeros(len(self.pivots)) for _ in range(3))
        self.low += np.inf  # an empty cell is never visited
        at = cells["cell"].to_numpy()
        self.n[at], self.low[at], self.high[at] = cells["n"], cells["low"], cells["high"]
        self.groups = None
        if groups is not None:
            code = pd.factorize(groups["grp"])[0]
            order = np.argsort(code, kind="stable")
            self.groups = (groups["cell"].to_numpy()[order], groups["n"].to_numpy()[order],
                           groups["high"].to_numpy()[order], np.flatnonzero(np.diff(code[order], prepend=-1)))

    def visited(self, v: np.ndarray, k: int | None, left_out: np.ndarray) -> list[np.ndarray]:
        """The cells that can hold one of the k best items (groups) of each query, of which ``left_out`` items don't
        count."""
        full = np.flatnonzero(self.n)
        if k is None:
            return [full] * len(v)
        d = self.distances(v, False)
        out = []
        for row, x in zip(d, left_out):
            if self.groups is None:
                reach = row + self.high
                order = np.argsort(reach)
                enough = np.searchsorted(np.cumsum(self.n[order]), k + x)
                bound = reach[order[enough]] if enough < len(order) else np.inf
            else:
                cell, n, high, first = self.groups
                near = np.minimum.reduceat(np.where(n > x, row[cell] + high, np.inf), first)
                bound = np.partition(near, k - 1)[k - 1] if len(near) >= k else np.inf
            least = np.maximum(row - self.high, self.low - row)
            # scores that are equal when rounded to 9 decimals, and rounded distances, must not lose a cell
            out.append(full[least[full] <= np.sqrt(bound**2 + 4e-9) + 1e-6 * (self.length + 1)])
        return out


def _make_cells(items: DataFrame, k: int | None, grouped: bool, cell_rows: int) -> tuple[Cells | None, DataFrame]:
    """Items (i_id, iv, grp), already written, with their ``cell``; None: one cell holds all."""
    spark = items.sparkSession
    square = F.aggregate("iv", F.lit(0.0), lambda a, x: a + x * x)
    r = items.agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("m")).first()
    count = min(MAX_PIVOTS, r["n"] // cell_rows)
    if count < 2 or k is None:
        return None, items.withColumn("cell", F.lit(0))
    drawn = items.select(F.xxhash64("i_id").alias("h"), "iv").orderBy("h").limit(count).toPandas()
    cells = Cells(np.stack(drawn["iv"].to_numpy()), float(np.sqrt(r["m"])) * (1 + 1e-12))
    shared = spark.sparkContext.broadcast(cells)

    def place(it):
        for pdf in it:
            cell, dist = shared.value.nearest(np.stack(pdf["iv"].to_numpy()))
            yield pdf.assign(cell=cell.astype("int32"), dist=dist)

    schema = StructType([*items.schema.fields, StructField("cell", IntegerType()), StructField("dist", DoubleType())])
    placed = items.mapInPandas(place, schema).checkpoint(eager=True)
    stats = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("low"),
                                       F.max("dist").alias("high")).toPandas()
    groups = None
    if grouped:
        g = placed.groupBy("cell", "grp").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("high"))
        groups = top_k(g, ["cell"], [F.col("n").desc(), F.col("grp")], CELL_GROUPS).drop("rank").toPandas()
    cells.describe(stats, groups)
    return cells, placed.drop("dist")


def _visits(queries: DataFrame, cells: Cells | None, k: int | None, exclude_self: bool) -> DataFrame:
    """Queries (q_id, qv, qx) with ``cells``, those that they are compared with, also as bits (``mask``)."""
    if cells is None:
        return queries.withColumn("cells", F.array(F.lit(0))).withColumn("mask", F.lit(b"\x80"))
    shared = queries.sparkSession.sparkContext.broadcast(cells)

    def go(it):
        for pdf in it:
            if len(pdf):
                left = np.array([0 if x is None else len(x) for x in pdf["qx"]]) + int(exclude_self)
                to = shared.value.visited(np.stack(pdf["qv"].to_numpy()), k, left)
                mask = np.zeros((len(pdf), len(shared.value.pivots)), dtype=bool)
                for row, x in zip(mask, to):
                    row[x] = True
                yield pdf.assign(cells=[x.astype("int32") for x in to],
                                 mask=[x.tobytes() for x in np.packbits(mask, axis=1)])

    schema = StructType([*queries.schema.fields, StructField("cells", ArrayType(IntegerType())),
                         StructField("mask", BinaryType())])
    return queries.mapInPandas(go, schema).checkpoint(eager=True)


def _pack(cells: Cells | None, rows: int, block_rows: int) -> list[tuple[int, int]]:
    """First and last block of every cell: neighbouring cells share a block of about ``block_rows`` items, a larger
    cell is dealt over several."""
    if cells is None:
        return [(0, max(0, -(-rows // block_rows) - 1))]
    out = [(0, 0)] * len(cells.n)
    left = np.ones(len(cells.n), dtype=bool)
    at, block, fill = 0, 0, 0
    while True:  # from pivot to nearest pivot
        left[at] = False
        n = int(cells.n[at])
        if fill and fill + n > block_rows:
            block, fill = block + 1, 0
        parts = max(1, -(-n // block_rows))
        out[at] = (block, block + parts - 1)
        if parts > 1:
            block += parts
        else:
            fill += n
        if not left.any():
            return out
        gap = ((cells.pivots - cells.pivots[at])**2).sum(axis=1) + (cells.rest - cells.rest[at])**2
        at = int(np.where(left, gap, np.inf).argmin())


def _codes(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, pd.Index]:
    """Ids of both sides as whole numbers, equal where the ids are (a missing number equals nothing)."""
    both = np.concatenate([left, right])
    code, known = pd.factorize(both, use_na_sentinel=both.dtype != object)
    a, b = code[:len(left)], code[len(left):]
    return a, np.where(b < 0, -2, b), pd.Index(known)


class _Left:
    """The (query, item) pairs of a block that don't count, in the order of the queries."""

    def __init__(self, qpdf: pd.DataFrame, iids: np.ndarray, exclude_self: bool):
        q, i, known = _codes(qpdf["q_id"].to_numpy(), iids)
        rows, codes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if exclude_self:
            rows.append(np.arange(len(q)))
            codes.append(q)
        for r, ex in enumerate(qpdf["qx"].to_numpy()):
            if ex is not None and len(ex):
                here = known.get_indexer(np.asarray(list(ex)))
                rows.append(np.full(len(here), r))
                codes.append(here)
        rows, codes = np.concatenate(rows), np.concatenate(codes)
        rows, codes = rows[codes >= 0], codes[codes >= 0]
        order = np.argsort(i, kind="stable")
        lo, hi = (np.searchsorted(i[order], codes, side=s) for s in ("left", "right"))
        n = hi - lo
        cols = order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        rows = np.repeat(rows, n)
        order = np.lexsort((cols, rows))
        self.rows, self.cols = rows[order], cols[order]

    def of(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.searchsorted(self.rows, [first, last])
        return self.rows[a:b] - first, self.cols[a:b]


class _Best:
    """The best items (of the best groups) of a chunk of queries so far, with ties."""

    def __init__(self, queries: int, k: int | None, grp: np.ndarray | None, place: np.ndarray):
        """``place``: the items' places in the order of ids."""
        self.k, self.grp, self.place = k, grp, place
        self.least = np.full(queries, -np.inf)  # score of the k-th
        self.row, self.col, self.sim = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def _kth(self, values: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """A bound that the k-th best of these values and those so far can't be below."""
        least = self.least[rows]
        if self.k is None or values.shape[1] <= self.k or np.isfinite(least).all():
            return least
        at = values.shape[1] - self.k
        return np.maximum(least, np.partition(values, at, axis=1)[:, at])

    def add(self, rows: np.ndarray, first: int, S: np.ndarray) -> None:
        """Scores ``S`` of some rows with the items from number ``first`` on; -inf doesn't count."""
        if self.grp is None:
            r, c = np.nonzero(S >= self._kth(S, rows)[:, None] - _TIE)
        else:
            g = self.grp[first:first + S.shape[1]]
            new = np.concatenate(([True], g[1:] != g[:-1]))
            top = np.maximum.reduceat(S, np.flatnonzero(new), axis=1)
            top = np.where(top >= self._kth(top, rows)[:, None] - _TIE, top - _TIE, np.inf)
            some = np.flatnonzero(np.isfinite(top).any(axis=1))
            r, c = np.nonzero(S[some] >= top[some][:, np.cumsum(new) - 1])
            r = some[r]
        sim = S[r, c]
        keep = sim > -np.inf
        if not keep.any():
            return
        self.row = np.concatenate([self.row, rows[r[keep]]])
        self.col = np.concatenate([self.col, first + c[keep]])
        self.sim = np.concatenate([self.sim, sim[keep]])
        if self.k is not None:
            self._trim()

    def _only(self, keep: np.ndarray) -> None:
        self.row, self.col, self.sim = self.row[keep], self.col[keep], self.sim[keep]

    def _trim(self) -> None:
        if self.grp is None:
            best = self.sim
            row, value = self.row, self.sim
        else:
            order = np.lexsort((-self.sim, self.grp[self.col], self.row))
            self._only(order)
            g = self.grp[self.col]
            new = np.concatenate(([True], (self.row[1:] != self.row[:-1]) | (g[1:] != g[:-1])))
            at = np.flatnonzero(new)
            row, value = self.row[at], self.sim[at]
            best = value[np.cumsum(new) - 1]
        order = np.lexsort((-value, row))
        row, value = row[order], value[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kth = place == self.k - 1
        self.least[row[kth]] = value[kth]
        self._only((best >= self.least[self.row] - _TIE) & (self.sim >= best - _TIE))
        if len(self.row) > 2 * self.k * len(self.least):
            self._cut_copies()

    def _cut_copies(self) -> None:
        """Of items of one score the smallest ids: k, or one of a group."""
        def keys():
            return [self.sim, self.row] if self.grp is None else [self.sim, self.grp[self.col], self.row]

        self._only(np.lexsort((self.place[self.col], *keys())))
        new = np.concatenate(([True], np.any([x[1:] != x[:-1] for x in keys()], axis=0)))
        run = np.arange(len(new)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        self._only(run < (self.k if self.grp is None else 1))


def _score_block(qpdf: pd.DataFrame, ipdf: pd.DataFrame, k: int | None, exclude_self: bool,
                 grouped: bool) -> pd.DataFrame:
    """The k best items (groups) of a block for each query, only cells that it visits."""
    if len(qpdf) == 0 or len(ipdf) == 0:
        return pd.DataFrame({"q_id": [], "i_id": [], "grp": [], "sim": []})
    code = pd.factorize(ipdf["grp"], use_na_sentinel=False)[0] if grouped else None
    order = np.lexsort((ipdf["cell"],) if code is None else (code, ipdf["cell"]))
    cell, grps, iids = (ipdf[c].to_numpy()[order] for c in ("cell", "grp", "i_id"))
    code = None if code is None else code[order]
    Q, I = np.stack(qpdf["qv"].to_numpy()), np.stack(ipdf["iv"].to_numpy())[order]
    goes = np.unpackbits(np.frombuffer(b"".join(qpdf["mask"]), np.uint8).reshape(len(qpdf), -1), axis=1)
    left = _Left(qpdf, iids, exclude_self)
    place = pd.factorize(iids, sort=True)[0]
    cut = np.diff(cell, prepend=-1) != 0
    cut[::_SLICE] = True  # scores of a large cell don't wait for each other
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(cell))
    rows, cols, sims = [], [], []
    for s in range(0, len(Q), _CHUNK):
        here = Q[s:s + _CHUNK]
        best = _Best(len(here), k, code, place)
        lr, lc = left.of(s, s + len(here))
        for a, b in zip(first, last):
            at = np.flatnonzero(goes[s:s + _CHUNK, cell[a]])
            if not len(at):
                continue
            S = here[at] @ I[a:b].T
            out = (lc >= a) & (lc < b)
            if out.any():
                row = np.full(len(here), -1)
                row[at] = np.arange(len(at))
                out &= row[lr] >= 0
                S[row[lr[out]], lc[out] - a] = -np.inf
            best.add(at, a, S)
        rows.append(s + best.row)
        cols.append(best.col)
        sims.append(best.sim)
    rows, cols = np.concatenate(rows), np.concatenate(cols)
    return pd.DataFrame({"q_id": qpdf["q_id"].to_numpy()[rows], "i_id": iids[cols], "grp": grps[cols],
                         "sim": np.concatenate(sims)})


def knn(queries: DataFrame, items: DataFrame, k: int | None, *,
        q_id: str = "q_id", i_id: str = "i_id", q_vec: str = "vec", i_vec: str = "vec",
        exclude: str | None = None, exclude_self: bool = False,
        i_group: str | None = None,
        cell_rows: int = CELL_ROWS,
        item_block_rows: int | None = None,
        query_block_rows: int | None = None) -> DataFrame:
    """Top-k items per query by dot product of the given vectors.

    ``queries``: (q_id, vec[, exclude array]) ; ``items``: (i_id, vec[, group]).
    Vectors should already be unit length for cosine similarity.
    Returns (q_id, i_id, rank int, sim double); ``k=None`` returns all.
    With ``i_group`` only the best item of each group competes (ranked
    groups, one row per group, column ``grp`` added).  ``item_block_rows`` and
    ``query_block_rows``: rows of a block at most, else as BLOCK_BYTES allow.
    """
    sc = items.sparkSession.sparkContext
    q_type = dict(queries.dtypes)[q_id]
    i_type = dict(items.dtypes)[i_id]
    qx = F.col(exclude).cast(f"array<{i_type}>") if exclude else F.lit(None).cast(f"array<{i_type}>")
    g_type = dict(items.dtypes)[i_group] if i_group else "long"
    gcol = (F.col(i_group) if i_group else F.lit(0).cast("long")).alias("grp")
    # written once: what they come from isn't run again for the statistics
    items = items.select(F.col(i_id).alias("i_id"), F.col(i_vec).cast("array<double>").alias("iv"),
                         gcol).checkpoint(eager=True)
    queries = queries.select(F.col(q_id).alias("q_id"), F.col(q_vec).cast("array<double>").alias("qv"),
                             qx.alias("qx")).checkpoint(eager=True)
    cells, placed = _make_cells(items, k, i_group is not None, cell_rows)
    visits = _visits(queries, cells, k, exclude_self)

    # blocks: as few as their bytes allow, but some for every core
    size = items.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("iv")).alias("d")).first()
    n_items, n_queries = size["n"], queries.count()
    most = BLOCK_BYTES // (8 * max(size["d"] or 1, 1))
    tasks = TASKS_PER_CORE * sc.defaultParallelism
    if item_block_rows is None:
        wish = min(-(-n_items // ITEM_BLOCK_ROWS), int(np.ceil(np.sqrt(tasks))))
        item_block_rows = max(1, min(most, -(-n_items // max(wish, 1))))
    span = _pack(cells, n_items, item_block_rows)
    n_ib = max(b for _, b in span) + 1
    if query_block_rows is None:
        wish = min(-(-n_queries // QUERY_BLOCK_ROWS), -(-tasks // n_ib))
        query_block_rows = max(1, min(most, -(-n_queries // max(wish, 1))))
    n_qb = max(1, -(-n_queries // query_block_rows))

    blocks = F.array(*[F.array(*[F.lit(b) for b in range(x, y + 1)]) for x, y in span])  # of every cell
    qb = visits.select("q_id", "qv", "qx", "mask", F.pmod(F.xxhash64("q_id"), F.lit(n_qb)).cast("int").alias("qb"),
                       F.explode(F.array_distinct(F.flatten(F.transform(
                           "cells", lambda c: F.element_at(blocks, c + 1))))).alias("ib"))
    own = F.element_at(blocks, F.col("cell") + 1)
    ib = placed.select("i_id", "iv", "grp", "cell", F.element_at(own, (F.pmod(
        F.xxhash64("i_id"), F.size(own)) + 1).cast("int")).alias("ib"),
        F.explode(F.sequence(F.lit(0), F.lit(n_qb - 1))).alias("qb"))
    self_ex, grouped = exclude_self, i_group is not None

    def score(qpdf: pd.DataFrame, ipdf: pd.DataFrame) -> pd.DataFrame:
        return _score_block(qpdf, ipdf, k, self_ex, grouped)

    cand = (qb.groupBy("qb", "ib").cogroup(ib.groupBy("qb", "ib"))
            .applyInPandas(score, schema=f"q_id {q_type}, i_id {i_type}, grp {g_type}, sim double"))
    order = [F.round("sim", 9).desc(), F.col("i_id")]
    if grouped:
        cand = top_k(cand, ["q_id", "grp"], order, 1, "_gr").drop("_gr")
    ranked = top_k(cand, ["q_id"], order, k)
    cols = [F.col("q_id").alias(q_id), F.col("i_id").alias(i_id), "rank", "sim"]
    if grouped:
        cols.insert(2, F.col("grp").alias(i_group))
    return ranked.select(*cols)


def unit_vectors(df: DataFrame, vec: str = "vec", out: str = "uvec") -> DataFrame:
    return df.withColumn(out, unit(F.col(vec).cast("array<double>")))


def cosine(a, b) -> Column:
    return dot(unit(a), unit(b))


def pair_norm(pairs: DataFrame, sents: DataFrame, cats: DataFrame) -> DataFrame:
    """unit(sent + cat) for every distinct (sent_no, cat_no) pair.

    ``sents``: (sent_no, vec); ``cats``: (cat_no, vec).  Two equi-joins; the
    category side is the small one and AQE broadcasts it at run time.
    """
    s = sents.select("sent_no", F.col("vec").alias("svec"))
    c = cats.select("cat_no", F.col("vec").alias("cvec"))
    return (pairs.join(s, "sent_no").join(c, "cat_no")
            .withColumn("uvec", unit(vadd("svec", "cvec")))
            .drop("svec", "cvec"))


def rounded_sim(df: DataFrame, col: str = "sim") -> DataFrame:
    return df.withColumn(col, r6(col))
