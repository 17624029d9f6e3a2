"""SimHash near-duplicates by a binary trie joined with itself.

Fingerprints are distinct before anything is compared.  The top of the trie is
built from prefix counts until no subtree is too large for a task; pairs of
subtrees whose prefixes differ in more bits than allowed are never made.  Each
remaining pair of subtrees is one group: both are walked down together, the
differing bits of a node pair accumulate, and a pair of nodes is dropped as
soon as its error budget is exceeded.  A group does not emit the pairs it
finds but a star over each cluster among its members, so the output is linear
in the fingerprints; the stars are joined into components afterwards.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, stage
from .components import Forest, connected_components

TOP_BITS = 16          # bits of a prefix histogram
SMALL_TREE = 1 << 12   # a subtree is never split below this many fingerprints
LARGE_TREE = 1 << 18   # and always split above
FRONTIER = 1 << 19     # node pairs expanded at once
SHINGLE_BLOCK = 1 << 16
# bits set in a byte, as an 8-column table for counting
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit majority fingerprint of the word shingles (repeats included)."""
    joined = b" ".join((text or "").encode().translate(ASCII_LOWER).split())
    if not joined:
        return 0
    at = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate(([0], at + 1))
    ends = np.concatenate((at, [len(joined)]))
    n = max(1, len(starts) - shingle + 1)
    starts, ends = starts[:n], ends[-n:]
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, n, SHINGLE_BLOCK):
        h = np.array([digest(joined[a:b], 42) for a, b in
                      zip(starts[k:k + SHINGLE_BLOCK].tolist(), ends[k:k + SHINGLE_BLOCK].tolist())],
                     dtype=np.uint64)
        # histogram of the byte values in each of the eight byte positions
        spots = h.view(np.uint8).reshape(-1, 8).astype(np.int64) + np.arange(0, 2048, 256)
        hist = np.bincount(spots.ravel(), minlength=2048).reshape(8, 256)
        counts += (hist @ _BITS).ravel()
    bits = np.packbits(2 * counts > n, bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text",
                 shingle: int = 3) -> DataFrame:
    """-> ``(key, fp)``, fp the unsigned fingerprint as a signed long; 0 without words."""
    schema = docs.select(F.col(f"`{key}`").alias("key")).schema

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))],
                                             names=["key", "fp"])

    return docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")) \
        .mapInArrow(run, schema.add("fp", "long"))


def _split(counts: np.ndarray, low: int, base: int, limit: int, out: list) -> None:
    """Cut a histogram of 2^TOP_BITS prefixes (below a prefix of ``base`` bits starting
    at ``low``) into subtrees of at most ``limit`` where the histogram allows it."""
    csum = np.concatenate(([0], np.cumsum(counts)))
    todo = [(0, 0)]
    while todo:
        at, depth = todo.pop()
        width = 1 << (TOP_BITS - depth)
        n = int(csum[at + width] - csum[at])
        if n == 0:
            continue
        if n > limit and depth < TOP_BITS:
            todo += [(at, depth + 1), (at + width // 2, depth + 1)]
        else:
            out.append((low + (at << (64 - base - TOP_BITS)), base + depth, n))


def subtrees(fps: DataFrame, limit: int | None = None) -> list[tuple[int, int, int]]:
    """``fps (fp)`` distinct -> disjoint subtrees ``(lowest value, prefix bits, size)``
    that hold all of them, in order.  Only prefix counts reach the driver: at most
    2^16 a histogram, one histogram for the root and one for each subtree that is
    still too large after 16 more bits."""
    n = fps.count()
    limit = limit or min(LARGE_TREE, max(SMALL_TREE, n // 32))
    done, large = [], [(0, 0)] if n else []
    while large:
        low, base = large.pop()
        u = fps
        if base:
            u = u.filter(F.shiftrightunsigned("fp", 64 - base) == F.lit(low >> (64 - base)))
        part = F.shiftrightunsigned("fp", 64 - base - TOP_BITS).bitwiseAND(F.lit((1 << TOP_BITS) - 1))
        counts = np.zeros(1 << TOP_BITS, np.int64)
        for r in u.groupBy(part.alias("p")).count().toLocalIterator():
            counts[r["p"]] = r["count"]
        found: list = []
        _split(counts, low, base, limit, found)
        for t in found:
            if t[2] > limit and t[1] == base + TOP_BITS < 64:
                large.append(t[:2])
            else:
                done.append(t)
    return sorted(done)


class Trie:
    """The binary trie over sorted distinct 64-bit values, level by level: node numbers
    of a level are in value order, ``zero[d][x]`` and ``one[d][x]`` are the children of
    node x of level d (-1: none)."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.zero, self.one, self.first, self.size = [], [], [], []
        n = len(values)
        first = np.zeros(1, np.int64)  # first value of each node
        for d in range(65):
            self.first.append(first)
            self.size.append(np.diff(np.append(first, n)))
            if d == 64:
                break
            key = values >> np.uint64(63 - d)
            start = np.ones(n, bool)
            start[1:] = key[1:] != key[:-1]
            below = np.flatnonzero(start)
            bit = (key[below] & np.uint64(1)).astype(bool)
            owner = np.searchsorted(first, below, side="right") - 1
            zero, one = np.full(len(first), -1, np.int64), np.full(len(first), -1, np.int64)
            zero[owner[~bit]] = np.flatnonzero(~bit)
            one[owner[bit]] = np.flatnonzero(bit)
            self.zero.append(zero)
            self.one.append(one)
            first = below
            if len(first) == n:  # only single values are left: pairs of those are compared whole
                self.first.append(first)
                self.size.append(np.ones(n, np.int64))
                break


def trie_pairs(a: Trie, b: Trie, bits: int, same: bool):
    """Walk both tries together; yields arrays of positions (i in a, j in b) of values
    within ``bits`` differing bits (i < j when both are the same trie)."""
    todo = [(0, np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        d, x, y, diff = todo.pop()
        if len(x) > FRONTIER:
            h = len(x) // 2
            todo += [(d, x[h:], y[h:], diff[h:]), (d, x[:h], y[:h], diff[:h])]
            continue
        da, db = min(d, len(a.first) - 1), min(d, len(b.first) - 1)
        single = (a.size[da][x] == 1) & (b.size[db][y] == 1)
        if single.any():
            i, j = a.first[da][x[single]], b.first[db][y[single]]
            near = np.bitwise_count(a.values[i] ^ b.values[j]) <= bits
            if same:
                near &= i < j
            if near.any():
                yield i[near], j[near]
            x, y, diff = x[~single], y[~single], diff[~single]
        if not len(x):
            continue
        ax, bx = _children(a, d, x), _children(b, d, y)
        parts = []
        for p, q, cost in ((0, 0, 0), (1, 1, 0), (0, 1, 1), (1, 0, 1)):
            u, v, c = ax[p], bx[q], diff + cost
            keep = (u >= 0) & (v >= 0) & (c <= bits)
            if same:
                keep &= u <= v
            parts.append((u[keep], v[keep], c[keep]))
        x, y, diff = (np.concatenate(c) for c in zip(*parts))
        if len(x):
            todo.append((d + 1, x, y, diff))


def _children(t: Trie, d: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if d < len(t.zero):
        return t.zero[d][x], t.one[d][x]
    # below the last level a node is one value: its only child keeps its number
    bit = (t.values[x] >> np.uint64(63 - d)) & np.uint64(1)
    return np.where(bit == 0, x, -1), np.where(bit == 1, x, -1)


def fingerprint_links(fps: DataFrame, bits: int = 3, limit: int | None = None) -> DataFrame:
    """Distinct ``fps (fp)`` -> edges ``(u, v)`` whose components are those of all
    pairs of fingerprints within ``bits`` differing bits."""
    spark = fps.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    trees = subtrees(fps, limit)
    low = np.array([t[0] for t in trees], np.uint64)
    depth = np.array([t[1] for t in trees], np.int64)

    def spread(batches):
        for b in batches:
            v = np.sort(b.column(0).to_numpy().view(np.uint64))
            own = np.searchsorted(low, v, side="right") - 1
            rows = {"a": [], "b": [], "side": [], "fps": []}
            for t in np.unique(own):
                data = v[own == t].tobytes()
                d = np.minimum(depth, depth[t])
                x = low ^ low[t]
                far = np.where(d == 0, np.uint64(0), x >> np.minimum(64 - d, 63).astype(np.uint64))
                for p in np.flatnonzero(np.bitwise_count(far) <= bits).tolist():
                    rows["a"].append(min(int(t), p))
                    rows["b"].append(max(int(t), p))
                    rows["side"].append(int(t > p))
                    rows["fps"].append(data)
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema(
                [("a", pa.int64()), ("b", pa.int64()), ("side", pa.int32()), ("fps", pa.binary())]))

    def join(g: pd.DataFrame) -> pd.DataFrame:
        same = g["a"].iloc[0] == g["b"].iloc[0]
        sides = [np.unique(np.frombuffer(b"".join(g["fps"][g["side"] == s]), np.uint64)) for s in (0, 1)]
        left, right = sides[0], sides[0] if same else sides[1]
        if not len(left) or not len(right):
            return pd.DataFrame({"u": pd.Series(dtype="int64"), "v": pd.Series(dtype="int64")})
        ta = Trie(left)
        tb = ta if same else Trie(right)
        every = left if same else np.concatenate((left, right))
        forest = Forest(len(every))
        for i, j in trie_pairs(ta, tb, bits, same):
            forest.link(i, j if same else j + len(left))
        child = np.flatnonzero(forest.parent != np.arange(len(every)))
        return pd.DataFrame({"u": every[child].view(np.int64),
                             "v": every[forest.parent[child]].view(np.int64)})

    ordered = fps.repartitionByRange(n, F.col("fp").bitwiseXOR(F.lit(-(1 << 63))))
    pieces = ordered.mapInArrow(spread, "a long, b long, side int, fps binary")
    return pieces.groupBy("a", "b").applyInPandas(join, "u long, v long")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text",
                    shingle: int = 3, bits: int = 3) -> DataFrame:
    """-> ``(key, fp, component)``: the fingerprint of every row and the smallest key
    reachable over links of at most ``bits`` differing bits.

    Defined cases: null, empty and blank texts have fingerprint 0 and are linked like
    any other; texts with fewer words than a shingle count as one shingle; rows with
    equal text share a fingerprint, so repeated rows are one group; null keys stay in
    their group but never name it (a group of null keys only has component null); an
    empty table gives an empty result.  Other columns are not read.
    """
    fp = stage(fingerprints(docs, key=key, text=text, shingle=shingle), "simhash")
    named, low = _groups(fp, bits)
    return fp.join(named.join(low, "root").select("fp", "component"), "fp")


def _groups(fp: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """``fp (key, fp)`` -> the group of every fingerprint ``(fp, root)`` and the smallest
    key of every group ``(root, component)``."""
    distinct = stage(fp.groupBy("fp").agg(F.min("key").alias("low")), "simhash-distinct")
    roots = connected_components(fingerprint_links(distinct.select("fp"), bits))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left") \
        .withColumn("root", F.coalesce("root", "fp"))
    return named.select("fp", "root"), named.groupBy("root").agg(F.min("low").alias("component"))


def _row_hash(cols: list[str]) -> Column:
    """128 bits over all columns; rows share them exactly when they are identical."""
    exact = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
             "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    return F.unhex(F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in cols]), exact)))


def representatives(docs: DataFrame, *, key: str = "doc_id", text: str = "text",
                    shingle: int = 3, bits: int = 3) -> DataFrame:
    """``docs`` with one row of every near-duplicate group: the one with the smallest
    key, null after any other, then with the smallest hash of the whole row.

    A key that several documents carry can stand for several groups; every group
    keeps a row of its own.  Groups of null keys only keep one row each.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       _row_hash(docs.columns).alias("tag"))
    k = F.col("row").getField(key)
    order = rows.select(F.struct(k.isNull().alias("blank"), k.alias("key"), "tag").alias("order"),
                        F.col("row").getField(text).alias("text"))
    fp = stage(fingerprints(order, key="order", text="text", shingle=shingle), "simhash-rows")
    first = _groups(fp, bits)[1].select("component.tag")
    # only identical rows share a hash, and they are of one group
    return rows.join(first, "tag", "left_semi").dropDuplicates(["tag"]).select("row.*")
