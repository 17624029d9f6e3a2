"""Mixing sources to target weights with hash-threshold histograms.

Every row has a 60-bit hash of its key.  Sizes are summed by (source, hash
bucket); running sums over a source's buckets locate the one bucket in which
the budget of the source runs out, and only that bucket is split into finer
buckets, until it holds a single hash value.  The result is one threshold per
source: rows whose hash lies below it are taken.  Nothing is sorted by hash,
and a smaller budget always takes a subset of what a larger one takes.

Targets above the size of a source are met by whole repeats plus a threshold
for the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import dense_index
from .common import null_key, stage, word_count

HASH_BITS = 60
LEVEL_BITS = 10


def _hash60(key: Column, seed: str) -> Column:
    text = F.concat(F.lit(seed + "|"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=(3.0, 1.0, 2.0), share: float = 1.5,
                   cap: float = 2.0) -> DataFrame:
    """``(source, size)`` rows, one per source -> adds ``target`` (double).

    Sources ordered by code point, null last, get ``weights`` in turn. They
    share ``share`` of the sum of all sizes by weight; a target stops at
    ``cap`` times the size of its source and the excess is shared again by
    weight among the others until none is above.  At that fixed point every
    uncapped source has ``level * weight``, so only the one number ``level`` is
    raised on the driver; the sources stay a DataFrame.
    """
    src = dense_index(sizes, [F.col("source").isNull(), F.col("source")], "rank")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.col("rank") % len(weights) + 1).cast("int"))
    src = stage(src.select("source", "size", w.alias("weight")), "mix-sources")
    total = src.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    budget, level, capped_before = share * total, 0.0, -1
    is_capped = F.lit(False)
    while True:
        r = src.agg(F.coalesce(F.sum(F.when(is_capped, F.col("size"))), F.lit(0)).alias("capped"),
                    F.coalesce(F.sum(F.when(~is_capped, F.col("weight"))), F.lit(0.0)).alias("w"),
                    F.count(F.when(is_capped, 1)).alias("n")).first()
        if r["n"] == capped_before or r["w"] == 0:
            break
        level, capped_before = (budget - cap * r["capped"]) / r["w"], r["n"]
        is_capped = F.lit(cap) * F.col("size") <= F.lit(level) * F.col("weight")
    return src.select("source", "size", F.least(F.lit(cap) * F.col("size"),
                                                F.lit(level) * F.col("weight")).alias("target"))


def thresholds(rows: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows (sk, h, size)``, ``targets (sk, size, target)`` ->
    histogram ``(sk, b)`` of the first level and decisions ``(sk, copies, cut)``.

    A row is taken ``copies`` times, once more when ``h < cut``.  Rows of equal
    hash stand or fall together; they are in when at least half of them fits.
    """
    shift = HASH_BITS - LEVEL_BITS
    hist = stage(_histogram(rows, shift), "mix-hist")
    t = targets.select("sk", "target", "size",
                       F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size")))
                       .otherwise(0).cast("long").alias("copies"))
    t = stage(t.withColumn("rest", F.col("target") - F.col("copies") * F.col("size")), "mix-rest")
    level, found = _boundary(hist, t.select("sk", "rest"), shift), []
    while True:
        level = stage(level, "mix-level")
        done = (F.col("hmin") == F.col("hmax")) if shift else F.lit(True)
        found.append(level.filter(done).select(
            "sk", F.when(F.col("s") <= 2 * F.col("rest"), F.col("hmax") + 1)
            .otherwise(F.col("hmin")).alias("cut")))
        level = level.filter(~done)
        if level.isEmpty():
            break
        # only the rows of the boundary buckets, joined on (source, bucket): a hot
        # source is already spread over its buckets
        inside = rows.withColumn("b", F.shiftright("h", shift)).join(
            level.select("sk", "b"), ["sk", "b"], "left_semi")
        shift -= LEVEL_BITS
        level = _boundary(_histogram(inside, shift), level.select("sk", "rest"), shift)
    cuts = found[0]
    for f in found[1:]:
        cuts = cuts.unionByName(f)
    # no boundary bucket: the budget ends between two buckets (or nothing is to be
    # taken), so the cut is the end of the last bucket that fits
    whole = _running(hist, t.select("sk", "rest")).filter("c1 <= rest").groupBy("sk").agg(
        F.shiftleft(F.max("b") + 1, HASH_BITS - LEVEL_BITS).alias("edge"))
    out = t.join(cuts, "sk", "left").join(whole, "sk", "left").select(
        "sk", "target", F.col("size").alias("source_size"), "copies",
        F.when(F.col("rest") > 0, F.coalesce("cut", "edge", F.lit(0))).otherwise(0).alias("cut"))
    return hist, stage(out, "mix-cuts")


def _histogram(rows: DataFrame, shift: int) -> DataFrame:
    return rows.groupBy("sk", F.shiftright("h", shift).alias("b")).agg(
        F.sum("size").alias("s"), F.min("h").alias("hmin"), F.max("h").alias("hmax"))


def _running(hist: DataFrame, rest: DataFrame) -> DataFrame:
    """Running sums c0, c1 before and after each bucket (at most 2^LEVEL_BITS a source)."""
    w = Window.partitionBy("sk").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    return (hist.withColumn("c1", F.sum("s").over(w)).withColumn("c0", F.col("c1") - F.col("s"))
            .join(rest, "sk"))


def _boundary(hist: DataFrame, rest: DataFrame, shift: int) -> DataFrame:
    """The bucket of each source in which its budget runs out, with the rest of the
    budget inside it.  If the budget ends on an edge inside a refined bucket, the
    bucket after the edge is returned with nothing left."""
    r = _running(hist, rest)
    first = r.filter("c1 > rest").groupBy("sk").agg(F.min_by(F.struct("b", "s", "hmin", "hmax",
                                                                       "c0", "rest"), "b").alias("x"))
    r = first.select("sk", "x.b", "x.s", "x.hmin", "x.hmax",
                     (F.col("x.rest") - F.col("x.c0")).alias("rest"))
    return r.filter("rest > 0") if shift == HASH_BITS - LEVEL_BITS else r


def mix(docs: DataFrame, *, key: str = "doc_id", source: str = "source",
        size: Column | None = None, weights=(3.0, 1.0, 2.0), share: float = 1.5,
        cap: float = 2.0, seed: str = "mix") -> DataFrame:
    """Rows of ``docs`` with the number of times the mix takes each.

    Returns ``row`` (struct of all input columns, so no name can clash),
    ``size``, ``source_size``, ``target`` and ``copies``.  ``size`` defaults to the
    words of ``text``.

    Defined cases: a null size counts 0 (null and empty texts); a null source is
    a source of its own, last in order; null keys share one hash and repeated
    rows share theirs, so they are taken or left together; an empty table gives
    an empty result.  Taken sizes of a source differ from its target by at most
    half of the sizes at one hash value (one row when keys are unique).
    """
    size = word_count(F.col("text")) if size is None else F.coalesce(size.cast("long"), F.lit(0))
    full = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col(f"`{source}`").cast("string").alias("source"),
                       null_key(F.col(f"`{source}`")).alias("sk"),
                       _hash60(F.col(f"`{key}`"), seed).alias("h"), size.alias("size"))
    narrow = stage(full.select("source", "sk", "h", "size"), "mix-sizes")
    totals = narrow.groupBy("source").agg(F.sum("size").alias("size"))
    targets = source_targets(totals, weights, share, cap)
    hist, cuts = thresholds(narrow, targets.withColumn("sk", null_key(F.col("source"))))
    # one decision per (source, bucket): the join key of a hot source is spread
    decide = hist.select("sk", "b").join(cuts, "sk")
    return (full.withColumn("b", F.shiftright("h", HASH_BITS - LEVEL_BITS))
            .join(decide, ["sk", "b"])
            .select("row", "size", "source_size", "target",
                    (F.col("copies") + (F.col("h") < F.col("cut")).cast("long")).alias("copies")))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: ``docs`` with every row repeated as often as it is taken."""
    m = mix(docs, **options).filter("copies > 0")
    return (m.withColumn("_rep", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
            .select([F.col("row").getField(c).alias(c) for c in docs.columns]))


ORACLE_TARGETS = """
sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    ('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15))::BIGINT AS h FROM {docs}),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS n,
    [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)]::DOUBLE AS w
    FROM sized GROUP BY source),
steps AS (SELECT *, (SELECT 1.5 * sum(n) FROM src) AS budget,
    coalesce(sum(n) OVER (ORDER BY 2 * n / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(w) OVER (ORDER BY 2 * n / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w FROM src),
lev AS (SELECT (budget - 2.0 * capped) / left_w AS level FROM steps
    WHERE (budget - 2.0 * capped) / left_w < 2 * n / w ORDER BY 2 * n / w LIMIT 1),
tgt AS (SELECT source, n, least(2.0 * n, coalesce((SELECT level FROM lev) * w, 2.0 * n)) AS target FROM src),
rest AS (SELECT *, CASE WHEN n > 0 THEN CAST(floor(target / n) AS BIGINT) ELSE 0 END AS copies FROM tgt),
run AS (SELECT s.doc_id, s.size, r.n, r.target, r.copies, r.target - r.copies * r.n AS rest,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY h) AS c1,
    sum(s.size) OVER (PARTITION BY s.source, h) AS g
    FROM sized s JOIN rest r ON s.source IS NOT DISTINCT FROM r.source),
mixed AS (SELECT *, copies + CASE WHEN 2 * (c1 - g) + g <= 2 * rest AND rest > 0 THEN 1 ELSE 0 END AS times FROM run)
"""
