"""Vocabulary, id maps and the derived sampling tables.

All counting is a distributed ``groupBy`` with partial aggregation; all
global orderings use :mod:`ordering` (range partitioning, no single-task
window).  The Huffman tree is merged on the histogram of counts (one row per
distinct count) and words get their codes from it in parallel.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordering import dense_index, running_sum_dense

# Fixed values of the reference's defaults
NOISE_POWER = 0.75
DEFAULT_MIN_COUNT = 5
DEFAULT_SAMPLE = 0.0


def word_count(corpus: DataFrame, words: str = "words") -> DataFrame:
    """(word, cnt) over all tokens."""
    return (explode_tokens(corpus.select(words), words)
            .groupBy("word").agg(F.count(F.lit(1)).alias("cnt")))


def explode_tokens(df: DataFrame, words: str = "words", pos: str | None = None) -> DataFrame:
    """One row per token.  ``explode_outer`` + a null filter instead of
    ``explode``: for ``explode`` the optimizer infers a ``size(words) > 0``
    filter that re-evaluates the whole tokenizer expression a second time."""
    keep = [c for c in df.columns if c != words]
    if pos:
        out = df.select(*keep, F.posexplode_outer(words).alias(pos, "word"))
    else:
        out = df.select(*keep, F.explode_outer(words).alias("word"))
    return out.filter(F.col("word").isNotNull())


def corpus_stats(corpus: DataFrame, approx: bool = False) -> DataFrame:
    """One row: n_words, n_types, n_lines, n_sents, n_cats."""
    distinct = F.approx_count_distinct if approx else F.countDistinct
    lines = corpus.agg(F.count(F.lit(1)).alias("n_lines"),
                       F.sum(F.size("words")).cast("long").alias("n_words"),
                       distinct("sent_id").alias("n_sents"),
                       distinct("cat_id").alias("n_cats"))
    types = word_count(corpus).agg(F.count(F.lit(1))).scalar()
    return lines.withColumn("n_types", types)


def vocab_prune(counts: DataFrame, min_count: int = DEFAULT_MIN_COUNT) -> DataFrame:
    """Keep words with cnt >= min_count; idx = rank by (cnt desc, word)."""
    kept = counts.filter(F.col("cnt") >= min_count)
    return dense_index(kept, [F.col("cnt").desc(), F.col("word")], "idx")


def doc_ids(corpus: DataFrame) -> DataFrame:
    """(sent_id, sent_no, first_line) in first-seen order."""
    first = corpus.groupBy("sent_id").agg(F.min("line_no").alias("first_line"))
    return dense_index(first, [F.col("first_line"), F.col("sent_id")], "sent_no")


def cat_ids(corpus: DataFrame) -> DataFrame:
    """(cat_id, cat_no, first_line) in first-seen order."""
    first = corpus.groupBy("cat_id").agg(F.min("line_no").alias("first_line"))
    return dense_index(first, [F.col("first_line"), F.col("cat_id")], "cat_no")


def sent_cat_pairs(corpus: DataFrame, docs: DataFrame, cats: DataFrame) -> DataFrame:
    """(pair_no, sent_no, cat_no, n): distinct pairs with multiplicity,
    numbered by (cat_no, sent_no)."""
    n = corpus.groupBy("sent_id", "cat_id").agg(F.count(F.lit(1)).alias("n"))
    p = (n.join(docs.select("sent_id", "sent_no"), "sent_id")
         .join(cats.select("cat_id", "cat_no"), "cat_id")
         .select("sent_no", "cat_no", "n"))
    return dense_index(p, [F.col("cat_no"), F.col("sent_no")], "pair_no")


class HuffmanRuns:
    """The Huffman tree of a vocabulary, built from its histogram of counts.

    Nodes of one weight are merged as runs: the j-th node of a run becomes child
    ``j % 2`` of the run's (j // 2)-th parent, so a run of any length is one merge
    step and its parents are one run of twice the weight.  Ties go by (count, node
    number); leaf numbers are vocabulary indexes, inner nodes follow in the order
    in which they are made.  There are no more runs than a few per distinct count,
    and a corpus of N tokens has at most sqrt(2N) distinct counts.
    """

    def __init__(self, histogram: list[tuple[int, int, int]]):
        """``histogram``: (count, smallest index, words) of every distinct count."""
        self.leaves = made = sum(n for _, _, n in histogram)
        waiting: dict[int, list[tuple[int, int]]] = {c: [(first, n)] for c, first, n in histogram}
        weights = list(waiting)
        heapq.heapify(weights)
        # child runs: first child, children, their place in the merged sequence, first parent
        steps: list[tuple[int, int, int, int]] = []

        def add(weight: int, first: int, n: int) -> None:
            if weight not in waiting:
                waiting[weight] = []
                heapq.heappush(weights, weight)
            waiting[weight].append((first, n))

        odd = None  # (weight, node) left over from the weight before
        while weights:
            weight = heapq.heappop(weights)
            runs = waiting.pop(weight)
            if odd is not None:
                first, n = runs[0]
                steps += [(odd[1], 1, 0, made), (first, 1, 1, made)]
                add(odd[0] + weight, made, 1)
                made, odd = made + 1, None
                runs = runs[1:] if n == 1 else [(first + 1, n - 1), *runs[1:]]
            total = sum(n for _, n in runs)
            if total % 2:
                first, n = runs.pop()
                odd = (weight, first + n - 1)
                if n > 1:
                    runs.append((first, n - 1))
            at = 0
            for first, n in runs:
                steps.append((first, n, at, made))
                at += n
            if at:
                add(2 * weight, made, at // 2)
                made += at // 2
        self.root = odd[1] if odd else None
        cols = np.array(sorted(steps), dtype=np.int64).reshape(-1, 4)
        self.first, _, self.place, self.parent = cols.T

    def codes(self, idx: np.ndarray) -> tuple[list, list]:
        """Codes and inner-node paths (root first) of some leaves, all climbing at once."""
        node = np.asarray(idx, dtype=np.int64).copy()
        bits, path = [], []
        while True:
            live = node != self.root
            if not live.any():
                break
            run = np.searchsorted(self.first, node, side="right") - 1
            run = np.maximum(run, 0)
            seq = node - self.first[run] + self.place[run]
            up = self.parent[run] + seq // 2
            bits.append(np.where(live, seq % 2, -1))
            path.append(np.where(live, up - self.leaves, -1))
            node = np.where(live, up, node)
        if not bits:
            return [[] for _ in idx], [[] for _ in idx]
        bits, path = np.array(bits)[::-1].T, np.array(path)[::-1].T
        return [b[b >= 0].tolist() for b in bits], [p[p >= 0].tolist() for p in path]


def huffman(vocab: DataFrame) -> DataFrame:
    """Add ``code`` (array<tinyint>) and ``point`` (array<int>) to vocab, whose idx must be
    in descending order of cnt.  Only the histogram of counts reaches the driver; words
    get their codes in parallel."""
    hist = vocab.groupBy("cnt").agg(F.min("idx").alias("first"), F.max("idx").alias("last"),
                                    F.count(F.lit(1)).alias("n")).collect()
    if any(r["last"] - r["first"] + 1 != r["n"] for r in hist):
        raise ValueError("words of one count must have consecutive idx")
    runs = vocab.sparkSession.sparkContext.broadcast(
        HuffmanRuns([(r["cnt"], r["first"], r["n"]) for r in hist]))
    schema = T.StructType([*vocab.schema.fields, T.StructField("code", T.ArrayType(T.ByteType())),
                           T.StructField("point", T.ArrayType(T.IntegerType()))])

    def assign(batches):
        for pdf in batches:
            code, point = runs.value.codes(pdf["idx"].to_numpy())
            yield pdf.assign(code=code, point=point)

    return vocab.mapInPandas(assign, schema)


def noise_dist(vocab: DataFrame, power: float = NOISE_POWER) -> DataFrame:
    """Add [noise_lo, noise_hi): cumulative share of cnt^power in idx order."""
    w = vocab.withColumn("_w", F.pow(F.col("cnt").cast("double"), F.lit(power)))
    # totals are scalar subqueries (one value each), not joins
    z = w.agg(F.sum("_w")).scalar()
    mx = w.agg(F.max("idx")).scalar()
    cum = running_sum_dense(w, "idx", F.col("_w"), "_cum")
    # the last interval ends at exactly 1.0 so that no draw falls past it
    return (cum.withColumn("noise_lo", (F.col("_cum") - F.col("_w")) / z)
            .withColumn("noise_hi", F.when(F.col("idx") == mx, F.lit(1.0)).otherwise(F.col("_cum") / z))
            .drop("_w", "_cum"))


def subsample_prob(vocab: DataFrame, sample: float = DEFAULT_SAMPLE) -> DataFrame:
    """p = min(1, (sqrt(c/t) + 1) * t/c), t = sample * total count; 1 if sample=0."""
    if not sample:
        return vocab.withColumn("sample_prob", F.lit(1.0))
    t = vocab.agg(F.sum("cnt") * F.lit(float(sample))).scalar()
    c = F.col("cnt").cast("double")
    p = (F.sqrt(c / t) + 1) * (t / c)
    return vocab.withColumn("sample_prob", F.least(p, F.lit(1.0)))


def expected_words(vocab: DataFrame) -> DataFrame:
    return vocab.agg(F.sum(F.col("cnt") * F.col("sample_prob")).alias("expected_words"))


def build_vocab(corpus: DataFrame, min_count: int = DEFAULT_MIN_COUNT,
                sample: float = DEFAULT_SAMPLE, hs: bool = True, negative: int = 0,
                power: float = NOISE_POWER) -> DataFrame:
    """The full vocab table: word, idx, cnt, sample_prob[, code, point][, noise_lo, noise_hi]."""
    v = vocab_prune(word_count(corpus), min_count)
    v = subsample_prob(v, sample)
    if hs:
        v = huffman(v)
    if negative:
        v = noise_dist(v, power)
    return v


def sent_to_cat(corpus: DataFrame) -> DataFrame:
    """sent_id -> cat_id of its last line."""
    return corpus.groupBy("sent_id").agg(F.max_by("cat_id", "line_no").alias("cat_id"))


def rev_dict(df: DataFrame, key: str, value: str) -> DataFrame:
    """Swap key and value; the largest key wins a shared value."""
    return df.groupBy(F.col(value).alias("key")).agg(F.max(key).alias("value"))
