"""Benchmark decontamination over a distributed positional inverted index.

Training documents are tokenized once into blocks of bounded size.  A block is
one coordinate axis of token positions (its documents lie one after another,
apart), and for every term it stores the sorted positions: the postings.
The index is a table that later searches reuse.

A search takes the terms of the test windows, counts them over the whole index
to know which are rare, and reads only their postings.  Inside a block a
phrase starts from the postings of its rarest term, shifted to the start of the
phrase, and intersects them with the shifted postings of the next rarer terms
until none is left.  Test windows are taken in blocks of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, scratch_uri, stage

# fixed pattern: letters and digits after lower-casing A-Z, and everything beyond ASCII
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

BLOCK_TOKENS = 1 << 20    # tokens of an index block (a longer document is a block of its own)
BLOCK_DOCS = 1 << 16      # and documents of one
GAP = 1 << 10             # empty positions between documents; a proximity match is shorter
WINDOW_BLOCK = 50_000     # test windows searched in one pass
DOCS_TERM = ""            # term of the row that lists the documents of a block

INDEX_SCHEMA = "block long, term string, n long, postings binary, keys binary"


def terms(text: str | None) -> list[bytes]:
    return TERM.findall((text or "").encode().translate(ASCII_LOWER))


class _Block:
    """Postings of some documents: term numbers of all tokens, then one stable sort."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.parts, self.keys, self.lengths, self.tokens = [], [], [], 0

    def add(self, key, words: list[bytes]) -> None:
        number = self.number
        for w in set(words).difference(number):
            number[w] = len(number)
        self.parts.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
        self.keys.append(key)
        self.lengths.append(len(words))
        self.tokens += len(words)

    def rows(self, block: int, key_type: pa.DataType) -> pa.RecordBatch:
        ids = np.concatenate(self.parts)
        n = np.array(self.lengths, np.int64)
        start = np.cumsum(n) - n + np.arange(len(n)) * GAP
        pos = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(len(ids))
        order = np.argsort(ids, kind="stable")
        counts = np.bincount(ids, minlength=len(self.number))
        ends = 4 * np.cumsum(counts)
        gaps = np.diff(pos[order], prepend=0)  # each list: first position, then differences
        first = (ends // 4 - counts)[counts > 0]
        gaps[first] = pos[order[first]]
        data = gaps.astype("<i4").tobytes()
        lists = pa.Array.from_buffers(pa.binary(), len(counts), [
            None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32)), pa.py_buffer(data)])
        spans = np.stack((start, n), 1).astype("<i8").tobytes()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([("key", key_type)])) as w:
            w.write_table(pa.table({"key": pa.array(self.keys, key_type)}))
        m = len(counts)
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(m + 1, block), pa.int64()),
            pa.array([DOCS_TERM, *(w.decode() for w in self.number)], pa.string()),
            pa.array(np.concatenate(([len(n)], counts)), pa.int64()),
            pa.concat_arrays([pa.array([spans], pa.binary()), lists]),
            pa.array([sink.getvalue().to_pybytes(), *[None] * m], pa.binary())],
            names=["block", "term", "n", "postings", "keys"])


def build_index(docs: DataFrame, *, key: str = "doc_id", text: str = "text",
                path: str | None = None) -> DataFrame:
    """Positional index of ``docs``: one row per (block, term) with the term's positions,
    and one row per block that lists its documents.  Written to ``path`` (by default
    below the shared checkpoint folder) and read from there."""
    spark = docs.sparkSession
    path = path or scratch_uri(spark, "postings")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # block numbers: unique within a job, and the job's output is written once
        number, block, key_type = TaskContext.get().partitionId() << 24, _Block(), None
        for b in batches:
            key_type = b.schema.field(0).type
            for k, t in zip(b.column(0), b.column(1)):
                words = terms(t.as_py())
                if block.keys and (block.tokens + len(words) > BLOCK_TOKENS
                                   or len(block.keys) >= BLOCK_DOCS):
                    yield block.rows(number, key_type)
                    number, block = number + 1, _Block()
                block.add(k.as_py(), words)
        if block.keys:
            yield block.rows(number, key_type)

    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    rows.mapInArrow(run, INDEX_SCHEMA).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(INDEX_SCHEMA).parquet(path)


def windows_of(items: DataFrame, *, item: str = "item_id", text: str = "text",
               length: int = 13) -> DataFrame:
    """``(item, words)``: the distinct windows of ``length`` consecutive terms of every
    item; an item with fewer terms, but not none, is one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, rows = [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1)):
                w = b" ".join(terms(t.as_py())).decode().split(" ")
                if w != [""]:
                    found = {tuple(w[i:i + length]) for i in range(max(1, len(w) - length + 1))}
                    owner += [k] * len(found)
                    rows += [list(x) for x in found]
            for k in range(0, len(rows), 10000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(owner[k:k + 10000], pa.string()),
                     pa.array(rows[k:k + 10000], pa.list_(pa.string()))], names=["item", "words"])

    return items.select(F.col(f"`{item}`").cast("string").alias("item"), F.col(f"`{text}`").alias("text")) \
        .mapInArrow(run, "item string, words array<string>").distinct()


def _starts(rarest: list[tuple[int, str]], lists: dict[str, np.ndarray]) -> np.ndarray:
    """Positions where the phrase begins: offset-adjusted lists, rarest term first."""
    at = None
    for i, word in rarest:
        p = lists.get(word)
        if p is None:
            return np.zeros(0, np.int32)
        if at is None:
            at = p - i
        else:
            k = np.searchsorted(p, at + i)
            at = at[(k < len(p)) & (p[np.minimum(k, len(p) - 1)] == at + i)]
        if not len(at):
            break
    return at


def _near(rarest: list[tuple[int, str]], slop: int, lists: dict[str, np.ndarray]) -> np.ndarray:
    """(start, end) of the tightest spans, one for each occurrence of the rarest
    term, that hold all different words with at most ``slop`` other tokens between."""
    order = list(dict.fromkeys(w for _, w in rarest))
    if any(w not in lists for w in order):
        return np.zeros((0, 2), np.int64)
    width = len(order) + slop
    anchor = lists[order[0]].astype(np.int64)
    out = []
    for a in anchor.tolist():
        # candidate starts are occurrences of any word at or before the anchor
        hits = np.concatenate([p[np.searchsorted(p, a - width + 1):np.searchsorted(p, a, "right")]
                               for p in (lists[w] for w in order)])
        best = None
        for s in np.unique(hits).tolist():
            ends = []
            for w in order:
                p = lists[w]
                k = np.searchsorted(p, s)
                if k == len(p) or p[k] >= s + width:
                    break
                ends.append(int(p[k]))
            else:
                e = max(*ends, a)
                if e < s + width and (best is None or e + 1 - s <= best[1] - best[0]):
                    best = (s, e + 1)
        if best:
            out.append(best)
    return np.array(out, np.int64).reshape(-1, 2)


def search(index: DataFrame, phrases: DataFrame, *, key_type: str = "long",
           slop: int | None = None) -> DataFrame:
    """``phrases (item, words)`` against the index -> one row per indexed document:
    ``key``, ``doc`` (block and number, unique), ``n_words``, ``spans`` (merged ranges of
    matched token positions, [start, end)) and ``items`` (those with a match, sorted).

    Without ``slop`` a match is the exact phrase; with it, all different words of the
    phrase within a stretch of as many tokens plus ``slop`` others (proximity).
    """
    if slop is not None and slop >= GAP // 2:
        raise ValueError(f"slop must be below {GAP // 2}")
    spark = index.sparkSession
    p = stage(phrases.select("item", "words"), "phrases")
    passes = max(1, -(-p.count() // WINDOW_BLOCK))
    schema = f"doc struct<block:long,n:long>, key {key_type}, n_words long, " \
             "spans array<struct<start:long,end:long>>, items array<string>"
    found = None
    for k in range(passes):
        # a bounded block of the stated query set
        part = p.filter(F.pmod(F.xxhash64("words"), F.lit(passes)) == k).groupBy("words").agg(
            F.collect_set("item").alias("items")).collect()
        queries = [(list(r["words"]), sorted(r["items"])) for r in part]
        vocabulary = sorted({w for words, _ in queries for w in words})
        wanted = spark.createDataFrame([(w,) for w in [DOCS_TERM, *vocabulary]], "term string")
        lists = index.join(F.broadcast(wanted), "term", "left_semi")
        counts = lists.filter(F.col("term") != DOCS_TERM).groupBy("term").agg(F.sum("n").alias("n"))
        rank = {r["term"]: r["n"] for r in counts.collect()}  # at most the words of the block
        rarest_first = [sorted(enumerate(words), key=lambda x: rank.get(x[1], 0)) for words, _ in queries]
        shared = spark.sparkContext.broadcast([(o, items) for o, (_, items) in zip(rarest_first, queries)])
        hits = lists.groupBy("block").applyInPandas(_block_search(shared, slop), schema)
        found = hits if found is None else found.unionByName(hits)
    return found if passes == 1 else _merge_passes(stage(found, "hits"), schema)


def _block_search(shared, slop: int | None):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        queries = shared.value
        lists = {t: np.cumsum(np.frombuffer(p, "<i4"), dtype=np.int32) for t, p in zip(g["term"], g["postings"]) if t != DOCS_TERM}
        docs = g[g["term"] == DOCS_TERM].iloc[0]
        start, n = np.frombuffer(docs["postings"], "<i8").reshape(-1, 2).T
        with pa.ipc.open_stream(docs["keys"]) as r:
            keys = r.read_all()["key"].to_pandas(integer_object_nulls=True)
        first, last, owner = [], [], []
        for q, (rarest, _) in enumerate(queries):
            if slop is None:
                a = _starts(rarest, lists)
                b = a + len(rarest)
            else:
                a, b = _near(rarest, slop, lists).T
            if len(a):
                first.append(a.astype(np.int64))
                last.append(b.astype(np.int64))
                owner.append(np.full(len(a), q))
        spans = [[] for _ in keys]
        items = [set() for _ in keys]
        if first:
            a, b, q = (np.concatenate(x) for x in (first, last, owner))
            doc = np.searchsorted(start, a, "right") - 1
            inside = b <= start[doc] + n[doc]  # a gap keeps phrases apart; long slops may reach over
            a, b, q, doc = a[inside], b[inside], q[inside], doc[inside]
            order = np.argsort(a, kind="stable")
            a, b, q, doc = a[order], b[order], q[order], doc[order]
            if len(a):
                top = np.maximum.accumulate(b)
                head = np.ones(len(a), bool)
                head[1:] = (a[1:] > top[:-1]) | (doc[1:] != doc[:-1])
                h = np.flatnonzero(head)
                for d, s, e in zip(doc[h].tolist(), a[h].tolist(), np.maximum.reduceat(b, h).tolist()):
                    spans[d].append({"start": s - int(start[d]), "end": e - int(start[d])})
                for d, x in set(zip(doc.tolist(), q.tolist())):
                    items[d].update(queries[x][1])
        block = int(docs["block"])
        return pd.DataFrame({"doc": [{"block": block, "n": k} for k in range(len(keys))],
                             "key": keys, "n_words": n, "spans": spans,
                             "items": [sorted(x) for x in items]})
    return run


def _merge_passes(found: DataFrame, schema: str) -> DataFrame:
    """One row per document again after several passes: ranges merged, items united."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            merged = []
            for spans in g["spans"]:
                out: list = []
                for s in sorted(spans, key=lambda s: (s["start"], s["end"])):
                    if out and s["start"] <= out[-1]["end"]:
                        out[-1]["end"] = max(out[-1]["end"], s["end"])
                    else:
                        out.append({"start": s["start"], "end": s["end"]})
                merged.append(out)
            yield g.assign(spans=merged)

    return found.groupBy("doc").agg(
        F.first("key").alias("key"), F.first("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    ).mapInPandas(run, schema)


def contamination(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text",
                  item: str = "item_id", item_text: str = "text", length: int = 13,
                  share: int = 20, path: str | None = None) -> DataFrame:
    """-> per row of ``docs``: ``key``, ``n_words``, ``n_hit`` (words inside any occurrence
    of a window of an item), ``spans``, ``items`` (with an occurring window, sorted as
    strings) and ``contaminated`` (some hit and ``share * n_hit >= n_words``).

    Defined cases: null, empty and word-less texts have 0 words and are clean; items
    without words have no window; null item ids take part under no name (their hits
    count, ``items`` leaves them out); repeated rows are judged each, repeated items
    count once; empty tables on either side give clean documents or no rows.  Other
    columns are not read.
    """
    key_type = docs.select(F.col(f"`{key}`")).schema[0].dataType.simpleString()
    index = build_index(docs, key=key, text=text, path=path)
    hits = search(index, windows_of(items, item=item, text=item_text, length=length), key_type=key_type)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return hits.select("key", "n_words", n_hit.alias("n_hit"), "spans", "items").withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words")))


def clean_documents(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text",
                    **options) -> DataFrame:
    """``docs`` without the contaminated ones, all columns kept.  A verdict depends on
    the text alone, so rows are matched by key (null-safe) and a hash of the text."""
    words, number = F.col(f"`{text}`"), F.col(f"`{key}`")
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), words.alias("_text"),
                         F.struct(number.alias("k"), F.xxhash64(words).alias("h")).alias("_id"))
    bad = contamination(marked.select("_id", "_text"), items, key="_id", text="_text", **options) \
        .filter("contaminated").select(F.col("key.k").alias("_k"), F.col("key.h").alias("_h")).distinct()
    return marked.join(bad, (F.col("_id.h") == F.col("_h")) & F.col("_id.k").eqNullSafe(F.col("_k")),
                       "left_anti").select("_row.*")
