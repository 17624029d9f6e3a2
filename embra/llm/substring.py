"""Substring dedup by super-k-mer partitioning.

Texts are taken in batches (a table of packed word sequences).  In a batch
every window of ``k`` words has a minimiser: the smallest hash among its short
runs of ``m`` words.  Consecutive windows with the same minimiser travel as one
packed string (a super-k-mer) to the bucket of the minimiser; equal strings of a
batch travel once, with the smallest document key.  In a bucket the windows are
sorted and compared by their words, which gives the smallest key of every
window exactly, and only windows that another batch owns are sent back.

Word runs that fill a large part of the corpus (a common line, a common word
group) rank behind all others, so they are minimisers only of windows made of
nothing else; such windows are equal strings, which travel once a batch.  No
bucket grows with a hot run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch_uri

M = 3                     # words of the runs that minimisers are chosen from
BATCH_WORDS = 1 << 20     # words of a batch (a longer text is a batch of its own)
BATCH_DOCS = 1 << 16
BUCKET_WORDS = 1 << 19    # words of the corpus for each bucket
RUN_WINDOWS = 64          # windows of a super-k-mer at most
HOT_SHARE = 1 / 4096      # of all words: a run this frequent ranks last
HASH_WORDS = 1 << 16
TEXT_LEVEL = 6            # compression of packed words
NULL_KEY = (1 << 63) - 1  # a null key ranks behind every other

_MUL = np.uint64(0x9E3779B97F4A7C15)
_ONE = np.uint64(1)
_POWERS: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        p = np.full(size, base, np.uint64)
        p[0] = 1
        _POWERS[base] = have = np.multiply.accumulate(p)
    return have[:n]


# odd multipliers and their inverses modulo 2^64
_BYTE, _WORD = 0x100000001B3, 0xD6E8FEB86659FD93
_INVERSE = {b: pow(b, -1, 1 << 64) for b in (_BYTE, _WORD)}


def _range_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of values[start:end] for many ranges, from one running sum."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(base, len(values)), out=sums[1:])
    h = (sums[end] - sums[start]) * _power(_INVERSE[base], len(values) + 1)[start]
    return _mix(h + (end - start).astype(np.uint64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * _MUL
    return h ^ (h >> np.uint64(29))


def _words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a buffer of words with one blank or line break
    between (words may hold other control characters)."""
    sep = np.flatnonzero((buf == 32) | (buf == 10))
    return np.concatenate(([0], sep + 1)), np.concatenate((sep, [len(buf)]))


def _word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), np.uint64)
    for k in range(0, len(start), HASH_WORDS):
        s, e = start[k:k + HASH_WORDS], end[k:k + HASH_WORDS]
        part = buf[s[0]:e[-1]].astype(np.uint64) + _ONE
        out[k:k + HASH_WORDS] = _range_hash(part, s - s[0], e - s[0], _BYTE)
    return out


def _pack(numbers: np.ndarray) -> bytes:
    """Integers that mostly rise slowly, as compressed differences."""
    return zstandard.ZstdCompressor(3).compress(np.diff(numbers, prepend=0).astype("<i8").tobytes())


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<i8"))


class Batch:
    """Some documents as one buffer of words: separated by a blank, documents by a line
    break.  Everything derived from it depends on nothing but its content."""

    def __init__(self, keys: list, texts: list[bytes]):
        self.keys, self.texts = keys, texts  # texts: words joined by one blank
        full = [t for t in texts if t]
        self.buf = np.frombuffer(b"\n".join(full), np.uint8)
        self.bytes = b"\n".join(full)
        if not full:
            self.start = self.end = np.zeros(0, np.int64)
        else:
            self.start, self.end = _words(self.buf)
        self.n_words = np.array([t.count(b" ") + 1 if t else 0 for t in texts], np.int64)
        self.doc = np.repeat(np.arange(len(texts)), self.n_words)
        self.rank = np.array([NULL_KEY if k is None else k for k in keys], np.int64)

    def pack(self) -> bytes:
        keys = np.array([0 if k is None else k for k in self.keys], "<i8").tobytes()
        nulls = np.array([k is None for k in self.keys], np.uint8).tobytes()
        body = len(self.keys).to_bytes(8, "little") + keys + nulls + b"\n".join(self.texts)
        return zstandard.ZstdCompressor(TEXT_LEVEL).compress(body)

    @classmethod
    def unpack(cls, packed: bytes) -> Batch:
        body = zstandard.ZstdDecompressor().decompress(packed)
        n = int.from_bytes(body[:8], "little")
        keys = np.frombuffer(body, "<i8", n, 8).tolist()
        nulls = np.frombuffer(body, np.uint8, n, 8 + 8 * n)
        return cls([None if z else k for k, z in zip(keys, nulls)], body[8 + 9 * n:].split(b"\n"))

    def run_hashes(self, m: int) -> np.ndarray:
        """Hash of the m words from each position (positions that hold m words)."""
        h = _word_hashes(self.buf, self.start, self.end) if len(self.start) else np.zeros(0, np.uint64)
        n = len(h) - m + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        g = np.zeros(n, np.uint64)
        for j in range(m):
            g = g * _MUL + h[j:j + n]
        return _mix(g)

    def super_kmers(self, k: int, m: int, hot: np.ndarray):
        """-> first window, number of windows, minimiser of each run of windows."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        n = len(self.start) - k + 1
        if n <= 0:
            return none
        r = self.run_hashes(m) >> _ONE
        if len(hot):
            at = np.minimum(np.searchsorted(hot, r), len(hot) - 1)
            r = np.where(hot[at] == r, r | np.uint64(1 << 63), r)
        have, low, want = 1, r, k - m + 1
        while have < want:  # minimum over a window, by doubling
            step = min(have, want - have)
            low = np.minimum(low[:-step], low[step:])
            have += step
        first = np.flatnonzero(self.doc[:n] == self.doc[k - 1:])  # windows inside one document
        if not len(first):
            return none
        low = low[first]
        head = np.ones(len(first), bool)
        head[1:] = (low[1:] != low[:-1]) | (first[1:] != first[:-1] + 1)
        at = np.flatnonzero(head)
        length = np.diff(np.append(at, len(first)))
        extra = (length - 1) // RUN_WINDOWS  # very long runs are cut
        if extra.any():
            at = np.repeat(at, extra + 1)
            step = np.arange(len(at)) - np.repeat(np.cumsum(extra + 1) - extra - 1, extra + 1)
            at = at + step * RUN_WINDOWS
            length = np.diff(np.append(at, len(first)))
        return first[at], length, low[at]

    def strings(self, first: np.ndarray, length: np.ndarray, k: int):
        """The distinct packed strings of the runs, and the number of each run's string."""
        number: dict[bytes, int] = {}
        data = self.bytes
        of = [number.setdefault(data[a:b], len(number)) for a, b in
              zip(self.start[first].tolist(), self.end[first + length + k - 2].tolist())]
        return list(number), np.array(of, np.int64)


def batches(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write ``docs`` as packed batches ``(batch, words, packed)`` and read them back."""
    path = scratch_uri(docs.sparkSession, "batches")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, keys, texts, words = TaskContext.get().partitionId() << 24, [], [], 0

        def out():
            return pa.RecordBatch.from_pydict(
                {"batch": [number], "words": [words], "packed": [Batch(keys, texts).pack()]},
                schema=pa.schema([("batch", pa.int64()), ("words", pa.int64()), ("packed", pa.binary())]))

        for b in rows:
            for k, t in zip(b.column(0), b.column(1)):
                w = (t.as_py() or "").encode().split()  # bytes.split: ASCII white space only
                if keys and (words + len(w) > BATCH_WORDS or len(keys) >= BATCH_DOCS):
                    yield out()
                    number, keys, texts, words = number + 1, [], [], 0
                keys.append(k.as_py())
                texts.append(b" ".join(w))
                words += len(w)
        if keys:
            yield out()

    docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text")) \
        .mapInArrow(run, "batch long, words long, packed binary").write.option(
        "compression", "uncompressed").parquet(path)
    return docs.sparkSession.read.schema("batch long, words long, packed binary").parquet(path)


def hot_runs(packed: DataFrame, m: int, words: int) -> np.ndarray:
    """Ranks of the word runs that make up at least HOT_SHARE of all words: at most
    1 / HOT_SHARE of them.  A run with that share of the corpus has it in some batch, so
    batches report only those."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for p in b.column(0):
                g, n = np.unique(Batch.unpack(p.as_py()).run_hashes(m), return_counts=True)
                top = n >= max(2, n.sum() * HOT_SHARE)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g[top].view(np.int64)), pa.array(n[top])], names=["run", "n"])

    rows = packed.select("packed").mapInArrow(run, "run long, n long").groupBy("run").agg(
        F.sum("n").alias("n")).filter(F.col("n") >= HOT_SHARE * words).select("run").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64) >> _ONE)


def _send(k: int, m: int, hot, buckets: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for number, p in zip(b.column(0).to_pylist(), b.column(1)):
                batch = Batch.unpack(p.as_py())
                first, length, low = batch.super_kmers(k, m, hot.value)
                strings, of = batch.strings(first, length, k)
                best = np.full(len(strings), NULL_KEY, np.int64)
                np.minimum.at(best, of, batch.rank[batch.doc[first]])
                bucket = np.zeros(len(strings), np.int64)
                bucket[of] = (_mix(low) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
                out = {"bucket": [], "batch": [], "strings": [], "keys": [], "packed": []}
                pack = zstandard.ZstdCompressor(TEXT_LEVEL)
                for part in np.split(order, cuts[1:]) if len(order) else []:
                    out["bucket"].append(int(bucket[part[0]]))
                    out["batch"].append(number)
                    out["strings"].append(_pack(part))
                    out["keys"].append(_pack(best[part]))
                    out["packed"].append(pack.compress(b"\n".join([strings[i] for i in part.tolist()])))
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema(
                    [("bucket", pa.int64()), ("batch", pa.int64()), ("strings", pa.binary()),
                     ("keys", pa.binary()), ("packed", pa.binary())]))
    return run


def _count(k: int):
    """Bucket -> for each batch the strings with windows that a smaller key owns: string
    numbers, then the smallest key of every window of these strings."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        unpack = zstandard.ZstdDecompressor()
        data = b"\n".join([unpack.decompress(p) for p in g["packed"]])
        ids = [_unpack(x) for x in g["strings"]]
        string = np.concatenate(ids)
        best = np.concatenate([_unpack(x) for x in g["keys"]])
        batch = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
        buf = np.frombuffer(data, np.uint8)
        start, end = _words(buf)
        breaks = np.flatnonzero(buf[end[:-1]] == 10) + 1
        words = np.diff(np.concatenate(([0], breaks, [len(start)])))
        windows = words - k + 1
        owner = np.repeat(np.arange(len(words)), windows)
        begin = np.cumsum(windows) - windows
        first = np.repeat(np.cumsum(words) - words, windows) + np.arange(len(owner)) - begin[owner]
        h = _range_hash(_word_hashes(buf, start, end), first, first + k, _WORD)
        order = np.argsort(h)
        head = np.ones(len(h), bool)
        head[1:] = h[order][1:] != h[order][:-1]
        at = np.flatnonzero(head)
        size = np.diff(np.append(at, len(h)))
        key = best[owner]
        low = key.copy()
        # equal hashes are compared word for word; windows alone keep their key
        several = np.flatnonzero(size > 1)
        left, right = start[first], end[first + k - 1]
        member = np.repeat(size > 1, size)
        same = order[member]
        texts = [data[a:b] for a, b in zip(left[same].tolist(), right[same].tolist())]
        edge = np.cumsum(size[several]) - size[several]
        for s, n in zip(edge.tolist(), size[several].tolist()):
            if texts[s:s + n].count(texts[s]) != n:  # different windows with one hash
                least: dict[bytes, int] = {}
                for t, i in zip(texts[s:s + n], same[s:s + n].tolist()):
                    least[t] = min(least.get(t, NULL_KEY), int(key[i]))
                for t, i in zip(texts[s:s + n], same[s:s + n].tolist()):
                    low[i] = least[t]
                size[several[np.searchsorted(edge, s)]] = -n
        good = size > 1
        if good.any():
            least = np.minimum.reduceat(key[order], at)
            low[order[np.repeat(good, np.abs(size))]] = np.repeat(least[good], size[good])
        smaller = np.add.reduceat(low < key, begin) > 0 if len(begin) else np.zeros(0, bool)
        out = {"batch": [], "strings": [], "lows": []}
        names = g["batch"].to_numpy()
        for x in np.unique(batch[smaller]):
            mine = np.flatnonzero(smaller & (batch == x))
            take = np.repeat(smaller & (batch == x), windows)
            out["batch"].append(int(names[x]))
            out["strings"].append(np.stack((string[mine], windows[mine])).astype("<i8").tobytes())
            out["lows"].append(_pack(low[take]))
        return pd.DataFrame(out)
    return run


def _mark(k: int, m: int, hot):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for p, strings, lows in zip(b.column(0), b.column(1), b.column(2)):
                batch = Batch.unpack(p.as_py())
                first, length, _ = batch.super_kmers(k, m, hot.value)
                names, of = batch.strings(first, length, k)
                # smallest key of every window: of its string in this batch, unless a
                # bucket has sent a smaller one
                rank = batch.rank[batch.doc[first]]
                best = np.full(len(names), NULL_KEY, np.int64)
                np.minimum.at(best, of, rank)
                sent = np.full(len(names), -1, np.int64)
                back = [np.zeros(0, np.int64)]
                base = 0
                for s, low in zip(strings.as_py() or [], lows.as_py() or []):
                    number, n = np.frombuffer(s, "<i8").reshape(2, -1)
                    sent[number] = base + np.cumsum(n) - n
                    back.append(_unpack(low))
                    base += len(back[-1])
                back = np.concatenate(back)
                run_of = np.repeat(np.arange(len(first)), length)
                step = np.arange(len(run_of)) - np.repeat(np.cumsum(length) - length, length)
                low = best[of][run_of]
                far = sent[of][run_of]
                low[far >= 0] = back[(far + step)[far >= 0]]
                bad = (first[run_of] + step)[low < rank[run_of]]
                cover = np.zeros(len(batch.start) + 1, np.int64)
                np.add.at(cover, bad, 1)
                np.add.at(cover, bad + k, -1)
                yield _kept(batch, np.cumsum(cover[:-1]) > 0)
    return run


def _kept(batch: Batch, gone: np.ndarray) -> pa.RecordBatch:
    """Rows (key, n_words, n_removed, removed ranges, kept text) of a marked batch."""
    edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
    a, b = edge[::2], edge[1::2]
    base = np.cumsum(batch.n_words) - batch.n_words
    # a removed range may run on into the next document: cut it there
    cut = base[1:][batch.n_words[1:] > 0] if len(base) > 1 else base[:0]
    cut = cut[(cut > 0) & (cut < len(gone))]
    cut = cut[gone[cut] & gone[cut - 1]] if len(cut) else cut
    a, b = np.sort(np.concatenate((a, cut))), np.sort(np.concatenate((b, cut)))
    doc = batch.doc[a] if len(a) else np.zeros(0, np.int64)
    lo = np.searchsorted(doc, np.arange(len(batch.keys)))
    hi = np.searchsorted(doc, np.arange(len(batch.keys)), "right")
    removed, ranges, kept = [], [], []
    data = batch.bytes
    for d, text in enumerate(batch.texts):
        if lo[d] == hi[d]:
            removed.append(0)
            ranges.append([])
            kept.append(text.decode())
            continue
        s, e = a[lo[d]:hi[d]], b[lo[d]:hi[d]]
        removed.append(int((e - s).sum()))
        ranges.append([{"start": x, "end": y} for x, y in zip((s - base[d]).tolist(), (e - base[d]).tolist())])
        left, right = np.append(base[d], e), np.append(s, base[d] + batch.n_words[d])
        some = right > left
        kept.append(b" ".join([data[x:y] for x, y in zip(
            batch.start[left[some]].tolist(), batch.end[right[some] - 1].tolist())]).decode())
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    return pa.RecordBatch.from_arrays(
        [pa.array(batch.keys, pa.int64()), pa.array(batch.n_words), pa.array(removed, pa.int64()),
         pa.array(ranges, pa.list_(span)), pa.array(kept, pa.large_string()).cast(pa.string())],
        names=["key", "n_words", "n_removed", "removed", "kept"])


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = 13,
                   m: int = M, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """Remove every word covered by a window of ``k`` words that also starts in a document
    with a smaller key (windows judged on the input).

    -> per row: ``key``, ``n_words``, ``n_removed``, ``removed`` (word ranges [start,
    end)), ``kept`` (remaining words joined by one blank).

    Defined cases: null, empty and blank texts have no words; texts shorter than a window
    lose nothing; rows of equal keys never take from each other; a null key counts as
    larger than all others; an empty table gives an empty result.  Keys are integers;
    other columns are not read.
    """
    spark = docs.sparkSession
    packed = batches(docs, key=key, text=text)
    words = packed.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    hot = spark.sparkContext.broadcast(hot_runs(packed, m, words))  # at most 1 / HOT_SHARE
    buckets = max(1, -(-words // bucket_words))
    sent = packed.select("batch", "packed").mapInArrow(
        _send(k, m, hot, buckets), "bucket long, batch long, strings binary, keys binary, packed binary")
    back = sent.groupBy("bucket").applyInPandas(_count(k), "batch long, strings binary, lows binary")
    back = back.groupBy("batch").agg(F.collect_list(F.struct("strings", "lows")).alias("back"))
    joined = packed.select("batch", "packed").join(back, "batch", "left").select(
        "packed", F.col("back.strings").alias("strings"), F.col("back.lows").alias("lows"))
    return joined.mapInArrow(_mark(k, m, hot), "key long, n_words long, n_removed long, "
                             "removed array<struct<start:long,end:long>>, kept string")
