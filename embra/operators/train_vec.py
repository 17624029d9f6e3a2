"""Vectorised form of the synchronous training step (same results as the
relational form in :mod:`train`, much fewer rows).

One plan serves every size.  Lines are dealt into groups (a document's lines
together, a very long document's over several groups).  Once per epoch the keys
each group reads in each mini-batch are listed: its words, the nodes on their
Huffman paths, the words its noise draws can hit, its documents and categories.
A mini-batch then fetches those rows from the block-partitioned store
(:mod:`param_store`), brings them to their groups by one shuffle, and every
group scores its examples with numpy, in pieces of a fixed number of bytes.  It
emits one partial gradient per row it touched; Spark sums them by key, and the
updated rows, only these, are appended to the store.  Nothing passes through the
driver, and a group holds the rows it reads, never a whole matrix.

The keyed draws are those of the relational form and the SQL twins, drawn for
whole arrays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import keyed_draw_np
from . import train as T
from .param_store import ParamStore, whole_batches, written

PIECE_BYTES = 32 << 20    # of all (rows x size) numbers of a piece of the step; a few arrays of that are alive at most
HOT_TOKENS = 1 << 20      # a document with more tokens is dealt over several groups
GROUP_TOKENS = 1 << 22    # tokens of a group in a mini-batch at most; a row travels to every group that reads it
GROUP_BYTES = 256 << 20   # parameter rows of a group in a mini-batch, about
KINDS = ("syn0", "syn1", "syn1neg", "sent", "cat")  # integer codes 0..4 inside tasks
SYN0, SYN1, SYN1NEG, SENT, CAT = range(5)
LINE_COLS = ["line_no", "sent_no", "cat_no", "idxs", "base", "c_lo", "c_hi", "n"]
GRAD_SCHEMA = "kind string, id long, grad array<double>, n long"


def _dots(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray) -> np.ndarray:
    """Dot products of columns ``at`` of ``a`` and ``bt`` of ``b``."""
    out = np.zeros(len(at))
    for x, y in zip(a, b):
        out += x[at] * y[bt]
    return out


def _add_columns(to: np.ndarray, ids: np.ndarray, a: np.ndarray, at: np.ndarray, weight: np.ndarray) -> None:
    """``to[:, ids] += weight * a[:, at]``, where ids may come several times: one number of all vectors after the
    other, so that neither a sort nor a (rows x size) array is needed."""
    if to.shape[1] > 4 * len(ids):
        some, ids = np.unique(ids, return_inverse=True)
        for row, x in zip(to, a):
            row[some] += np.bincount(ids, x[at] * weight, len(some))
    else:
        for row, x in zip(to, a):
            row += np.bincount(ids, x[at] * weight, len(row))


class _Step:
    """Gradients of one group: the examples of a piece are scored together and added
    up.  Words, nodes and categories have the numbers of :class:`Fetched`."""

    def __init__(self, words: dict, mats: dict, spec: T.TrainSpec, epoch: int):
        self.words, self.mats, self.spec, self.epoch = words, mats, spec, epoch
        self.extra = {"word": 0, "sent": 1, "cat": 2}[spec.family]
        self.learn = {SENT} | ({SYN0} if spec.word_learn else set()) | ({CAT} if spec.cat_learn else set())
        # rows of size d that one centre makes at most, on either side of the network
        path = words["hs_pts"].shape[1] if spec.hs else 0
        outs = path + (1 + spec.negative if spec.negative else 0)
        slots = 2 * spec.window + 1
        rows = slots * max(outs, 2) if spec.arch == "sg" else max(outs, slots + 2)
        self.piece = max(1, PIECE_BYTES // (8 * spec.size * rows))
        # vectors are columns here
        self.sums: dict[int, np.ndarray] = {}
        self.counts: dict[int, np.ndarray] = {}
        self.cols = {code: np.ascontiguousarray(mats[name].T) for code, name in enumerate(KINDS) if name in mats}
        self._reset()

    def documents(self, vecs: np.ndarray) -> None:
        """Other document vectors than those fetched."""
        self.cols[SENT] = np.ascontiguousarray(vecs.T)

    def gradient(self, kind: int, at: np.ndarray) -> np.ndarray:
        """Sums of some rows, a row each."""
        return self.sums[kind][:, at].T

    def _reset(self) -> None:
        self.line, self.i, self.j, self.target = [], [], [], []
        self.inputs: list[tuple] = []  # example, kind, id, weight
        self.n = 0

    def add(self, lines: "Lines", at: np.ndarray, ii: np.ndarray, tokens: np.ndarray, doc: np.ndarray,
            cat: np.ndarray) -> None:
        """Examples of the centre positions ``ii`` of the lines number ``at``, whose position p is
        ``tokens[start + p - base]`` (-1: no word of the vocabulary); ``doc``, ``cat``: numbers of every line's (-1: none)."""
        spec, w = self.spec, self.spec.window
        line_no, n = lines.line_no[at], lines.n[at]
        shift = lines.starts[at] - lines.base[at]
        b = np.floor(keyed_draw_np(spec.seed, "win", self.epoch, line_no, ii) * w).astype(np.int64)
        lo = np.maximum(0, ii - w + b)
        hi = np.minimum(n - 1, ii + w - b)
        cnt = hi - lo + 1
        owner = np.repeat(np.arange(len(ii)), cnt)  # centre of each window slot
        jj = np.repeat(lo, cnt) + (np.arange(cnt.sum()) - np.repeat(np.cumsum(cnt) - cnt, cnt))
        tok = tokens[jj + shift[owner]]
        own = tokens[ii + shift]
        if spec.arch == "sg":
            m = tok >= 0
            if spec.family == "word":
                m &= jj != ii[owner]
            owner = owner[m]
            self._examples(line_no[owner], ii[owner], jj[m], own[owner] if spec.family == "word" else tok[m])
            if spec.family == "word":
                self._inputs(np.arange(self.n), SYN0, tok[m], 1.0)
            else:
                self._known_inputs(np.arange(self.n), SENT, doc[at[owner]], 1.0)
                if spec.family == "cat":
                    self._known_inputs(np.arange(self.n), CAT, cat[at[owner]], 1.0)
        else:
            ex = np.arange(len(ii))
            self._examples(line_no, ii, -1, own)
            m = (tok >= 0) & (jj != ii[owner])
            wt = np.ones(len(ii))
            if spec.cbow_mean:
                wt = 1.0 / np.maximum(np.bincount(owner[m], minlength=len(ii)) + self.extra, 1)
            self._inputs(owner[m], SYN0, tok[m], wt[owner[m]])
            if self.extra >= 1:
                self._known_inputs(ex, SENT, doc[at], wt)
            if self.extra == 2:
                self._known_inputs(ex, CAT, cat[at], wt)
        self.score()

    def _examples(self, line_no, i, j, target) -> None:
        self.line, self.i, self.target = line_no, i, target
        self.j = np.broadcast_to(np.asarray(j, np.int64), len(i))
        self.n = len(i)

    def _inputs(self, ex, kind, ids, weight) -> None:
        if len(ex):
            self.inputs.append((ex, kind, ids, np.broadcast_to(np.asarray(weight, np.float64), len(ex))))

    def _known_inputs(self, ex, kind, ids, weight) -> None:
        m = ids >= 0
        self._inputs(ex[m], kind, ids[m], np.broadcast_to(np.asarray(weight, np.float64), len(ex))[m])

    def score(self) -> None:
        """Score the examples and add their gradients."""
        if not self.n or not self.inputs:
            self._reset()
            return
        if self.spec.arch == "sg" and self.spec.family != "word":
            self._score_counted()
            self._reset()
            return
        spec, n = self.spec, self.n
        l1, has_in = np.zeros((spec.size, n)), np.zeros(n, dtype=bool)
        for ex, kind, ids, weight in self.inputs:
            _add_columns(l1, ex, self.cols[kind], ids, weight)
            has_in[ex] = True
        e_vec, has_e = np.zeros((spec.size, n)), np.zeros(n, dtype=bool)
        for kind, r_ex, r_id, label in self._outputs(self.target):
            keep = has_in[r_ex]
            r_ex, r_id, label = r_ex[keep], r_id[keep], label[keep]
            dt = _dots(l1, r_ex, self.cols[kind], r_id)
            ok = np.abs(dt) < T.MAX_EXP
            r_ex, r_id = r_ex[ok], r_id[ok]
            if not len(r_ex):
                continue
            g = label[ok] - 1.0 / (1.0 + np.exp(-dt[ok]))
            _add_columns(e_vec, r_ex, self.cols[kind], r_id, g)
            has_e[r_ex] = True
            if spec.word_learn:
                self._gather(kind, r_id, l1, r_ex, g)
        for ex, kind, ids, _ in self.inputs:
            m = has_e[ex]
            if kind in self.learn and m.any():
                self._gather(kind, ids[m], e_vec, ex[m], np.ones(int(m.sum())))
        self._reset()

    def _score_counted(self) -> None:
        """DBoW: the input of an example is its document (and category), so equal outputs of one input are one row
        with a count."""
        spec, n = self.spec, self.n
        both = {kind: np.full(n, -1) for kind in (SENT, CAT)}
        for ex, kind, ids, _ in self.inputs:
            both[kind][ex] = ids
        code = (both[SENT] + 1) * (self.cols[CAT].shape[1] + 1) + both[CAT] + 1
        _, first, inp = np.unique(code, return_index=True, return_inverse=True)
        sent, cat = both[SENT][first], both[CAT][first]
        l1 = np.zeros((spec.size, len(first)))
        for kind, ids in ((SENT, sent), (CAT, cat)):
            l1[:, ids >= 0] += self.cols[kind][:, ids[ids >= 0]]
        has_in = (sent >= 0) | (cat >= 0)
        e_vec, has_e = np.zeros_like(l1), np.zeros(n, dtype=bool)
        for kind, r_ex, r_id, label in self._outputs(self.target):
            keep = has_in[inp[r_ex]]
            r_ex, r_id, label = r_ex[keep], r_id[keep], label[keep]
            width = self.cols[kind].shape[1]
            key = (inp[r_ex] * width + r_id) * 2 + label.astype(np.int64)
            key, back, times = np.unique(key, return_inverse=True, return_counts=True)
            where, row = np.divmod(key >> 1, width)
            label = (key & 1).astype(np.float64)
            dt = _dots(l1, where, self.cols[kind], row)
            ok = np.abs(dt) < T.MAX_EXP
            has_e[r_ex if ok.all() else r_ex[ok[back]]] = True
            where, row, times = where[ok], row[ok], times[ok]
            if not len(where):
                continue
            g = (label[ok] - 1.0 / (1.0 + np.exp(-dt[ok]))) * times
            _add_columns(e_vec, where, self.cols[kind], row, g)
            if spec.word_learn:
                self._gather(kind, row, l1, where, g, times)
        times = np.bincount(inp[has_e], minlength=len(first))
        for kind, ids in ((SENT, sent), (CAT, cat)):
            m = np.flatnonzero((ids >= 0) & (times > 0))
            if kind in self.learn and len(m):
                self._gather(kind, ids[m], e_vec, m, np.ones(len(m)), times[m])

    def _outputs(self, target: np.ndarray):
        """(kind, example, row, label) of the output rows of every example."""
        spec, words, n = self.spec, self.words, self.n
        if spec.hs:
            lens = words["hs_len"][target]
            ex = np.repeat(np.arange(n), lens)
            pos = np.arange(len(ex)) - np.repeat(np.cumsum(lens) - lens, lens)
            t = target[ex]
            yield SYN1, ex, words["hs_pts"][t, pos], 1.0 - words["hs_codes"][t, pos]
        if spec.negative:
            u = self.draws(self.line[:, None], self.i[:, None], self.j[:, None])
            at = np.searchsorted(words["noise_lo"], u.ravel(), side="right") - 1
            ex = np.repeat(np.arange(n), spec.negative)
            k = words["noise_word"][np.maximum(at, 0)]
            ok = (at >= 0) & (u.ravel() < words["noise_hi"][np.maximum(at, 0)]) & (k != target[ex])
            yield (SYN1NEG, np.concatenate((np.arange(n), ex[ok])), np.concatenate((target, k[ok])),
                   np.concatenate((np.ones(n), np.zeros(int(ok.sum())))))

    def draws(self, line, i, j) -> np.ndarray:
        return keyed_draw_np(self.spec.seed, "neg", self.epoch, line, i, j,
                             np.arange(1, self.spec.negative + 1)[None, :])

    def _gather(self, kind: int, ids: np.ndarray, vecs: np.ndarray, at: np.ndarray, weight: np.ndarray,
                times: np.ndarray | None = None) -> None:
        """Add gradients of rows, weighted vectors number ``at``, each of so many examples."""
        if kind not in self.sums:
            self.sums[kind] = np.zeros_like(self.cols[kind])
            self.counts[kind] = np.zeros(self.sums[kind].shape[1], np.int64)
        _add_columns(self.sums[kind], ids, vecs, at, weight)
        np.add.at(self.counts[kind], ids, 1 if times is None else times)


class _Draws(_Step):
    """Only the noise buckets that the examples' draws fall into."""

    def __init__(self, spec: T.TrainSpec, epoch: int, buckets: int):
        super().__init__({"hs_pts": np.zeros((0, 0), np.int64)}, {}, spec, epoch)
        self.buckets, self.hits = buckets, np.zeros(buckets, dtype=bool)

    @property
    def hit(self) -> np.ndarray:
        return np.flatnonzero(self.hits)

    def score(self) -> None:
        if self.n:
            u = self.draws(self.line[:, None], self.i[:, None], self.j[:, None])
            self.hits[np.floor(u * self.buckets).astype(np.int64)] = True
        self._reset()


class Fetched:
    """The parameter rows of a group as matrices over its own numbering of words, nodes, documents and categories."""

    def __init__(self, rows: pa.Table, spec: T.TrainSpec):
        kinds = rows["kind"].to_numpy(zero_copy_only=False)
        ids = rows["id"].to_numpy()
        at = {k: np.flatnonzero(kinds == k) for k in (*KINDS, "path", "noise")}
        self.words = np.unique(np.concatenate([ids[at[k]] for k in ("syn0", "syn1neg", "path", "noise")]))
        self.ids = {SYN0: self.words, SYN1NEG: self.words,
                    **{c: np.sort(ids[at[KINDS[c]]]) for c in (SYN1, SENT, CAT)}}
        self.mats = {}
        for code, name in enumerate(KINDS):
            m = np.zeros((spec.size, max(len(self.ids[code]), 1))).T  # the step works on columns
            if len(at[name]):
                vec = rows["vec"].take(pa.array(at[name])).combine_chunks()
                m[np.searchsorted(self.ids[code], ids[at[name]])] = vec.flatten().to_numpy().reshape(-1, spec.size)
            self.mats[name] = m
        self.side: dict = {}
        if spec.hs:
            paths = rows.take(pa.array(at["path"]))
            lens = pa.compute.list_value_length(paths["point"]).to_numpy()
            longest = int(lens.max(initial=1))
            inside = np.arange(longest)[None, :] < lens[:, None]
            place = np.searchsorted(self.words, ids[at["path"]])
            pts = np.zeros((len(self.words), longest), np.int64)
            codes = np.zeros((len(self.words), longest))
            both = [paths[c].combine_chunks().flatten().to_numpy() for c in ("point", "code")]
            pts[place[:, None].repeat(longest, 1)[inside], np.nonzero(inside)[1]] = np.searchsorted(
                self.ids[SYN1], both[0])
            codes[place[:, None].repeat(longest, 1)[inside], np.nonzero(inside)[1]] = both[1]
            n = np.zeros(len(self.words), np.int64)
            n[place] = lens
            self.side.update(hs_len=n, hs_pts=pts, hs_codes=codes)
        if spec.negative:
            noise = at["noise"]
            lo, hi = (rows[c].to_numpy()[noise] for c in ("lo", "hi"))
            order = np.argsort(lo)
            # at least one interval, which nothing falls into
            self.side.update(noise_lo=np.append(lo[order], 2.0), noise_hi=np.append(hi[order], 2.0),
                             noise_word=np.append(np.searchsorted(self.words, ids[noise][order]), -1))

    def local(self, code: int, ids: np.ndarray) -> np.ndarray:
        """Numbers of global ids; -1 for what isn't here."""
        known = self.ids[code]
        if not len(known):
            return np.full(len(ids), -1)
        at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
        return np.where(known[at] == ids, at, -1)


class Lines:
    """The lines of a group, their tokens as one array."""

    def __init__(self, table: pa.Table):
        idxs = table["idxs"].combine_chunks()
        self.tokens = pa.compute.fill_null(idxs.flatten(), -1).to_numpy().astype(np.int64)
        self.ends = np.cumsum(pa.compute.list_value_length(idxs).to_numpy())
        self.starts = np.append(0, self.ends[:-1]).astype(np.int64)
        self.line_no, self.base, self.c_lo, self.c_hi, self.n = (
            table[c].to_numpy().astype(np.int64) for c in ("line_no", "base", "c_lo", "c_hi", "n"))
        self.doc, self.cat = (pa.compute.fill_null(table[c].cast(pa.int64()), -1).to_numpy()
                              for c in ("sent_no", "cat_no"))

    def feed(self, step: _Step, spec: T.TrainSpec, batch: int | None, rows: Fetched | None = None,
             docs: np.ndarray | None = None) -> None:
        """Give the lines' examples to ``step``, centres of many lines at once; with ``rows``, in their numbering, with
        the documents' vectors from ``docs`` or else as fetched."""
        K, B = spec.batches, spec.slice_len
        tokens, doc, cat = self.tokens, np.full(len(self.doc), -1), np.full(len(self.cat), -1)
        if rows is not None:
            tokens = np.where(tokens >= 0, rows.local(SYN0, tokens), -1)
            doc, cat = rows.local(SENT, self.doc), rows.local(CAT, self.cat)
            if docs is not None:
                step.documents(docs)
        count = np.maximum(self.c_hi - self.c_lo, 0)
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        for first in range(0, total, step.piece):
            k = np.arange(first, min(first + step.piece, total))
            at = np.searchsorted(ends, k, side="right")
            ii = self.c_lo[at] + k - (ends[at] - count[at])
            keep = tokens[self.starts[at] + ii - self.base[at]] >= 0
            if K > 1 and batch is not None:
                keep &= (self.line_no[at] + ii // B) % K == batch
            if keep.any():
                step.add(self, at[keep], ii[keep], tokens, doc, cat)


def _gradient_rows(step: _Step, rows: Fetched) -> pa.Table:
    """One row per touched parameter row."""
    kinds, ids, grads, counts = [], [], [np.zeros((0, step.spec.size))], []
    for code, n in step.counts.items():
        at = np.flatnonzero(n)
        kinds += [KINDS[code]] * len(at)
        ids.append(rows.ids[code][at])
        grads.append(step.gradient(code, at))
        counts.append(n[at])
    flat = np.concatenate(grads)
    offsets = np.arange(len(flat) + 1, dtype=np.int32) * step.spec.size
    none = np.zeros(0, np.int64)
    return pa.table({"kind": pa.array(kinds, pa.string()), "id": pa.array(np.concatenate([none, *ids])),
                     "grad": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.ravel())),
                     "n": pa.array(np.concatenate([none, *counts]))})


# --------------------------------------------------------------------------
# groups and what they read


def group_count(lines: DataFrame, vocab: DataFrame, spec: T.TrainSpec) -> int:
    """Groups such that none has more than GROUP_TOKENS tokens in a mini-batch or reads much more than GROUP_BYTES."""
    largest = max([r["n"] for r in T.batch_sizes(lines, spec).collect()], default=0)
    return max(lines.sparkSession.sparkContext.defaultParallelism, -(-largest // _group_tokens(vocab, spec)))


def _group_tokens(vocab: DataFrame, spec: T.TrainSpec) -> int:
    """Tokens of a mini-batch that read GROUP_BYTES at most, by halves of GROUP_TOKENS.

    Among n tokens, or n draws, there are no more different words, expected, than the sum of every word's share times
    n, each at most 1."""
    share = F.col("cnt") / vocab.agg(F.sum("cnt")).scalar()
    sizes = [max(GROUP_TOKENS >> k, 1) for k in range(12)]
    draws = spec.negative * (2 * spec.window if spec.arch == "sg" else 1)

    def words(n: int):
        seen = F.least(F.lit(1.0), n * share)
        drawn = F.least(F.lit(1.0), n * draws * (F.col("noise_hi") - F.col("noise_lo"))) if draws else F.lit(0.0)
        both = seen * F.lit(1.0 + spec.hs) + F.greatest(seen, drawn) * F.lit(float(spec.negative > 0))
        return F.sum(both)

    reads = vocab.agg(*[words(n).alias(f"n{k}") for k, n in enumerate(sizes)]).first()
    room = GROUP_BYTES // (8 * spec.size)
    return next((n for n, rows in zip(sizes, reads) if (rows or 0) <= room), sizes[-1])


def group_labels(spark: SparkSession, groups: int, partitions: int) -> list[int]:
    """Group labels that hash evenly over the partitions."""
    want = -(-groups // partitions)
    h = spark.range(8 * partitions * (want + 4)).select(
        F.col("id").cast("int").alias("g"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(partitions)).alias("p"))
    found: dict[int, list[int]] = {}
    for r in h.orderBy("g").collect():
        found.setdefault(r["p"], []).append(r["g"])
    labels = [x for k in range(want) for p in range(partitions) for x in found.get(p, [])[k:k + 1]]
    return labels[:max(groups, 1)]


def spread_lines(lines: DataFrame, spec: T.TrainSpec, groups: int) -> tuple[DataFrame, int]:
    """Deal the lines into groups and write them once: the kernel is CPU-bound, so every core gets some, and the
    groups' rows then come to the lines without moving them again.

    The lines of a document with more than HOT_TOKENS tokens are dealt over several groups by a salt; each of them
    reads its vector.
    -> lines with ``part``, number of partitions"""
    spark = lines.sparkSession
    partitions = min(groups, max(spark.sparkContext.defaultParallelism,
                                 int(spark.conf.get("spark.sql.shuffle.partitions"))))
    labels = F.array(*[F.lit(g) for g in group_labels(spark, groups, partitions)])
    lines = T.with_segment_cols(lines)
    if spec.family == "word":  # no vector to share: segments go anywhere
        number = F.xxhash64("line_no", "c_lo")
    else:
        load = lines.groupBy("sent_no").agg(F.sum(F.col("c_hi") - F.col("c_lo")).alias("_n"))
        hot = load.filter(F.col("_n") > HOT_TOKENS).select(
            "sent_no", F.ceil(F.col("_n") / F.lit(HOT_TOKENS)).cast("int").alias("salts"))
        lines = lines.join(hot, "sent_no", "left")
        salt = F.when(F.col("salts") > 1, F.pmod(F.xxhash64("line_no", "c_lo"), F.col("salts"))).otherwise(0)
        number = F.xxhash64("sent_no", salt)
    part = F.element_at(labels, (F.pmod(number, F.size(labels)) + 1).cast("int"))
    dealt = lines.select(*LINE_COLS, part.alias("part")).repartition(partitions, "part").sortWithinPartitions("part")
    return written(dealt), partitions


def _batches(first, last, spec: T.TrainSpec):
    """The mini-batches of the slices first..last of a line."""
    if spec.batches == 1:
        return F.array(F.lit(0))
    return F.array_distinct(F.transform(
        F.sequence(first, F.least(last, first + spec.batches - 1)),
        lambda x: F.pmod(F.col("line_no") + x, F.lit(spec.batches)).cast("int")))


def _spans(spec: T.TrainSpec):
    """First and last slice of the centres of a line."""
    B = F.lit(spec.slice_len)
    return F.floor(F.col("c_lo") / B), F.floor(F.greatest(F.col("c_hi") - 1, F.col("c_lo")) / B)


def in_batch(lines: DataFrame, spec: T.TrainSpec, batch: int) -> DataFrame:
    """The lines that have centres in a mini-batch; only these go to the kernel."""
    return lines if spec.batches == 1 else lines.filter(F.array_contains(_batches(*_spans(spec), spec), batch))


def group_keys(lines: DataFrame, vocab: DataFrame, spec: T.TrainSpec, epochs: list[int],
               store: ParamStore) -> tuple[DataFrame, DataFrame]:
    """What the groups of :func:`spread_lines` read in each mini-batch of an epoch (or of several passes):
    parameter keys ``(part, batch, kind, id)`` in the store's partitioning, and ``(part, batch, kind, id, point,
    code, lo, hi)``, the paths and noise intervals they need."""
    B, w = F.lit(spec.slice_len), spec.window
    t = lines.filter(F.size("idxs") > 0).select("part", "line_no", "base", F.posexplode("idxs").alias("k", "id"))
    pos = F.col("base") + F.col("k")
    slices = (F.floor(F.greatest(pos - w, F.lit(0)) / B), F.floor((pos + w) / B))
    words = t.filter("id is not null").select("part", "id", F.explode(_batches(*slices, spec)).alias("batch")).distinct()
    reads = []
    if spec.family == "word" or spec.arch == "cbow":
        reads.append(words.withColumn("kind", F.lit("syn0")))
    side = [words.select("part", "batch", F.lit("path").alias("kind"), "id")]
    empty = {"point": "array<int>", "code": "array<tinyint>", "lo": "double", "hi": "double"}
    nothing = {c: F.lit(None).cast(d) for c, d in empty.items()}
    if spec.hs:
        paths = words.join(vocab.select(F.col("idx").alias("id"), *[F.col(c).cast(empty[c]).alias(c)
                                                                    for c in ("point", "code")]), "id")
        paths = paths.checkpoint(eager=True)
        side = [paths.select("part", "batch", F.lit("path").alias("kind"), "id", "point", "code",
                             *[nothing[c].alias(c) for c in ("lo", "hi")])]
        reads.append(paths.select("part", "batch", F.explode(F.col("point").cast("array<long>")).alias("id")).distinct()
                     .withColumn("kind", F.lit("syn1")))
    else:
        side = []
    if spec.negative:
        with whole_batches(lines.sparkSession):
            noise = _noise_of_groups(lines, vocab, spec, epochs).checkpoint(eager=True)
        side.append(noise.select("part", "batch", F.lit("noise").alias("kind"), "id",
                                 *[nothing[c].alias(c) for c in ("point", "code")], "lo", "hi"))
        reads.append(words.select("part", "batch", "id").unionByName(noise.select("part", "batch", "id")).distinct()
                     .withColumn("kind", F.lit("syn1neg")))
    spans = _spans(spec)
    for kind, col in (("sent", "sent_no"), ("cat", "cat_no")):
        if spec.family == "cat" or kind == "sent" and spec.family == "sent":
            reads.append(lines.filter(F.col(col).isNotNull()).select(
                "part", F.col(col).alias("id"), F.explode(_batches(*spans, spec)).alias("batch")).distinct()
                .withColumn("kind", F.lit(kind)))
    keys, extra = reads[0], side[0]
    for r in reads[1:]:
        keys = keys.unionByName(r)
    for s in side[1:]:
        extra = extra.unionByName(s)
    return written(store.place(keys.select("part", "batch", "kind", "id"))), extra


def _noise_of_groups(lines: DataFrame, vocab: DataFrame, spec: T.TrainSpec, epochs: list[int]) -> DataFrame:
    """(part, batch, id, lo, hi): the noise intervals that a group's draws can fall into.  Draws meet intervals by
    bucket; there are about as many buckets as words."""
    buckets = 1 << max(10, (max(vocab.count(), 1) - 1).bit_length())
    plain = T.with_spec(spec, hs=False)

    def run(table: pa.Table) -> pa.Table:
        group, batch = Lines(table), table["batch"][0].as_py()
        draws = _Draws(plain, epochs[0], buckets)
        for epoch in epochs:
            draws.epoch = epoch
            group.feed(draws, plain, batch if spec.batches > 1 else None)
        n = len(draws.hit)
        return pa.table({"part": pa.array([table["part"][0].as_py()] * n, pa.int32()),
                         "batch": pa.array([batch] * n, pa.int32()), "nb": pa.array(draws.hit)})

    dealt = lines.select("*", F.explode(_batches(*_spans(spec), spec)).alias("batch"))
    hits = dealt.groupBy("part", "batch").applyInArrow(run, "part int, batch int, nb long")
    return hits.join(T.noise_buckets(vocab, buckets), "nb").select(
        "part", "batch", F.col("idx").alias("id"), F.col("noise_lo").alias("lo"), F.col("noise_hi").alias("hi")).distinct()


def fetched(store: ParamStore, keys: DataFrame, side: DataFrame, batch: int) -> DataFrame:
    """The rows that the groups read in a mini-batch."""
    here = F.col("batch") == batch
    rows = store.read(keys.filter(here).select("part", "kind", "id"))
    return rows.unionByName(side.filter(here).drop("batch"), allowMissingColumns=True).select(
        F.col("part").alias("group"), "kind", "id", "vec", "point", "code", "lo", "hi")


# --------------------------------------------------------------------------
# training


def gradients_vec(store: ParamStore, lines: DataFrame, keys: DataFrame, side: DataFrame, spec: T.TrainSpec,
                  epoch: int = 0, batch: int = 0) -> DataFrame:
    """Summed (or mean) gradients per parameter row: (kind, id, grad)."""

    def run(table: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(table):
            return _gradient_rows(_Step({"hs_pts": np.zeros((0, 0))}, {}, spec, epoch), None)
        have = Fetched(rows, spec)
        step = _Step(have.side, have.mats, spec, epoch)
        Lines(table).feed(step, spec, batch if spec.batches > 1 else None, have)
        return _gradient_rows(step, have)

    rows = fetched(store, keys, side, batch)
    here = in_batch(lines, spec, batch)
    part = here.groupBy("part").cogroup(rows.groupBy("group")).applyInArrow(run, GRAD_SCHEMA)
    # straight to the store's blocks: a group has one row per key already.  Number by number: a hash aggregate without objects
    agg = part.repartition(store.blocks, "kind", "id").groupBy("kind", "id").agg(
        *[F.sum(F.col("grad")[k]).alias(f"_g{k}") for k in range(spec.size)], F.sum("n").alias("_n"))
    over = F.col("_n") if spec.combine == "mean" else F.lit(1.0)
    return agg.select("kind", "id", F.array(*[F.col(f"_g{k}") / over for k in range(spec.size)]).alias("grad"))


def train_epoch_vec(params: DataFrame, lines: DataFrame, vocab: DataFrame, spec: T.TrainSpec,
                    epoch: int = 0, total_words: float | None = None, groups: int | None = None,
                    blocks: int | None = None) -> DataFrame:
    """One epoch of K synchronous steps with the vectorised gradients.  ``groups`` and ``blocks`` (of the lines and
    of the store) change how work is dealt, not the result."""
    if total_words is None:
        total_words = float(vocab.agg(F.sum(F.col("cnt") * F.col("sample_prob"))).first()[0])
    lines = T.with_segment_cols(lines)
    alphas = T.batch_alphas(lines, spec, total_words)
    store = ParamStore(params, blocks)
    lines, _ = spread_lines(lines, spec, groups or group_count(lines, vocab, spec))
    keys, side = group_keys(lines, vocab, spec, [epoch], store)
    for b in range(spec.batches):
        grads = gradients_vec(store, lines, keys, side, spec, epoch, b)
        store.append(T.updated_rows(store.read(grads, state=True), spec, alphas[b]))
    return store.latest()
