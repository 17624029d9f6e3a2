"""Training as synchronous mini-batch gradient aggregation.

One definition covers the word model (skip-gram / CBOW), the paragraph
model (DBoW / DM) and the category model (DBoW / DM with a category
vector), each with hierarchical softmax and/or negative sampling, and the
SGD / AdaGrad / AdaDelta / ADAM updates.

Within a mini-batch every parameter is frozen: examples are generated
from the in-vocabulary tokens of each line, joined with the parameter
rows they read, scored, and their gradients are summed per parameter row
(ML ``Summarizer`` = a real aggregate with map-side partial aggregation,
so the Huffman root touched by every example is combined before the
shuffle).  The update rule then runs once per touched row.  Results do
not depend on partitioning; every random draw is a keyed uniform.

Tables
  vocab  : word, idx, cnt, sample_prob[, code, point][, noise_lo, noise_hi]
  lines  : line_no, sent_no, cat_no, idxs array<long>
  params : kind string, id long, vec array<double>, state array<double>
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.vectors import dot, keyed_draw, keyed_draw_np, keyed_uniform
from .similarity import sum_vectors

# Fixed values that must equal the reference's settings
MAX_EXP = 6.0
ADAGRAD_EPS = 1e-8
ADADELTA_EPS = 1e-8
ADADELTA_RHO = 0.995
ADAM_L = 0.99999999
ADAM_B1 = 0.9
ADAM_B2 = 0.999
ADAM_A = 0.001

OPTIMIZERS = ("sgd", "adagrad", "adadelta", "adam")
NOISE_BUCKETS = 1 << 16
# lines are trained in pieces of so many tokens
SEGMENT_LEN = 10_000
# tokens of a part of the relational step, about
PART_TOKENS = 1 << 18
# words whose tokens are kept from gathering; any other has less than a thousandth of them
HOT_WORDS = 1_000
# tokens whose words are numbered together, and lines added at a time
CHUNK_TOKENS = 1 << 20
CHUNK_LINES = 64
LINE_KEYS = ["line_no", "sent_id", "cat_id", "piece", "pieces"]


@dataclass(frozen=True)
class TrainSpec:
    family: str = "cat"          # word | sent | cat
    arch: str = "sg"             # sg: skip-gram / DBoW ; cbow: CBOW / DM
    hs: bool = True
    negative: int = 0
    window: int = 5
    cbow_mean: bool = False
    word_learn: bool = True
    cat_learn: bool = True
    optimizer: str = "sgd"
    size: int = 100
    alpha: float = 0.025
    min_alpha: float = 0.0001
    seed: int = 1
    sample: float = 0.0
    min_count: int = 5
    init_adjust: bool = True
    batches: int = 1             # K mini-batches per epoch
    combine: str = "sum"         # per-row gradient: exact sum of touches, or their mean
    slice_len: int = 10000       # B: positions of one line per batch slice
    epochs: int = 1
    normalize_each_epoch: bool = False

    def validate(self):
        if not self.hs and not self.negative:
            raise ValueError("either hs or negative must be enabled")
        if self.combine not in ("sum", "mean"):
            raise ValueError("combine must be 'sum' or 'mean'")
        if self.optimizer not in OPTIMIZERS:
            raise ValueError(f"unknown optimizer {self.optimizer}")
        if self.family not in ("word", "sent", "cat") or self.arch not in ("sg", "cbow"):
            raise ValueError("bad family/arch")
        return self

    @property
    def state_width(self) -> int:
        d = self.size
        return {"sgd": 0, "adagrad": d, "adadelta": 2 * d, "adam": 2 * d + 3}[self.optimizer]

    def identifier(self) -> str:
        """Model id: the fields of the format in their fixed order, joined by '_'."""
        fields = [
            f"{self.family}{self.size}",
            {"sg": "sg"}.get(self.arch, "cb"),
            "hs" if self.hs else f"neg{self.negative}",
            f"a{self.alpha:g}",
            f"it{self.epochs}",
            "n" * self.normalize_each_epoch,
            {"adadelta": "adadel"}.get(self.optimizer, self.optimizer),
        ]
        return "_".join(filter(None, fields))


# --------------------------------------------------------------------------
# parameters


def _init_vec(kind: str, id_col: Column, d: int, seed: int, denom: float) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(d - 1)),
                       lambda k: (keyed_uniform(seed, F.lit(kind), id_col, k) - F.lit(0.5))
                       / F.lit(denom))


def init_state(spec: TrainSpec) -> Column:
    d = spec.size
    if spec.optimizer == "sgd":
        return F.array().cast("array<double>")
    if spec.optimizer == "adagrad":
        return F.array_repeat(F.lit(0.0), d)
    if spec.optimizer == "adadelta":
        return F.array_repeat(F.lit(0.0), 2 * d)
    return F.concat(F.array_repeat(F.lit(0.0), 2 * d),
                    F.array(F.lit(ADAM_B1), F.lit(ADAM_B1), F.lit(ADAM_B2)))


def word_denominator(spec: TrainSpec) -> float:
    d = spec.size
    if spec.family != "word" and spec.init_adjust:
        return d / math.sqrt(d)
    return float(d)


def doc_denominator(spec: TrainSpec) -> float:
    return math.sqrt(spec.size) if spec.init_adjust else float(spec.size)


def init_params(spec: TrainSpec, vocab: DataFrame, docs: DataFrame | None = None,
                cats: DataFrame | None = None) -> DataFrame:
    """Initial params: syn0 random, syn1/syn1neg zero, sent/cat random."""
    d, seed = spec.size, spec.seed
    zero = F.array_repeat(F.lit(0.0), d)
    st = init_state(spec)
    parts = [vocab.select(F.lit("syn0").alias("kind"), F.col("idx").alias("id"),
                          _init_vec("syn0", F.col("idx"), d, seed, word_denominator(spec)).alias("vec"))]
    if spec.hs:
        inner = vocab.select("idx").filter(F.col("idx") < vocab.agg(F.max("idx")).scalar())
        parts.append(inner.select(F.lit("syn1").alias("kind"), F.col("idx").alias("id"),
                                  zero.alias("vec")))
    if spec.negative:
        parts.append(vocab.select(F.lit("syn1neg").alias("kind"), F.col("idx").alias("id"),
                                  zero.alias("vec")))
    if spec.family in ("sent", "cat") and docs is not None:
        parts.append(docs.select(F.lit("sent").alias("kind"), F.col("sent_no").alias("id"),
                                 _init_vec("sent", F.col("sent_no"), d, seed,
                                           doc_denominator(spec)).alias("vec")))
    if spec.family == "cat" and cats is not None:
        parts.append(cats.select(F.lit("cat").alias("kind"), F.col("cat_no").alias("id"),
                                 _init_vec("cat", F.col("cat_no"), d, seed,
                                           doc_denominator(spec)).alias("vec")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("state", st)


def reuse_word_vectors(params: DataFrame, vocab: DataFrame, stored_words: DataFrame) -> DataFrame:
    """Start a model from stored word vectors: syn0 rows of words present in
    ``stored_words`` (word, vec) take the stored vector (equi-join on the
    word); the others keep their initial vector."""
    sw = stored_words.select("word", F.col("vec").alias("_sv"))
    s0 = (params.filter(F.col("kind") == "syn0")
          .join(vocab.select(F.col("idx").alias("id"), "word"), "id")
          .join(sw, "word", "left")
          .select("kind", "id", F.coalesce("_sv", "vec").alias("vec"), "state"))
    return params.filter(F.col("kind") != "syn0").unionByName(s0)


# --------------------------------------------------------------------------
# lines and examples


def prepare_lines(corpus: DataFrame, vocab: DataFrame, spec: TrainSpec, epoch: int = 0,
                  docs: DataFrame | None = None, cats: DataFrame | None = None,
                  keep_oov: bool = False, segment_len: int | None = None) -> DataFrame:
    """In-vocabulary token ids of every line, sub-sampled, positions compacted.

    The distinct words of a chunk of lines, not its tokens, meet the vocabulary
    in an equi-join (see :func:`token_ids`).  Without ``segment_len`` a line
    stays whole (bounded by one input row).  With it, every line is cut into
    pieces of that many tokens first, and the pieces of longer lines become
    segments with margins (see :func:`segment_lines`), so no task holds a
    whole long line; training and inference always do this.  With
    ``keep_oov`` (inference) OOV tokens stay as null and nothing is
    sub-sampled.
    """
    lines = corpus.select("line_no", "sent_id", "cat_id", "words")
    keys = ["line_no", "sent_id", "cat_id"]
    if segment_len:
        if segment_len <= spec.window:
            raise ValueError("segment_len must exceed the window")
        S = int(segment_len)
        parts = F.greatest(F.ceil(F.size("words") / S), F.lit(1)).cast("int")
        cut = F.transform(F.sequence(F.lit(0), parts - 1), lambda k: F.struct(
            k.alias("piece"), F.slice("words", k * S + 1, F.lit(S)).alias("words"), parts.alias("pieces")))
        lines = lines.select(*keys, F.explode_outer(cut).alias("_p")).select(
            *keys, "_p.piece", "_p.pieces", "_p.words")
    else:
        lines = lines.withColumn("piece", F.lit(0)).withColumn("pieces", F.lit(1))
    sub = (spec.seed, epoch) if spec.sample and not keep_oov else None
    j = token_ids(lines, vocab, keep_oov, sub, int(segment_len or 0))
    # rows of equal keys are one line, their tokens in order of position
    tokens = F.transform(F.flatten(F.transform("_a", lambda x: F.arrays_zip(x["opos"], x["idxs"]))),
                         lambda t: F.struct(t["opos"].alias("opos"), t["idxs"].alias("idx")))
    found = F.when(F.size("_a") > 1, F.array_sort(tokens)).otherwise(tokens)
    g = j.groupBy(*keys, "piece").agg(F.collect_list(F.struct("opos", "idxs")).alias("_a"),
                                      F.max("pieces").alias("pieces"))
    ids = F.when(F.size("_a") > 1, F.transform(F.array_sort(tokens), lambda t: t["idx"])).otherwise(F.col("_a")[0]["idxs"])
    if segment_len:
        # the number of pieces is an aggregate, not a key: both branches below then
        # share one shuffle of the pieces
        whole = with_segment_cols(g.filter("pieces = 1").select(*keys, ids.alias("idxs")))
        long = g.filter("pieces > 1").select(*keys, "piece", found.alias("_t"))
        lines = whole.unionByName(segment_lines(long, spec.window, S, compact=not keep_oov))
    else:
        lines = g.select(*keys, ids.alias("idxs"))
    if docs is not None:
        lines = lines.join(docs.select("sent_id", "sent_no"), "sent_id", "left")
    else:
        lines = lines.withColumn("sent_no", F.lit(None).cast("long"))
    if cats is not None:
        lines = lines.join(cats.select("cat_id", "cat_no"), "cat_id", "left")
    else:
        lines = lines.withColumn("cat_no", F.lit(None).cast("long"))
    extra = ["base", "c_lo", "c_hi", "n"] if segment_len else []
    return lines.select("line_no", "sent_no", "cat_no", "idxs", *extra)


def token_ids(lines: DataFrame, vocab: DataFrame, keep_oov: bool, sub: tuple[int, int] | None,
              piece_len: int = 0) -> DataFrame:
    """Pieces of lines (line_no, sent_id, cat_id, piece, pieces, words) with ``opos`` and ``idxs``, the places and ids of
    their tokens, instead of ``words``; pieces without a token are left out.

    A task numbers the words of chunks of about CHUNK_TOKENS tokens and writes the lines as these numbers, beside each
    chunk's distinct words.  Only the distinct words are joined with the vocabulary; their ids come back to the lines
    by chunk.  ``sub``: seed and epoch of the draws of sub-sampling."""
    def encode(batches):
        task, made = TaskContext.get().partitionId() << 32, 0
        held, tokens = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_LINES):
                held.append(batch.slice(at, CHUNK_LINES))
                words = held[-1]["words"]
                tokens += len(words.flatten())
                if tokens >= CHUNK_TOKENS:
                    yield from _numbered(held, task + made)
                    held, tokens, made = [], 0, made + 1
        if held:
            yield from _numbered(held, task + made)

    fields = [StructField(c, lines.schema[c].dataType) for c in LINE_KEYS]
    kept = lines.select(*LINE_KEYS, "words").mapInArrow(encode, StructType([
        StructField("chunk", LongType()), *fields, StructField("codes", BinaryType()),
        StructField("code", IntegerType()), StructField("word", StringType())])).checkpoint(eager=True)

    v = vocab.select("word", "idx", "sample_prob")
    known = lookup_words(kept.filter("word is not null").select(F.col("chunk").alias("line_no"),
                                                                F.col("code").alias("opos"), "word"),
                         v, v.filter(F.col("idx") < HOT_WORDS)).filter("idx is not null").select(
        F.col("line_no").alias("chunk"), F.col("opos").alias("code"), "idx", "sample_prob")

    def look_up(rows: pa.Table, ids: pa.Table) -> pa.Table:
        return _ids_of_chunk(rows, ids, keep_oov, sub, piece_len)

    out = StructType([*fields, StructField("opos", ArrayType(LongType())), StructField("idxs", ArrayType(LongType()))])
    return (kept.filter("codes is not null").select("chunk", *LINE_KEYS, "codes").groupBy("chunk")
            .cogroup(known.groupBy("chunk")).applyInArrow(look_up, out))


def _numbered(held: list, chunk: int):
    """The lines of a chunk with the numbers of their words (-1: null), then its distinct words."""
    t = pa.Table.from_batches(held)
    words = t["words"].combine_chunks()
    n = pa.compute.fill_null(pa.compute.list_value_length(words), 0).to_numpy().astype(np.int64)
    flat = words.flatten().dictionary_encode()
    codes = pa.compute.fill_null(flat.indices, -1).to_numpy().astype(np.int32)
    ends = np.cumsum(n)
    packed = pa.array([codes[b - c:b].tobytes() if c else None for b, c in zip(ends, n)], pa.binary())
    rows, distinct = len(t), len(flat.dictionary)
    names = ["chunk", *LINE_KEYS, "codes", "code", "word"]
    yield from pa.table([pa.array(np.full(rows, chunk)), *[t[c] for c in LINE_KEYS], packed, pa.nulls(rows, pa.int32()),
                         pa.nulls(rows, pa.string())], names=names).to_batches()
    yield from pa.table([pa.array(np.full(distinct, chunk)), *[pa.nulls(distinct, t.schema.field(c).type) for c in LINE_KEYS],
                         pa.nulls(distinct, pa.binary()), pa.array(np.arange(distinct, dtype=np.int32)),
                         flat.dictionary.cast(pa.string())], names=names).to_batches()


def _ids_of_chunk(rows: pa.Table, ids: pa.Table, keep_oov: bool, sub: tuple[int, int] | None, piece_len: int) -> pa.Table:
    flat = [np.frombuffer(x.as_py(), np.int32) for x in rows["codes"]]
    n = np.array([len(x) for x in flat], np.int64)
    codes = np.concatenate([np.zeros(0, np.int32), *flat])
    code = ids["code"].to_numpy()
    most = max(codes.max(initial=-1), code.max(initial=-1)) + 2  # -1, the last: a null word
    idx = np.full(most, -1, np.int64)
    idx[code] = ids["idx"].to_numpy()
    own = idx[codes]
    row = np.repeat(np.arange(len(n)), n)
    opos = np.arange(len(codes)) - np.repeat(np.cumsum(n) - n, n) + (rows["piece"].to_numpy().astype(np.int64) * piece_len)[row]
    keep = codes >= 0 if keep_oov else own >= 0
    if sub:
        prob = np.zeros(most)
        prob[code] = ids["sample_prob"].to_numpy()
        line = rows["line_no"].combine_chunks()
        u = keyed_draw_np(sub[0], "sub", sub[1], pa.compute.fill_null(line, 0).to_numpy()[row], opos)
        u[line.is_null().to_numpy(zero_copy_only=False)[row]] = np.inf  # no line number, no draw
        keep &= (prob[codes] >= 1.0) | (prob[codes] >= u)
    own, opos, n = own[keep], opos[keep], np.bincount(row[keep], minlength=len(n))
    some = n > 0
    ends = pa.array(np.append(0, np.cumsum(n[some])).astype(np.int32))
    t = rows.select(LINE_KEYS).filter(pa.array(some))
    return pa.table([*[t[c] for c in LINE_KEYS], pa.ListArray.from_arrays(ends, pa.array(opos)),
                     pa.ListArray.from_arrays(ends, pa.array(own, mask=own < 0))], names=[*LINE_KEYS, "opos", "idxs"])


def lookup_words(tokens: DataFrame, words: DataFrame, frequent: DataFrame) -> DataFrame:
    """Tokens (line_no, opos, word, ...) with the columns of ``words`` (word, idx, sample_prob); null for what isn't
    there.

    ``frequent``: at most HOT_WORDS rows of the same columns, words of which there may be very many tokens (idx null
    for one that isn't in the vocabulary).  They are looked up in a broadcast; their tokens pass the join of the
    others under scattered keys that match nothing, so no word gathers its tokens in one partition."""
    hot = F.broadcast(frequent.select("word", F.col("idx").alias("_i"), F.col("sample_prob").alias("_p"),
                                      F.lit(True).alias("_hot")))
    t = tokens.join(hot, "word", "left")
    scattered = F.pmod(F.xxhash64("line_no", "opos"), F.lit(1 << 20)).cast("string")
    t = t.withColumn("_rare", F.col("_hot").isNull()).withColumn(
        "_key", F.when(F.col("_rare"), F.col("word")).otherwise(scattered))
    rare = words.select(F.col("word").alias("_key"), "idx", "sample_prob", F.lit(True).alias("_rare"))
    return t.join(rare, ["_key", "_rare"], "left").select(
        *tokens.columns, F.coalesce("_i", "idx").alias("idx"), F.coalesce("_p", "sample_prob").alias("sample_prob"))


def with_segment_cols(lines: DataFrame) -> DataFrame:
    """Whole lines as one segment: base 0, centres [0, n), n = line length."""
    if "base" in lines.columns:
        return lines
    n = F.size("idxs").cast("long")
    return (lines.withColumn("base", F.lit(0).cast("long")).withColumn("c_lo", F.lit(0).cast("long"))
            .withColumn("c_hi", n).withColumn("n", n))


def _part_of(df: DataFrame) -> list[str]:
    """The column by which rows of a group are kept together, if there is one."""
    return ["part"] if "part" in df.columns else []


def positions(lines: DataFrame, spec: TrainSpec, epoch: int = 0,
              batch: int | None = None) -> DataFrame:
    """One row per token position with its reduced context window.

    Window: b = floor(u * window), context [i-window+b, i+window-b] clipped
    to the line.  ``ctx`` holds the token ids of the whole window (centre
    included) and ``lo`` its first position, built inside the row with
    ``slice`` (no self-join).  Batch of a position:
    pmod(line_no + floor(i / slice_len), K).  A row may be a segment of a
    long line (centres [c_lo, c_hi), tokens from position ``base``, line
    length ``n``); positions are always line positions.
    """
    w, seed = spec.window, spec.seed
    own = _part_of(lines)
    lines = with_segment_cols(lines)

    def one(k):
        i = F.col("c_lo") + k
        n = F.col("n")
        b = F.floor(keyed_draw(seed, "win", epoch, F.col("line_no"), i) * w)
        lo = F.greatest(F.lit(0).cast("long"), i - w + b)
        hi = F.least(n - 1, i + w - b)
        return F.struct(i.alias("i"), F.element_at("idxs", (i - F.col("base") + 1).cast("int")).alias("word"),
                        lo.alias("lo"),
                        F.slice("idxs", (lo - F.col("base") + 1).cast("int"), (hi - lo + 1).cast("int")).alias("ctx"))

    p = lines.filter(F.col("c_hi") > F.col("c_lo")).select(
        *own, "line_no", "sent_no", "cat_no",
        F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("c_hi") - F.col("c_lo") - 1), one)).alias("p"))
    p = p.select(*own, "line_no", "sent_no", "cat_no", F.col("p.i").cast("long").alias("i"),
                 F.col("p.word").alias("word"), F.col("p.lo").cast("long").alias("lo"),
                 F.col("p.ctx").alias("ctx")).filter(F.col("word").isNotNull())
    if batch is not None and spec.batches > 1:
        p = p.filter(batch_of(spec) == batch)
    return p


def segment_lines(pieces: DataFrame, window: int, segment_len: int, compact: bool = True) -> DataFrame:
    """Pieces of long lines as segments, without gathering a whole line anywhere.

    pieces: (line_no, sent_id, cat_id, piece, _t array of (opos, idx) in order).
    Compacted positions (``compact``; else the original ones) are the place in
    the piece plus the tokens of the pieces before, summed over one row per
    piece.  A token goes to its segment and, when it lies within ``window`` of a
    boundary, to the neighbouring segment as margin; a segment row then holds at
    most ``segment_len + 2 * window`` tokens, whatever the line length."""
    S, w = int(segment_len), int(window)
    p = pieces
    if compact:
        before = Window.partitionBy("line_no").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
        start = pieces.select("line_no", "piece", F.size("_t").cast("long").alias("_c")).withColumn(
            "_st", F.coalesce(F.sum("_c").over(before), F.lit(0).cast("long"))).drop("_c")
        p = pieces.join(start, ["line_no", "piece"])
        t = p.select("line_no", "sent_id", "cat_id", "_st", F.posexplode("_t").alias("_k", "_x")).select(
            "line_no", "sent_id", "cat_id", "_x.idx", (F.col("_st") + F.col("_k")).alias("pos"))
    else:
        t = p.select("line_no", "sent_id", "cat_id", F.explode("_t").alias("_x")).select(
            "line_no", "sent_id", "cat_id", "_x.idx", F.col("_x.opos").cast("long").alias("pos"))
    seg = F.floor(F.col("pos") / S)
    t = t.withColumn("_seg", seg)
    near_lo = F.col("pos") - F.col("_seg") * S < w
    near_hi = (F.col("_seg") + 1) * S - 1 - F.col("pos") < w
    t = t.withColumn("_to", F.explode(F.array(F.col("_seg"), F.when(near_lo, F.col("_seg") - 1),
                                              F.when(near_hi, F.col("_seg") + 1))))
    t = t.filter(F.col("_to").isNotNull() & (F.col("_to") >= 0))
    lens = t.filter(F.col("_to") == F.col("_seg")).groupBy("line_no").agg((F.max("pos") + 1).alias("n"))
    g = (t.groupBy("line_no", "sent_id", "cat_id", F.col("_to").alias("seg"))
         .agg(F.array_sort(F.collect_list(F.struct("pos", "idx"))).alias("_t")))
    g = g.join(lens, "line_no").filter(F.col("seg") * S < F.col("n"))
    return g.select("line_no", "sent_id", "cat_id",
                    F.transform("_t", lambda x: x["idx"]).alias("idxs"),
                    F.col("_t")[0]["pos"].alias("base"), (F.col("seg") * S).alias("c_lo"),
                    F.least(F.col("n"), (F.col("seg") + 1) * S).alias("c_hi"), "n")


def batch_of(spec: TrainSpec) -> Column:
    return F.pmod(F.col("line_no") + F.floor(F.col("i") / F.lit(spec.slice_len)),
                  F.lit(spec.batches))


def examples(pos: DataFrame, spec: TrainSpec) -> tuple[DataFrame, DataFrame]:
    """(inputs, targets) keyed by (line_no, i, j).

    inputs : line_no, i, j, in_kind, in_id, in_w   (l1 = sum in_w * vec)
    targets: line_no, i, j, target                  (word id to predict)

    With a ``part`` in ``pos`` both have it, and targets of DBoW their line's sent_no and cat_no.
    """
    own = _part_of(pos)
    if spec.arch == "sg":
        # j = absolute position of the context token
        ctx = (pos.select(*own, "line_no", "sent_no", "cat_no", "i", "word", "lo",
                          F.posexplode("ctx").alias("k", "cword"))
               .filter(F.col("cword").isNotNull())
               .withColumn("j", F.col("lo") + F.col("k")).drop("k", "lo"))
        key = [*own, "line_no", "i", "j"]
        if spec.family == "word":
            pairs = ctx.filter(F.col("j") != F.col("i"))
            ins = pairs.select(*key, F.lit("syn0").alias("in_kind"),
                               F.col("cword").alias("in_id"), F.lit(1.0).alias("in_w"))
            tg = pairs.select(*key, F.col("word").alias("target"))
            return ins, tg
        # DBoW: every window position j (centre included) is a target of sent (+cat)
        tg = ctx.select(*key, F.col("cword").alias("target"), *(["sent_no", "cat_no"] if own else []))
        ins = ctx.select(*key, F.lit("sent").alias("in_kind"),
                         F.col("sent_no").alias("in_id"), F.lit(1.0).alias("in_w"))
        if spec.family == "cat":
            ins = ins.unionByName(ctx.select(*key, F.lit("cat").alias("in_kind"),
                                             F.col("cat_no").alias("in_id"), F.lit(1.0).alias("in_w")))
        return ins, tg
    # CBOW / DM: context words (centre excluded) [+ sent (+ cat)] predict the centre
    extra = {"word": 0, "sent": 1, "cat": 2}[spec.family]
    nctx = F.size(F.filter("ctx", lambda x: x.isNotNull())) - 1
    if spec.cbow_mean:
        wexpr = F.when(nctx + extra > 0, 1.0 / (nctx + extra)).otherwise(F.lit(1.0))
    else:
        wexpr = F.lit(1.0)

    def read(kind, id_col):
        return F.struct(F.lit(kind).alias("in_kind"), id_col.cast("long").alias("in_id"))

    around = F.filter(F.transform("ctx", lambda x, k: read("syn0", F.when(F.col("lo") + k != F.col("i"), x))),
                      lambda r: r["in_id"].isNotNull())
    known = [read(kind, F.col(c)) for kind, c in (("sent", "sent_no"), ("cat", "cat_no"))[:extra]]
    read_all = F.concat(around, F.array(*known)) if known else around
    j = F.lit(-1).cast("long").alias("j")
    ins = pos.select(*own, "line_no", "i", j, wexpr.cast("double").alias("in_w"), F.inline(read_all)).select(
        *own, "line_no", "i", "j", "in_kind", "in_id", "in_w")
    return ins, pos.select(*own, "line_no", "i", j, F.col("word").alias("target"))


def noise_buckets(vocab: DataFrame, buckets: int = NOISE_BUCKETS) -> DataFrame:
    """Each noise interval repeated for every u-bucket it overlaps, so the
    draw -> word lookup is an equi-join on the bucket plus a range filter
    (no nested-loop range join)."""
    return vocab.select(*_part_of(vocab), "idx", "noise_lo", "noise_hi").withColumn(
        "nb", F.explode(F.sequence(F.floor(F.col("noise_lo") * buckets).cast("long"),
                                   F.least(F.floor(F.col("noise_hi") * buckets),
                                           F.lit(buckets - 1)).cast("long"))))


def _near(df: DataFrame) -> DataFrame:
    """Rows of a part that the part's other rows look up: a hash table of each part, no sort."""
    return df.hint("shuffle_hash") if _part_of(df) else df


def targets_out(tg: DataFrame, vocab: DataFrame, spec: TrainSpec, epoch: int = 0,
                per: list[str] | None = None) -> DataFrame:
    """Output rows: line_no, i, j, out_kind, out_id, label.

    With a ``part`` in ``tg`` also in ``vocab``: the words that the part's examples need.  ``per``: columns of ``tg``
    that outputs are counted by, instead of one row per example: these columns, out_kind, out_id, label, n."""
    own = _part_of(tg)
    keep = own + (per or ["line_no", "i", "j"])

    def counted(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n")) if per else rows

    n = ["n"] if per else []
    one = counted(tg.select(*keep, "target"))
    parts = []
    if spec.hs:
        hv = vocab.filter("code is not null") if own else vocab
        h = (one.join(_near(hv.select(*own, F.col("idx").alias("target"), "code", "point")), [*own, "target"])
             .select(*keep, *n, F.explode(F.arrays_zip("point", "code")).alias("pc")))
        h = h.select(*keep, *n, F.lit("syn1").alias("out_kind"), F.col("pc.point").cast("long").alias("out_id"),
                     (F.lit(1.0) - F.col("pc.code")).alias("label"))
        if per:
            h = h.groupBy(*keep, "out_kind", "out_id", "label").agg(F.sum("n").alias("n"))
        parts.append(h)
    if spec.negative:
        parts.append(one.select(*keep, *n, F.lit("syn1neg").alias("out_kind"),
                                F.col("target").alias("out_id"), F.lit(1.0).alias("label")))
        draws = tg.withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(spec.negative))))
        # neither column can be null (2 and -1 hit no interval): else the join leaves nulls out by a filter that computes
        # the draw again for each, term by term
        u = keyed_draw(spec.seed, "neg", epoch, F.col("line_no"), F.col("i"), F.col("j"), F.col("d"))
        draws = draws.withColumn("u", F.coalesce(u, F.lit(2.0)))
        draws = draws.withColumn("nb", F.coalesce(F.floor(F.col("u") * NOISE_BUCKETS).cast("long"), F.lit(-1)))
        nz = noise_buckets(vocab.filter("noise_lo is not null") if own else vocab)
        hit = (draws.join(_near(nz), [*own, "nb"])
               .filter((F.col("u") >= F.col("noise_lo")) & (F.col("u") < F.col("noise_hi")))
               .filter(F.col("idx") != F.col("target")))
        hit = counted(hit.select(*keep, F.col("idx").alias("out_id")))
        parts.append(hit.select(*keep, *n, F.lit("syn1neg").alias("out_kind"), "out_id", F.lit(0.0).alias("label")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*keep, "out_kind", "out_id", "label", *n)


# --------------------------------------------------------------------------
# one step


def _dot(a: str, b: str, d: int) -> Column:
    return sum((F.col(a)[k] * F.col(b)[k] for k in range(1, d)), F.col(a)[0] * F.col(b)[0])


def _score(rows: DataFrame, d: int) -> DataFrame:
    rows = rows.withColumn("dt", _dot("l1", "ovec", d)).filter(F.abs("dt") < MAX_EXP)
    return rows.withColumn("g", F.col("label") - F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("dt"))))


def _added(rows: DataFrame, keys: list[str], vec: str, d: int, out: str, weight: str | None = None,
           how: str = "sum") -> DataFrame:
    """Sums (or means) of ``weight * vec`` per key, number by number: a hash aggregate without objects."""
    add = F.sum if how == "sum" else F.avg
    x = [F.col(vec)[k] if weight is None else F.col(weight) * F.col(vec)[k] for k in range(d)]
    g = rows.groupBy(*keys).agg(*[add(c).alias(f"_x{k}") for k, c in enumerate(x)])
    return g.select(*keys, F.array(*[F.col(f"_x{k}") for k in range(d)]).alias(out))


def _out_vectors(params: DataFrame) -> DataFrame:
    return _near(params.select(*_part_of(params), F.col("kind").alias("out_kind"), F.col("id").alias("out_id"),
                               F.col("vec").alias("ovec")))


def _gradients_counted(params: DataFrame, outs: DataFrame, spec: TrainSpec) -> DataFrame:
    """DBoW with summed gradients: an example's input is its line's document (+ category) vector, so equal outputs of
    a document are one row with a count, and all gradients are sums of the scored rows."""
    own, d = _part_of(params), spec.size

    def given(kind, id_col, vec):
        return _near(params.filter(F.col("kind") == kind).select(*own, F.col("id").alias(id_col),
                                                                 F.col("vec").alias(vec)))

    rows = outs.join(given("sent", "sent_no", "l1"), [*own, "sent_no"])
    if spec.family == "cat":
        rows = rows.join(given("cat", "cat_no", "cv"), [*own, "cat_no"], "left")
        rows = rows.withColumn("l1", F.when(F.col("cv").isNull(), F.col("l1")).otherwise(
            F.array(*[F.col("l1")[k] + F.col("cv")[k] for k in range(d)])))
    rows = _score(rows.join(_out_vectors(params), [*own, "out_kind", "out_id"]), d)

    def touched(kind, id_col, vec):
        return F.struct(kind.alias("kind"), F.col(id_col).alias("id"), F.col(vec).alias("v"))

    to = [touched(F.lit("sent"), "sent_no", "ovec")]
    if spec.family == "cat" and spec.cat_learn:
        to.append(touched(F.lit("cat"), "cat_no", "ovec"))
    if spec.word_learn:
        to.append(touched(F.col("out_kind"), "out_id", "l1"))
    grads = rows.select((F.col("g") * F.col("n")).alias("w"), F.inline(F.array(*to))).filter("id is not null")
    return _added(grads, ["kind", "id"], "v", d, "grad", "w")


def _counts_outputs(spec: TrainSpec) -> bool:
    return spec.arch == "sg" and spec.combine == "sum" and spec.family != "word"


def gradients(params: DataFrame, ins: DataFrame, outs: DataFrame, spec: TrainSpec,
              lines: DataFrame | None = None) -> DataFrame:
    """Summed gradients (kind, id, grad) of one mini-batch; g excludes alpha.

    With a ``part`` everywhere, ``params`` are the rows that each part reads.  ``outs`` may be counted by document and
    category (see :func:`targets_out`); ``lines`` isn't needed."""
    if "n" in outs.columns:
        return _gradients_counted(params, outs, spec)
    own, d = _part_of(params), spec.size
    key = [*own, "line_no", "i", "j"]
    pv = params.select(*own, F.col("kind").alias("in_kind"), F.col("id").alias("in_id"), "vec")
    l1 = _added(ins.join(_near(pv), [*own, "in_kind", "in_id"]), key, "vec", d, "l1", "in_w")
    rows = _score(outs.join(_near(l1), key).join(_out_vectors(params), [*own, "out_kind", "out_id"]), d)
    grads = []
    if spec.word_learn:
        grads.append(_added(rows, ["out_kind", "out_id"], "l1", d, "grad", "g", spec.combine)
                     .select(F.col("out_kind").alias("kind"), F.col("out_id").alias("id"), "grad"))
    e = _added(rows, key, "ovec", d, "e", "g")
    learn = ["sent"]
    if spec.word_learn:
        learn.append("syn0")
    if spec.cat_learn:
        learn.append("cat")
    gi = ins.filter(F.col("in_kind").isin(learn)).select(*key, "in_kind", "in_id").join(_near(e), key)
    grads.append(_added(gi, ["in_kind", "in_id"], "e", d, "grad", how=spec.combine)
                 .select(F.col("in_kind").alias("kind"), F.col("in_id").alias("id"), "grad"))
    out = grads[0]
    for g in grads[1:]:
        out = out.unionByName(g)
    return out


def batch_loss(params: DataFrame, ins: DataFrame, outs: DataFrame) -> DataFrame:
    """Mean negative log-likelihood of the example targets (one row)."""
    key = ["line_no", "i", "j"]
    pv = params.select("kind", "id", "vec")
    l1p = (ins.join(pv.withColumnRenamed("kind", "in_kind").withColumnRenamed("id", "in_id"),
                    ["in_kind", "in_id"])
           .withColumn("wv", F.transform("vec", lambda x: x * F.col("in_w"))))
    l1 = sum_vectors(l1p, key, "wv", out="l1")
    rows = (outs.join(l1, key)
            .join(pv.withColumnRenamed("kind", "out_kind").withColumnRenamed("id", "out_id")
                  .withColumnRenamed("vec", "ovec"), ["out_kind", "out_id"]))
    z = dot("l1", "ovec") * (F.lit(2.0) * F.col("label") - F.lit(1.0))
    return rows.agg(F.avg(F.log1p(F.exp(-z))).alias("loss"))


def apply_update(params: DataFrame, grads: DataFrame, spec: TrainSpec, alpha: float) -> DataFrame:
    """Run the optimizer once on every touched row; untouched rows pass."""
    return updated_rows(params.join(grads, ["kind", "id"], "left"), spec, alpha)


def updated_rows(rows: DataFrame, spec: TrainSpec, alpha: float) -> DataFrame:
    """The optimizer's step on rows with ``grad`` (kind, id, vec, state, grad); null passes a row."""
    d, j = spec.size, rows
    G = F.col("grad")
    v, s = F.col("vec"), F.col("state")
    a = F.lit(float(alpha))
    if spec.optimizer == "sgd":
        nv, ns = F.zip_with(v, G, lambda x, g: x + a * g), s
    elif spec.optimizer == "adagrad":
        s2 = F.zip_with(s, G, lambda x, g: x + g * g)
        nv = F.transform(v, lambda x, k: x + a * G[k] / F.sqrt(F.lit(ADAGRAD_EPS) + s2[k]))
        ns = s2
    elif spec.optimizer == "adadelta":
        rho, eps = F.lit(ADADELTA_RHO), F.lit(ADADELTA_EPS)
        sg = F.transform(F.sequence(F.lit(0), F.lit(d - 1)),
                         lambda k: rho * s[k] + (F.lit(1.0) - rho) * G[k] * G[k])
        dl = F.transform(F.sequence(F.lit(0), F.lit(d - 1)),
                         lambda k: F.sqrt(eps + s[k + d]) / F.sqrt(eps + sg[k]) * G[k])
        sq = F.transform(F.sequence(F.lit(0), F.lit(d - 1)),
                         lambda k: rho * s[k + d] + (F.lit(1.0) - rho) * dl[k] * dl[k])
        nv = F.zip_with(v, dl, lambda x, y: x + y)
        ns = F.concat(sg, sq)
    else:
        b1t, p1, p2 = s[2 * d], s[2 * d + 1], s[2 * d + 2]
        m = F.transform(F.sequence(F.lit(0), F.lit(d - 1)),
                        lambda k: b1t * s[k] + (F.lit(1.0) - b1t) * G[k])
        vv = F.transform(F.sequence(F.lit(0), F.lit(d - 1)),
                         lambda k: F.lit(ADAM_B2) * s[k + d] + F.lit(1.0 - ADAM_B2) * G[k] * G[k])
        bc1 = F.lit(1.0) / (F.lit(1.0) - p1)
        bc2 = F.lit(1.0) / (F.lit(1.0) - p2)
        nv = F.transform(v, lambda x, k: x + F.lit(ADAM_A) * m[k] * bc1
                         / F.sqrt(F.lit(ADAGRAD_EPS) + vv[k] * bc2))
        ns = F.concat(m, vv, F.array(b1t * F.lit(ADAM_L), p1 * F.lit(ADAM_B1), p2 * F.lit(ADAM_B2)))
    touched = G.isNotNull()
    return j.select("kind", "id", F.when(touched, nv).otherwise(v).alias("vec"),
                    F.when(touched, ns).otherwise(s).alias("state"))


def batch_sizes(lines: DataFrame, spec: TrainSpec) -> DataFrame:
    """(batch, n): centre positions per mini-batch, counted slice by slice (batch ids
    only, no windows or draws)."""
    lines, B = with_segment_cols(lines), F.lit(spec.slice_len)

    def count(k):
        first = F.greatest(F.col("c_lo"), k * B)
        size = F.least(F.col("c_hi"), (k + 1) * B) - first
        own = F.slice("idxs", (first - F.col("base") + 1).cast("int"), size.cast("int"))
        return F.struct(F.pmod(F.col("line_no") + k, F.lit(spec.batches)).alias("batch"),
                        F.size(F.filter(own, lambda x: x.isNotNull())).alias("n"))

    slices = F.sequence(F.floor(F.col("c_lo") / B), F.floor((F.col("c_hi") - 1) / B))
    return (lines.filter(F.col("c_hi") > F.col("c_lo")).select(F.inline(F.transform(slices, count)))
            .groupBy("batch").agg(F.sum("n").alias("n")))


def batch_alphas(lines: DataFrame, spec: TrainSpec, total_words: float) -> list[float]:
    """Learning rate per batch: linear decay by words done before it (SGD);
    constant for the adaptive optimizers.  Restarts every epoch."""
    if spec.optimizer != "sgd":
        return [spec.alpha] * spec.batches
    if spec.batches == 1:
        return [spec.alpha]
    counts = {int(r["batch"]): r["n"] for r in batch_sizes(lines, spec).collect()}
    out, done = [], 0
    for b in range(spec.batches):
        out.append(max(spec.min_alpha, spec.alpha * (1 - done / total_words)))
        done += counts.get(b, 0)
    return out


def train_epoch(params: DataFrame, lines: DataFrame, vocab: DataFrame, spec: TrainSpec,
                epoch: int = 0, total_words: float | None = None) -> DataFrame:
    """K synchronous mini-batch steps over one epoch.

    Lines are dealt into parts of about PART_TOKENS tokens.  Only the parameter rows, paths and noise intervals that a
    part reads travel, to it, and its partial sums back; examples are joined with them where they are made."""
    from . import train_vec as X
    from .param_store import ParamStore, with_conf, written
    if total_words is None:
        total_words = float(vocab.agg(F.sum(F.col("cnt") * F.col("sample_prob"))).first()[0])
    spark = lines.sparkSession
    lines = with_segment_cols(lines)
    alphas = batch_alphas(lines, spec, total_words)
    store = ParamStore(params)
    tokens = lines.agg(F.sum(F.col("c_hi") - F.col("c_lo"))).first()[0] or 0
    lines, partitions = X.spread_lines(lines, spec, max(spark.sparkContext.defaultParallelism, -(-tokens // PART_TOKENS)))
    keys, side = X.group_keys(lines, vocab, spec, [epoch], store)
    per = ["sent_no", "cat_no"] if _counts_outputs(spec) else None
    for b in range(spec.batches):
        read = written(X.fetched(store, keys, side, b).withColumnRenamed("group", "part").repartition(partitions, "part"))
        words = read.filter(F.col("kind").isin("path", "noise")).select(
            "part", F.col("id").alias("idx"), "point", "code", F.col("lo").alias("noise_lo"), F.col("hi").alias("noise_hi"))
        pos = written(positions(lines, spec, epoch, batch=b))  # each example starts from it a few times
        ins, tg = examples(pos, spec)
        outs = targets_out(tg, words, spec, epoch, per)
        grads = gradients(read.filter("vec is not null").select("part", "kind", "id", "vec"), ins, outs, spec)
        # both sides of its joins are partitioned by the part, one of their keys: no rows move
        with with_conf(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false"):
            grads = grads.checkpoint(eager=True)
        store.append(updated_rows(store.read(store.place(grads), state=True), spec, alphas[b]))
    return store.latest()


def normalize_params(params: DataFrame,
                     kinds=("syn0", "syn1", "syn1neg", "sent", "cat")) -> DataFrame:
    """L2-normalise every row of the given matrices (zero rows stay zero)."""
    from ..functions.vectors import unit
    return params.withColumn("vec", F.when(F.col("kind").isin(list(kinds)), unit("vec"))
                             .otherwise(F.col("vec")))


def batch_alpha_frame(lines: DataFrame, vocab: DataFrame, spec: TrainSpec,
                      epoch: int = 0) -> DataFrame:
    """(batch, alpha) as a DataFrame: K rows, decayed by words of earlier batches."""
    spark = lines.sparkSession
    bs = spark.range(spec.batches).select(F.col("id").alias("batch"))
    if spec.optimizer != "sgd" or spec.batches == 1:
        return bs.withColumn("alpha", F.lit(float(spec.alpha)))
    cnt = batch_sizes(lines, spec)
    tw = vocab.agg(F.sum(F.col("cnt") * F.col("sample_prob"))).scalar()
    w = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)  # K rows only
    done = (bs.join(cnt, "batch", "left").fillna(0, ["n"])
            .withColumn("done", F.coalesce(F.sum("n").over(w), F.lit(0))))
    return done.select("batch", F.greatest(F.lit(float(spec.min_alpha)),
                                           F.lit(float(spec.alpha)) * (F.lit(1.0) - F.col("done") / tw))
                       .alias("alpha"))


def train(corpus: DataFrame, spec: TrainSpec, vocab: DataFrame | None = None):
    """Build vocabulary and ids, then ``spec.epochs`` epochs.  Returns
    (params, vocab, docs, cats); every epoch ends with a checkpoint."""
    from . import vocab as V
    from .train_vec import train_epoch_vec
    spec.validate()
    if vocab is None:
        vocab = V.build_vocab(corpus, spec.min_count, spec.sample, hs=spec.hs,
                              negative=spec.negative)
    vocab = vocab.checkpoint(eager=True)
    docs = V.doc_ids(corpus) if spec.family != "word" else None
    cats = V.cat_ids(corpus) if spec.family == "cat" else None
    params = init_params(spec, vocab, docs, cats)
    for ep in range(spec.epochs):
        lines = prepare_lines(corpus, vocab, spec, ep, docs, cats, segment_len=SEGMENT_LEN).checkpoint(eager=True)
        params = train_epoch_vec(params, lines, vocab, spec, ep)
        if spec.normalize_each_epoch:
            params = normalize_params(params)
        params = params.checkpoint(eager=True)
    return params, vocab, docs, cats


def with_spec(spec: TrainSpec, **kw) -> TrainSpec:
    return replace(spec, **kw)
