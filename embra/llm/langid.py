"""Language identification: sparse multinomial logistic regression on TF-IDF
character n-grams.

Features are hashed n-grams of the lower-cased text (runs of characters that
are not letters count as one blank).  Document frequencies cover every training
document.  The weights are fitted with follow-the-regularised-leader and
elastic-net penalties on a bounded sample of labelled documents (``max_rows``,
shared evenly among the languages, chosen by a hash of the key); a temperature
is then fitted on sample documents that the weights haven't seen.  Prediction
covers every document and its whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import null_key, stage

NGRAMS = (1, 2, 3)
DIM_BITS = 15             # hashed features: 2^DIM_BITS
MAX_ROWS = 6000           # labelled documents the weights are fitted on, at most about this many
CALIBRATION = 5           # one in so many of them fits the temperature instead
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
PIECE = 1 << 18           # characters hashed at once
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_MUL = np.uint32(0x9E3779B1)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m.group().isalpha() for m in _LETTER.finditer(text))


def ngram_counts(text: str, bits: int = DIM_BITS) -> tuple[np.ndarray, np.ndarray]:
    """-> feature numbers (ascending) and counts of the hashed n-grams of a whole text."""
    clean = f" {_NOT_LETTERS.sub(' ', text.lower()).strip()} "
    code = np.frombuffer(clean.encode("utf-32-le"), "<u4")
    total = np.zeros(1 << bits, np.int64)
    longest = max(NGRAMS)
    for k in range(0, len(code), PIECE):
        part = code[k:k + PIECE + longest - 1]  # n-grams that begin in this piece
        h = np.zeros(len(part), np.uint32)
        for n in range(1, longest + 1):
            m = len(part) - n + 1
            if m <= 0:
                break
            h = (h[:m] + part[n - 1:]) * _MUL
            if n in NGRAMS:
                x = h[:PIECE] ^ (h[:PIECE] >> np.uint32(15))
                total += np.bincount((x * _MUL) >> np.uint32(32 - bits), minlength=1 << bits)
    at = np.flatnonzero(total)
    return at, total[at]


def features(text: str, idf: np.ndarray, bits: int = DIM_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Unit TF-IDF vector of a text (logarithmic counts): feature numbers and values."""
    at, n = ngram_counts(text, bits)
    v = (1 + np.log(n)) * idf[at]
    norm = np.sqrt(v @ v)
    return at, v / norm if norm > 0 else v


def document_frequencies(docs: DataFrame, bits: int = DIM_BITS) -> tuple[np.ndarray, int]:
    """``docs (text)`` -> number of documents with each feature, and of documents.  Each
    task counts its documents; the counts are added by feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << bits, np.int64), 0
        for b in batches:
            for t in b.column(0):
                t = t.as_py()
                if has_letter(t):
                    df[ngram_counts(t, bits)[0]] += 1
                    n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))],
                                         names=["f", "n"])

    out = np.zeros((1 << bits) + 1, np.int64)  # at most 2^bits + 1 rows reach the driver
    for r in docs.select("text").mapInArrow(run, "f long, n long").groupBy("f").agg(
            F.sum("n").alias("n")).collect():
        out[r["f"]] = r["n"]
    return out[:-1], int(out[-1])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(xs: list, ys: np.ndarray, dims: int, classes: int, epochs: int = EPOCHS, alpha: float = ALPHA,
             beta: float = BETA, l1: float = L1, l2: float = L2) -> np.ndarray:
    """Per-coordinate follow-the-regularised-leader -> weights (dims + 1, classes), the
    last row the intercepts (not penalised)."""
    z, n = np.zeros((dims + 1, classes)), np.zeros((dims + 1, classes))
    penalty = np.full(dims + 1, l1)
    penalty[-1] = 0.0

    def weights(at):
        zi, over = z[at], np.abs(z[at]) - penalty[at][:, None]
        return np.where(over > 0, -np.sign(zi) * over / ((beta + np.sqrt(n[at])) / alpha + l2), 0.0)

    rng = np.random.default_rng(42)
    for _ in range(epochs):
        for i in rng.permutation(len(xs)):
            at, v = xs[i]
            at, v = np.append(at, dims), np.append(v, 1.0)
            w = weights(at)
            g = softmax(v @ w)
            g[ys[i]] -= 1
            g = v[:, None] * g[None, :]
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    return weights(np.arange(dims + 1))


def fit_temperature(logits: np.ndarray, ys: np.ndarray) -> float:
    """Temperature with the least mean negative log likelihood, by golden section on its
    logarithm between 1/20 and 20."""
    if not len(ys):
        return 1.0

    def loss(t):
        p = softmax(logits / np.exp(t))
        return -np.log(np.maximum(p[np.arange(len(ys)), ys], 1e-300)).mean()

    a, b, r = -3.0, 3.0, (np.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


class LanguageModel:
    """Languages, idf, weights (sparse rows) and temperature; small and picklable:
    2^bits idf values and the non-zero weights."""

    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float, bits: int):
        self.languages, self.idf, self.temperature, self.bits = languages, idf, temperature, bits
        self.rows = np.flatnonzero(weights.any(axis=1))
        self.values, self.shape = weights[self.rows], weights.shape
        self._full = None

    def __getstate__(self):
        return self.__dict__ | {"_full": None}

    def scores(self, text: str | None) -> np.ndarray | None:
        """Calibrated probabilities; None for texts without a letter."""
        if not self.languages or not has_letter(text):
            return None
        if self._full is None:
            self._full = np.zeros(self.shape)
            self._full[self.rows] = self.values
        at, v = features(text, self.idf, self.bits)
        return softmax((v @ self._full[at] + self._full[-1]) / self.temperature)


def sample_rows(docs: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """``docs (key, text, lang)`` -> about ``max_rows / languages`` rows of each language (all
    where there are fewer), by a hash of the key; the same rows on every run."""
    counts = docs.groupBy("lang").count()
    n = max(1, counts.count())
    rate = counts.select("lang", (F.lit(max_rows / n) / F.col("count")).alias("rate"))
    u = F.pmod(F.xxhash64(F.lit("langid"), null_key(F.col("key"))), F.lit(1 << 30)) / F.lit(1 << 30)
    return docs.withColumn("u", u).join(F.broadcast(rate), "lang").filter("u < rate") \
        .select("key", "text", "lang", "u")


def train(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang",
          max_rows: int = MAX_ROWS, bits: int = DIM_BITS) -> LanguageModel:
    """Fit a model on the rows whose language is known.

    Rows with a null language or a text without letters teach nothing; with one
    language, or none, the model always answers it, or ``und``.
    """
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"),
                       F.col(f"`{lang}`").cast("string").alias("lang")).filter("lang is not null and text is not null")
    df, n = document_frequencies(rows, bits)
    idf = np.log((1 + n) / (1 + df)) + 1
    shared = docs.sparkSession.sparkContext.broadcast(idf)  # 2^bits numbers

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, y, u in zip(b.column(0), b.column(1), b.column(2)):
                if has_letter(t.as_py()):
                    at, v = features(t.as_py(), shared.value, bits)
                    out.append({"lang": y.as_py(), "u": u.as_py(), "at": at.astype("<i4").tobytes(),
                                "v": v.astype("<f4").tobytes()})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(
                [("lang", pa.string()), ("u", pa.float64()), ("at", pa.binary()), ("v", pa.binary())]))

    sample = stage(sample_rows(rows, max_rows).select("text", "lang", "u").mapInArrow(
        vectors, "lang string, u double, at binary, v binary"), "langid-sample")

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        # one task: a bounded sample, put in an order of its own
        g = g.sort_values(["u", "lang", "at"], kind="stable").reset_index(drop=True)
        languages = sorted(set(g["lang"]))
        ys = g["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy()
        xs = [(np.frombuffer(a, "<i4"), np.frombuffer(v, "<f4").astype(np.float64)) for a, v in zip(g["at"], g["v"])]
        held = np.arange(len(xs)) % CALIBRATION == CALIBRATION - 1
        w = fit_ftrl([x for x, h in zip(xs, held) if not h], ys[~held], 1 << bits, len(languages))
        logits = np.array([v @ w[a] + w[-1] for (a, v), h in zip(xs, held) if h]).reshape(-1, len(languages))
        t = fit_temperature(logits, ys[held])
        rows = np.flatnonzero(w.any(axis=1))
        return pd.DataFrame({"languages": [languages], "temperature": [t],
                             "rows": [rows.astype("<i8").tobytes()], "weights": [w[rows].astype("<f8").tobytes()]})

    fitted = sample.groupBy(F.lit(1).alias("one")).applyInPandas(
        fit, "languages array<string>, temperature double, rows binary, weights binary").collect()
    if not fitted:
        return LanguageModel([], idf, np.zeros(((1 << bits) + 1, 0)), 1.0, bits)
    m = fitted[0]
    w = np.zeros(((1 << bits) + 1, len(m["languages"])))
    w[np.frombuffer(m["rows"], "<i8")] = np.frombuffer(m["weights"], "<f8").reshape(-1, len(m["languages"]))
    return LanguageModel(list(m["languages"]), idf, w, m["temperature"], bits)


def predict(docs: DataFrame, model: LanguageModel, *, text: str = "text",
            keep: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` as ``row`` (struct of all its columns, or of ``keep``) with ``lang_pred`` and its
    calibrated probability ``score``; ``und`` with score 0 where the text is null or has
    no letter.  Rows depend on nothing but their text; an empty table stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    cols = keep or docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"),
                       *([] if text in cols else [F.col(f"`{text}`").alias("text")]))
    schema = rows.select("row").schema.add("lang_pred", "string").add("score", "double")
    at = cols.index(text) if text in cols else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            names, scores = [], []
            for t in b.column(1) if at is None else pc.struct_field(b.column(0), at):
                p = m.scores(t.as_py())
                best = None if p is None else int(np.argmax(p))
                names.append(UNKNOWN if p is None else m.languages[best])
                scores.append(0.0 if p is None else min(1.0, float(p[best])))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=["row", "lang_pred", "score"])

    return rows.mapInArrow(run, schema)


def fold(key: Column) -> Column:
    """crc32 of the key as text, modulo 5; null keys count as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 5
