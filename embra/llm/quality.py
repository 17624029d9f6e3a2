"""Quality rules as a short-circuit cascade.

A rule is a predicate over measures of a text; a measure may build on others
(words on the split text, repeats on words).  On a sample, one task times every
measure and every rule is judged on every text.  The driver then orders the
rules greedily: next comes the rule that rejects most of the sampled texts still
standing per second of its measures not yet taken.  In the job, each batch
takes a rule's measures only of the texts that no earlier rule has rejected.

The order decides the cost and which rule is named as the first to reject, never
the verdict: a text is kept if every rule passes.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 2000       # texts on which costs and rejections are estimated
GROUP_BYTES = 1 << 20    # text measured together
SPLIT_BYTES = 1 << 22    # a text is split into words in pieces of about this size
WINDOW = 5

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLLOWS = (np.arange(256) & 0xC0) == 0x80          # UTF-8 continuation bytes
_IN_WORD = ~(_SPACE | _FOLLOWS)                     # first bytes of the characters of words
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
_NO_LETTERS = bytes(set(range(256)) - set(_LETTERS))


class WordIds(dict):
    """word -> number, in order of appearance"""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text in pieces that end between words."""
    at = 0
    while len(text) - at > SPLIT_BYTES:
        end = at + SPLIT_BYTES
        while end < len(text) and not _SPACE[text[end]]:
            end += 1
        yield text[at:end]
        at = end
    yield text[at:] if at else text


class Texts:
    """A group of texts and the measures taken of them, by name: one number a text."""

    def __init__(self, texts: list[bytes], taken: dict[str, np.ndarray] | None = None):
        self.texts, self.taken = texts, taken or {}
        self._words = self._lines = None

    def __len__(self) -> int:
        return len(self.texts)

    def subset(self, at: np.ndarray) -> Texts:
        out = Texts([self.texts[i] for i in at], {k: v[at] for k, v in self.taken.items()})
        if self._words is not None:
            ids, sizes, table = self._words
            inside = np.zeros(len(self), bool)
            inside[at] = True
            out._words = ids[np.repeat(inside, sizes)], sizes[at], table
        if self._lines is not None:
            out._lines = [self._lines[i] for i in at]
        return out

    def words(self) -> tuple[np.ndarray, np.ndarray, WordIds]:
        """Word numbers of all texts in a row, words per text, the numbering."""
        if self._words is None:
            table, parts, sizes = WordIds(), [], []
            for t in self.texts:
                n = 0
                for piece in _pieces(t):
                    w = piece.split()
                    parts.append(np.fromiter(map(table.__getitem__, w), np.int64, len(w)))
                    n += len(w)
                sizes.append(n)
            self._words = (np.concatenate(parts) if parts else np.zeros(0, np.int64)), np.array(sizes, np.int64), table
        return self._words

    def lines(self) -> list[list[bytes]]:
        """Lines with a word, by text."""
        if self._lines is None:
            self._lines = [[x for x in t.split(b"\n") if x.strip()] for t in self.texts]
        return self._lines

    def count_bytes(self, kind: np.ndarray) -> np.ndarray:
        return np.array([np.count_nonzero(kind[np.frombuffer(t, np.uint8)]) for t in self.texts], np.int64)

    def sum_words(self, values: np.ndarray) -> np.ndarray:
        """Per text, the sum over its words of a value of each."""
        sizes = self.words()[1]
        return np.bincount(np.repeat(np.arange(len(self)), sizes), values, len(self)).astype(np.int64)


def n_repeat_words(t: Texts) -> np.ndarray:
    """Words in windows of WINDOW words found twice or more in the text, first occurrences included."""
    ids, sizes, table = t.words()
    doc = np.repeat(np.arange(len(t)), sizes)
    end = np.repeat(np.cumsum(sizes), sizes)
    at = np.flatnonzero(np.arange(len(ids)) + WINDOW <= end)
    # windows with equal rank so far are equal so far; what is alone can't come twice
    rank = doc[at]
    for k in range(WINDOW):
        key = rank * len(table) + ids[at + k]
        _, rank, n = np.unique(key, return_inverse=True, return_counts=True)
        again = n[rank] > 1
        at, rank = at[again], rank[again]
    hit = np.zeros(len(ids) + 1, np.int64)
    np.add.at(hit, at, 1)
    np.add.at(hit, at + WINDOW, -1)
    return t.sum_words(np.cumsum(hit[:-1]) > 0)


def n_alpha_words(t: Texts) -> np.ndarray:
    ids, _, table = t.words()
    alpha = np.fromiter((bool(w.translate(None, _NO_LETTERS)) for w in table), bool, len(table))
    return t.sum_words(alpha[ids])


# what a measure needs first: the cost of words and lines is counted once
MEASURES: dict[str, tuple[tuple[str, ...], Callable[[Texts], np.ndarray]]] = {
    "words": ((), lambda t: t.words()[1]),
    "lines": ((), lambda t: np.array([len(x) for x in t.lines()], np.int64)),
    "n_words": (("words",), lambda t: t.words()[1]),
    "word_chars": ((), lambda t: t.count_bytes(_IN_WORD)),
    "n_symbols": ((), lambda t: t.count_bytes(_SYMBOL)),
    "n_lines": (("lines",), lambda t: np.array([len(x) for x in t.lines()], np.int64)),
    "n_dup_lines": (("lines",), lambda t: np.array([len(x) - len(set(x)) for x in t.lines()], np.int64)),
    "n_cut_lines": (("lines",), lambda t: np.array(
        [sum(y.rstrip().endswith((b"...", "…".encode())) for y in x) for x in t.lines()], np.int64)),
    "n_repeat_words": (("words",), n_repeat_words),
    "n_alpha_words": (("words",), n_alpha_words),
}


@dataclass(frozen=True)
class Rule:
    """``passes`` takes the measures as arrays, in the order of ``measures``."""

    name: str
    measures: tuple[str, ...]
    passes: Callable[..., np.ndarray]


RULES = (
    Rule("length", ("n_words",), lambda n: n >= 10),
    Rule("repeated_windows", ("n_repeat_words", "n_words"), lambda r, n: 100 * r <= 20 * n),
    Rule("word_length", ("word_chars", "n_words"), lambda c, n: (c >= 2 * n) & (c <= 15 * n)),
    Rule("symbols", ("n_symbols", "n_words"), lambda s, n: s <= n),
    Rule("repeated_lines", ("n_dup_lines", "n_lines"), lambda d, n: 2 * d <= n),
    Rule("cut_lines", ("n_cut_lines", "n_lines"), lambda c, n: 10 * c <= 3 * n),
    Rule("letters", ("n_alpha_words", "n_words"), lambda a, n: 2 * a >= n),
)


def _take(t: Texts, measure: str, clock: dict[str, float] | None = None) -> None:
    if measure in t.taken:
        return
    needs, run = MEASURES[measure]
    for m in needs:
        _take(t, m, clock)
    began = time.thread_time()
    t.taken[measure] = run(t)
    if clock is not None:
        clock[measure] = clock.get(measure, 0.0) + time.thread_time() - began


def _groups(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of whole texts of about GROUP_BYTES: (place of the first, texts)."""
    group, size, first = [], 0, 0
    for i, t in enumerate(texts.cast(pa.binary())):
        group.append(t.as_py() or b"")
        size += len(group[-1])
        if size >= GROUP_BYTES:
            yield first, group
            group, size, first = [], 0, i + 1
    if group:
        yield first, group


def closure(measures) -> list[str]:
    """Measures with all they need."""
    out: list[str] = []
    for m in measures:
        out += [x for x in closure(MEASURES[m][0]) if x not in out]
        if m not in out:
            out.append(m)
    return out


def order_rules(rules: tuple[Rule, ...], costs: dict[str, float], passed: np.ndarray,
                taken: tuple[str, ...] = ()) -> list[int]:
    """Greedy order of rules from ``costs`` (seconds by measure) and ``passed`` (sampled texts x rules): always the
    rule that rejects most standing texts per second of measures not taken yet; ties go to the cheaper, then to the
    given order."""
    have, left, order = set(closure(taken)), list(range(len(rules))), []
    standing = np.ones(len(passed), bool)
    while left:
        def gain(r: int) -> tuple[float, float, int]:
            cost = sum(costs.get(m, 0.0) for m in closure(rules[r].measures) if m not in have) + 1e-9
            return np.count_nonzero(standing & ~passed[:, r]) / cost, -cost, -r
        best = max(left, key=gain)
        left.remove(best)
        order.append(best)
        have |= set(closure(rules[best].measures))
        standing &= passed[:, best]
    return order


def sample_statistics(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, text: str = "text",
                      sample_rows: int = SAMPLE_ROWS, seed: int = 42) -> tuple[dict[str, float], np.ndarray]:
    """Seconds by measure and the verdict of every rule on about ``sample_rows`` texts, taken in one task."""
    total = docs.count()
    share = min(1.0, 4 * sample_rows / max(total, 1))
    some = docs.select(F.col(f"`{text}`").cast("string").alias("t")).sample(share, seed).limit(sample_rows).coalesce(1)

    def run(batches):
        clock: dict[str, float] = {}
        verdicts = []
        for b in batches:
            for _, group in _groups(b.column(0)):
                t = Texts(group)
                for r in rules:
                    for m in r.measures:
                        _take(t, m, clock)
                verdicts.append(np.stack([r.passes(*(t.taken[m] for m in r.measures)) for r in rules], axis=1))
        bits = np.concatenate(verdicts) if verdicts else np.ones((0, len(rules)), bool)
        yield pa.RecordBatch.from_pydict({"costs": [json.dumps(clock)], "passed": [bits.astype(np.uint8).tobytes()]})

    costs: dict[str, float] = {}
    passed = []
    for r in some.mapInArrow(run, "costs string, passed binary").collect():
        for m, s in json.loads(r["costs"]).items():
            costs[m] = costs.get(m, 0.0) + s
        passed.append(np.frombuffer(bytes(r["passed"]), np.uint8).reshape(-1, len(rules)) > 0)
    return costs, np.concatenate(passed) if passed else np.ones((0, len(rules)), bool)


def run_cascade(texts: list[bytes], rules: tuple[Rule, ...], order: list[int],
                report: tuple[str, ...] = ()) -> tuple[Texts, np.ndarray, np.ndarray]:
    """-> (texts with the reported measures, number of the rejecting rule or -1, rules judged) of a group."""
    whole = Texts(texts)
    for m in report:
        _take(whole, m)
    rejected = np.full(len(texts), -1)
    judged = np.zeros(len(texts), np.int64)
    at, t = np.arange(len(texts)), whole
    for r in order:
        if not len(at):
            break
        for m in rules[r].measures:
            _take(t, m)
        judged[at] += 1
        ok = rules[r].passes(*(t.taken[m] for m in rules[r].measures))
        if not ok.all():
            rejected[at[~ok]] = r
            at, t = at[ok], t.subset(np.flatnonzero(ok))
    return whole, rejected, judged


def quality_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, key: str = "doc_id", text: str = "text",
                    report: tuple[str, ...] = (), order: list[int] | None = None, **sampling) -> DataFrame:
    """-> ``key``, the measures of ``report`` (long, taken of every row), ``rejected_by`` (the first rule in the
    cascade's order that rejects the text, else null), ``n_judged`` (rules judged) and ``kept`` for every row.

    Defined cases: null and empty texts have no words, lines or symbols, so every measure is 0 and the rule on
    length rejects them; ratios are compared as products, so a text without words or lines never divides by zero;
    rows with null or repeated keys and repeated texts are judged one by one; an empty table gives an empty result.
    Other columns are not read.
    """
    if order is None:
        order = order_rules(rules, *sample_statistics(docs, rules, text=text, **sampling), taken=report)
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("t"))

    def run(batches):
        for b in batches:
            for first, group in _groups(b.column(1)):
                whole, rejected, judged = run_cascade(group, rules, order, report)
                names = pa.array([rules[r].name if r >= 0 else None for r in rejected], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, len(group)), *(pa.array(whole.taken[m], pa.int64()) for m in report),
                     names, pa.array(judged, pa.int64()), pa.array(rejected < 0)],
                    names=["key", *report, "rejected_by", "n_judged", "kept"])

    schema = rows.select("key").schema
    for m in report:
        schema = schema.add(m, "long")
    return rows.mapInArrow(run, schema.add("rejected_by", "string").add("n_judged", "long").add("kept", "boolean"))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, text: str = "text",
              order: list[int] | None = None, **sampling) -> DataFrame:
    """The rows of ``docs``, all columns, whose text every rule passes; defined cases as in :func:`quality_cascade`."""
    if order is None:
        order = order_rules(rules, *sample_statistics(docs, rules, text=text, **sampling))
    place = docs.columns.index(text)

    def run(batches):
        for b in batches:
            good = [run_cascade(group, rules, order)[1] < 0 for _, group in _groups(b.column(place))]
            yield b.filter(pa.array(np.concatenate(good) if good else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)
