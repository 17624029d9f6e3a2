"""Alignment of two tokenizers' tokens, and how often their ids meet across the corpus.

The byte ranges of the tokens of A and of B cut a text twice; where they overlap
two tokens are linked, and where both end a group ends.  Cuts before a space that
follows a solid character are ends of both, so a text is encoded and aligned in
chunks, which a worker remembers.

Counting is an external merge.  A map task turns every document into records
(id pair, document, links) and writes them, sorted, in runs of a fixed size; a
run is radix-partitioned by the A id into zstd pieces of small blocks, and one
shuffle brings the pieces of a radix together.  A k-way heap merge over the
blocks counts the documents of each pair with one block of each run open; the
counts merge again, a fixed number at a time, until one table a radix is left,
bounded by the vocabularies.  Its order has the A id in front, so the highest
count of an A id is known when its pairs have passed.  The same pieces are then
streamed against the table of their radix, and what each run's documents gain
is added up run by run.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch_uri, shuffle_partitions, stage
from .files import TempFiles, commit, open_fs
from .tokens import byte_alphabet

RADIX = 32                # radix partitions of the A ids
RUN_RECORDS = 1 << 21     # records sorted together
RUN_DOCS = 1 << 16        # documents of a run
BLOCK = 1 << 14           # pairs of a block
MERGE_BYTES = 32 << 20    # compressed pieces merged at once
FAN_IN = 16               # and at least so many, so that rounds end
GROUP_CHARS = 4 << 20     # text encoded together
LINES = 1000              # chunks encoded in one call
CACHE_ENTRIES = 400_000   # chunks a worker remembers
CACHE_CHARS = 32 << 20    # and their characters
DOC_BITS = 17             # of a document's place in its run, in sort keys

PLAIN = re.compile(r" [\S\x1c-\x1f]+")  # one space, then solid characters only


# --------------------------------------------------------------------------
# encoding and aligning


def chunk_starts(b: np.ndarray) -> np.ndarray:
    """Places in UTF-8 bytes where both tokenizers always begin a token: spaces after a character that is surely solid
    (printable ASCII or one of two bytes that isn't a space)."""
    if len(b) < 2:
        return np.zeros(0, np.int64)
    solid = (b > 0x20) & (b < 0x7F)
    solid[1:] |= (b[:-1] >= 0xC3) & (b[:-1] < 0xE0) & (b[1:] >= 0x80)
    return np.flatnonzero(solid[:-1] & (b[1:] == 0x20)) + 1


class Aligner:
    """Encodes and aligns chunks; remembers them in numbered slots."""

    def __init__(self, a_json: str, b_model: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        alphabet = byte_alphabet()
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            if all(c in alphabet for c in token):
                self.a_bytes[i] = bytes(alphabet[c] for c in token)
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i)
                                else piece.replace("▁", " ").encode())
        self.a_len = np.array([len(x) for x in self.a_bytes])
        self.b_len = np.array([len(x) for x in self.b_bytes])
        # an id with what follows it: inside a group, at the end of its side
        self.a_text, self.b_text = (np.array([[f"{i},", f"{i}{end}"] for i in range(n)], object)
                                    for n, end in ((len(self.a_bytes), "|"), (len(self.b_bytes), ";")))
        self.newline = self.a.encode("\n", add_special_tokens=False).ids
        self.space = self.b.piece_to_id("▁")
        self.rows = -(-len(self.a_bytes) // RADIX)  # A ids of a radix
        self.reset()

    @property
    def width(self) -> int:
        """Codes of one A id."""
        return len(self.b_bytes)

    def code(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Pairs as numbers ordered by radix, A id and B id."""
        return ((a % RADIX) * self.rows + a // RADIX) * self.width + b

    def reset(self) -> None:
        self.slots: dict[str, int] = {}
        self.chars = 0
        self.groups: list[str] = []
        self.good = np.zeros(0, bool)
        self.sizes = np.zeros((0, 3), np.int64)   # A ids, B ids, groups
        self.first = np.zeros(1, np.int64)        # links of a slot
        self.links = np.zeros(0, np.int64)

    def _encode_a(self, plain: list[str], rest: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks in a row and how many each has.  A line break between plain chunks is a token of its own,
        so they go in few calls."""
        ids, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in range(0, len(plain), LINES):
            some = plain[k:k + LINES]
            x = np.array(self.a.encode_batch_fast(["\n".join(some)], add_special_tokens=False)[0].ids, np.int64)
            inside = x != self.newline[0]
            ends = np.append(np.flatnonzero(~inside), len(x))
            if len(self.newline) != 1 or len(ends) != len(some):
                raise ValueError("the vocabulary doesn't keep line breaks apart")
            ids.append(x[inside])
            counts.append(np.diff(ends, prepend=-1) - 1)
        for e in self.a.encode_batch_fast(rest, add_special_tokens=False):
            ids.append(np.array(e.ids, np.int64))
            counts.append(np.array([len(ids[-1])], np.int64))
        return np.concatenate(ids), np.concatenate(counts)

    def _encode_b(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The model puts a space in front itself, but not before an empty text."""
        ids = self.b.encode([c[1:] for c in chunks], num_threads=1)
        ids = [x if x or c != " " else [self.space] for c, x in zip(chunks, ids)]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(itertools.chain.from_iterable(ids), np.int64, int(counts.sum())), counts

    def add(self, chunks: list[str]) -> None:
        """Align new chunks and give them slots."""
        if not chunks:
            return
        plain = [c for c in chunks if PLAIN.fullmatch(c)]
        known = set(plain)
        rest = [c for c in chunks if c not in known] if len(plain) < len(chunks) else []
        chunks = plain + rest
        (fa, na), (fb, nb) = self._encode_a(plain, rest), self._encode_b(chunks)
        texts = [c.encode() for c in chunks]
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        owner_a, owner_b = (np.repeat(np.arange(len(n)), n) for n in (na, nb))
        ok = np.ones(len(chunks), bool)
        for ids, owner, lens, table in ((fa, owner_a, self.a_len, self.a_bytes), (fb, owner_b, self.b_len, self.b_bytes)):
            ok &= np.bincount(owner, lens[ids], len(chunks)) == size
        for ids, owner, table in ((fa, owner_a, self.a_bytes), (fb, owner_b, self.b_bytes)):
            keep = ok[owner]
            kept = ids[keep].tolist()
            if b"".join(map(table.__getitem__, kept)) != b"".join(itertools.compress(texts, ok.tolist())):
                ends = np.cumsum(np.bincount(owner[keep], minlength=len(chunks))).tolist()
                at = 0
                for k, end in enumerate(ends):
                    if ok[k] and b"".join(map(table.__getitem__, kept[at:end])) != texts[k]:
                        ok[k] = False
                    at = end
        start = len(self.slots)
        self.slots.update(zip(chunks, range(start, start + len(chunks))))
        self.chars += int(size.sum())
        # ranges of the good chunks laid end to end
        fa, fb = fa[ok[owner_a]], fb[ok[owner_b]]
        ea, eb, ends = np.cumsum(self.a_len[fa]), np.cumsum(self.b_len[fb]), np.cumsum(size[ok])
        mark = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, np.int8)
        mark[ea] = 1
        mark[eb] += 2
        cuts, both = np.flatnonzero(mark), np.flatnonzero(mark == 3)
        # between two neighbouring cuts lie one A and one B token: the links
        links = self.code(fa[np.cumsum(mark[cuts] & 1) - (mark[cuts] & 1)], fb[np.cumsum(mark[cuts] >> 1) - (mark[cuts] >> 1)])
        n_links, n_groups = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        n_links[ok] = np.diff(np.searchsorted(cuts, ends, side="right"), prepend=0)
        n_groups[ok] = np.diff(np.searchsorted(both, ends, side="right"), prepend=0)
        # the ids as text, group by group, A before B
        ga, gb = np.searchsorted(both, ea), np.searchsorted(both, eb)
        last_a, last_b = (np.diff(g, append=len(both)) > 0 for g in (ga, gb))
        words = np.concatenate((self.a_text[fa, last_a.astype(int)], self.b_text[fb, last_b.astype(int)]))
        side = np.concatenate((2 * ga, 2 * gb + 1))
        words = words[np.argsort(side, kind="stable")].tolist()
        n_words = np.where(ok, na + nb, 0)
        at = 0
        for n in n_words.tolist():
            self.groups.append("".join(words[at:at + n])[:-1])
            at += n
        self.good = np.concatenate((self.good, ok))
        self.sizes = np.concatenate((self.sizes, np.stack((na, nb, n_groups), axis=1)))
        self.first = np.concatenate((self.first, self.first[-1] + np.cumsum(n_links)))
        self.links = np.concatenate((self.links, links))

    def _cut(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray]:
        """Texts with a space in front as numbers of distinct chunks in a row, the chunks, and how many each text has."""
        laid = pa.array([" " + t if t else "" for t in texts], pa.large_string())
        at = np.frombuffer(laid.buffers()[1], np.int64)[:len(texts) + 1]
        data = laid.buffers()[2] or pa.py_buffer(b"")
        raw = np.frombuffer(data, np.uint8)[:at[-1]]
        mark = np.zeros(len(raw) + 1, bool)
        mark[chunk_starts(raw)] = mark[at] = True
        cuts = np.flatnonzero(mark)
        pieces = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), data).dictionary_encode()
        return (pieces.indices.to_numpy().astype(np.int64), pieces.dictionary.to_numpy(zero_copy_only=False).tolist(),
                np.diff(np.searchsorted(cuts, at)))

    def align(self, texts: list[str | None]) -> tuple[dict[str, np.ndarray], list[str], tuple]:
        """-> numbers by document, group digests, and links as (document, code, how often), codes of a document not
        yet distinct."""
        index, chunks, per_doc = self._cut(texts)
        new = [c for c in chunks if c not in self.slots]
        if len(self.slots) + len(new) > CACHE_ENTRIES or self.chars > CACHE_CHARS:
            self.reset()
            new = chunks
        self.add(new)
        slot = np.fromiter(map(self.slots.__getitem__, chunks), np.int64, len(chunks))[index]
        doc = np.repeat(np.arange(len(texts)), per_doc)
        sound = np.bincount(doc, ~self.good[slot], len(texts)) == 0
        keep = sound[doc]
        doc, slot = doc[keep], slot[keep]
        n = {name: np.bincount(doc, self.sizes[slot, k], len(texts)).astype(np.int64)
             for k, name in enumerate(("n_a", "n_b", "n_groups"))}
        n["n_links"] = np.bincount(doc, np.diff(self.first)[slot], len(texts)).astype(np.int64)
        digests, at = [], 0
        names, groups = slot.tolist(), self.groups
        for k, fine in zip(per_doc.tolist(), sound.tolist()):
            if not (k and fine):
                digests.append("")
                continue
            digests.append(hashlib.sha256(";".join([groups[s] for s in names[at:at + k]]).encode()).hexdigest())
            at += k
        # each chunk once a document, with its number
        pair, often = np.unique(doc * len(self.groups) + slot, return_counts=True)
        doc, slot = np.divmod(pair, max(len(self.groups), 1))
        size = self.first[slot + 1] - self.first[slot]
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - self.first[slot], size)
        return n, digests, (np.repeat(doc, size), self.links[place], np.repeat(often, size))


_ALIGNERS: dict[tuple, Aligner] = {}


def _aligner(a_json: str, b_model: bytes) -> Aligner:
    """One aligner a Python worker, kept between tasks."""
    key = (hash(a_json), hash(b_model))
    if key not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[key] = Aligner(a_json, b_model)
    return _ALIGNERS[key]


# --------------------------------------------------------------------------
# runs: sorted pieces of zstd blocks

_ZSTD = pa.Codec("zstd", compression_level=6)
_TYPES = [np.uint8, np.uint16, np.uint32, np.uint64]


def _pack(columns: list[np.ndarray]) -> bytes:
    """Columns of numbers >= 0, each in its narrowest type and byte by byte, as one zstd frame after its length."""
    parts = []
    for c in columns:
        kind = int(np.searchsorted([1 << 8, 1 << 16, 1 << 32], int(c.max(initial=0)), side="right"))
        planes = np.ascontiguousarray(c.astype(_TYPES[kind]).view(np.uint8).reshape(-1, 1 << kind).T)
        parts += [kind.to_bytes(1, "little"), len(c).to_bytes(8, "little"), planes.tobytes()]
    raw = b"".join(parts)
    frame = _ZSTD.compress(raw, asbytes=True)
    return len(frame).to_bytes(8, "little") + len(raw).to_bytes(8, "little") + frame


def _unpack(data: bytes, at: int, columns: int) -> tuple[list[np.ndarray], int]:
    """The first columns of the frame at a place, as int64, and the place after it."""
    size, raw_size = (int.from_bytes(data[at + k:at + k + 8], "little") for k in (0, 8))
    raw = _ZSTD.decompress(data[at + 16:at + 16 + size], raw_size, asbytes=True)
    out, pos = [], 0
    for _ in range(columns):
        kind, n = raw[pos], int.from_bytes(raw[pos + 1:pos + 9], "little")
        width = 1 << kind
        planes = np.frombuffer(raw, np.uint8, n * width, pos + 9).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(_TYPES[kind]).ravel().astype(np.int64))
        pos += 9 + n * width
    return out, at + 16 + size


def blocks(payload: bytes, columns: int) -> Iterator[list[np.ndarray]]:
    """The first columns of every block; the codes of a block are stored as differences."""
    at = 0
    while at < len(payload):
        cols, at = _unpack(payload, at, columns)
        cols[0] = np.cumsum(cols[0])
        yield cols


def write_counts(codes: np.ndarray, *values: np.ndarray) -> bytes:
    return b"".join(_pack([np.diff(codes[k:k + BLOCK], prepend=0), *(v[k:k + BLOCK] for v in values)])
                    for k in range(0, len(codes), BLOCK))


def write_run(keys: np.ndarray, links: np.ndarray, span: int) -> Iterator[tuple[int, bytes]]:
    """Records (code << DOC_BITS | document) and their links, in any order -> (radix, piece)."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    start = np.flatnonzero(np.diff(keys, prepend=-1))
    links = np.add.reduceat(links[order], start) if len(start) else links[:0]
    keys = keys[start]
    code, doc = keys >> DOC_BITS, keys & ((1 << DOC_BITS) - 1)
    first = np.flatnonzero(np.diff(code, prepend=-1))   # records where a pair begins
    # documents of a pair as differences
    step = np.diff(doc, prepend=0)
    step[first] = doc[first]
    ends = np.append(first, len(code))
    codes = code[first]
    radix = codes // span
    for r in np.unique(radix):
        lo, hi = np.searchsorted(radix, [r, r + 1])
        piece = []
        for k in range(lo, hi, BLOCK):
            e = min(k + BLOCK, hi)
            piece.append(_pack([np.diff(codes[k:e], prepend=0), np.diff(ends[k:e + 1]),
                                step[ends[k]:ends[e]], links[ends[k]:ends[e]]]))
        yield int(r), b"".join(piece)


def merge_counts(payloads: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """K-way merge of sorted (code, count) blocks -> sorted distinct codes and summed counts, part by part.  One
    block of every payload is open; the heap has the payload whose open block ends first on top."""
    readers = [blocks(p, 2) for p in payloads]
    open_blocks: dict[int, list[np.ndarray]] = {}
    heap: list[tuple[int, int]] = []

    def load(k: int) -> None:
        nxt = next(readers[k], None)
        if nxt is None:
            open_blocks.pop(k, None)
        else:
            open_blocks[k] = nxt
            heapq.heappush(heap, (int(nxt[0][-1]), k))

    for k in range(len(payloads)):
        load(k)
    held = np.zeros(0, np.int64), np.zeros(0, np.int64)  # the last code may go on in the next part
    while heap:
        limit = heap[0][0]
        parts = [held]
        for k, (codes, counts) in open_blocks.items():
            n = np.searchsorted(codes, limit, side="right")
            if n:
                parts.append((codes[:n], counts[:n]))
                open_blocks[k] = [codes[n:], counts[n:]]
        while heap and heap[0][0] == limit:
            load(heapq.heappop(heap)[1])
        codes, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        counts = np.zeros(len(codes), np.int64)
        np.add.at(counts, place, np.concatenate([p[1] for p in parts]))
        yield codes[:-1], counts[:-1]
        held = codes[-1:], counts[-1:]
    yield held


def with_maxima(parts: Iterator[tuple[np.ndarray, np.ndarray]], width: int):
    """Marks, part by part, the codes whose count is the highest of their A id.  Only the pairs of one A id wait."""
    codes = counts = np.zeros(0, np.int64)

    def marked(c, n):
        side = c // width
        first = np.flatnonzero(np.diff(side, prepend=-1))
        top = np.maximum.reduceat(n, first) if len(first) else n
        return c, n, (n == np.repeat(top, np.diff(np.append(first, len(c))))).astype(np.int64)

    for c, n in parts:
        codes, counts = np.concatenate((codes, c)), np.concatenate((counts, n))
        if len(codes):
            done = np.searchsorted(codes, codes[-1] // width * width)
            yield marked(codes[:done], counts[:done])
            codes, counts = codes[done:], counts[done:]
    yield marked(codes, counts)


# --------------------------------------------------------------------------
# the job

NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def _tokenise(docs: DataFrame, shared) -> DataFrame:
    """Document rows (radix -1, ``at`` the place in the run) and pieces (radix, payload)."""
    key_type = docs.schema["key"].dataType.simpleString()
    schema = (f"run long, radix int, payload binary, at int, key {key_type}, "
              + ", ".join(f"{n} long" for n in NUMBERS) + ", groups_sha256 string")

    def run(batches):
        aligner = _aligner(*shared.value)
        span = aligner.rows * aligner.width
        part, number = TaskContext.get().partitionId(), 0
        docs_held, records, keys, links = 0, 0, [], []

        def pieces(run_id):
            rows = list(write_run(np.concatenate(keys), np.concatenate(links), span)) if keys else []
            if rows:
                n = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([run_id] * n, pa.int64()), pa.array([r for r, _ in rows], pa.int32()),
                     pa.array([p for _, p in rows], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, b.schema.field(0).type),
                     *(pa.nulls(n, pa.int64()) for _ in NUMBERS), pa.nulls(n, pa.string())], names=names)

        names = ["run", "radix", "payload", "at", "key", *NUMBERS, "groups_sha256"]
        b = None
        for b in batches:
            for first, texts in _groups(b.column(1)):
                if docs_held + len(texts) > RUN_DOCS or records >= RUN_RECORDS:
                    yield from pieces(part << 32 | number)
                    number += 1
                    docs_held, records, keys, links = 0, 0, [], []
                n, digests, (doc, code, often) = aligner.align(texts)
                keys.append(code << DOC_BITS | (doc + docs_held))
                links.append(often)
                records += len(code)
                k = len(texts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part << 32 | number] * k, pa.int64()), pa.array([-1] * k, pa.int32()),
                     pa.nulls(k, pa.binary()), pa.array(np.arange(docs_held, docs_held + k), pa.int32()),
                     b.column(0).slice(first, k), *(pa.array(n[x]) for x in NUMBERS), pa.array(digests, pa.string())],
                    names=names)
                docs_held += k
        if b is not None:
            yield from pieces(part << 32 | number)

    return docs.mapInArrow(run, schema)


def _groups(texts: pa.Array) -> Iterator[tuple[int, list]]:
    """Runs of whole texts of about GROUP_CHARS characters, RUN_DOCS at most."""
    group, size, first = [], 0, 0
    for i, t in enumerate(texts):
        group.append(t.as_py())
        size += len(group[-1] or "")
        if size >= GROUP_CHARS or len(group) == RUN_DOCS:
            yield first, group
            group, size, first = [], 0, i + 1
    if group:
        yield first, group


def _by_radix(batches, limit: int | None):
    """Consecutive payloads of a radix, about ``limit`` bytes at a time (None: all of them)."""
    radix, held, size = None, [], 0
    for b in batches:
        for r, p in zip(b.column("radix").to_pylist(), b.column("payload")):
            if held and (r != radix or limit and size >= limit and len(held) >= FAN_IN):
                yield radix, held
                held, size = [], 0
            radix = r
            held.append(p.as_py())
            size += len(held[-1])
    if held:
        yield radix, held


def _merge(pieces: DataFrame, name: str) -> DataFrame:
    """Sorted pieces of a radix in this task -> fewer pieces of counts."""

    def run(batches):
        for radix, payloads in _by_radix(batches, MERGE_BYTES):
            yield pa.RecordBatch.from_pydict(
                {"radix": pa.array([radix], pa.int32()),
                 "payload": pa.array([b"".join(write_counts(*p) for p in merge_counts(payloads))], pa.binary())})

    return stage(pieces.select("radix", "payload").mapInArrow(run, "radix int, payload binary"), name)


def _together(pieces: DataFrame, keys: list) -> DataFrame:
    return pieces.repartition(shuffle_partitions(pieces.sparkSession), *keys).sortWithinPartitions("radix")


def pair_tables(pieces: DataFrame, folder: str, width: int) -> DataFrame:
    """Count tables by radix, as committed files of (code, count, highest) blocks; returns their manifest."""
    counts = _merge(pieces, "align-counts")
    while True:
        sizes = counts.groupBy("radix").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("payload")).alias("b"))
        most = sizes.filter((F.col("n") > FAN_IN) & (F.col("b") > MERGE_BYTES)).agg(F.max("n")).first()[0]
        if not most:
            break
        deal = F.pmod(F.xxhash64("payload"), F.lit(-(-most // FAN_IN)))
        counts = _merge(_together(counts.withColumn("g", deal), ["radix", "g"]), "align-counts")

    def write(batches):
        temp = TempFiles(folder)
        for radix, payloads in _by_radix(batches, None):
            name, out = temp.create()
            for part in with_maxima(merge_counts(payloads), width):
                out.write(write_counts(*part))
            out.close()
            yield pa.RecordBatch.from_pydict({"tmp": [name], "name": [f"radix-{radix:05d}"]})

    return commit(_together(counts, ["radix"]).mapInArrow(write, "tmp string, name string"), folder)


def _gains(pieces: DataFrame, folder: str) -> DataFrame:
    """Every piece against the table of its radix -> (run, payload): by place in the run, the links whose count is
    the highest of their A id and the sum of the counts."""

    def run(batches):
        fs, path = open_fs(folder)
        radix, table = None, None
        for b in batches:
            runs, out = b.column("run").to_pylist(), []
            for r, p in zip(b.column("radix").to_pylist(), b.column("payload")):
                if r != radix:
                    with fs.open_input_stream(f"{path}/radix-{r:05d}") as f:
                        parts = list(blocks(f.read(), 3))
                    radix, table = r, [np.concatenate([x[k] for x in parts]) for k in range(3)]
                best = total = np.zeros(0, np.int64)
                for codes, n, step, links in blocks(p.as_py(), 4):
                    at = np.searchsorted(table[0], codes)
                    first = np.cumsum(n) - n
                    doc = np.cumsum(step)
                    # the sum starts anew at every pair
                    doc -= np.repeat(np.concatenate(([0], doc[first[1:] - 1])), n)
                    need = int(doc.max()) + 1
                    if need > len(best):
                        best, total = (np.concatenate((x, np.zeros(need - len(x), np.int64))) for x in (best, total))
                    np.add.at(best, doc, links * np.repeat(table[2][at], n))
                    np.add.at(total, doc, links * np.repeat(table[1][at], n))
                out.append(_pack([best, total]))
            yield pa.RecordBatch.from_pydict({"run": pa.array(runs, pa.int64()), "payload": pa.array(out, pa.binary())})

    return pieces.select("run", "radix", "payload").mapInArrow(run, "run long, payload binary")


def align_tokenizers(docs: DataFrame, a_json: str, b_model: bytes, *, key: str = "doc_id",
                     text: str = "text") -> DataFrame:
    """-> one row per document: ``key``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best`` (links whose count
    is the highest of their A id), ``count_sum`` (counts over links) and ``groups_sha256``.

    A (a byte-level vocabulary of the tokenizers library, without normalizer) encodes a space and the text, B (a
    sentencepiece model whose pieces have spaces only in front) the text, in front of which it puts one.  The count
    of an id pair is the number of documents that hold it linked.

    Defined cases: null and empty texts, and texts whose A or B bytes differ from space + text, have no tokens:
    zeros and an empty digest; strings of special tokens are plain text; rows with null or repeated keys are
    documents of their own; ties for the highest count all count as highest; an empty table gives an empty result.
    Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    shared = spark.sparkContext.broadcast((a_json, b_model))  # two vocabulary files
    parts = shuffle_partitions(spark)
    # pieces of a radix stay in few partitions, documents go anywhere
    spread = F.when(F.col("radix") < 0, F.pmod(F.xxhash64("run", "at"), F.lit(16 * parts))).otherwise(
        F.pmod(F.xxhash64("run"), F.lit(-(-4 * parts // RADIX))))
    done = stage(_tokenise(rows, shared).repartition(parts, "radix", spread).sortWithinPartitions("radix", "run"),
                 "align-runs")
    pieces = done.filter("radix >= 0").select("run", "radix", "payload")
    folder = scratch_uri(spark, "align-tables")
    pair_tables(pieces, folder, _width(b_model))
    gains = _gains(pieces, folder)
    names = ["key", *NUMBERS, "groups_sha256"]
    both = gains.select("run", "payload", F.lit(-1).alias("at"), *(
        F.lit(None).cast(done.schema[n].dataType).alias(n) for n in names)).unionByName(
        done.filter("radix < 0").select("run", F.lit(None).cast("binary").alias("payload"), "at", *names))
    return _finish(both.repartition(parts, "run").sortWithinPartitions("run", "at"), names)


def _width(b_model: bytes) -> int:
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_proto=b_model).get_piece_size()


def _finish(rows: DataFrame, names: list[str]) -> DataFrame:
    """Rows by run, gains before documents: add up the gains and hand them to the documents."""

    def run(batches):
        current, sums = None, None
        for b in batches:
            runs, places = b.column("run").to_numpy(), b.column("at").to_numpy()
            best, total = np.zeros(len(runs), np.int64), np.zeros(len(runs), np.int64)
            cuts = np.flatnonzero(np.diff(runs, prepend=runs[0] - 1)).tolist() if len(runs) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(runs)]):
                if runs[lo] != current:
                    current, sums = runs[lo], [np.zeros(RUN_DOCS, np.int64), np.zeros(RUN_DOCS, np.int64)]
                own = lo + int(np.count_nonzero(places[lo:hi] < 0))
                for p in b.column("payload").slice(lo, own - lo):
                    for s, g in zip(sums, _unpack(p.as_py(), 0, 2)[0]):
                        s[:len(g)] += g
                best[own:hi], total[own:hi] = (s[places[own:hi]] for s in sums)
            keep = pa.array(places >= 0)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(n) for n in names), pa.array(best), pa.array(total)],
                names=[*names, "n_best", "count_sum"]).filter(keep)

    schema = rows.select(*names).schema.add("n_best", "long").add("count_sum", "long")
    return rows.mapInArrow(run, schema)
