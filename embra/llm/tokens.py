"""Token-id files: tokenized documents as Simple-8b blocks, and reading them back.

Documents are range-sorted by key; every task streams its range into files of
one contiguous id sequence each:

    magic | words (uint64, little endian) | footer | footer length (uint64) | magic

The words are blocks of 1024 ids (:mod:`.simple8b`).  The footer is an Arrow
stream: key and id count of every document, and as metadata the word offset of
every block and the escapes, so any run of ids is decoded from its own blocks.
Files are committed with a manifest (:mod:`.files`).
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import simple8b
from .files import TempFiles, commit, one_task_per_file, open_fs

MAGIC = b"EMBRAS8B"
FLUSH_IDS = 1 << 20      # ids held before they are coded
FILE_IDS = 1 << 27       # a file is closed at the first document end beyond this
READ_BLOCKS = 1 << 10    # blocks decoded at once
CACHE_ENTRIES = 300_000  # words of a generation: a worker remembers two
LINES = 100              # pieces encoded in one call
GROUP_BYTES = 8 << 20    # bytes of text encoded together

# Latin letters that a piece may consist of
LATIN_RUN = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ɏ]+")
_LETTER, _PUNCT, _SPACE = (np.zeros(256, bool) for _ in range(3))
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PUNCT[33:127] = ~_LETTER[33:127]
_ASCII_OTHER = (np.arange(256) < 128) & ~_LETTER


def cuts_inside(b: np.ndarray) -> np.ndarray:
    """Places in UTF-8 bytes where the pre-tokenizer's pattern always ends a piece, whatever stands around: after a
    Latin letter that meets another ASCII character; after ASCII punctuation or a digit that meets ASCII white
    space; and after a single line break so preceded that meets a letter."""
    if len(b) < 2:
        return np.zeros(0, np.int64)
    # two-byte letters: U+00C0 to U+024F without the two signs in between
    tail, lead = b[1:], b[:-1]
    two = (lead >= 0xC3) & (lead <= 0xC9) & (tail >= 0x80) & (tail < 0xC0)
    two &= ~((lead == 0xC3) & ((tail == 0x97) | (tail == 0xB7))) & ~((lead == 0xC9) & (tail > 0x8F))
    letter = _LETTER[b]
    letter[1:] |= two
    cut = letter[:-1] & _ASCII_OTHER[tail] | _PUNCT[lead] & _SPACE[tail]   # between bytes i and i + 1
    solid = _LETTER[tail] | (tail == 0xC3)
    cut[1:] |= cut[:-1] & (lead[1:] == 10) & solid[1:]
    return np.flatnonzero(cut) + 1


class ChunkEncoder:
    """Encodes texts; remembers the ids (as little-endian uint32 bytes) of the pieces they are cut into
    (:func:`cuts_inside`): ``words``, and ``older`` ones until they come again.  A text with the string of an added
    token is one piece.

    Texts are cut only for byte-level vocabularies with that pattern and without
    normalizer or post-processor; others are encoded whole.
    """

    def __init__(self, tokenizer_json: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        spec = json.loads(tokenizer_json)
        pre = spec.get("pre_tokenizer") or {}
        self.chunked = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                        and not pre.get("add_prefix_space") and not spec.get("normalizer")
                        and not spec.get("post_processor"))
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.shown = {b: c for c, b in byte_alphabet().items()}
        if self.chunked:  # the same model alone, for runs of Latin letters: one piece each, a line break between
            lines = {"type": "Split", "pattern": {"String": self.shown[10]}, "behavior": "Isolated", "invert": False}
            alone = spec | {"pre_tokenizer": lines, "post_processor": None, "added_tokens": []}
            self.pieces = Tokenizer.from_str(json.dumps(alone))
            self.newline = self._ids("\n")[0]

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        ids, counts = self.encode_together(pa.array(texts, pa.string()), [])
        return np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else []

    def encode_together(self, texts: pa.Array, tail: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, ``tail`` after each, and how many each has.  The pieces are numbered, so only
        distinct ones are looked at one by one."""
        n = len(texts)
        texts = pc.fill_null(texts, "").cast(pa.string())
        if not n or not self.chunked:
            parts = [np.concatenate((self._ids(t), np.array(tail, "<u4"))) for t in texts.to_pylist()]
            return (np.concatenate(parts) if parts else np.zeros(0, "<u4")), np.array([len(x) for x in parts], np.int64)
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int32)[texts.offset:texts.offset + n + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
        mark = np.zeros(len(raw) + 1, bool)
        mark[cuts_inside(raw)] = True
        for token in self.added:  # strings that the tokenizer looks for first: no cuts in such texts
            for k in np.flatnonzero(pc.match_substring(texts, token)).tolist():
                mark[at[k] - at[0]:at[k + 1] - at[0]] = False
        mark[at - at[0]] = True
        cuts = np.flatnonzero(mark) + at[0]
        pieces = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int32)),
                                             data or pa.py_buffer(b"")).dictionary_encode()
        entries = self._entries(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        entries.append(np.array(tail, "<u4").tobytes())
        # entry numbers in order, the tail after each text's last
        first = np.searchsorted(cuts, at)
        order = np.insert(pieces.indices.to_numpy().astype(np.int64), first[1:], len(entries) - 1)
        lens = np.fromiter(map(len, entries), np.int64, len(entries)) // 4
        start = np.cumsum(lens) - lens
        size = lens[order]
        ends = np.cumsum(size)
        place = np.arange(ends[-1]) - np.repeat(ends - size - start[order], size)
        ids = np.frombuffer(b"".join(entries), "<u4")[place]
        return ids, np.diff(ends[first[1:] + np.arange(n)], prepend=0)

    def _entries(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces."""
        if len(self.words) > CACHE_ENTRIES:
            self.words, self.older = {}, self.words
        out = list(map(self.words.get, pieces))
        new = [i for i, ids in enumerate(out) if ids is None]
        self._encode_many([pieces[i] for i in new if pieces[i] not in self.older])
        for i in new:
            out[i] = self.words.get(pieces[i])
            if out[i] is None:
                out[i] = self.words[pieces[i]] = self.older[pieces[i]]
        return out

    def _encode_many(self, pieces: list[str]) -> None:
        latin = []
        for p in pieces:
            if LATIN_RUN.fullmatch(p):
                latin.append(p)
            else:
                self.words[p] = self._ids(p).tobytes()
        lines = [latin[k:k + LINES] for k in range(0, len(latin), LINES)]
        done = self.pieces.encode_batch_fast([self._shown("\n".join(x)) for x in lines], add_special_tokens=False)
        for some, e in zip(lines, done):
            ids = np.array(e.ids, "<u4")
            ends = [*np.flatnonzero(ids == self.newline).tolist(), len(ids)]
            data = ids.tobytes()
            if len(ends) != len(some):
                raise ValueError("the vocabulary doesn't keep line breaks apart")
            at = 0
            for p, end in zip(some, ends):
                self.words[p] = data[4 * at:4 * end]
                at = end + 1

    def _shown(self, text: str) -> str:
        """Letters, spaces and line breaks in the characters of a byte-level vocabulary."""
        if text.isascii():
            return text.replace(" ", self.shown[32]).replace("\n", self.shown[10])
        return text.encode().decode("latin-1").translate(self.shown)


def byte_alphabet() -> dict[str, int]:
    """Characters that byte-level vocabularies write for the 256 bytes: printable ones for themselves, the others
    for 256, 257, ... in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


_ENCODERS: dict[int, ChunkEncoder] = {}


def _encoder(tokenizer_json: str) -> ChunkEncoder:
    """One encoder a Python worker, kept between tasks."""
    key = zlib.crc32(tokenizer_json.encode())
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = ChunkEncoder(tokenizer_json)
    return _ENCODERS[key]


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Runs of (keys, texts) of about GROUP_BYTES, texts whole."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64))
    at = 0
    while at < len(size):
        before = int(size[at - 1]) if at else 0
        end = min(int(np.searchsorted(size, before + GROUP_BYTES)) + 1, len(size))
        yield batch.column(0).slice(at, end - at), batch.column(1).slice(at, end - at)
        at = end


class TokenFile:
    """One file being written by a task."""

    def __init__(self, temp: TempFiles):
        self.name, self.out = temp.create()
        self.out.write(MAGIC)
        self.keys, self.counts, self.held, self.held_ids = [], [], [], 0
        self.ids, self.words = 0, 0
        self.offsets, self.escapes, self.escaped = [np.zeros(1, np.int64)], [], []

    def add(self, keys: pa.Array, counts: np.ndarray, ids: np.ndarray) -> None:
        """Documents whose ids follow one another."""
        self.keys.append(keys)
        self.counts.append(counts)
        self.held.append(ids)
        self.held_ids += len(ids)
        if self.held_ids >= FLUSH_IDS:
            self._code(self.held_ids - self.held_ids % simple8b.BLOCK)

    def _code(self, n: int) -> None:
        v = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        words, offsets, escape, escaped = simple8b.encode(v[:n].astype(np.uint64))
        self.out.write(words.astype("<u8").tobytes())
        self.offsets.append(self.words + offsets[1:])
        self.escapes.append(escape + self.ids)
        self.escaped.append(escaped)
        self.words += len(words)
        self.ids += n
        self.held, self.held_ids = [v[n:]], len(v) - n

    def close(self, key_type: pa.DataType) -> dict:
        self._code(self.held_ids)
        meta = {"offsets": np.concatenate(self.offsets).astype("<i8").tobytes(),
                "escapes": np.concatenate(self.escapes).astype("<i8").tobytes(),
                "escaped": np.concatenate(self.escaped).astype("<u8").tobytes()}
        table = pa.table({"key": pa.chunked_array(self.keys, key_type),
                          "n": pa.array(np.concatenate(self.counts), pa.int64())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema.with_metadata(meta)) as w:
            w.write_table(table)
        footer = sink.getvalue().to_pybytes()
        self.out.write(footer + len(footer).to_bytes(8, "little") + MAGIC)
        self.out.close()
        return {"tmp": self.name, "docs": len(table), "ids": self.ids,
                "bytes": 8 * self.words + len(footer) + 24}


FILE_SCHEMA = "tmp string, name string, docs long, ids long, bytes long"


def write_token_files(docs: DataFrame, folder: str, tokenizer_json: str, *, key: str = "doc_id",
                      text: str = "text", end_id: int | None = None,
                      partitions: int | None = None) -> DataFrame:
    """Encode ``text``, append ``end_id`` and write files in ascending key order (null
    keys first).  Returns the manifest: name, docs, ids, bytes and ``start``, the ids
    in all files before it.

    Defined cases: null and empty texts encode to nothing but the end id; repeated
    rows are written as often as they occur; rows of one key are ordered by text; where a
    file ends depends on sampled range bounds, the order and the ids don't; an empty table writes no file.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    tokenizer = spark.sparkContext.broadcast(tokenizer_json)  # one vocabulary file

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, temp = _encoder(tokenizer.value), TempFiles(folder)
        part, done, file, key_type = TaskContext.get().partitionId(), [], None, None
        tail = [] if end_id is None else [end_id]
        for b in batches:
            key_type = b.schema.field(0).type
            for keys, texts in _groups(b):
                ids, counts = encoder.encode_together(texts, tail)
                ends, at, used = np.cumsum(counts), 0, 0
                while at < len(keys):
                    file = file or TokenFile(temp)
                    room = FILE_IDS - file.ids - file.held_ids
                    end = min(int(np.searchsorted(ends, used + room)) + 1, len(keys))
                    upto = int(ends[end - 1])
                    file.add(keys.slice(at, end - at), counts[at:end], ids[used:upto])
                    at, used = end, upto
                    if file.ids + file.held_ids >= FILE_IDS:
                        done.append(file.close(key_type))
                        file = None
        if file:
            done.append(file.close(key_type))
        names = [f"tokens-{part:06d}-{k:04d}.s8b" for k in range(len(done))]
        yield pa.RecordBatch.from_pylist(
            [d | {"name": x} for d, x in zip(done, names)],
            schema=pa.schema([("tmp", pa.string()), ("name", pa.string()), ("docs", pa.int64()),
                              ("ids", pa.int64()), ("bytes", pa.int64())]))

    ordered = rows.repartitionByRange(n, "key").sortWithinPartitions("key", "text")
    files = commit(ordered.mapInArrow(write, FILE_SCHEMA), folder)
    return with_starts(files)


def with_starts(files: DataFrame) -> DataFrame:
    """Running id counts over the manifest: one row per file, not data."""
    before = Window.orderBy("name").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)).cast("long"))


class TokenReader:
    """Random access to one token file."""

    def __init__(self, folder: str, name: str):
        fs, path = open_fs(folder)
        self.file = fs.open_input_file(f"{path}/{name}")
        size = self.file.size()
        self.file.seek(size - 16)
        tail = self.file.read(16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{name}: not a token file")
        length = int.from_bytes(tail[:8], "little")
        self.file.seek(size - 16 - length)
        with pa.ipc.open_stream(self.file.read(length)) as r:
            self.docs, meta = r.read_all(), r.schema.metadata
        self.offsets = np.frombuffer(meta[b"offsets"], "<i8")
        self.escapes = np.frombuffer(meta[b"escapes"], "<i8")
        self.escaped = np.frombuffer(meta[b"escaped"], "<u8")

    def blocks(self, first: int, last: int) -> np.ndarray:
        """Ids of blocks first..last-1."""
        a, b = int(self.offsets[first]), int(self.offsets[last])
        self.file.seek(len(MAGIC) + 8 * a)
        words = np.frombuffer(self.file.read(8 * (b - a)), "<u8")
        lo, hi = np.searchsorted(self.escapes, [first * simple8b.BLOCK, last * simple8b.BLOCK])
        return simple8b.decode(words, self.escapes[lo:hi] - first * simple8b.BLOCK, self.escaped[lo:hi])

    def pieces(self) -> Iterator[tuple[int, np.ndarray, bool]]:
        """(document number, some of its ids as uint32, whether they are its last)."""
        doc, left = 0, None
        counts = self.docs["n"].to_pylist()
        left = counts[0] if counts else 0
        for at in range(0, len(self.offsets) - 1, READ_BLOCKS):
            ids = self.blocks(at, min(at + READ_BLOCKS, len(self.offsets) - 1)).astype("<u4")
            pos = 0
            while pos < len(ids):
                while left == 0:
                    yield doc, ids[:0], True
                    doc += 1
                    left = counts[doc]
                take = min(left, len(ids) - pos)
                left -= take
                pos += take
                yield doc, ids[pos - take:pos], left == 0
                if left == 0:
                    doc += 1
                    if doc < len(counts):
                        left = counts[doc]
        for d in range(doc, len(counts)):
            yield d, np.zeros(0, "<u4"), True


def read_token_files(spark: SparkSession, folder: str, files: DataFrame, key_type: str = "long",
                     ids: bool = False) -> DataFrame:
    """Decode the files of a manifest -> per document ``key``, ``start`` (ids before it),
    ``n_tokens``, ``ids_crc32`` (of its ids as little-endian uint32) and, with
    ``ids=True``, the ids themselves."""
    schema = f"key {key_type}, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, start in zip(b.column("name").to_pylist(), b.column("start").to_pylist()):
                reader = TokenReader(folder, name)
                n = reader.docs["n"].to_numpy()
                crcs, kept, crc, part = [], [], 0, []
                for _, piece, last in reader.pieces():
                    crc = zlib.crc32(piece, crc)
                    if ids:
                        part.append(piece)
                    if last:
                        crcs.append(crc)
                        crc = 0
                        if ids:
                            kept.append(np.concatenate(part).astype(np.int64))
                            part = []
                cols = {"key": reader.docs["key"], "start": pa.array(start + np.cumsum(n) - n, pa.int64()),
                        "n_tokens": pa.array(n, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())}
                if ids:
                    cols["ids"] = pa.array(kept, pa.list_(pa.int64()))
                yield from pa.table(cols).combine_chunks().to_batches(max_chunksize=10000)

    return one_task_per_file(files.select("name", "start")).mapInArrow(read, schema)
