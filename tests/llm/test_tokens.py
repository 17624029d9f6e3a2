import os
import random
import zlib

import numpy as np
import pytest

from embra.llm import simple8b, tokens
from embra.llm.queries import tokenizer_json

DOC = "doc_id long, text string, key string, ids long, start long, n long"


@pytest.fixture(scope="module")
def vocabulary():
    return tokenizer_json()


def plain(vocabulary, text):
    from tokenizers import Tokenizer
    return Tokenizer.from_str(vocabulary).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 7, 240, 1023, 1024, 1025, 5000])
@pytest.mark.parametrize("kind", ["wide", "zero", "ids", "mixed"])
def test_simple8b_round_trip(n, kind):
    rng = np.random.default_rng(n)
    v = {"wide": rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
         "zero": np.zeros(n, np.uint64), "ids": rng.integers(0, 50257, n).astype(np.uint64),
         "mixed": rng.integers(0, 1 << 63, n, dtype=np.uint64) >> rng.integers(0, 63, n).astype(np.uint64)}[kind]
    words, offsets, at, big = simple8b.encode(v)
    assert np.array_equal(simple8b.decode(words, at, big), v)
    assert offsets[-1] == len(words) and len(offsets) == -(-n // simple8b.BLOCK) + 1
    for b in range(len(offsets) - 1):  # every block decodes alone
        mine = at // simple8b.BLOCK == b
        part = simple8b.decode(words[offsets[b]:offsets[b + 1]], at[mine] - b * simple8b.BLOCK, big[mine])
        assert np.array_equal(part, v[b * simple8b.BLOCK:(b + 1) * simple8b.BLOCK])


def test_chunks_encode_as_whole_texts(vocabulary):
    enc = tokens.ChunkEncoder(vocabulary)
    assert enc.chunked
    rng = random.Random(8)
    alphabet = list("ab 's.1²½éд\n\t\x1c ́ſ!'lt  ") + ["<|endoftext|>", "日本", "\x00", "퟿"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 16))) for _ in range(4000)] + [None, "", "it's  x "]
    for t, ids in zip(texts, enc.encode(texts)):
        assert ids.tolist() == enc.tokenizer.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_cache_restarts_when_full(vocabulary, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 3)
    enc = tokens.ChunkEncoder(vocabulary)
    for t in ["one two three four", "five six", "one, two", "seven eight nine"]:
        assert enc.encode([t])[0].tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids


def cases():
    rng = random.Random(9)
    d = [(i, " ".join(rng.choice(["la", "Maison", "x1", "été,", "\n", "über"]) for _ in range(rng.randint(0, 60))))
         for i in rng.sample(range(1000), 70)]
    return d + [(2000, None), (2001, ""), (None, "no key"), (2002, "long " * 60000), d[0], (2003, "<|endoftext|>")]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1, 2, 3) for i, t in rows], DOC)


@pytest.mark.parametrize("small", [False, True])
def test_files_in_key_order_round_trip(spark, vocabulary, tmp_path, monkeypatch, small):
    if small:  # several files and flushes a task
        monkeypatch.setattr(tokens, "FILE_IDS", 300)
        monkeypatch.setattr(tokens, "FLUSH_IDS", 100)
        monkeypatch.setattr(tokens, "READ_BLOCKS", 1)
    d = cases()
    folder = str(tmp_path / "out")
    files = tokens.write_token_files(docs(spark, d), folder, vocabulary, end_id=2, partitions=3)
    got = tokens.read_token_files(spark, folder, files, ids=True).orderBy("start").collect()
    order = sorted(d, key=lambda r: (r[0] is not None, r[0] or 0))
    at = 0
    for r, (k, t) in zip(got, order, strict=True):
        want = plain(vocabulary, t) + [2]
        assert (r["key"], r["start"], r["n_tokens"], r["ids"]) == (k, at, len(want), want)
        assert r["ids_crc32"] == zlib.crc32(np.array(want, "<u4").tobytes())
        at += len(want)
    names = {r["name"] for r in files.collect()}
    assert names == {n for n in os.listdir(folder) if n.endswith(".s8b")}
    assert not os.path.exists(f"{folder}/_temporary")
    if small:
        assert len(names) > 3


def test_no_end_id_and_empty_documents(spark, vocabulary, tmp_path):
    folder = str(tmp_path / "out")
    files = tokens.write_token_files(docs(spark, [(1, ""), (2, None), (3, "a"), (4, "")]), folder, vocabulary)
    got = tokens.read_token_files(spark, folder, files).orderBy("key").collect()
    assert [(r["start"], r["n_tokens"], r["ids_crc32"]) for r in got][:2] == [(0, 0, 0), (0, 0, 0)]
    assert [r["n_tokens"] for r in got] == [0, 0, 1, 0]


def test_empty_table(spark, vocabulary, tmp_path):
    folder = str(tmp_path / "out")
    files = tokens.write_token_files(docs(spark, []), folder, vocabulary, end_id=2)
    assert tokens.read_token_files(spark, folder, files).count() == 0
