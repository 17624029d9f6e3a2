import random
from collections import Counter

import numpy as np
import pytest

from embra.llm import align
from embra.llm.queries import QUERIES, public_file, tokenizer_json

from . import brute

SCHEMA = "doc_id long, text string, key string, run int, radix int, n_a string"


@pytest.fixture(scope="module")
def model():
    with open(public_file("piece_bpe_32k.model"), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def whole(model):
    """Plain alignment of whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_str(tokenizer_json())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_proto=model)
    alphabet = align.byte_alphabet()

    def run(text):
        """-> (a ids, b ids, group string, links) or None"""
        if not text:
            return None
        raw = (" " + text).encode()
        ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        ta = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ia]
        tb = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
              for i in ib]
        if b"".join(ta) != raw or b"".join(tb) != raw:
            return None
        ea, eb = np.cumsum([len(x) for x in ta]).tolist(), np.cumsum([len(x) for x in tb]).tolist()
        links, groups, i, j, gi, gj = [], [], 0, 0, 0, 0
        while i < len(ia):
            links.append((ia[i], ib[j]))
            x, y = ea[i], eb[j]
            i, j = i + (x <= y), j + (y <= x)
            if x == y:
                groups.append(",".join(map(str, ia[gi:i])) + "|" + ",".join(map(str, ib[gj:j])))
                gi, gj = i, j
        return ia, ib, groups, links
    return run


def expected(rows, whole):
    found = [(key, whole(text)) for key, text in rows]
    count = Counter(p for _, w in found if w for p in set(w[3]))
    top = {}
    for (a, _), n in count.items():
        top[a] = max(top.get(a, 0), n)
    out = []
    for key, w in found:
        if w is None:
            out.append((key, 0, 0, 0, 0, 0, 0, ""))
            continue
        ia, ib, groups, links = w
        out.append((key, len(ia), len(ib), len(groups), len(links), sum(count[p] == top[p[0]] for p in links),
                    sum(count[p] for p in links), brute.sha256(";".join(groups))))
    return Counter(out)


def got(df):
    return Counter((r["key"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"],
                    r["groups_sha256"]) for r in df.collect())


TEXTS = [None, "", " ", "  ", "\n", "a", "abc ", " abc", "a  b   c", "a\tb\nc\n\n d", "x \n y", "x\n  y \n\n", "don't we'll",
         "<|endoftext|> <s> </s> <unk> <0x41>", "▁x a▁b", "ﬁ ① ½ é é", "日本語の文章 です", "a\x00b \x1c c\x1d", "　x y   z",
         "12345 67,89.0", "🙂🙃 👩‍👩‍👧 ok", "foo();\r\nbar {\r\n}\r\n", "w" * 5000, "long words " * 4000, "​zero﻿", "� x"]


def test_documents_as_brute_force(spark, model, whole):
    rows = [*enumerate(TEXTS), (5, "a"), (None, "abc  abc"), (None, None), (7, "abc ")]
    df = spark.createDataFrame([(i, t, "k", 1, 2, "n") for i, t in rows], SCHEMA)
    assert got(align.align_tokenizers(df, tokenizer_json(), model)) == expected(rows, whole)


def test_chunks_as_whole_texts(model, whole):
    rnd = random.Random(11)
    parts = ["the", " ", " ", " ", "  ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", " ", " ", "'s", "'", "é", "ß", "日本", "1", "23", ".", "!!",
             "#", "_", "▁", "́", "🙂", "\x00", "word", "Word", "<s>", "ing", "-", "‍", "ा", "﻿", "<0x0A>"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 30))) for _ in range(4000)]
    aligner = align.Aligner(tokenizer_json(), model)
    n, digests, (doc, code, often) = aligner.align(texts)
    links = [Counter() for _ in texts]
    for d, c, k in zip(doc.tolist(), code.tolist(), often.tolist()):
        links[d][c] += k
    for i, t in enumerate(texts):
        w = whole(t)
        if w is None:
            assert (n["n_a"][i], n["n_links"][i], digests[i], len(links[i])) == (0, 0, "", 0), repr(t)
            continue
        assert (n["n_a"][i], n["n_b"][i], n["n_groups"][i]) == (len(w[0]), len(w[1]), len(w[2])), repr(t)
        assert digests[i] == brute.sha256(";".join(w[2])), repr(t)
        assert links[i] == Counter(aligner.code(np.int64(a), np.int64(b)) for a, b in w[3]), repr(t)


def test_small_runs_blocks_and_rounds(spark, model, whole, monkeypatch):
    """Many runs, several blocks a piece, several merge rounds: the same result.  Tasks import the module anew, so
    the sizes are set there too."""
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(40)] + ["the", "of", "and"] * 6
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 60)))) for i in range(600)]
    rows += [(1000 + i, rows[3][1]) for i in range(300)]  # a third are copies
    df = spark.createDataFrame([(i, t, "k", 1, 2, "n") for i, t in rows], SCHEMA)
    small = {"RUN_RECORDS": 400, "RUN_DOCS": 8, "BLOCK": 5, "MERGE_BYTES": 2000, "FAN_IN": 3, "GROUP_CHARS": 300,
             "CACHE_ENTRIES": 50}
    for name, value in small.items():
        monkeypatch.setattr(align, name, value)

    def shrink(fn):
        def run(batches):
            for name, value in small.items():
                setattr(align, name, value)
            yield from fn(batches)
        return run

    plain = type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, fn, *a, **k: plain(self, shrink(fn), *a, **k))
    try:
        assert got(align.align_tokenizers(df, tokenizer_json(), model)) == expected(rows, whole)
    finally:
        undo = {"RUN_RECORDS": 1 << 21, "RUN_DOCS": 1 << 16, "BLOCK": 1 << 14, "MERGE_BYTES": 32 << 20, "FAN_IN": 16,
                "GROUP_CHARS": 1 << 20, "CACHE_ENTRIES": 400_000}

        def restore(batches):  # workers are reused
            for name, value in undo.items():
                setattr(align, name, value)
            yield from batches
        plain(spark.range(64).repartition(64), restore, "id long").count()


def test_merge_and_maxima():
    rng = np.random.default_rng(0)
    counts, payloads = Counter(), []
    for k in range(20):
        codes = np.unique(rng.integers(0, 5000, 700))
        n = rng.integers(1, 300, len(codes))
        counts.update(dict(zip(codes.tolist(), n.tolist())))
        payloads.append(b"".join(align.write_counts(codes[i:i + 50], n[i:i + 50]) for i in range(0, len(codes), 50)))
    payloads.append(b"")
    parts = list(align.with_maxima(align.merge_counts(payloads), 100))
    codes, n, top = (np.concatenate([p[k] for p in parts]) for k in range(3))
    assert dict(zip(codes.tolist(), n.tolist())) == counts and (np.diff(codes) > 0).all()
    best = {}
    for c, k in counts.items():
        best[c // 100] = max(best.get(c // 100, 0), k)
    assert [bool(x) for x in top] == [counts[c] == best[c // 100] for c in codes.tolist()]


def test_memory_of_a_merge_is_a_block_each(monkeypatch):
    open_now, most = Counter(), [0]
    real = align.blocks

    def watched(payload, columns):
        for b in real(payload, columns):
            open_now[id(payload)] = len(b[0])
            most[0] = max(most[0], sum(open_now.values()))
            yield b
    monkeypatch.setattr(align, "BLOCK", 10)
    monkeypatch.setattr(align, "blocks", watched)
    payloads = [align.write_counts(np.arange(k, 3000, 7), np.ones(len(range(k, 3000, 7)), np.int64)) for k in range(7)]
    assert sum(len(c) for c, _ in align.merge_counts(payloads)) == 3000
    assert most[0] <= 70


def test_empty_table(spark, model):
    out = align.align_tokenizers(spark.createDataFrame([], SCHEMA), tokenizer_json(), model)
    assert out.collect() == [] and out.columns[0] == "key"


def test_query_over_the_whole_table(spark, sf, whole):
    from embra.tables import table
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    out = QUERIES["op13_tokenizer_alignment"](spark, sf)
    assert got(out.withColumnRenamed("doc_id", "key")) == expected(rows, whole)
