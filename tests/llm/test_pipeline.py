"""The pipeline's stages against plain versions, each on what the stage before kept."""

import hashlib
import math
import os
import random
import sys
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from . import brute

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SOUNDS = {"aa": ["ka", "lo", "mi", "ra"], "bb": ["schu", "ver", "ung", "ein"]}


@pytest.fixture(scope="module")
def sf_dir(tmp_path_factory):
    rng = random.Random(13)

    def text(lang, n):
        return " ".join("".join(rng.choices(SOUNDS[lang], k=rng.randint(1, 4))) for _ in range(n))

    passages = [text("aa", 30) for _ in range(4)]
    rows = []
    for i in range(120):
        lang = "ab"[i % 2] * 2
        t = text(lang, rng.randint(20, 120))
        if i % 11 == 0:
            t = f"{t} {passages[i % 4]}"
        rows.append((i, t, lang if i % 13 else None, ["s1", "s2", None][i % 3]))
    rows += [(200 + i, rows[i][1], rows[i][2], "s2") for i in range(15)]
    rows += [(300 + i, rows[i][1].replace(" ", "  ", 3) + ".", rows[i][2], "s1") for i in range(20, 26)]
    rows += [(400, None, "aa", "s1"), (401, "", "aa", "s1"), (402, "123 456 !", "bb", "s2"), (403, passages[0], "aa", "s1")]
    path = tmp_path_factory.mktemp("pipeline")
    pq.write_table(pa.table({c: pa.array(v, t) for c, v, t in zip(
        COLUMNS, [*zip(*rows), [len(r[1] or "") for r in rows]],
        [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()])}), path / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array(range(4), pa.int64()), "text": passages}), path / "benchmark.parquet")
    return str(path)


def mixed(docs):
    """[(doc_id, text, source)] -> {doc_id: times taken}"""
    size = {d: len(brute.words(t)) for d, t, _ in docs}
    order = {d: int(hashlib.md5(f"mix|{d}".encode()).hexdigest()[:15], 16) for d, _, _ in docs}
    sources = sorted({s for _, _, s in docs}, key=lambda s: (s is None, s or ""))
    weight = dict(zip(sources, [3, 1, 2] * len(sources)))
    total = {s: sum(size[d] for d, _, x in docs if x == s) for s in sources}
    capped, level = set(), 0.0
    while True:
        free = [s for s in sources if s not in capped]
        if not free:
            break
        level = (1.5 * sum(total.values()) - 2 * sum(total[s] for s in capped)) / sum(weight[s] for s in free)
        more = {s for s in free if 2 * total[s] <= level * weight[s]}
        if not more:
            break
        capped |= more
    out = {}
    for s in sources:
        target = min(2.0 * total[s], level * weight[s])
        times = math.floor(target / total[s])
        rest, before = target - times * total[s], 0
        for d in sorted((d for d, _, x in docs if x == s), key=order.get):
            out[d] = times + (2 * before + size[d] <= 2 * rest and rest > 0)
            before += size[d]
    return out


def test_stages(spark, sf_dir):
    import corpus_pipeline as p
    from embra.llm.common import stage as written
    from embra.llm.queries import tokenizer_json
    from tokenizers import Tokenizer
    assert [n for n, _ in p.STAGES] == ["language_id", "simhash_near_dedup", "decontamination", "mixing", "token_files"]
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, f in p.STAGES[:-1]:
        docs = written(f(spark, docs, sf_dir), "test")
        assert docs.columns == COLUMNS, name
        kept.append([(r["doc_id"], r["text"], r["source"], r["lang"]) for r in docs.collect()])
    language, single, clean, mix = ([r[:3] for r in k] for k in kept)
    source = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    # clean documents stay, those without letters go, unknown languages are filled in
    assert {d for d, _, _ in language} == set(source) - {400, 401, 402}
    assert all(lang == "ab"[d % 2] * 2 for d, _, _, lang in kept[0] if d < 120)
    f = [brute.fingerprint(t) for _, t, _ in language]
    links = [(a, b) for a in range(len(f)) for b in range(a) if bin(f[a] ^ f[b]).count("1") <= 3]
    groups = {}
    for r, (d, _, _) in zip(brute.roots(len(f), links), language):
        groups.setdefault(r, []).append(d)
    assert sorted(d for d, _, _ in single) == sorted(map(min, groups.values())) and len(single) < len(language)
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    bad = {r[0] for r in brute.contamination([(d, t) for d, t, _ in single], bench) if r[4]}
    assert bad and {d for d, _, _ in clean} == {d for d, _, _ in single} - bad
    times = mixed(clean)
    got = {d: sum(x == d for x, _, _ in mix) for d, _, _ in clean}
    assert got == times and all(source[d] == t for d, t, _ in mix)
    # the last stage, and the whole run
    tok, at, want = Tokenizer.from_str(tokenizer_json()), 0, []
    for d, t, _ in sorted(mix, key=lambda r: r[0]):
        ids = tok.encode(t, add_special_tokens=False).ids + [2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    last = p.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert sorted(map(tuple, last)) == want
    assert sorted(map(tuple, p.run(spark, sf_dir).collect())) == want


def test_an_unsure_model_removes_no_document_with_a_given_language(spark, sf_dir, monkeypatch):
    import corpus_pipeline as p
    from embra.llm import langid
    n = 1 << langid.DIM_BITS
    unsure = langid.LanguageModel(["aa", "bb", "cc"], np.ones(n), np.zeros((n + 1, 3)), 1.0, langid.DIM_BITS)
    monkeypatch.setattr(langid, "train", lambda docs: unsure)  # every score is 1/3
    rows = [(1, "lo mi ra", "aa"), (2, "ka", "bb"), (3, "ra lo", None), (4, "12 !", "aa"), (5, None, "aa")]
    docs = spark.createDataFrame([(i, t, g, "s1", 3) for i, t, g in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["lang"] for r in p.identify_language(spark, docs, sf_dir).collect()}
    assert got == {1: "aa", 2: "bb"}


def test_empty_documents(spark, sf_dir, tmp_path):
    import corpus_pipeline as p
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert p.run(spark, str(tmp_path)).count() == 0
