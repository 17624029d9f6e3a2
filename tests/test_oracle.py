"""Registered queries against their DuckDB twins on sf0.001 (a cross-section;
tools/oracle_check.py runs all of them)."""

import pytest

from tools.oracle_check import check_one, duck

NAMES = [
    "knn_cat", "simple_preprocess", "deaccent", "word_count", "corpus_stats", "vocab_prune", "doc_ids",
    "sent_cat_pairs", "noise_dist", "subsample_prob", "sent_to_cat", "oov_words", "words_to_vocab_gaps",
    "ctx_window", "neg_sample", "lr_schedule", "d2v_dm_neg_adadelta", "c2v_dbow_hs_adam", "w2v_cbow_hs",
    "knn_pair_sum_ident", "knn_joint_sum_sent", "eval_cat", "confusion", "corpus_to_dense", "sparse_clip",
    "sparse_cosine", "knn_word_analogy", "analogy_accuracy", "infer_category", "src_wiki_sampled",
    "src_text8", "src_questions", "w2v_binary", "mm_roundtrip", "stream_word_count", "huffman_part",
    "vocab_reuse", "c2v_dbow_hs_sgd_mean", "decode_html", "to_unicode_policies", "most_similar",
    "word_similarity", "doesnt_match", "eval_limit", "word_dists", "epoch_loop",
]


@pytest.fixture(scope="module")
def registry():
    import __spark_entry__ as E
    return E.queries(), E.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", NAMES)
def test_matches_duckdb(spark, sf, con, registry, name):
    qs, sqls = registry
    assert name in sqls
    status, detail = check_one(spark, con, qs[name], sqls[name], sf)
    assert status == "ok", detail


def test_every_query_has_a_twin_or_is_documented(registry):
    from embra.plans.registry import ORACLE, QUERIES
    assert sorted(set(QUERIES) - set(ORACLE)) == ["eval_cat_trained", "eval_joint_cat_trained",
                                                  "eval_joint_sent_trained", "eval_sent_trained", "huffman"]
    assert set(QUERIES) <= set(registry[0])
