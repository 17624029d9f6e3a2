"""The registered queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import table
from . import mix as mix_op
from . import align, decontam, langid, quality, quotes, rollup, simhash, substring, tokens, vectors, warc, whiten
from .common import scratch_uri, stage, word_count

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


@query("op1_mix_sources", "WITH " + mix_op.ORACLE_TARGETS.format(docs="documents") + """
SELECT doc_id, size, n AS source_size, target, size * times AS taken FROM mixed""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix_op.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return m.select("row.doc_id", "size", "source_size", "target",
                    (F.col("size") * F.col("copies")).alias("taken"))


AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TERMS_SQL = f"regexp_extract_all({AZ}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query("op2_benchmark_decontamination", f"""
WITH d AS (SELECT doc_id, {TERMS_SQL} AS w FROM documents),
i AS (SELECT item_id, {TERMS_SQL} AS w FROM benchmark),
win AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, len(x) AS n, array_to_string(x, ' ') AS words FROM (
    SELECT item_id, unnest(list_transform(range(1, greatest(len(w) - 13, 0) + 2), lambda s: w[s:s + 12])) AS x
    FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens),
occ AS (SELECT p.doc_id, p.s, p.n, win.item FROM pos p
    JOIN win ON win.n = p.n AND win.words = array_to_string(p.w[p.s:p.s + p.n - 1], ' ')),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (
    SELECT doc_id, unnest(range(s, s + n)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
    FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"),
                               length=13, share=20)
    return c.select(F.col("key").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


WORDS_SQL = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"


@query("op3_substring_dedup", f"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
pos AS (SELECT doc_id, s, array_to_string(w[s:s + 12], ' ') AS x
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d)),
low AS (SELECT x, min(doc_id) AS m FROM pos GROUP BY x),
cover AS (SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS p FROM pos JOIN low USING (x) WHERE m < doc_id),
word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM word ANTI JOIN cover USING (doc_id, p) GROUP BY doc_id),
gone AS (SELECT doc_id, count(*) AS n FROM cover GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = substring.remove_repeats(table(spark, sf_dir, "documents"), k=13)
    return r.select(F.col("key").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op4_simhash_near_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, bits=3)
    return near.select(F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                       F.col("component").alias("component_id"))


@query("op8_warc_archives", """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS last, count(*) AS n FROM p WHERE strlen(h) >= 1000 GROUP BY h)
SELECT page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, sha1(p.h) AS payload_digest,
    CASE WHEN n > 1 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN n > 1 AND page_id <> last THEN last END AS refers_to
FROM p LEFT JOIN g ON p.h = g.h""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_uri(spark, "warc")
    files = warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, folder, files).select(
        F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = langid.fold(F.col("doc_id")) == 0
    model = langid.train(docs.filter(~held))
    out = langid.predict(docs.select("doc_id", held.alias("held_out"), "text"), model,
                         keep=["doc_id", "held_out"])
    return out.select("row.doc_id", "row.held_out", "lang_pred", "score")


@query("op10_embedding_near_dedup", """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
ok AS (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM v WHERE label IS NOT NULL AND e IS NOT NULL
    AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_dot_product(e, e) > 0),
link AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
    AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT v.vec_id, (SELECT count(*) FROM link l WHERE l.a = v.vec_id) AS n_links, comp.c AS component_id,
    v.vec_id = comp.c AS kept FROM v JOIN comp ON comp.a = v.vec_id""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = vectors.near_duplicate_vectors(table(spark, sf_dir, "embeddings"), cosine=0.98)
    return near.select(F.col("key").alias("vec_id"), "n_links",
                       F.col("component").alias("component_id"), "kept")


# the same class of characters for Java; lower-casing beyond A-Z doesn't change it
TERMS_JAVA = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@query("op5_quotation_linking", r"""
WITH RECURSIVE t AS (SELECT conv_id, turn, min(coalesce(text, '')) AS text FROM conversations
    WHERE turn IS NOT NULL GROUP BY conv_id, turn),
line AS (SELECT conv_id, turn, x FROM (SELECT conv_id, turn, unnest(string_split_regex(text, '
|
|
')) AS x FROM t)),
own AS (SELECT conv_id, turn, lower(trim(regexp_replace(x, '\s+', ' ', 'g'))) AS clean, length(x) AS size FROM line
    WHERE trim(regexp_replace(x, '\s+', ' ', 'g')) <> ''),
first AS (SELECT conv_id, clean, min(turn) AS origin FROM own GROUP BY conv_id, clean),
quoted AS (SELECT o.conv_id, o.turn + k AS turn, k AS level, o.size,
    CASE WHEN f.origin < o.turn + k THEN f.origin END AS origin
    FROM own o, (SELECT unnest([1, 2]) AS k) ks, t, first f
    WHERE t.conv_id = o.conv_id AND t.turn = o.turn + k AND f.conv_id = o.conv_id AND f.clean = o.clean),
cnt AS (SELECT conv_id, turn, max(level) AS quote_levels, count(*) AS n_quoted, count(origin) AS n_linked
    FROM quoted GROUP BY conv_id, turn),
votes AS (SELECT conv_id, turn, level, origin, sum(size) AS size FROM quoted WHERE origin IS NOT NULL
    GROUP BY conv_id, turn, level, origin),
best AS (SELECT conv_id, turn, origin AS reply_to FROM (SELECT *, row_number() OVER (
    PARTITION BY conv_id, turn ORDER BY level, size DESC, origin) AS r FROM votes) WHERE r = 1),
m AS (SELECT t.conv_id, t.turn, t.text, b.reply_to, coalesce(quote_levels, 0) AS quote_levels,
    coalesce(n_quoted, 0) AS n_quoted, coalesce(n_linked, 0) AS n_linked
    FROM t LEFT JOIN cnt USING (conv_id, turn) LEFT JOIN best b USING (conv_id, turn)),
chain AS (SELECT conv_id, turn, turn AS thread, 0 AS depth FROM m WHERE reply_to IS NULL
    UNION ALL SELECT m.conv_id, m.turn, c.thread, c.depth + 1 FROM m JOIN chain c
    ON c.conv_id = m.conv_id AND c.turn = m.reply_to)
SELECT m.conv_id, m.turn, m.reply_to, c.thread, CAST(c.depth AS BIGINT) AS depth,
    row_number() OVER (PARTITION BY m.conv_id, c.thread ORDER BY c.depth, m.turn) - 1 AS position,
    m.quote_levels, m.n_quoted, m.n_linked,
    sha256(regexp_replace(regexp_replace(array_to_string(string_split_regex(m.text, '
|
|
'), chr(10)),
        '^\s*
', ''), '\s+$', '')) AS own_sha256
FROM m JOIN chain c ON c.conv_id = m.conv_id AND c.turn = m.turn""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    mails = quotes.as_quoted_mail(table(spark, sf_dir, "conversations"), levels=2)
    out = quotes.link_quotes(mails)
    return out.select(F.col("scope").alias("conv_id"), F.col("order").alias("turn"), "reply_to", "thread", "depth",
                      "position", "quote_levels", "n_quoted", "n_linked", F.sha2("own", 256).alias("own_sha256"))


@query("op6_token_rollups", f"""
WITH d AS (SELECT doc_id, source, lang, len({WORDS_SQL}) AS n1, len({TERMS_SQL}) AS n2,
    CASE WHEN text IS NULL THEN TRUE ELSE doc_id = min(doc_id) OVER (PARTITION BY text) END AS stays FROM documents),
c AS (SELECT source, lang, CASE WHEN lang IS DISTINCT FROM 'en' THEN 'terms-2' ELSE 'words-1' END AS tokenizer,
    CASE WHEN lang IS DISTINCT FROM 'en' THEN n2 ELSE n1 END AS n FROM d WHERE stays)
SELECT source, lang, tokenizer, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM c GROUP BY ALL""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches over all documents: load, removal of exact copies, recounting of what
    isn't English under a new tokenizer version, and the second batch once more."""
    docs = table(spark, sf_dir, "documents")
    d = docs.select("doc_id", "source", "lang", F.md5("text").alias("same"), word_count(F.col("text")).alias("words"),
                    F.coalesce(F.regexp_count(F.lower("text"), F.lit(TERMS_JAVA)), F.lit(0)).cast("long").alias("terms"))
    d = stage(d, "counts")
    first = d.filter("same is not null").groupBy("same").agg(F.min("doc_id").alias("first"))
    d = stage(d.join(first, "same", "left").withColumn(
        "copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))), "counts")

    def counted(rows, version, column):
        return rows.select("source", "lang", F.lit(version).alias("tokenizer"), F.col(column).alias("tokens"))

    store = rollup.TokenRollup(spark, scratch_uri(spark, "rollup"))
    anew = d.filter(~F.col("copy") & ~F.col("lang").eqNullSafe(F.lit("en")))
    removal = rollup.deletes(counted(d.filter("copy"), "words-1", "words"))
    store.apply("load", rollup.inserts(counted(d, "words-1", "words")))
    store.apply("copies", removal)
    store.apply("recount", rollup.revisions(counted(anew, "words-1", "words"), counted(anew, "terms-2", "terms")))
    store.apply("copies", removal)
    return store.totals()


def tokenizer_json(path: str | None = None) -> str:
    """Text of a vocabulary file; by default the installed byte-level BPE."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def token_digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    folder = scratch_uri(spark, "tokens")
    files = tokens.write_token_files(docs, folder, tokenizer_json(), end_id=2)
    return tokens.read_token_files(spark, folder, files).withColumnRenamed("key", "doc_id")


@query("op7_token_id_files")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(spark, table(spark, sf_dir, "documents"))


@query("op12_embedding_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = whiten.whiten_vectors(table(spark, sf_dir, "embeddings"), components=32, weights="counts")
    return w.select(F.col("key").alias("vec_id"), "n", "deviation", "identity_error",
                    F.posexplode(F.arrays_zip("z", "explained")).alias("c", "v")).select(
        "vec_id", (F.col("c") + 1).alias("component"), "n", "deviation", F.col("v.z").alias("whitened"),
        F.col("v.explained").alias("explained"), "identity_error")


@query("op11_quality_rules", f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS_SQL} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
    FROM documents),
pos AS (SELECT doc_id, s, array_to_string(w[s:s + 4], ' ') AS x
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS s FROM d)),
twice AS (SELECT doc_id, x FROM pos GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS r FROM (
    SELECT doc_id, unnest(range(s, s + 5)) AS p FROM pos JOIN twice USING (doc_id, x)) GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(r, 0) AS n_repeat_words, len(l) AS n_lines,
    len(list_filter(l, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$'))) AS n_cut,
    len(list_filter(w, lambda x: regexp_matches(x, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]'))) AS n_alpha
    FROM d LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    n_words >= 10 AND 100 * n_repeat_words <= 20 * n_words AND word_chars BETWEEN 2 * n_words AND 15 * n_words
        AND n_symbols <= n_words AND 2 * n_dup_lines <= n_lines AND 10 * n_cut <= 3 * n_lines
        AND 2 * n_alpha >= n_words AS kept
FROM m""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base measures of every document and the verdict of the cascade, of which the two base rules are part."""
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    q = quality.quality_cascade(table(spark, sf_dir, "documents"), report=base)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return q.select(F.col("key").alias("doc_id"), *base, failed.alias("base_failed"), "kept")


def public_file(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op13_tokenizer_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_file("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    out = align.align_tokenizers(table(spark, sf_dir, "documents"), tokenizer_json(), model)
    return out.withColumnRenamed("key", "doc_id")
