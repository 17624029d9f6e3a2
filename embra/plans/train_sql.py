"""DuckDB twin of the training operators: builds the SQL text for
vocabulary + Huffman tree + noise table + examples + K chained
mini-batch updates, mirroring :mod:`embra.operators.train` step by step.

The Huffman tree is built with a recursive CTE (two lightest nodes merged
per iteration), so it is only used on small vocabularies.
"""

from __future__ import annotations

from ..functions.vectors import keyed_draw_sql
from ..operators.train import (ADADELTA_EPS, ADADELTA_RHO, ADAGRAD_EPS, ADAM_A, ADAM_B1, ADAM_B2,
                               ADAM_L, MAX_EXP, TrainSpec, doc_denominator, word_denominator)
from . import sqlh


def fl(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def u(seed, kind: str, epoch: int, *keys: str) -> str:
    return keyed_draw_sql(seed, kind, epoch, *keys)


def vocab_sql(spec: TrainSpec) -> list[str]:
    """CTEs: wc, vocab0, nv, [huffman], [noise], vocab."""
    ctes = [
        "wc AS (SELECT word, count(*) AS cnt FROM (SELECT unnest(words) AS word FROM corpus) GROUP BY word)",
        f"vocab0 AS (SELECT word, cnt, row_number() OVER (ORDER BY cnt DESC, word) - 1 AS idx "
        f"FROM wc WHERE cnt >= {spec.min_count})",
        "nv AS (SELECT count(*) AS V FROM vocab0)",
    ]
    if spec.sample:
        ctes.append(f"vocab1 AS (SELECT word, cnt, idx, least((sqrt(cnt / t) + 1) * (t / cnt), "
                    f"{fl(1.0)}) AS sample_prob FROM vocab0, (SELECT sum(cnt) * {fl(spec.sample)} AS t "
                    f"FROM vocab0))")
    else:
        ctes.append(f"vocab1 AS (SELECT word, cnt, idx, {fl(1.0)} AS sample_prob FROM vocab0)")
    cols = ["v.word", "v.cnt", "v.idx", "v.sample_prob"]
    joins = ""
    if spec.hs:
        ctes += huffman_sql("vocab0")
        cols += ["hp.code", "hp.point"]
        joins += " JOIN hpaths hp ON hp.node = v.idx"
    if spec.negative:
        ctes.append(
            "noise AS (SELECT idx, (cum - w) / z AS noise_lo, CASE WHEN idx = V - 1 THEN "
            f"{fl(1.0)} ELSE cum / z END AS noise_hi FROM (SELECT idx, w, sum(w) OVER (ORDER BY idx "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum, sum(w) OVER () AS z FROM "
            f"(SELECT idx, pow(cnt::DOUBLE, {fl(0.75)}) AS w FROM vocab0)), nv)")
        cols += ["nz.noise_lo", "nz.noise_hi"]
        joins += " JOIN noise nz ON nz.idx = v.idx"
    ctes.append(f"vocab AS (SELECT {', '.join(cols)} FROM vocab1 v{joins})")
    return ctes


def huffman_sql(vocab: str) -> list[str]:
    return [
        f"hheap(step, heap, merges) AS (SELECT 0, list(struct_pack(c := cnt, n := idx) "
        f"ORDER BY cnt, idx), []::STRUCT(node BIGINT, l BIGINT, r BIGINT)[] FROM {vocab} "
        "UNION ALL SELECT step + 1, list_sort(list_concat(heap[3:], [struct_pack(c := heap[1].c + "
        "heap[2].c, n := (SELECT V FROM nv) + step)])), list_append(merges, struct_pack(node := "
        "(SELECT V FROM nv) + step, l := heap[1].n, r := heap[2].n)) FROM hheap WHERE len(heap) > 1)",
        "htree AS (SELECT unnest(merges, recursive := true) FROM hheap WHERE len(heap) = 1)",
        "hkids AS (SELECT node, l AS child, 0 AS bit FROM htree UNION ALL "
        "SELECT node, r AS child, 1 AS bit FROM htree)",
        "hpaths(node, code, point) AS (SELECT max(node), []::TINYINT[], []::INTEGER[] FROM htree "
        "UNION ALL SELECT k.child, list_append(p.code, CAST(k.bit AS TINYINT)), "
        "list_append(p.point, CAST(p.node - (SELECT V FROM nv) AS INTEGER)) FROM hpaths p "
        "JOIN hkids k ON k.node = p.node)",
    ]


def ids_sql(spec: TrainSpec) -> list[str]:
    ctes = ["docs AS (SELECT sent_id, row_number() OVER (ORDER BY first_line, sent_id) - 1 AS sent_no "
            "FROM (SELECT sent_id, min(line_no) AS first_line FROM corpus GROUP BY sent_id))"]
    if spec.family == "cat":
        ctes.append("cats AS (SELECT cat_id, row_number() OVER (ORDER BY first_line, cat_id) - 1 AS cat_no "
                    "FROM (SELECT cat_id, min(line_no) AS first_line FROM corpus GROUP BY cat_id))")
    return ctes


def lines_sql(spec: TrainSpec, epoch: int = 0, tag: str = "", corpus: str = "corpus",
              docs: str = "docs", cats: str = "cats", keep_oov: bool = False,
              cat_fixed: str | None = None) -> list[str]:
    """toks, lines0, lines CTEs (names suffixed by ``tag``).  ``keep_oov``
    keeps out-of-vocabulary tokens as NULL (inference); ``cat_fixed`` gives
    every line the same category number."""
    sub = ""
    if spec.sample and not keep_oov:
        sub = (f" WHERE v.sample_prob >= 1.0 OR v.sample_prob >= "
               + u(spec.seed, "sub", epoch, "t.line_no", "t.opos"))
    join = "LEFT JOIN" if keep_oov else "JOIN"
    if cat_fixed is not None:
        cat_join, cat_col = "", f"CAST({cat_fixed} AS BIGINT)"
    elif spec.family == "cat":
        cat_join, cat_col = f"LEFT JOIN {cats} c ON c.cat_id = l.cat_id", "c.cat_no"
    else:
        cat_join, cat_col = "", "CAST(NULL AS BIGINT)"
    sent_join = f"LEFT JOIN {docs} d ON d.sent_id = l.sent_id" if spec.family != "word" else ""
    sent_col = "d.sent_no" if spec.family != "word" else "CAST(NULL AS BIGINT)"
    return [
        f"toks{tag} AS (SELECT line_no, sent_id, cat_id, unnest(words) AS word, "
        f"generate_subscripts(words, 1) - 1 AS opos FROM {corpus})",
        f"lines0{tag} AS (SELECT t.line_no, t.sent_id, t.cat_id, list(v.idx ORDER BY t.opos) AS idxs "
        f"FROM toks{tag} t {join} vocab v ON v.word = t.word{sub} GROUP BY t.line_no, t.sent_id, t.cat_id)",
        f"lines{tag} AS (SELECT l.line_no, {sent_col} AS sent_no, {cat_col} AS cat_no, l.idxs "
        f"FROM lines0{tag} l {sent_join} {cat_join})",
    ]


def pos_sql(spec: TrainSpec, epoch: int = 0, tag: str = "", lines: str = "lines") -> list[str]:
    """Positions with reduced windows (pos0/pos1/pos/ctxx + tag); NULL
    (out-of-vocabulary) tokens are neither centres nor context."""
    w = spec.window
    b = "floor(" + u(spec.seed, "win", epoch, "line_no", "i") + f" * {w})"
    return [
        f"pos0{tag} AS (SELECT line_no, sent_no, cat_no, idxs, unnest(range(0, len(idxs))) AS i "
        f"FROM {lines} WHERE len(idxs) > 0)",
        f"pos1{tag} AS (SELECT line_no, sent_no, cat_no, idxs, i, CAST(greatest(0, i - {w} + {b}) AS BIGINT) AS lo, "
        f"CAST(least(len(idxs) - 1, i + {w} - {b}) AS BIGINT) AS hi FROM pos0{tag})",
        f"pos{tag} AS (SELECT line_no, sent_no, cat_no, i, idxs[i + 1] AS word, lo, idxs[lo + 1:hi + 1] AS ctx, "
        f"((line_no + floor(i / {spec.slice_len})) % {spec.batches}) AS batch FROM pos1{tag} "
        f"WHERE idxs[i + 1] IS NOT NULL)",
        f"ctxx{tag} AS (SELECT * FROM (SELECT line_no, sent_no, cat_no, i, word, batch, unnest(ctx) AS cword, "
        f"lo + generate_subscripts(ctx, 1) - 1 AS j FROM pos{tag}) WHERE cword IS NOT NULL)",
    ]


def examples_sql(spec: TrainSpec, b: int, tag: str = "", epoch: int = 0) -> list[str]:
    bf = f"batch = {b}"
    pos, ctxx = f"pos{tag}", f"ctxx{tag}"
    n = f"{tag}{b}"
    if spec.arch == "sg":
        if spec.family == "word":
            ins = (f"SELECT line_no, i, j, 'syn0' AS in_kind, cword AS in_id, {fl(1.0)} AS in_w "
                   f"FROM {ctxx} WHERE j <> i AND {bf}")
            tg = f"SELECT line_no, i, j, word AS target FROM {ctxx} WHERE j <> i AND {bf}"
        else:
            ins = (f"SELECT line_no, i, j, 'sent' AS in_kind, sent_no AS in_id, {fl(1.0)} AS in_w "
                   f"FROM {ctxx} WHERE {bf}")
            if spec.family == "cat":
                ins += (f" UNION ALL SELECT line_no, i, j, 'cat' AS in_kind, cat_no AS in_id, "
                        f"{fl(1.0)} AS in_w FROM {ctxx} WHERE {bf}")
            tg = f"SELECT line_no, i, j, cword AS target FROM {ctxx} WHERE {bf}"
    else:
        extra = {"word": 0, "sent": 1, "cat": 2}[spec.family]
        nctx = "(len(list_filter(ctx, lambda x: x IS NOT NULL)) - 1)"
        wexpr = (f"CASE WHEN {nctx} + {extra} > 0 THEN {fl(1.0)} / ({nctx} + {extra}) ELSE {fl(1.0)} END"
                 if spec.cbow_mean else fl(1.0))
        pw = f"(SELECT line_no, i, sent_no, cat_no, word, {wexpr} AS in_w FROM {pos} WHERE {bf})"
        ins = (f"SELECT c.line_no, c.i, CAST(-1 AS BIGINT) AS j, 'syn0' AS in_kind, c.cword AS in_id, p.in_w "
               f"FROM {ctxx} c JOIN {pw} p ON p.line_no = c.line_no AND p.i = c.i WHERE c.j <> c.i")
        if extra >= 1:
            ins += (f" UNION ALL SELECT line_no, i, CAST(-1 AS BIGINT) AS j, 'sent' AS in_kind, "
                    f"sent_no AS in_id, in_w FROM {pw}")
        if extra == 2:
            ins += (f" UNION ALL SELECT line_no, i, CAST(-1 AS BIGINT) AS j, 'cat' AS in_kind, "
                    f"cat_no AS in_id, in_w FROM {pw}")
        tg = f"SELECT line_no, i, CAST(-1 AS BIGINT) AS j, word AS target FROM {pos} WHERE {bf}"
    outs = []
    if spec.hs:
        outs.append(f"SELECT line_no, i, j, 'syn1' AS out_kind, CAST(pt AS BIGINT) AS out_id, "
                    f"{fl(1.0)} - cd AS label FROM (SELECT t.line_no, t.i, t.j, unnest(v.point) AS pt, "
                    f"unnest(v.code) AS cd FROM tg{n} t JOIN vocab v ON v.idx = t.target)")
    if spec.negative:
        outs.append(f"SELECT line_no, i, j, 'syn1neg' AS out_kind, target AS out_id, {fl(1.0)} AS label "
                    f"FROM tg{n}")
        draws = (f"(SELECT line_no, i, j, target, "
                 + u(spec.seed, "neg", epoch, "line_no", "i", "j", "d") + " AS u FROM "
                 f"(SELECT *, unnest(range(1, {spec.negative + 1})) AS d FROM tg{n}))")
        outs.append(f"SELECT r.line_no, r.i, r.j, 'syn1neg' AS out_kind, v.idx AS out_id, {fl(0.0)} AS label "
                    f"FROM {draws} r JOIN vocab v ON r.u >= v.noise_lo AND r.u < v.noise_hi "
                    f"WHERE v.idx <> r.target")
    return [f"ins{n} AS ({ins})", f"tg{n} AS ({tg})", f"outs{n} AS ({' UNION ALL '.join(outs)})"]


def step_sql(spec: TrainSpec, b: int, p_in: str, p_out: str, alpha_sql: str, tag: str = "",
             epoch: int = 0, p_lookup: str | None = None) -> list[str]:
    """One synchronous step: parameters are read from ``p_lookup`` (default
    ``p_in``) and the update is applied to the rows of ``p_in``."""
    key = ["line_no", "i", "j"]
    agg = "avg" if spec.combine == "mean" else "sum"
    lk = p_lookup or p_in
    n = f"{tag}{b}"
    ctes = examples_sql(spec, b, tag, epoch)
    ctes.append(f"l1p{n} AS (SELECT x.line_no, x.i, x.j, list_transform(p.vec, lambda z: z * x.in_w) AS wv "
                f"FROM ins{n} x JOIN {lk} p ON p.kind = x.in_kind AND p.id = x.in_id)")
    ctes.append(f"l1{n} AS {sqlh.vec_agg(f'l1p{n}', key, 'wv', 'sum', 'l1')}")
    ctes.append(f"rows{n} AS (SELECT *, {fl(1.0)} * label - {fl(1.0)} / ({fl(1.0)} + exp(-dt)) AS g FROM ("
                f"SELECT o.line_no, o.i, o.j, o.out_kind, o.out_id, o.label, l.l1, p.vec AS ovec, "
                f"list_dot_product(l.l1, p.vec) AS dt FROM outs{n} o "
                f"JOIN l1{n} l ON l.line_no = o.line_no AND l.i = o.i AND l.j = o.j "
                f"JOIN {lk} p ON p.kind = o.out_kind AND p.id = o.out_id) WHERE abs(dt) < {fl(MAX_EXP)})")
    parts = []
    if spec.word_learn:
        ctes.append(f"gop{n} AS (SELECT out_kind AS kind, out_id AS id, list_transform(l1, lambda z: z * g) AS gv "
                    f"FROM rows{n})")
        ctes.append(f"gout{n} AS {sqlh.vec_agg(f'gop{n}', ['kind', 'id'], 'gv', agg, 'grad')}")
        parts.append(f"SELECT kind, id, grad FROM gout{n}")
    ctes.append(f"ep{n} AS (SELECT line_no, i, j, list_transform(ovec, lambda z: z * g) AS gv FROM rows{n})")
    ctes.append(f"e{n} AS {sqlh.vec_agg(f'ep{n}', key, 'gv', 'sum', 'e')}")
    learn = ["'sent'"] + (["'syn0'"] if spec.word_learn else []) + (["'cat'"] if spec.cat_learn else [])
    ctes.append(f"gip{n} AS (SELECT x.in_kind AS kind, x.in_id AS id, e.e FROM ins{n} x JOIN e{n} e "
                f"ON e.line_no = x.line_no AND e.i = x.i AND e.j = x.j WHERE x.in_kind IN ({', '.join(learn)}))")
    ctes.append(f"gin{n} AS {sqlh.vec_agg(f'gip{n}', ['kind', 'id'], 'e', agg, 'grad')}")
    parts.append(f"SELECT kind, id, grad FROM gin{n}")
    ctes.append(f"grads{n} AS ({' UNION ALL '.join(parts)})")
    ctes.append(f"{p_out} AS ({update_sql(spec, f'grads{n}', p_in, alpha_sql)})")
    return ctes


def update_sql(spec: TrainSpec, grads: str, p_in: str, alpha_from: str) -> str:
    alpha = "al.alpha"
    d = spec.size
    o = spec.optimizer
    if o == "sgd":
        nv = f"list_transform(p.vec, lambda x, k: x + {alpha} * g.grad[k])"
        ns = "p.state"
    elif o == "adagrad":
        s2 = f"list_transform(p.state, lambda x, k: x + g.grad[k] * g.grad[k])"
        nv = (f"list_transform(p.vec, lambda x, k: x + {alpha} * g.grad[k] / sqrt({fl(ADAGRAD_EPS)} + "
              f"(p.state[k] + g.grad[k] * g.grad[k])))")
        ns = s2
    elif o == "adadelta":
        rho = fl(ADADELTA_RHO)
        sg = f"({rho} * p.state[k] + (1 - {rho}) * g.grad[k] * g.grad[k])"
        dl = f"(sqrt({fl(ADADELTA_EPS)} + p.state[k + {d}]) / sqrt({fl(ADADELTA_EPS)} + {sg}) * g.grad[k])"
        nv = f"list_transform(p.vec, lambda x, k: x + {dl})"
        ns = (f"list_concat(list_transform(range(1, {d + 1}), lambda k: {sg}), "
              f"list_transform(range(1, {d + 1}), lambda k: {rho} * p.state[k + {d}] + (1 - {rho}) * {dl} * {dl}))")
    else:
        b1t, p1, p2 = f"p.state[{2 * d + 1}]", f"p.state[{2 * d + 2}]", f"p.state[{2 * d + 3}]"
        m = f"({b1t} * p.state[k] + (1 - {b1t}) * g.grad[k])"
        vv = f"({fl(ADAM_B2)} * p.state[k + {d}] + {fl(1 - ADAM_B2)} * g.grad[k] * g.grad[k])"
        nv = (f"list_transform(p.vec, lambda x, k: x + {fl(ADAM_A)} * {m} * ({fl(1.0)} / (1 - {p1})) / "
              f"sqrt({fl(ADAGRAD_EPS)} + {vv} * ({fl(1.0)} / (1 - {p2}))))")
        ns = (f"list_concat(list_transform(range(1, {d + 1}), lambda k: {m}), "
              f"list_transform(range(1, {d + 1}), lambda k: {vv}), "
              f"[{b1t} * {fl(ADAM_L)}, {p1} * {fl(ADAM_B1)}, {p2} * {fl(ADAM_B2)}])")
    return (f"SELECT p.kind, p.id, CASE WHEN g.grad IS NULL THEN p.vec ELSE {nv} END AS vec, "
            f"CASE WHEN g.grad IS NULL THEN p.state ELSE {ns} END AS state "
            f"FROM {p_in} p LEFT JOIN {grads} g ON g.kind = p.kind AND g.id = p.id, "
            f"({alpha_from}) al")


def rand_vec_sql(spec: TrainSpec, kind: str, idcol: str, denom: float) -> str:
    return (f"list_transform(range(0, {spec.size}), lambda k: ({sqlh.keyed_uniform(spec.seed, repr(kind), idcol, 'k')} "
            f"- {fl(0.5)}) / {fl(denom)})")


def state_sql(spec: TrainSpec) -> str:
    d = spec.size
    return {"sgd": "[]::DOUBLE[]",
            "adagrad": f"list_transform(range(0, {d}), lambda k: {fl(0.0)})",
            "adadelta": f"list_transform(range(0, {2 * d}), lambda k: {fl(0.0)})",
            "adam": f"list_concat(list_transform(range(0, {2 * d}), lambda k: {fl(0.0)}), "
                    f"[{fl(ADAM_B1)}, {fl(ADAM_B1)}, {fl(ADAM_B2)}])"}[spec.optimizer]


def init_params_sql(spec: TrainSpec) -> str:
    d = spec.size
    zero = f"list_transform(range(0, {d}), lambda k: {fl(0.0)})"
    parts = [f"SELECT 'syn0' AS kind, idx AS id, {rand_vec_sql(spec, 'syn0', 'idx', word_denominator(spec))} "
             f"AS vec FROM vocab"]
    if spec.hs:
        parts.append(f"SELECT 'syn1' AS kind, idx AS id, {zero} AS vec FROM vocab "
                     f"WHERE idx < (SELECT max(idx) FROM vocab)")
    if spec.negative:
        parts.append(f"SELECT 'syn1neg' AS kind, idx AS id, {zero} AS vec FROM vocab")
    if spec.family in ("sent", "cat"):
        parts.append(f"SELECT 'sent' AS kind, sent_no AS id, "
                     f"{rand_vec_sql(spec, 'sent', 'sent_no', doc_denominator(spec))} AS vec FROM docs")
    if spec.family == "cat":
        parts.append(f"SELECT 'cat' AS kind, cat_no AS id, "
                     f"{rand_vec_sql(spec, 'cat', 'cat_no', doc_denominator(spec))} AS vec FROM cats")
    return f"SELECT kind, id, vec, {state_sql(spec)} AS state FROM ({' UNION ALL '.join(parts)})"


def alphas_sql(spec: TrainSpec, tag: str = "") -> list[str]:
    """Per-batch learning rates (SGD decay by words of earlier batches)."""
    if spec.optimizer != "sgd" or spec.batches == 1:
        return [f"alphas{tag} AS (SELECT b, {fl(spec.alpha)} AS alpha FROM range(0, {spec.batches}) t(b))"]
    return [
        f"tw{tag} AS (SELECT sum(cnt * sample_prob) AS total FROM vocab)",
        f"bw{tag} AS (SELECT b, coalesce((SELECT count(*) FROM pos{tag} WHERE batch < b), 0) AS done "
        f"FROM range(0, {spec.batches}) t(b))",
        f"alphas{tag} AS (SELECT b, greatest({fl(spec.min_alpha)}, {fl(spec.alpha)} * (1 - done / total)) AS alpha "
        f"FROM bw{tag}, tw{tag})",
    ]


def prefix_ctes(spec: TrainSpec, corpus_sql: str, with_pos: bool = True) -> list[str]:
    """corpus, vocabulary, ids, lines [and positions] CTEs."""
    ctes = [f"corpus AS ({corpus_sql})"] + vocab_sql(spec)
    if spec.family != "word":
        ctes += ids_sql(spec)
    ctes += lines_sql(spec)
    if with_pos:
        ctes += pos_sql(spec)
    return ctes


def train_ctes(spec: TrainSpec, corpus_sql: str) -> tuple[list[str], str]:
    """CTEs of one epoch; returns (ctes, name of the final params CTE)."""
    ctes = prefix_ctes(spec, corpus_sql)
    ctes.append(f"p0 AS ({init_params_sql(spec)})")
    ctes += alphas_sql(spec)
    for b in range(spec.batches):
        ctes += step_sql(spec, b, f"p{b}", f"p{b + 1}", f"SELECT alpha FROM alphas WHERE b = {b}")
    return ctes, f"p{spec.batches}"


def train_sql(spec: TrainSpec, corpus_sql: str) -> str:
    """Full SQL: params after one epoch of ``spec.batches`` mini-batches."""
    ctes, final = train_ctes(spec, corpus_sql)
    sel = (f"SELECT kind, id, {sqlh.r6_list('vec')} AS vec, {sqlh.r6_list('state')} AS state FROM {final}")
    return sqlh.with_ctes(ctes) + "\n" + sel


def epochs_sql(spec: TrainSpec, corpus_sql: str) -> str:
    """Full SQL of ``spec.epochs`` epochs: lines, windows and draws anew in each, the learning rate starting anew,
    vectors normalised after each if asked for."""
    ctes = [f"corpus AS ({corpus_sql})"] + vocab_sql(spec) + (ids_sql(spec) if spec.family != "word" else [])
    ctes.append(f"p_0_0 AS ({init_params_sql(spec)})")
    for ep in range(spec.epochs):
        tag = f"_e{ep}_"
        ctes += lines_sql(spec, ep, tag=tag) + pos_sql(spec, ep, tag=tag, lines=f"lines{tag}") + alphas_sql(spec, tag)
        for b in range(spec.batches):
            ctes += step_sql(spec, b, f"p_{ep}_{b}", f"p_{ep}_{b + 1}",
                             f"SELECT alpha FROM alphas{tag} WHERE b = {b}", tag=tag, epoch=ep)
        vec = sqlh.unit("vec") if spec.normalize_each_epoch else "vec"
        ctes.append(f"p_{ep + 1}_0 AS (SELECT kind, id, {vec} AS vec, state FROM p_{ep}_{spec.batches})")
    return sqlh.with_ctes(ctes) + (f"\nSELECT kind, id, {sqlh.r6_list('vec')} AS vec, {sqlh.r6_list('state')} AS state "
                                   f"FROM p_{spec.epochs}_0")
