"""DuckDB SQL snippets used by the oracle twins (text only, no execution)."""

from __future__ import annotations

import re


def with_ctes(ctes: list[str]) -> str:
    """WITH clause over ``name AS (...)`` strings.  What several steps refer to is computed
    once (MATERIALIZED); a recursive one, which refers to itself, stays as it is."""
    out = []
    for c in ctes:
        head, found, body = c.partition(" AS (")
        name = head.split("(")[0].strip()
        once = found and not re.search(rf"\b{re.escape(name)}\b", body)
        out.append(f"{head} AS MATERIALIZED ({body}" if once else c)
    return "WITH RECURSIVE " + ",\n".join(out)


def r6(expr: str) -> str:
    return f"(CASE WHEN round({expr}, 6) = 0 THEN 0.0::DOUBLE ELSE round({expr}, 6) END)"


def r6_list(expr: str) -> str:
    return f"list_transform({expr}, lambda x: {r6('x')})"


def norm(expr: str) -> str:
    return f"sqrt(list_dot_product({expr}, {expr}))"


def unit(expr: str) -> str:
    n = norm(expr)
    return f"(CASE WHEN {n} > 0 THEN list_transform({expr}, lambda x: x / {n}) ELSE {expr} END)"


def vadd(a: str, b: str) -> str:
    return f"list_transform(list_zip({a}, {b}), lambda p: p[1] + p[2])"


def vsub(a: str, b: str) -> str:
    return f"list_transform(list_zip({a}, {b}), lambda p: p[1] - p[2])"


def vec_agg(src: str, keys: list[str], vec: str, fn: str = "sum", out: str = "vec") -> str:
    """Element-wise aggregate of a list column per key."""
    k = ", ".join(keys)
    return (f"(SELECT {k}, list(_s ORDER BY _i) AS {out} FROM ("
            f"SELECT {k}, _i, {fn}(_x) AS _s FROM (SELECT {k}, unnest({vec}) AS _x, "
            f"generate_subscripts({vec}, 1) AS _i FROM {src}) GROUP BY {k}, _i) GROUP BY {k})")


def knn(q: str, i: str, k: int | None, exclude_self: bool = False,
        extra_where: str = "") -> str:
    """q: (q_id, uvec), i: (i_id, uvec) subqueries -> q_id, i_id, rank, sim(raw)."""
    conds = []
    if exclude_self:
        conds.append("q.q_id <> i.i_id")
    if extra_where:
        conds.append(extra_where)
    where = ("WHERE " + " AND ".join(conds)) if conds else ""
    lim = f"WHERE rank <= {k}" if k is not None else ""
    return (f"(SELECT * FROM (SELECT q_id, i_id, sim, CAST(row_number() OVER (PARTITION BY q_id "
            f"ORDER BY round(sim, 9) DESC, i_id) AS INTEGER) AS rank FROM ("
            f"SELECT q.q_id, i.i_id, list_dot_product(q.uvec, i.uvec) AS sim "
            f"FROM ({q}) q, ({i}) i {where})) {lim})")


def keyed_uniform(seed, *keys: str) -> str:
    inner = ", ".join([f"'{seed}'"] + [f"CAST({k} AS VARCHAR)" for k in keys])
    return f"(('0x' || substr(md5(concat_ws('|', {inner})), 1, 8))::UBIGINT / 4294967296.0)"


def knn_grouped(q: str, i: str, k: int, extra_where: str = "") -> str:
    """q: (q_id, uvec), i: (i_id, grp, uvec): best item per group, top-k groups."""
    where = f"WHERE {extra_where}" if extra_where else ""
    return (f"(SELECT q_id, i_id, grp, sim, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY q_id "
            f"ORDER BY round(sim, 9) DESC, i_id) AS INTEGER) AS rank FROM (SELECT * FROM (SELECT *, "
            f"row_number() OVER (PARTITION BY q_id, grp ORDER BY round(sim, 9) DESC, i_id) AS _r1 FROM ("
            f"SELECT q.q_id, i.i_id, i.grp, list_dot_product(q.uvec, i.uvec) AS sim FROM ({q}) q, ({i}) i "
            f"{where})) WHERE _r1 = 1)) WHERE rank <= {k})")


def vconcat(a: str, b: str) -> str:
    return f"list_concat({a}, {b})"


def vscale(a: str, s: str) -> str:
    return f"list_transform({a}, lambda x: x * {s})"
