"""DuckDB oracle SQL, generated from small templates.

Iterative operators become an unrolled chain of CTEs (``AS MATERIALIZED`` so
DuckDB never inlines and recomputes an earlier pass).  Centres are kept as
ONE row with columns c{j}_{i}, so per-row sums across centres sit side by
side and no row key is needed (lineitem has none).
"""

from __future__ import annotations


def cte(name: str, body: str) -> str:
    return f"{name} AS MATERIALIZED (\n{body}\n)"


def with_(ctes: list[str], final: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + final


def not_null(cols: list[str]) -> str:
    return " AND ".join(f"{c} IS NOT NULL" for c in cols)


# --- fixtures -------------------------------------------------------------

def li_points(name: str = "p", dims: int = 4) -> str:
    exprs = ["CAST(l_quantity AS DOUBLE)", "l_extendedprice / 1000.0",
             "CAST(l_discount AS DOUBLE)", "CAST(l_tax AS DOUBLE)"][:dims]
    raw = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"][:dims]
    sel = ", ".join(f"{e} AS x{i}" for i, e in enumerate(exprs))
    return cte(name, f"SELECT l_orderkey, l_linenumber, {sel} FROM lineitem "
                     f"WHERE {not_null(raw)}")


def ev_points(name: str = "p") -> str:
    return cte(name, "SELECT event_id, value / 100.0 AS x0, hour(ts) / 24.0 AS x1 "
                     "FROM events WHERE value IS NOT NULL AND ts IS NOT NULL")


def emb_points(name: str = "p", dims: int = 64) -> str:
    sel = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS x{i}" for i in range(dims))
    return cte(name, f"SELECT vec_id, label, {sel} FROM embeddings "
                     "WHERE embedding IS NOT NULL "
                     "AND list_count(embedding) = len(embedding)")


# --- centres as one wide row ---------------------------------------------

def ccol(j: int, i: int) -> str:
    return f"c{j}_{i}"


def group_mean_centers(name: str, src: str, group_expr: str, k: int, d: int) -> str:
    """One-row table of per-group means; groups numbered 0.. in group order."""
    means = ", ".join(f"avg(x{i}) AS m{i}" for i in range(d))
    inner = (f"SELECT row_number() OVER (ORDER BY grp) - 1 AS g, * FROM "
             f"(SELECT {group_expr} AS grp, {means} FROM {src} GROUP BY 1)")
    cols = ", ".join(f"max(CASE WHEN g = {j} THEN m{i} END) AS {ccol(j, i)}"
                     for j in range(k) for i in range(d))
    return cte(name, f"SELECT {cols} FROM ({inner})")


def dist_expr(j: int, d: int, x: str = "x", c: str = "") -> str:
    pre = f"{c}." if c else ""
    return " + ".join(f"({x}{i} - {pre}{ccol(j, i)}) * ({x}{i} - {pre}{ccol(j, i)})"
                      for i in range(d))


def dist_select(k: int, d: int) -> str:
    return ", ".join(f"{dist_expr(j, d)} AS d{j}" for j in range(k))


def argmin_expr(k: int, prefix: str = "d") -> str:
    """First index of the minimum (lowest index on ties)."""
    if k == 1:
        return "0"
    parts = []
    for j in range(k - 1):
        cond = " AND ".join(f"{prefix}{j} <= {prefix}{l}" for l in range(j + 1, k))
        parts.append(f"WHEN {cond} THEN {j}")
    return f"CAST(CASE {' '.join(parts)} ELSE {k - 1} END AS INTEGER)"


def argmax_expr(k: int, prefix: str) -> str:
    if k == 1:
        return "0"
    parts = []
    for j in range(k - 1):
        cond = " AND ".join(f"{prefix}{j} >= {prefix}{l}" for l in range(j + 1, k))
        parts.append(f"WHEN {cond} THEN {j}")
    return f"CAST(CASE {' '.join(parts)} ELSE {k - 1} END AS INTEGER)"


def centers_long(cname: str, k: int, d: int, digits: int = 6) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT CAST({j} AS INTEGER) AS cluster, CAST({i} AS INTEGER) AS dim, "
        f"CAST(round({ccol(j, i)}, {digits}) AS DOUBLE) AS value FROM {cname}"
        for j in range(k) for i in range(d))


def unpivot(src: str, keep: list[str], k: int, cols: dict[str, str],
            key: str = "cluster") -> str:
    """k rows per source row: (keep.., key, name=expr(j)) via UNION ALL."""
    out = []
    kp = "".join(f"{c}, " for c in keep)
    for j in range(k):
        sel = ", ".join(f"{expr.format(j=j)} AS {name}" for name, expr in cols.items())
        out.append(f"SELECT {kp}CAST({j} AS INTEGER) AS {key}, {sel} FROM {src}")
    return "\nUNION ALL\n".join(out)


# --- fuzzy c-means ----------------------------------------------------------

def fuzzy_u_select(k: int, m: float) -> list[str]:
    """Selects for r_j, u_j, um_j given columns d0.. and dmin."""
    p = repr(1.0 / (m - 1.0))
    rs = [f"CASE WHEN dmin <= 0 THEN (CASE WHEN d{j} <= 0 THEN 1.0 ELSE 0.0 END) "
          f"ELSE pow(dmin / d{j}, {p}) END AS r{j}" for j in range(k)]
    total = " + ".join(f"r{j}" for j in range(k))
    us = [f"r{j} / ({total}) AS u{j}" for j in range(k)]
    ums = [f"pow(u{j}, {float(m)!r}) AS um{j}" for j in range(k)]
    return rs, us, ums


def fuzzy_memberships(name: str, src: str, cname: str, k: int, d: int, m: float,
                      keep: list[str]) -> list[str]:
    """CTEs adding d_j, u_j, um_j columns for every row of ``src``."""
    rs, us, ums = fuzzy_u_select(k, m)
    kx = ", ".join(keep + [f"x{i}" for i in range(d)])
    least = f"least({', '.join(f'd{j}' for j in range(k))})" if k > 1 else "d0"
    return [
        cte(f"{name}_d", f"SELECT {kx}, {dist_select(k, d)} FROM {src}, {cname}"),
        cte(f"{name}_r", f"SELECT *, {', '.join(rs)} FROM "
                         f"(SELECT *, {least} AS dmin FROM {name}_d)"),
        cte(name, f"SELECT *, {', '.join(us)} FROM {name}_r"),
        cte(f"{name}_m", f"SELECT *, {', '.join(ums)} FROM {name}"),
    ]


def fuzzy_step(out: str, src: str, cname: str, k: int, d: int, m: float) -> list[str]:
    """One fuzzy pass from centres ``cname`` to ``out`` (one wide row)."""
    mem = fuzzy_memberships(f"{out}_u", src, cname, k, d, m, keep=[])
    cols = ", ".join(
        f"CASE WHEN sum(um{j}) > 0 THEN sum(um{j} * x{i}) / sum(um{j}) "
        f"ELSE max({ccol(j, i)}) END AS {ccol(j, i)}"
        for j in range(k) for i in range(d))
    body = f"SELECT {cols} FROM {out}_u_m, {cname}"
    return mem + [cte(out, body)]


# --- k-means ------------------------------------------------------------------

def with_done(name: str, src: str, k: int, d: int) -> str:
    """Start centres + run-state columns: done flag and cost."""
    cols = ", ".join(ccol(j, i) for j in range(k) for i in range(d))
    return cte(name, f"SELECT {cols}, false AS done, CAST('inf' AS DOUBLE) AS cost FROM {src}")


def assign_ctes(name: str, src: str, cname: str, k: int, d: int, keep: list[str],
                weight: str | None = None) -> list[str]:
    """Rows of ``src`` with d_j, nearest cluster ``a`` and its distance ``dmin``."""
    kx = ", ".join(keep + [f"x{i}" for i in range(d)] + ([weight] if weight else []))
    least = f"least({', '.join(f'd{j}' for j in range(k))})" if k > 1 else "d0"
    return [cte(f"{name}_d", f"SELECT {kx}, {dist_select(k, d)} FROM {src}, {cname}"),
            cte(name, f"SELECT *, {argmin_expr(k)} AS a, {least} AS dmin FROM {name}_d")]


def kmeans_step(out: str, src: str, prev: str, k: int, d: int, eps: float,
                weight: str | None = None) -> list[str]:
    """One Lloyd pass with the stop rule carried in ``done``.

    A finished run keeps its centres and its last cost; an empty cluster
    keeps its centre; the run finishes when no centre moved more than eps.
    """
    w = weight or "1.0"
    a = assign_ctes(f"{out}_a", src, prev, k, d, keep=[], weight=weight)
    newc = ", ".join(
        f"CASE WHEN sum(CASE WHEN a = {j} THEN {w} ELSE 0.0 END) > 0 "
        f"THEN sum(CASE WHEN a = {j} THEN {w} * x{i} ELSE 0.0 END) / "
        f"sum(CASE WHEN a = {j} THEN {w} ELSE 0.0 END) "
        f"ELSE max({ccol(j, i)}) END AS {ccol(j, i)}"
        for j in range(k) for i in range(d))
    n = cte(f"{out}_n", f"SELECT {newc}, sum({w} * dmin) AS cost FROM {out}_a, {prev}")
    moved = " OR ".join(
        "(" + " + ".join(f"(n.{ccol(j, i)} - p.{ccol(j, i)}) * (n.{ccol(j, i)} - p.{ccol(j, i)})"
                         for i in range(d)) + f") > {eps * eps!r}" for j in range(k))
    keepc = ", ".join(f"CASE WHEN p.done THEN p.{ccol(j, i)} ELSE n.{ccol(j, i)} END AS {ccol(j, i)}"
                      for j in range(k) for i in range(d))
    body = (f"SELECT {keepc}, p.done OR NOT ({moved}) AS done, "
            f"CASE WHEN p.done THEN p.cost ELSE n.cost END AS cost FROM {prev} p, {out}_n n")
    return [*a, n, cte(out, body)]


def kmeans_chain(prefix: str, src: str, start: str, k: int, d: int, steps: int,
                 eps: float, weight: str | None = None) -> tuple[list[str], str]:
    ctes = [with_done(f"{prefix}0", start, k, d)]
    for s in range(1, steps + 1):
        ctes += kmeans_step(f"{prefix}{s}", src, f"{prefix}{s - 1}", k, d, eps, weight)
    return ctes, f"{prefix}{steps}"


# --- streaming k-means -----------------------------------------------------------

def ev_blocks(name: str = "p", days: int = 10) -> str:
    return cte(name, "SELECT event_id, user_id, value / 100.0 AS x0, hour(ts) / 24.0 AS x1, "
                     f"CAST(floor(date_diff('day', (SELECT min(CAST(ts AS DATE)) FROM events), "
                     f"CAST(ts AS DATE)) / {days}) AS INTEGER) AS blk "
                     "FROM events WHERE value IS NOT NULL AND ts IS NOT NULL")


def stream_state(name: str, centers: str, k: int, d: int, weights: list[str]) -> str:
    cols = ", ".join(ccol(j, i) for j in range(k) for i in range(d))
    ws = ", ".join(f"CAST({w} AS DOUBLE) AS w{j}" for j, w in enumerate(weights))
    return cte(name, f"SELECT {cols}, {ws} FROM {centers}")


def stream_update(out: str, src: str, prev: str, blk: int, k: int, d: int,
                  decay: float, unit: str) -> list[str]:
    """One micro-batch: assign, discount, move, split a dying cluster."""
    a = assign_ctes(f"{out}_a", f"(SELECT * FROM {src} WHERE blk = {blk})", prev, k, d, keep=[])
    stats = ", ".join([f"CAST(count(*) FILTER (WHERE a = {j}) AS DOUBLE) AS n{j}" for j in range(k)]
                      + [f"coalesce(sum(x{i}) FILTER (WHERE a = {j}), 0.0) AS s{j}_{i}"
                         for j in range(k) for i in range(d)])
    n = cte(f"{out}_n", f"SELECT {stats} FROM {out}_a")
    total = " + ".join(f"n{j}" for j in range(k))
    disc = repr(float(decay)) if unit == "batches" else f"pow({float(decay)!r}, {total})"
    sel = []
    for j in range(k):
        wd = f"(p.w{j} * {disc})"
        upd = f"({wd} + n{j})"
        lam = f"(n{j} / greatest({upd}, 1e-16))"
        sel.append(f"CASE WHEN n{j} > 0 THEN {upd} ELSE {wd} END AS w{j}")
        for i in range(d):
            sel.append(f"CASE WHEN n{j} > 0 THEN p.{ccol(j, i)} * (1.0 - {lam}) + "
                       f"({lam} / n{j}) * s{j}_{i} ELSE p.{ccol(j, i)} END AS {ccol(j, i)}")
    m = cte(f"{out}_m", f"SELECT {', '.join(sel)} FROM {prev} p, {out}_n")
    ws = ", ".join(f"w{j}" for j in range(k))
    g = cte(f"{out}_g", f"SELECT *, {argmax_expr(k, 'w')} AS big, {argmin_expr(k, 'w')} AS small, "
                        f"greatest({ws}) AS wmax, least({ws}) AS wmin FROM {out}_m")
    fin = []
    for j in range(k):
        fin.append(f"CASE WHEN wmin < 1e-8 * wmax AND (big = {j} OR small = {j}) "
                   f"THEN (wmax + wmin) / 2.0 ELSE w{j} END AS w{j}")
        for i in range(d):
            xl = "CASE big " + " ".join(f"WHEN {l} THEN {ccol(l, i)}" for l in range(k)) + " END"
            pl = f"1e-14 * greatest(abs({xl}), 1.0)"
            fin.append(f"CASE WHEN wmin < 1e-8 * wmax AND big = {j} THEN ({xl}) + {pl} "
                       f"WHEN wmin < 1e-8 * wmax AND small = {j} THEN ({xl}) - {pl} "
                       f"ELSE {ccol(j, i)} END AS {ccol(j, i)}")
    return [*a, n, m, g, cte(out, f"SELECT {', '.join(fin)} FROM {out}_g")]


def state_long(name: str, k: int, d: int) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT CAST({j} AS INTEGER) AS cluster, CAST(round(w{j}, 4) AS DOUBLE) AS weight, "
        f"CAST({i} AS INTEGER) AS dim, CAST(round({ccol(j, i)}, 6) AS DOUBLE) AS value FROM {name}"
        for j in range(k) for i in range(d))
