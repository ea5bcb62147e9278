"""SQL twins of the longer queries, put together from rounds that SQL has to spell out one by one."""

from __future__ import annotations

from ..functions.bits import GAMMA, MUL1, MUL2
from . import bindings as b

N_PARTS = "(SELECT count(*) FROM part)"
N_CUSTOMERS = "(SELECT count(*) FROM customer)"
TWO = "18446744073709551616::UHUGEINT"


def graph(base: str, rows: str, cols: str, square: bool) -> str:
    """CTEs m (entries), n (vertices) and g (s, t): edges both ways without loops; rectangular ones with columns after rows."""
    if square:
        both = "SELECT r AS s, c AS t FROM m WHERE r <> c UNION SELECT c, r FROM m WHERE r <> c"
        size = rows
    else:
        both = f"SELECT r AS s, c + {rows} AS t FROM m UNION SELECT c + {rows}, r FROM m"
        size = f"{rows} + {cols}"
    return f"m AS MATERIALIZED ({base}), n AS MATERIALIZED (SELECT {size} AS n), g AS MATERIALIZED ({both})"


def component_summary(prefix: str, rounds: int = 12) -> str:
    """Least labels spread a step a round, which must be as many as the longest way."""
    steps = ["l0 AS MATERIALIZED (SELECT unnest(range(n)) AS i, unnest(range(n)) AS l FROM n)"]
    for k in range(1, rounds + 1):
        steps.append(
            f"l{k} AS MATERIALIZED (SELECT x.i, least(min(x.l), coalesce(min(y.l), min(x.l))) AS l FROM l{k - 1} x LEFT JOIN g ON g.s = x.i LEFT JOIN l{k - 1} y ON y.i = g.t GROUP BY x.i)"
        )
    return f"""WITH {prefix}, {", ".join(steps)}, z AS (SELECT count(*) AS k FROM l{rounds} GROUP BY l)
SELECT count(*) AS n_components, max(k) / sum(k) AS largest_comp_frac FROM z"""


def levels(prefix: str, sources: str, rounds: int = 12) -> str:
    """(source, node, level) by fronts; sources is a query of (source)."""
    steps = [f"f0 AS MATERIALIZED (SELECT source, source AS node, 0 AS level FROM ({sources}))", "s0 AS MATERIALIZED (SELECT * FROM f0)"]
    for k in range(1, rounds + 1):
        steps.append(
            f"f{k} AS MATERIALIZED (SELECT DISTINCT f.source, g.t AS node, {k} AS level FROM f{k - 1} f JOIN g ON g.s = f.node WHERE NOT EXISTS (SELECT 1 FROM s{k - 1} s WHERE s.source = f.source AND s.node = g.t))"
        )
        steps.append(f"s{k} AS MATERIALIZED (SELECT * FROM s{k - 1} UNION ALL SELECT * FROM f{k})")
    return f"WITH {prefix}, {', '.join(steps)} SELECT source, node, level FROM s{rounds}"


def first_by_hash(seed: int, n: int, ids: str) -> str:
    return f"SELECT i AS source FROM ({ids}) ORDER BY md5('{seed}:' || i), i LIMIT {n}"


def pagerank(prefix: str, rounds: int = 10) -> str:
    steps = ["dg AS MATERIALIZED (SELECT s, count(*) AS d FROM g GROUP BY s)", "p0 AS MATERIALIZED (SELECT unnest(range(n)) AS i, 1.0::DOUBLE / n AS p FROM n)"]
    for k in range(1, rounds + 1):
        steps.append(f"loose{k} AS MATERIALIZED (SELECT coalesce(sum(p), 0) AS x FROM p{k - 1} WHERE i NOT IN (SELECT s FROM dg))")
        steps.append(f"got{k} AS MATERIALIZED (SELECT g.t, sum(p / d) AS x FROM g JOIN dg ON dg.s = g.s JOIN p{k - 1} ON i = g.s GROUP BY g.t)")
        steps.append(f"q{k} AS MATERIALIZED (SELECT i, 0.15 / n + 0.85 * (coalesce(got{k}.x, 0) + loose{k}.x / n) AS p FROM p{k - 1} LEFT JOIN got{k} ON t = i, n, loose{k})")
        steps.append(f"p{k} AS MATERIALIZED (SELECT i, p / (SELECT sum(p) FROM q{k}) AS p FROM q{k})")
    return f"WITH {prefix}, {', '.join(steps)} SELECT i AS node, p AS rank FROM p{rounds}"


def mixed(name: str, source: str, key: str, seeds: dict[str, int]) -> str:
    """CTE of (key, a hash a seed): splitmix64 of key xor seed with the top bit flipped, so that signed order is unsigned order."""
    cols = list(seeds)
    first = ", ".join(f"CAST((CAST(xor(CAST({key} AS UBIGINT), {s}::UBIGINT) AS UHUGEINT) + {GAMMA}::UHUGEINT) % {TWO} AS UBIGINT) AS {c}" for c, s in seeds.items())
    inner = f"SELECT {key}, {first} FROM {source}"
    for shift, mul in ((30, MUL1), (27, MUL2)):
        inner = f"SELECT {key}, " + ", ".join(f"CAST((CAST(xor({c}, {c} >> {shift}) AS UHUGEINT) * {mul}::UHUGEINT) % {TWO} AS UBIGINT) AS {c}" for c in cols) + f" FROM ({inner})"
    out = ", ".join(f"CAST(CAST(xor({c}, {c} >> 31) AS HUGEINT) - 9223372036854775808 AS BIGINT) AS {c}" for c in cols)
    return f"{name} AS MATERIALIZED (SELECT {key}, {out} FROM ({inner}))"


def lsh_order(hashes: int = 4, most: int = 128) -> str:
    names = [f"h{i}" for i in range(hashes)]
    seeds = {name: (i + 1) * GAMMA & (1 << 64) - 1 for i, name in enumerate(names)}
    steps = [f"m AS MATERIALIZED ({b.PART_GRAPH})", mixed("w", "(SELECT DISTINCT c FROM m)", "c", seeds), f"x0 AS MATERIALIZED (SELECT r, {', '.join(f'min({h}) AS {h}' for h in names)} FROM m JOIN w USING (c) GROUP BY r)"]
    for i in range(1, hashes):
        steps.append(f"x{i} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN count(*) OVER (PARTITION BY {', '.join(names[:i])}) > {most} THEN h{i} END AS h{i}) FROM x{i - 1})")
    by = ", ".join(f"{h} NULLS FIRST" for h in names)
    return f"WITH {', '.join(steps)} SELECT row_number() OVER (ORDER BY r IS NULL, {by}, p_partkey) - 1 AS new_pos, p_partkey AS old_idx FROM part LEFT JOIN x{hashes - 1} ON r = p_partkey"


_POINTS = "pt AS MATERIALIZED (SELECT s_nationkey AS id, avg(s_acctbal) AS x, count(*)::DOUBLE AS y FROM supplier GROUP BY 1)"
_PAIRS = "e AS MATERIALIZED (SELECT p.id AS u, q.id AS v, sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) AS w FROM pt p JOIN pt q ON p.id < q.id)"


def spanning_tree(rounds: int = 5) -> str:
    """CTE tree (u, v, w): an edge is in it where no way around has only lighter ones; ways double in length a round."""
    steps = [_POINTS, _PAIRS, "k AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY w, u, v) AS k FROM e)", "b0 AS MATERIALIZED (SELECT u, v, k FROM k UNION ALL SELECT v, u, k FROM k)"]
    for i in range(1, rounds + 1):
        steps.append(
            f"b{i} AS MATERIALIZED (SELECT u, v, min(k) AS k FROM (SELECT * FROM b{i - 1} UNION ALL SELECT x.u, y.v, greatest(x.k, y.k) FROM b{i - 1} x JOIN b{i - 1} y ON x.v = y.u AND x.u <> y.v) GROUP BY u, v)"
        )
    steps.append(f"tree AS MATERIALIZED (SELECT k.u, k.v, k.w FROM k JOIN b{rounds} z ON z.u = k.u AND z.v = k.v AND z.k = k.k)")
    return ", ".join(steps)


def mst_flexibility() -> str:
    return f"""WITH {spanning_tree()}, s AS (SELECT row_number() OVER (ORDER BY w, u, v) AS k, sum(w) OVER (ORDER BY w, u, v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM tree)
SELECT max(e - k) AS psi FROM s, (SELECT count(*) AS e FROM tree), (SELECT max(w) AS d FROM e) WHERE (e - k) * d <= 2.0 * s"""


def two_sided(side: str, w: int = 4, iters: int = 4, block: int = 32) -> str:
    """Lexicographic rounds of rows and columns, all of them; the answer is the last of those that each had fewer blocks than the one before."""
    steps = [f"m0 AS MATERIALIZED (SELECT r, c FROM ({b.CUSTOMER_PART}))"]
    steps += [f"r0 AS MATERIALIZED (SELECT unnest(range({N_CUSTOMERS})) AS p, unnest(range({N_CUSTOMERS})) AS o)", f"c0 AS MATERIALIZED (SELECT unnest(range({N_PARTS})) AS p, unnest(range({N_PARTS})) AS o)"]

    def lex(tag: str, source: str, row: str, col: str, spine: str) -> None:
        steps.append(f"s{tag} AS MATERIALIZED (SELECT DISTINCT {row} AS i, {col} // {w} AS win FROM {source})")
        steps.append(f"d{tag} AS MATERIALIZED (SELECT win, row_number() OVER (ORDER BY count(*) DESC, win) - 1 AS rank FROM s{tag} GROUP BY win)")
        steps.append(f"l{tag} AS MATERIALIZED (SELECT i, list(rank ORDER BY rank) AS sig FROM s{tag} JOIN d{tag} USING (win) GROUP BY i)")
        steps.append(f"o{tag} AS MATERIALIZED (SELECT row_number() OVER (ORDER BY coalesce(sig, []), p) - 1 AS p, p AS o FROM (SELECT p FROM {spine}) LEFT JOIN l{tag} ON i = p)")

    for k in range(1, iters + 1):
        lex(f"r{k}", f"m{k - 1}", "r", "c", "r0")
        steps.append(f"x{k} AS MATERIALIZED (SELECT q.p AS r, c FROM m{k - 1} JOIN or{k} q ON q.o = r)")
        lex(f"c{k}", f"x{k}", "c", "r", "c0")
        steps.append(f"m{k} AS MATERIALIZED (SELECT r, q.p AS c FROM x{k} JOIN oc{k} q ON q.o = c)")
        for x in ("r", "c"):
            steps.append(f"{x}{k} AS MATERIALIZED (SELECT q.p, z.o FROM o{x}{k} q JOIN {x}{k - 1} z ON z.p = q.o)")
    counts = ", ".join(f"(SELECT count(*) FROM (SELECT DISTINCT r // {block}, c // {block} FROM m{k})) AS n{k}" for k in range(iters + 1))
    kept = " ".join(f"WHEN NOT ({' AND '.join(f'n{j} < n{j - 1}' for j in range(1, k + 1))}) THEN {k - 1}" for k in range(1, iters + 1))
    steps += [f"cnt AS MATERIALIZED (SELECT {counts})", f"best AS MATERIALIZED (SELECT CASE {kept} ELSE {iters} END AS best FROM cnt)"]
    every = " UNION ALL ".join(f"SELECT {k} AS k, p, o FROM {side}{k}" for k in range(iters + 1))
    return f"WITH {', '.join(steps)} SELECT p AS new_pos, o AS old_idx FROM ({every}) JOIN best ON k = best"


def community_ctes(rounds: int = 6, levels_: int = 2) -> str:
    """CTE com (i, c1, c2): labels of most neighbours, a round a CTE, then the same over the graph of labels."""
    steps, top = [graph(b.PART_GRAPH, N_PARTS, N_PARTS, True), "g1 AS MATERIALIZED (SELECT s, t FROM g)"], {}
    for lv in range(1, levels_ + 1):
        steps.append(f"v{lv}_0 AS MATERIALIZED (SELECT DISTINCT s AS i, s AS l FROM g{lv})")
        for k in range(1, rounds + 1):
            p = f"v{lv}_{k - 1}"
            votes = f"SELECT e.s AS i, x.l FROM g{lv} e JOIN {p} x ON x.i = e.t UNION ALL SELECT i, l FROM {p}"
            steps.append(f"v{lv}_{k} AS MATERIALIZED (SELECT i, arg_min(l, [-k, l]) AS l FROM (SELECT i, l, count(*) AS k FROM ({votes}) GROUP BY i, l) GROUP BY i)")
        top[lv] = f"v{lv}_{rounds}"
        steps.append(f"g{lv + 1} AS MATERIALIZED (SELECT DISTINCT x.l AS s, y.l AS t FROM g{lv} e JOIN {top[lv]} x ON x.i = e.s JOIN {top[lv]} y ON y.i = e.t WHERE x.l <> y.l)")
    steps.append(f"k1 AS MATERIALIZED (SELECT p_partkey AS i, coalesce(l, p_partkey) AS c1 FROM part LEFT JOIN {top[1]} v ON v.i = p_partkey)")
    steps.append(f"com AS MATERIALIZED (SELECT k1.i, c1, coalesce(l, c1) AS c2 FROM k1 LEFT JOIN {top[2]} v ON v.i = c1)")
    steps.append("co AS MATERIALIZED (SELECT row_number() OVER (ORDER BY c2, c1, coalesce(k, 0) DESC, com.i) - 1 AS p, com.i AS o FROM com LEFT JOIN (SELECT r, count(*) AS k FROM m GROUP BY r) ON r = com.i)")
    return ", ".join(steps)


def fingerprint(name: str, base: str, rows: str, cols: str, square: bool) -> str:
    """One row with the columns of a fingerprint but times and betweenness."""
    pre = graph(base, rows, cols, square)

    def degrees(side: str, n: str) -> str:
        return f"SELECT i, coalesce(k, 0) AS d FROM (SELECT unnest(range({n})) AS i) LEFT JOIN (SELECT {side[0]} AS j, count(*) AS k FROM m GROUP BY 1) ON i = j"

    def degree_stats(side: str, n: str) -> str:
        x, gini = f"{side}_", "2.0 * sum(k * d) / (count(*) * sum(d)) - (count(*) + 1.0) / count(*)"
        shares = ", ".join(f"round(avg(CASE WHEN d {c} THEN 1.0 ELSE 0 END), 9) AS {x}{k}" for k, c in (("frac_empty", "= 0"), ("frac_deg1", "= 1"), ("frac_gt50", "> 50")))
        q = ", ".join(f"round(quantile_cont(d::DOUBLE, {v}), 9) AS {x}{k}" for k, v in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99)))
        return f"""(SELECT round(max(mu), 9) AS {x}mean, round(max(sd), 9) AS {x}std, round(max(sd) / max(mu), 9) AS {x}cv, CAST(max(d) AS BIGINT) AS {x}max, {q}, {shares},
  round(avg((d - mu) ** 3) / max(sd) ** 3, 6) AS {x}skew, round({gini}, 9) AS {x}gini
  FROM (SELECT d, row_number() OVER (ORDER BY d) AS k FROM ({degrees(side, n)})), (SELECT avg(d) AS mu, stddev_pop(d) AS sd FROM ({degrees(side, n)})))"""

    band = f"""(SELECT max(abs(r - c)) AS bandwidth_max, round(avg(abs(r - c)), 9) AS bandwidth_avg, round(max(abs(r - c)) / greatest({rows}, {cols}), 9) AS bandwidth_norm,
  round(avg(CASE WHEN abs(r - c) <= 32 THEN 1.0 ELSE 0 END), 9) AS frac_nnz_band32, round(avg(CASE WHEN abs(r - c) <= 128 THEN 1.0 ELSE 0 END), 9) AS frac_nnz_band128,
  {"round(avg(CASE WHEN r = c THEN 1.0 ELSE 0 END), 9)" if square else "0.0::DOUBLE"} AS diag_frac FROM m)"""
    spread = """(SELECT round(avg(s), 9) AS avg_row_spread, max(s) AS max_row_spread, CAST(sum(s) AS BIGINT) AS profile FROM (SELECT max(c) - min(c) AS s FROM m GROUP BY r)),
  (SELECT round(avg(s), 9) AS avg_col_spread, max(s) AS max_col_spread FROM (SELECT max(r) - min(r) AS s FROM m GROUP BY c))"""
    adjacent = "(SELECT round((SELECT count(*) FROM m a JOIN m z ON a.c = z.c AND z.r = a.r - 1) / (count(*) - count(DISTINCT c)), 9) AS vert_adj_ratio FROM m)"
    blocks = "(SELECT count(*) AS block16_occupied FROM (SELECT DISTINCT r // 16, c // 16 FROM m))"
    pick = "SELECT r, c FROM m ORDER BY md5('0:' || r || ':' || c), r, c LIMIT {n}"
    other = "r, list(c) AS s FROM m GROUP BY r" if square else "c AS r, list(r) AS s FROM m GROUP BY c"
    overlap = f"""(SELECT round(avg(j), 9) AS edge_jaccard_mean, round(quantile_cont(j, 0.9), 9) AS edge_jaccard_p90, round(avg(CASE WHEN j > 0.5 THEN 1.0 ELSE 0 END), 9) AS edge_jaccard_frac_gt05
  FROM (SELECT len(list_intersect(x.s, y.s)) / len(list_distinct(list_concat(x.s, y.s))) AS j FROM ({pick.format(n=2000)}) p
  JOIN (SELECT r, list(c) AS s FROM m GROUP BY r HAVING count(*) <= 5000) x ON x.r = p.r JOIN (SELECT {other} HAVING count(*) <= 5000) y ON y.r = p.c))"""
    start = first_by_hash(0, 1, "SELECT DISTINCT s AS i FROM g")
    sweep = f"""(SELECT max(level)::DOUBLE AS pseudo_diameter, round(max(level) / ln(max(n)), 9) AS pseudo_diameter_norm, round(avg(level) FILTER (level > 0), 9) AS bfs_depth_mean, max(level)::DOUBLE AS bfs_depth_max
  FROM ({levels("u AS (SELECT 1)", "SELECT arg_min(node, [-level, node]) AS source FROM (" + levels("v AS (SELECT 1)", start) + ")")}), n)"""
    ranks = f"(SELECT round(max(rank), 9) AS pagerank_max, round(stddev_pop(rank), 9) AS pagerank_std FROM ({pagerank('u AS (SELECT 1)')}))"
    ends = "SELECT r AS i, c AS o FROM m UNION SELECT c, r FROM m" if square else f"SELECT r AS i, c AS o FROM m UNION ALL SELECT c + {rows}, r FROM m"
    gd = f"SELECT x.i, coalesce(k, 0) AS d FROM (SELECT unnest(range(n)) AS i FROM n) x LEFT JOIN (SELECT i, count(*) AS k FROM ({ends}) GROUP BY i) USING (i)"
    hubs = f"""(SELECT round(sum(d) FILTER (k <= greatest(1, n // 100)) / sum(d), 9) AS hub1pct_coverage, round(max(d) / avg(d), 9) AS hub_prominence
  FROM (SELECT d, row_number() OVER (ORDER BY d DESC) AS k FROM ({gd})), n)"""
    every = degrees("row", rows) + ("" if square else f" UNION ALL {degrees('col', cols)}")
    power = f"""(SELECT round(1.0 - 1.0 / regr_slope(ln(d), ln(k)), 6) AS powerlaw_alpha FROM (SELECT d, row_number() OVER (ORDER BY d DESC) AS k, count(*) OVER () AS n FROM ({every}) WHERE d > 0)
  WHERE k <= greatest(50, n // 5))"""
    dr, dc = degrees("row", rows), degrees("col", cols)
    if square:
        own = f"""(SELECT round(corr(x.d, y.d), 9) AS row_col_deg_corr FROM ({dr}) x JOIN ({dc}) y USING (i)),
  (SELECT CAST(count(*) = 0 AS BIGINT) AS pattern_symmetric FROM m a WHERE NOT EXISTS (SELECT 1 FROM m z WHERE z.r = a.c AND z.c = a.r)),
  (SELECT round(corr(x.d, y.d), 6) AS assortativity FROM ({pick.format(n=5000)}) p JOIN ({dr}) x ON x.i = r JOIN ({dr}) y ON y.i = c),
  (SELECT round(3.0 * t / w, 9) AS triangle_closure_rate FROM (SELECT sum(k * (k - 1) // 2) AS w FROM (SELECT count(*) AS k FROM g GROUP BY s)),
  (SELECT count(*) AS t FROM g a JOIN g z ON z.s = a.t AND a.t > a.s AND z.t > z.s JOIN g y ON y.s = a.s AND y.t = z.t))"""
    else:
        own = "(SELECT NULL::DOUBLE AS row_col_deg_corr, NULL::BIGINT AS pattern_symmetric, NULL::DOUBLE AS assortativity, 0.0::DOUBLE AS triangle_closure_rate)"
    size = f"""(SELECT '{name}' AS matrix, 'ok' AS status, {rows} AS n_rows, {cols} AS n_cols, count(*) AS nnz, count(*) / ({rows} * {cols}) AS density, {int(square)}::BIGINT AS is_square,
  round(ln(1 + {rows}), 9) AS log_n_rows, round(ln(1 + count(*)), 9) AS log_nnz, round(ln(1 + count(*) / ({rows} * {cols})), 9) AS log_density FROM m)"""
    parts = [size, degree_stats("row", rows), degree_stats("col", cols), band, spread, adjacent, blocks, overlap, f"({component_summary('u AS (SELECT 1)')})", sweep, ranks, hubs, power, own]
    return f"""SELECT * REPLACE (round(density, 9) AS density, round(largest_comp_frac, 9) AS largest_comp_frac), edge_jaccard_mean AS jaccard_mean, edge_jaccard_p90 AS jaccard_max, edge_jaccard_frac_gt05 AS jaccard_frac_gt05,
  round(nnz / (block16_occupied * 256), 9) AS block16_density, round(nnz / (block16_occupied * 256) / density, 9) AS block_fill_gain
FROM (WITH {pre} SELECT * FROM {", ".join(parts)})"""
