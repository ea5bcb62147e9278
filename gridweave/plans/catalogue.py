"""Named queries of the library over the Parquet tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.bits import GAMMA, MUL1, MUL2, SEED_1, SEED_2
from ..operators import features, graph, heuristics, linalg, matrix, metrics, ml, ordering, packed, report
from ..operators import sketch as sk
from ..operators.matrix import Axis, compose, inverse
from ..sources.files import ARCH, SUITES, keep_listed, matrix_name, select_suite
from . import bindings as b
from . import twins

_Q: dict = {}
_S: dict = {}


def query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql is not None:
            _S[f.__name__] = sql
        return f

    return add


def queries():
    return dict(_Q)


def oracle_sql():
    return dict(_S)


def _rc(df):
    """row and col under names that are no keywords."""
    names = {"row": "r", "col": "c", "val": "v"}
    return df.select(*[F.col(x).alias(names.get(x, x)) for x in df.columns])


def _longs(df, *cols):
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


ROWS = {"cp": "(SELECT count(*) FROM customer)", "op": "(SELECT count(*) FROM orders)", "pp": "(SELECT count(*) FROM part)"}
CP, OP, PG, PS = b.CUSTOMER_PART, b.ORDER_PART, b.PART_GRAPH, b.PART_SUPPLIER
CP_SK = f"m AS ({CP}), sk AS (SELECT DISTINCT r, c // 32 AS win FROM m)"
OP_SK = f"m AS ({OP}), sk AS (SELECT DISTINCT r, c // 4 AS win FROM m)"
RANK = "deg AS (SELECT win, count(*) AS deg FROM sk GROUP BY win), rk AS (SELECT win, deg, row_number() OVER (ORDER BY deg DESC, win) - 1 AS rank FROM deg)"


# ---- sketches


@query(f"WITH {CP_SK} SELECT r, win FROM sk")
def sketch_w32(spark, d):
    return _rc(sk.mask(b.customer_part(spark, d), 32))


@query(f"""WITH m AS ({CP}), n AS (SELECT count(*) AS n FROM part), l AS (SELECT 16 AS w, 0 AS o UNION ALL SELECT 8, ceil(n / 16) FROM n UNION ALL SELECT 4, ceil(n / 16) + ceil(n / 8) FROM n
  UNION ALL SELECT 1, ceil(n / 16) + ceil(n / 8) + ceil(n / 4) FROM n) SELECT DISTINCT r, CAST(c // w + o AS BIGINT) AS win FROM m, l""")
def sketch_multilevel(spark, d):
    return _rc(sk.multilevel(b.customer_part(spark, d)))


@query(f"WITH {CP_SK}, {RANK} SELECT win, deg, rank FROM rk")
def column_rank(spark, d):
    return sk.column_rank(sk.mask(b.customer_part(spark, d), 32))


@query(f"WITH {OP_SK} SELECT win, count(*) AS deg FROM sk GROUP BY win")
def window_degree(spark, d):
    return sk.window_degree(sk.mask(b.order_part(spark, d), 4))


_CUT = "greatest(64, CAST(ceil(0.45 * {n}) AS BIGINT))"


@query(f"WITH {CP_SK} SELECT win, count(*) AS deg FROM sk GROUP BY win HAVING count(*) > {_CUT.format(n=ROWS['cp'])}")
def hub_windows(spark, d):
    m = b.customer_part(spark, d)
    return sk.hubs(sk.mask(m, 32), m.rows, 0.45)




def _sketch_sql(base: str, rows: str, frac: str) -> str:
    """Row sketches; the mixer is unrolled into stages as its terms repeat."""
    two = "18446744073709551616::UHUGEINT"
    stages, cols = [], {"h1": SEED_1, "h2": SEED_2}
    first = ", ".join(f"CAST((CAST(xor(CAST(win AS UBIGINT), {s}::UBIGINT) AS UHUGEINT) + {GAMMA}::UHUGEINT) % {two} AS UBIGINT) AS {c}" for c, s in cols.items())
    stages.append(f"d1 AS (SELECT win, deg, {first} FROM (SELECT win, count(*) AS deg FROM sk GROUP BY win))")
    for i, (shift, mul) in enumerate(((30, MUL1), (27, MUL2)), 2):
        stages.append(f"d{i} AS (SELECT win, deg, " + ", ".join(f"CAST((CAST(xor({c}, {c} >> {shift}) AS UHUGEINT) * {mul}::UHUGEINT) % {two} AS UBIGINT) AS {c}" for c in cols) + f" FROM d{i - 1})")
    out = ", ".join(f"CAST(CAST(xor({c}, {c} >> 31) AS HUGEINT) - 9223372036854775808 AS BIGINT) AS {c}" for c in cols)
    stages.append(f"d AS (SELECT win, deg, deg > greatest(64, CAST(ceil({frac} * {rows}) AS BIGINT)) AS hub, {out} FROM d3)")
    stages.append(f"""e AS (SELECT r, s.win, hub, h1, h2, CASE WHEN hub THEN deg WHEN deg >= 2 THEN deg ELSE {rows} + 1 END AS eff FROM sk s JOIN d ON s.win = d.win),
rs AS (SELECT r AS row_id, coalesce(min(h1) FILTER (NOT hub), min(h1)) AS h1, coalesce(min(h2) FILTER (NOT hub), min(h2)) AS h2,
  coalesce(min([eff, win]) FILTER (NOT hub), min([eff, win]))[2] AS rare_win, count(*) AS row_len FROM e GROUP BY r)""")
    return base + ", " + ", ".join(stages)


@query(f"WITH {_sketch_sql(CP_SK, ROWS['cp'], '0.45')} SELECT * FROM rs")
def row_sketch(spark, d):
    m = b.customer_part(spark, d)
    return sk.row_sketches(sk.mask(m, 32), m.rows, 0.45)


@query(f"WITH {_sketch_sql(OP_SK, ROWS['op'], '0.05')} SELECT row_id, h1, h2 FROM rs")
def splitmix_minhash(spark, d):
    m = b.order_part(spark, d)
    return sk.row_sketches(sk.mask(m, 4), m.rows).select("row_id", "h1", "h2")


_MICRO = """t AS (SELECT *, (h1 >> 56) AS bucket FROM rs),
u AS (SELECT *, CASE WHEN coalesce(h1 = lag(h1) OVER w OR rare_win = lag(rare_win) OVER w, false) THEN 0 ELSE 1 END AS cut FROM t WINDOW w AS (PARTITION BY bucket ORDER BY h1, h2, rare_win, row_len, row_id)),
v AS (SELECT *, sum(cut) OVER (PARTITION BY bucket ORDER BY h1, h2, rare_win, row_len, row_id) AS island FROM u),
x AS (SELECT *, row_number() OVER (PARTITION BY bucket, island ORDER BY h1, h2, rare_win, row_len, row_id) - 1 AS place FROM v),
micro AS (SELECT row_id AS r, sum(CASE WHEN place % 32 = 0 THEN 1 ELSE 0 END) OVER (ORDER BY h1, h2, rare_win, row_len, row_id) - 1 AS micro_id, place % 32 AS pos_in_micro FROM x)"""


@query(f"WITH {_sketch_sql(OP_SK, ROWS['op'], '0.05')}, {_MICRO} SELECT r, CAST(micro_id AS BIGINT) AS micro_id, CAST(pos_in_micro AS BIGINT) AS pos_in_micro FROM micro")
def micro_clusters(spark, d):
    m = b.order_part(spark, d)
    return _rc(sk.micro_clusters(sk.row_sketches(sk.mask(m, 4), m.rows)))


@query(f"WITH {_sketch_sql(OP_SK, ROWS['op'], '0.05')}, {_MICRO}, p AS (SELECT DISTINCT micro_id, sk.win, hub FROM sk JOIN micro ON sk.r = micro.r JOIN d ON sk.win = d.win), o AS (SELECT micro_id, bool_and(hub) AS only_hubs FROM p GROUP BY micro_id) SELECT CAST(p.micro_id AS BIGINT) AS micro_id, win FROM p JOIN o ON p.micro_id = o.micro_id WHERE NOT hub OR only_hubs")
def macro_incidence(spark, d):
    m = b.order_part(spark, d)
    s = sk.mask(m, 4)
    return sk.macro_incidence(s, sk.micro_clusters(sk.row_sketches(s, m.rows)), m.rows)


_IDX = f"WITH {OP_SK}, deg AS (SELECT win, count(*) AS deg FROM sk GROUP BY win), mass AS (SELECT r, round(sum(ln({ROWS['op']} / (1.0 + deg))), 9) AS mass FROM sk JOIN deg USING (win) GROUP BY r), idx AS (SELECT win, r, pos FROM (SELECT win, r, row_number() OVER (PARTITION BY win ORDER BY mass DESC, r) AS pos FROM sk JOIN mass USING (r)) WHERE pos <= 16)"


@query(f"{_IDX} SELECT win, r, pos FROM idx")
def capped_inverted_index(spark, d):
    m = b.order_part(spark, d)
    return _rc(sk.inverted_index(sk.mask(m, 4), m.rows, 16))


@query(f"""{_IDX}, cand AS (SELECT a.r AS r, b.r AS cand, min([a.win, b.pos]) AS place FROM idx a JOIN idx b ON a.win = b.win WHERE a.r <> b.r GROUP BY 1, 2),
top AS (SELECT r, cand FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY place, cand) AS k FROM cand) WHERE k <= 32), n AS (SELECT r, count(*) AS n FROM sk GROUP BY r),
i AS (SELECT top.r, top.cand, count(y.win) AS i FROM top JOIN sk x ON x.r = top.r LEFT JOIN sk y ON y.r = top.cand AND y.win = x.win GROUP BY 1, 2)
SELECT i.r, i.cand, round(i / (a.n + b.n - i), 9) AS jaccard FROM i JOIN n a ON a.r = i.r JOIN n b ON b.r = i.cand""")
def candidate_pairs(spark, d):
    m = b.order_part(spark, d)
    return _rc(ordering.candidate_pairs(sk.mask(m, 4), m.rows, 16, 32)).withColumn("jaccard", F.round("jaccard", 9))


# ---- orders


@query(f"WITH {OP_SK} SELECT row_number() OVER (ORDER BY w NULLS LAST, o_orderkey) - 1 AS new_pos, o_orderkey AS old_idx FROM orders LEFT JOIN (SELECT r, min(win) AS w FROM sk GROUP BY r) ON r = o_orderkey")
def order_first_window(spark, d):
    m = b.order_part(spark, d)
    return ordering.first_window(sk.mask(m, 4), m.rows)


_LEX = "sig AS (SELECT r, list(rank ORDER BY rank) AS sig FROM sk JOIN rk USING (win) GROUP BY r)"


@query(f"WITH {OP_SK}, {RANK}, {_LEX} SELECT row_number() OVER (ORDER BY coalesce(sig, []), o_orderkey) - 1 AS new_pos, o_orderkey AS old_idx FROM orders LEFT JOIN sig ON r = o_orderkey")
def order_lex(spark, d):
    m = b.order_part(spark, d)
    return ordering.lexicographic(sk.mask(m, 4), m.rows)


@query(f"WITH m AS ({CP}), n AS (SELECT count(*) AS n FROM part), sk AS (SELECT DISTINCT r, c // 16 AS win FROM m UNION ALL SELECT DISTINCT r, CAST(c // 4 + ceil(n / 16) AS BIGINT) FROM m, n), {RANK}, {_LEX} SELECT row_number() OVER (ORDER BY coalesce(sig, []), c_custkey) - 1 AS new_pos, c_custkey AS old_idx FROM customer LEFT JOIN sig ON r = c_custkey")
def order_multilevel(spark, d):
    return ordering.multilevel(b.customer_part(spark, d), (16, 4))


_DEG_PERM = "dp AS (SELECT row_number() OVER (ORDER BY coalesce(k, 0), o_orderkey) - 1 AS new_pos, o_orderkey AS old_idx FROM orders LEFT JOIN (SELECT r, count(*) AS k FROM m GROUP BY r) ON r = o_orderkey)"
_PG_PERM = "dp AS (SELECT row_number() OVER (ORDER BY coalesce(k, 0), p_partkey) - 1 AS new_pos, p_partkey AS old_idx FROM part LEFT JOIN (SELECT r, count(*) AS k FROM m GROUP BY r) ON r = p_partkey)"
_RND = "SELECT row_number() OVER (ORDER BY md5('42:' || {k}), {k}) - 1 AS new_pos, {k} AS old_idx FROM {t}"


@query(f"WITH m AS ({OP}), {_DEG_PERM} SELECT * FROM dp")
def order_degree(spark, d):
    return ordering.by_degree(b.order_part(spark, d))


@query(f"""WITH m AS ({OP}), z AS ({_RND.format(k='o_orderkey', t='orders')}), k AS (SELECT r, count(*) AS k FROM m GROUP BY r)
SELECT row_number() OVER (ORDER BY coalesce(k, 0), z.new_pos) - 1 AS new_pos, old_idx FROM z LEFT JOIN k ON r = old_idx""")
def order_degree_scrambled(spark, d):
    return ordering.pre_permuted(b.order_part(spark, d), ordering.by_degree)


@query(_RND.format(k="c_custkey", t="customer"))
def order_random(spark, d):
    return ordering.random_rows(spark, b.t(spark, d, "customer").count())


@query("SELECT o_orderkey AS new_pos, o_orderkey AS old_idx FROM orders")
def order_identity(spark, d):
    from ..operators.matrix import identity

    return identity(spark, b.t(spark, d, "orders").count())


@query(f"WITH m AS ({CP}), g AS (SELECT r, count(*) AS cnt, bit_or(1::BIGINT << CAST(c * 32 // {ROWS['pp']} AS INT)) AS bitmap FROM m GROUP BY r), x1 AS (SELECT *, xor(bitmap, bitmap >> 1) AS k FROM g), x2 AS (SELECT * REPLACE (xor(k, k >> 2) AS k) FROM x1), x3 AS (SELECT * REPLACE (xor(k, k >> 4) AS k) FROM x2), x4 AS (SELECT * REPLACE (xor(k, k >> 8) AS k) FROM x3) SELECT r, cnt, bitmap, xor(k, k >> 16) AS gray_rank FROM x4")
def gray_bitmap(spark, d):
    return _rc(heuristics.gray_bitmaps(b.customer_part(spark, d)))


@query()
def order_hybrid(spark, d):
    return ordering.hybrid(b.order_part(spark, d), 4)


@query()
def hybrid_stats(spark, d):
    m = b.order_part(spark, d)
    return ordering.hybrid_stages(sk.mask(m, 4), m.rows)[1]


@query(twins.two_sided("r"))
def order_two_sided(spark, d):
    return ordering.two_sided(b.customer_part(spark, d), 4, 4)[0]


@query(twins.two_sided("c"))
def order_two_sided_cols(spark, d):
    return ordering.two_sided(b.customer_part(spark, d), 4, 4)[1]


@query()
def order_jaccard(spark, d):
    m = b.customer_part(spark, d)
    return ordering.cluster_centroids(sk.mask(m, 32), m.rows, 64)


@query()
def order_cluster_chain(spark, d):
    m = b.order_part(spark, d)
    return ordering.cluster_chain(sk.mask(m, 4), m.rows)


@query(f"WITH {OP_SK}, deg AS (SELECT win, count(*) AS deg FROM sk GROUP BY win), s AS (SELECT r, list(win ORDER BY deg, win)[1:8] AS sig FROM sk JOIN deg USING (win) GROUP BY r) SELECT row_number() OVER (ORDER BY sig NULLS LAST, o_orderkey) - 1 AS new_pos, o_orderkey AS old_idx FROM orders LEFT JOIN s ON r = o_orderkey")
def order_anchor(spark, d):
    m = b.order_part(spark, d)
    return ordering.anchor_order(sk.mask(m, 4), m.rows)


@query()
def order_similarity_rounds(spark, d):
    return ordering.similarity_rounds(b.customer_part(spark, d), 32, 32, refine_passes=1)[0]


def _heuristic(name, f, sql=None):
    def run(spark, d):
        return f(b.part_graph(spark, d))

    run.__name__ = f"order_{name}"
    query(sql)(run)


_COMMUNITIES = f"WITH {twins.community_ctes()} SELECT p AS new_pos, o AS old_idx FROM co"
_PARTS = f"""WITH {twins.community_ctes()}, k AS (SELECT greatest(CASE WHEN n >= 128 THEN greatest(1, CAST(floor(1.03 * n / 128) AS BIGINT)) ELSE 1 END, (n + 127) // 128) AS k FROM n)
SELECT row_number() OVER (ORDER BY least(p // k, 127), o) - 1 AS new_pos, o AS old_idx FROM co, k"""


_heuristic("rcm", heuristics.rcm)
_heuristic("minimum_degree", heuristics.minimum_degree)
_heuristic("partition", heuristics.partition_order, _PARTS)
_heuristic("communities", heuristics.community_order, _COMMUNITIES)
_heuristic("community_walk", heuristics.community_walk)
_heuristic("slashburn", heuristics.slashburn)
_heuristic("mst", lambda m: heuristics.mst_order(m, 32))
_heuristic("lsh", heuristics.lsh_order, twins.lsh_order())
_heuristic("overlap_groups", heuristics.overlap_groups)
_heuristic("window_greedy", heuristics.window_greedy)


@query(f"WITH m AS ({PG}), g AS (SELECT r, count(*) AS cnt, bit_or(1::BIGINT << CAST(c * 32 // {ROWS['pp']} AS INT)) AS bitmap FROM m GROUP BY r), x1 AS (SELECT *, xor(bitmap, bitmap >> 1) AS k FROM g), x2 AS (SELECT * REPLACE (xor(k, k >> 2) AS k) FROM x1), x3 AS (SELECT * REPLACE (xor(k, k >> 4) AS k) FROM x2), x4 AS (SELECT * REPLACE (xor(k, k >> 8) AS k) FROM x3), z AS (SELECT greatest(1, count(*) // {ROWS['pp']} // 16) AS z FROM m), x5 AS (SELECT r, CAST(cnt > 32 AS INT) AS dense, CASE WHEN cnt > 32 THEN 0 ELSE cnt // z END AS grp, xor(k, k >> 16) AS gray FROM x4, z) SELECT row_number() OVER (ORDER BY dense NULLS FIRST, grp NULLS FIRST, gray NULLS FIRST, p_partkey) - 1 AS new_pos, p_partkey AS old_idx FROM part LEFT JOIN x5 ON r = p_partkey")
def order_gray(spark, d):
    return heuristics.gray_order(b.part_graph(spark, d))


# ---- permutations applied


@query(f"WITH m AS ({OP}), {_DEG_PERM} SELECT new_pos AS r, c, v FROM m JOIN dp ON old_idx = r")
def permute_rows(spark, d):
    m = b.order_part(spark, d)
    return _rc(m.apply(Axis.ROW, ordering.by_degree(m)).coo)


@query(f"WITH m AS ({CP}), p AS ({_RND.format(k='p_partkey', t='part')}) SELECT r, new_pos AS c, v FROM m JOIN p ON old_idx = c")
def permute_cols(spark, d):
    m = b.customer_part(spark, d)
    return _rc(m.permute_cols(ordering.random_rows(spark, m.cols)).coo)


@query(f"WITH m AS ({PG}), {_PG_PERM} SELECT a.new_pos AS r, z.new_pos AS c, CAST(v AS DOUBLE) AS v FROM m JOIN dp a ON a.old_idx = r JOIN dp z ON z.old_idx = c")
def permute_symmetric(spark, d):
    m = b.part_graph(spark, d)
    return _rc(m.apply(Axis.SYMMETRIC, ordering.by_degree(m)).coo)


@query(f"WITH m AS ({CP}), p AS ({_RND.format(k='c_custkey', t='customer')}), q AS ({_RND.format(k='p_partkey', t='part')}) SELECT p.new_pos AS r, q.new_pos AS c, v FROM m JOIN p ON p.old_idx = r JOIN q ON q.old_idx = c")
def permute_asymmetric(spark, d):
    m = b.customer_part(spark, d)
    return _rc(m.apply(Axis.ASYMMETRIC, ordering.random_rows(spark, m.rows), ordering.random_rows(spark, m.cols)).coo)


@query(f"WITH m AS ({CP}) SELECT c AS r, r AS c, v FROM m")
def transpose(spark, d):
    return _rc(b.customer_part(spark, d).transpose().coo)


@query(f"WITH m AS ({OP}), {_DEG_PERM} SELECT old_idx AS new_pos, new_pos AS old_idx FROM dp")
def perm_inverse(spark, d):
    return inverse(ordering.by_degree(b.order_part(spark, d)))


@query(f"WITH m AS ({OP}), {_DEG_PERM}, p AS ({_RND.format(k='o_orderkey', t='orders')}) SELECT dp.new_pos, p.old_idx FROM dp JOIN p ON dp.old_idx = p.new_pos")
def perm_compose(spark, d):
    m = b.order_part(spark, d)
    return compose(ordering.by_degree(m), ordering.random_rows(spark, m.rows))


@query(f"WITH m AS ({OP}), k AS (SELECT o_orderkey AS r, coalesce(n, 0) AS nzcount FROM orders LEFT JOIN (SELECT r, count(*) AS n FROM m GROUP BY r) ON r = o_orderkey) SELECT r, nzcount, CAST(coalesce(sum(nzcount) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS row_ptr FROM k")
def row_ptr(spark, d):
    return _rc(b.order_part(spark, d).row_ptr())


# ---- blocks


@query(f"WITH m AS ({PS}) SELECT r // 4 AS brow, c // 4 AS bcol, 16 AS n_vals, CAST(sum(v) AS DOUBLE) AS total, CAST(sum(((r % 4) * 4 + c % 4 + 1) * v) AS DOUBLE) AS checksum FROM m GROUP BY 1, 2")
def bsr_build(spark, d):
    s = b.part_supplier(spark, d).to_bsr(4)
    add = lambda e: F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return s.select("brow", "bcol", F.size("vals").alias("n_vals"), add("vals").alias("total"), add(F.transform("vals", lambda x, i: (i + 1) * x)).alias("checksum"))


@query(f"WITH m AS ({CP}) SELECT count(*) AS n_blocks FROM (SELECT DISTINCT r // 16, c // 32 FROM m)")
def block_count_csr(spark, d):
    return metrics.block_count(b.customer_part(spark, d), 32, 16)


@query(f"WITH m AS ({PS}), s AS (SELECT DISTINCT r // 4 AS br, c // 4 AS bc FROM m), x AS (SELECT unnest(range(br * 4 // 6, (br * 4 + 3) // 6 + 1)) AS wr, bc FROM s) SELECT count(*) AS n_blocks FROM (SELECT DISTINCT wr, unnest(range(bc * 4 // 6, (bc * 4 + 3) // 6 + 1)) AS wc FROM x)")
def block_count_bsr(spark, d):
    return metrics.block_count_bsr(b.part_supplier(spark, d).to_bsr(4), 4, 6, 6)


@query(f"WITH m AS ({CP}), s AS (SELECT unnest([4, 8, 16, 32, 64, 128]) AS b) SELECT CAST(b AS BIGINT) AS b, CAST(sum(n) AS BIGINT) AS nnz, count(*) AS n_blocks, round(sum(n) / (count(*) * b * b), 12) AS density FROM (SELECT b, r // b AS x, c // b AS y, count(*) AS n FROM m, s GROUP BY ALL) GROUP BY b")
def block_density_sweep(spark, d):
    return metrics.block_density_sweep(b.customer_part(spark, d)).withColumn("density", F.round("density", 12))


@query(f"WITH {CP_SK}, {RANK}, {_LEX}, p AS (SELECT row_number() OVER (ORDER BY coalesce(sig, []), c_custkey) - 1 AS new_pos, c_custkey AS old_idx FROM customer LEFT JOIN sig ON r = c_custkey) SELECT (SELECT count(*) FROM (SELECT DISTINCT r // 32, c // 32 FROM m)) AS before_blocks, (SELECT count(*) FROM (SELECT DISTINCT new_pos // 32, c // 32 FROM m JOIN p ON old_idx = r)) AS after_blocks")
def lex_block_gain(spark, d):
    m = b.customer_part(spark, d)
    after = m.permute_rows(ordering.lexicographic(sk.mask(m, 32), m.rows))
    return metrics.block_count(m, 32, 32).withColumnRenamed("n_blocks", "before_blocks").join(F.broadcast(metrics.block_count(after, 32, 32).withColumnRenamed("n_blocks", "after_blocks")))


@query(f"WITH m AS ({PS}) SELECT DISTINCT r, c // 8 AS win FROM m")
def sketch_bsr(spark, d):
    m = b.part_supplier(spark, d)
    return _rc(sk.mask_bsr(m.to_bsr(4), 4, 8, m.rows))


@query(f"WITH m AS ({PS}), n AS (SELECT unnest(range((SELECT count(*) + 3 FROM part) // 4)) AS k), p AS (SELECT row_number() OVER (ORDER BY md5('42:' || k), k) - 1 AS new_pos, k FROM n) SELECT new_pos AS brow, c // 4 AS bcol, CAST(sum(v) AS DOUBLE) AS total FROM m JOIN p ON k = r // 4 GROUP BY 1, 2")
def permute_bsr(spark, d):
    m = b.part_supplier(spark, d)
    moved = matrix.permute_bsr(m.to_bsr(4), ordering.random_rows(spark, -(-m.rows // 4)))
    return moved.select("brow", "bcol", F.aggregate("vals", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query(f"WITH m AS ({CP}) SELECT r, c, v FROM m WHERE v <> 1")
def drop_zeros(spark, d):
    m = b.customer_part(spark, d)
    return _rc(m.with_coo(m.coo.withColumn("val", F.col("val") - 1)).drop_zeros().coo.withColumn("val", F.col("val") + 1))


# ---- structure


@query(f"WITH m AS ({PG}) SELECT max(abs(r - c)) AS bandwidth_max, round(avg(abs(r - c)), 9) AS bandwidth_avg, round(max(abs(r - c)) / {ROWS['pp']}, 9) AS bandwidth_norm, round(avg(CASE WHEN abs(r - c) <= 32 THEN 1.0 ELSE 0 END), 9) AS frac_nnz_band32, round(avg(CASE WHEN abs(r - c) <= 128 THEN 1.0 ELSE 0 END), 9) AS frac_nnz_band128, round(avg(CASE WHEN r = c THEN 1.0 ELSE 0 END), 9) AS diag_frac, coalesce(max(r - c) FILTER (r > c), 0) AS bandwidth_lower, coalesce(max(c - r) FILTER (c > r), 0) AS bandwidth_upper FROM m")
def bandwidth(spark, d):
    x = metrics.bandwidth(b.part_graph(spark, d))
    return x.withColumns({c: F.round(c, 9) for c in ("bandwidth_avg", "bandwidth_norm", "frac_nnz_band32", "frac_nnz_band128", "diag_frac")})


@query(f"WITH m AS ({CP}), a AS (SELECT r, max(c) - min(c) AS s FROM m GROUP BY r), z AS (SELECT c, max(r) - min(r) AS s FROM m GROUP BY c) SELECT round((SELECT avg(s) FROM a), 9) AS avg_row_spread, (SELECT max(s) FROM a) AS max_row_spread, CAST((SELECT sum(s) FROM a) AS BIGINT) AS profile, round((SELECT avg(s) FROM z), 9) AS avg_col_spread, (SELECT max(s) FROM z) AS max_col_spread")
def row_spread(spark, d):
    return metrics.spread(b.customer_part(spark, d)).withColumns({c: F.round(c, 9) for c in ("avg_row_spread", "avg_col_spread")})


@query(f"WITH m AS ({CP}), p AS (SELECT count(*) AS p FROM m a JOIN m z ON a.c = z.c AND z.r = a.r - 1) SELECT p AS n_adjacent, round(p / (SELECT count(*) - count(DISTINCT c) FROM m), 12) AS vert_adj_ratio FROM p")
def vert_adjacency(spark, d):
    return metrics.vertical_adjacency(b.customer_part(spark, d)).withColumn("vert_adj_ratio", F.round("vert_adj_ratio", 12))


def _stats_sql(side: str, base: str, spine: str) -> str:
    n = f"{side}_"
    key, k = ("r", spine.split()[0]) if side == "row" else ("c", spine.split()[0])
    return f"""WITH m AS ({base}), dg AS (SELECT coalesce(n, 0)::DOUBLE AS d FROM {spine.split()[1]} LEFT JOIN (SELECT {key}, count(*) AS n FROM m GROUP BY 1) ON {key} = {k}), a AS (SELECT avg(d) AS mu, stddev_pop(d) AS sd FROM dg)
SELECT round(max(mu), 9) AS {n}mean, round(max(sd), 9) AS {n}std, round(max(sd) / max(mu), 9) AS {n}cv, CAST(max(d) AS BIGINT) AS {n}max, round(quantile_cont(d, 0.5), 9) AS {n}p50, round(quantile_cont(d, 0.9), 9) AS {n}p90, round(quantile_cont(d, 0.99), 9) AS {n}p99,
round(avg((d - mu) ** 3) / max(sd) ** 3, 6) AS {n}skew, round(avg(CASE WHEN d = 0 THEN 1.0 ELSE 0 END), 9) AS {n}frac_empty, round(avg(CASE WHEN d = 1 THEN 1.0 ELSE 0 END), 9) AS {n}frac_deg1, round(avg(CASE WHEN d > 50 THEN 1.0 ELSE 0 END), 9) AS {n}frac_gt50 FROM dg, a"""


def _round_all(df, digits=9):
    return df.withColumns({c: F.round(c, 6 if c.endswith("skew") else digits) for c, k in df.dtypes if k == "double"})


@query(_stats_sql("row", OP, "o_orderkey orders"))
def degree_stats_row(spark, d):
    return _round_all(features.degree_stats(b.order_part(spark, d), "row"))


@query(_stats_sql("col", CP, "p_partkey part"))
def degree_stats_col(spark, d):
    return _round_all(features.degree_stats(b.customer_part(spark, d), "col"))


_OP_DEG = f"m AS ({OP}), dg AS (SELECT coalesce(n, 0) AS d FROM orders LEFT JOIN (SELECT r, count(*) AS n FROM m GROUP BY 1) ON r = o_orderkey)"
_PG_DEG = f"m AS ({PG}), dg AS (SELECT p_partkey AS i, coalesce(n, 0) AS d FROM part LEFT JOIN (SELECT r, count(*) AS n FROM m GROUP BY 1) ON r = p_partkey)"


@query(f"WITH {_OP_DEG}, o AS (SELECT d, row_number() OVER (ORDER BY d) AS i FROM dg) SELECT round(2.0 * sum(i * d) / (count(*) * sum(d)) - (count(*) + 1.0) / count(*), 9) AS gini FROM o")
def gini(spark, d):
    return _round_all(features.gini(features.degrees(b.order_part(spark, d))))


@query(f"WITH {_PG_DEG}, n AS (SELECT count(*) AS n FROM dg WHERE d > 0), o AS (SELECT d, row_number() OVER (ORDER BY d DESC) AS k FROM dg WHERE d > 0), s AS (SELECT regr_slope(ln(d), ln(k)) AS s FROM o, n WHERE k <= greatest(50, n // 5)) SELECT round(1.0 - 1.0 / s, 6) AS powerlaw_alpha FROM s")
def powerlaw(spark, d):
    return _round_all(features.powerlaw_alpha(b.part_graph(spark, d)), 6)


@query(f"WITH {_PG_DEG}, e AS (SELECT p_partkey AS i, coalesce(n, 0) AS e FROM part LEFT JOIN (SELECT c, count(*) AS n FROM m GROUP BY 1) ON c = p_partkey) SELECT round(corr(d, e), 9) AS row_col_deg_corr FROM dg JOIN e USING (i)")
def row_col_deg_corr(spark, d):
    return _round_all(features.degree_correlation(b.part_graph(spark, d)))


@query(f"WITH m AS ({PG}) SELECT CAST(count(*) = 0 AS INT) AS pattern_symmetric FROM m a WHERE NOT EXISTS (SELECT 1 FROM m z WHERE z.r = a.c AND z.c = a.r)")
def pattern_symmetric(spark, d):
    return features.pattern_symmetric(b.part_graph(spark, d))


@query(f"WITH {OP_SK}, {RANK}, {_LEX}, p AS (SELECT row_number() OVER (ORDER BY coalesce(sig, []), o_orderkey) - 1 AS new_pos, o_orderkey AS old_idx FROM orders LEFT JOIN sig ON r = o_orderkey), w AS (SELECT new_pos, coalesce(list(win) FILTER (win IS NOT NULL), []) AS s FROM p LEFT JOIN sk ON r = old_idx GROUP BY new_pos) SELECT a.new_pos, round(CASE WHEN len(a.s) + len(z.s) = 0 THEN 0 ELSE 1 - len(list_intersect(a.s, z.s)) / len(list_distinct(list_concat(a.s, z.s))) END, 9) AS dist FROM w a JOIN w z ON z.new_pos = a.new_pos - 1")
def neighbour_jaccard(spark, d):
    m = b.order_part(spark, d)
    s = sk.mask(m, 4)
    return _round_all(metrics.neighbour_jaccard(s, ordering.lexicographic(s, m.rows)))


@query(f"WITH s AS (SELECT r, c FROM ({OP})), n AS (SELECT r, count(*) AS n FROM s GROUP BY r), p AS (SELECT x.r AS a, y.r AS b, count(*) AS i FROM s x JOIN s y ON x.c = y.c AND x.r < y.r GROUP BY 1, 2) SELECT a, b, i AS inter, round(i / (x.n + y.n - i), 9) AS jaccard FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b")
def jaccard_pairs(spark, d):
    return _round_all(metrics.pair_jaccard(sk.mask(b.order_part(spark, d), 1)))


@query(f"WITH m AS ({PG}), p AS (SELECT r, c FROM m ORDER BY md5('0:' || r || ':' || c), r, c LIMIT 2000), s AS (SELECT r, list(c) AS s FROM m GROUP BY r HAVING count(*) <= 5000), j AS (SELECT len(list_intersect(x.s, y.s)) / len(list_distinct(list_concat(x.s, y.s))) AS j FROM p JOIN s x ON x.r = p.r JOIN s y ON y.r = p.c) SELECT round(avg(j), 9) AS edge_jaccard_mean, round(quantile_cont(j, 0.9), 9) AS edge_jaccard_p90, round(avg(CASE WHEN j > 0.5 THEN 1.0 ELSE 0 END), 9) AS edge_jaccard_frac_gt05 FROM j")
def edge_jaccard(spark, d):
    return _round_all(features.edge_jaccard(b.part_graph(spark, d)))


@query(f"WITH {_PG_DEG}, o AS (SELECT d, row_number() OVER (ORDER BY d DESC, i) AS k FROM dg), n AS (SELECT count(*) AS n, sum(d) AS t, avg(d) AS a, max(d) AS x FROM dg) SELECT round(sum(d) FILTER (k <= greatest(1, n // 100)) / max(t), 9) AS hub1pct_coverage, round(max(x) / max(a), 9) AS hub_prominence FROM o, n")
def hub_coverage(spark, d):
    return _round_all(features.hub_coverage(b.part_graph(spark, d)))


@query(f"WITH {_PG_DEG}, p AS (SELECT r, c FROM m ORDER BY md5('0:' || r || ':' || c), r, c LIMIT 5000) SELECT round(corr(x.d, y.d), 6) AS assortativity FROM p JOIN dg x ON x.i = r JOIN dg y ON y.i = c")
def assortativity(spark, d):
    return _round_all(features.assortativity(b.part_graph(spark, d)), 6)


_FINGERPRINTS = twins.fingerprint("customer_part", CP, ROWS["cp"], ROWS["pp"], False) + " UNION ALL BY NAME " + twins.fingerprint("part_graph", PG, ROWS["pp"], ROWS["pp"], True)


@query(_FINGERPRINTS)
def fingerprint(spark, d):
    both = features.fingerprint(b.customer_part(spark, d), "customer_part").unionByName(features.fingerprint(b.part_graph(spark, d), "part_graph"))
    out = both.drop("load_s", "feat_s", "approx_betweenness_mean", "approx_betweenness_max")
    return out.withColumns({c: F.round(c, 6 if c.endswith("skew") or c in ("powerlaw_alpha", "assortativity") else 9) for c, k in out.dtypes if k == "double"})


@query()
def betweenness(spark, d):
    m = b.part_graph(spark, d)
    return features.betweenness(m, min(m.rows, 256))


# ---- graphs


def _nation_graph(spark, d):
    c = b.t(spark, d, "customer")
    n = c.count()
    return c.select(F.col("c_custkey").alias("src"), (F.col("c_nationkey") + n).cast("long").alias("dst"))


@query("WITH n AS (SELECT count(*) AS n FROM customer), g AS (SELECT c_nationkey, min(c_custkey) AS k FROM customer GROUP BY 1) SELECT c_custkey AS node, k AS component FROM customer JOIN g USING (c_nationkey) UNION ALL SELECT c_nationkey + n, k FROM g, n")
def components(spark, d):
    return graph.components(_nation_graph(spark, d))


_PG_GRAPH = twins.graph(PG, ROWS["pp"], ROWS["pp"], True)


@query(twins.component_summary(_PG_GRAPH))
def component_summary(spark, d):
    return graph.component_summary(b.part_graph(spark, d))


@query(twins.levels(_PG_GRAPH, twins.first_by_hash(0, 1, "SELECT DISTINCT s AS i FROM g")).replace("SELECT source, node, level FROM s12", "SELECT max(level)::DOUBLE AS first_depth, count(*) AS reached FROM s12"))
def reach_of_first(spark, d):
    e = graph.edges_of(b.part_graph(spark, d))
    pick = e.select(F.col("src").alias("node")).distinct().orderBy(F.md5(F.concat_ws(":", F.lit(0), "node").cast("string")), "node").limit(1)
    return graph.bfs(e, pick).agg(F.max("level").cast("double").alias("first_depth"), F.count("*").alias("reached"))


@query(f"""WITH RECURSIVE m AS MATERIALIZED ({PS}), e AS MATERIALIZED (SELECT r AS s, c + {ROWS['pp']} AS t FROM m UNION SELECT c + {ROWS['pp']}, r FROM m),
w AS (SELECT 0::BIGINT AS node, 0 AS level UNION SELECT e.t, w.level + 1 FROM w JOIN e ON e.s = w.node WHERE w.level < 16) SELECT 0::BIGINT AS source, node, min(level) AS level FROM w GROUP BY node""")
def bfs_levels(spark, d):
    return graph.bfs(graph.edges_of(b.part_supplier(spark, d)), spark.createDataFrame([(0,)], "node long"))


@query(twins.levels(_PG_GRAPH, twins.first_by_hash(42, 64, "SELECT p_partkey AS i FROM part")))
def bfs_multi_source(spark, d):
    m = b.part_graph(spark, d)
    src = m.spine.orderBy(F.md5(F.concat_ws(":", F.lit(42), "row").cast("string")), "row").limit(64).select(F.col("row").alias("node"))
    return graph.bfs(graph.edges_of(m), src)


@query(f"SELECT node, round(rank, 9) AS rank FROM ({twins.pagerank(_PG_GRAPH)})")
def pagerank(spark, d):
    return graph.pagerank(b.part_graph(spark, d)).withColumn("rank", F.round("rank", 9))


@query(f"WITH m AS MATERIALIZED ({PG}), w AS (SELECT sum(k * (k - 1) // 2) AS w FROM (SELECT count(*) AS k FROM m GROUP BY r)), t AS (SELECT count(*) AS t FROM m a JOIN m z ON z.r = a.c AND a.c > a.r AND z.c > z.r JOIN m y ON y.r = a.r AND y.c = z.c) SELECT CAST(w AS BIGINT) AS wedges, t AS triangles, round(3.0 * t / w, 9) AS triangle_closure_rate FROM w, t")
def triangles(spark, d):
    pairs = b.part_pairs(spark, d)
    ends = b.t(spark, d, "lineitem").agg(F.min("l_partkey"), F.max("l_partkey")).first()
    if ends[0] is not None and 0 <= ends[0] and ends[1] < packed.MOST:
        return _round_all(packed.closure(pairs, ends[1] + 1))
    return _round_all(graph.triangles(graph.edges_of(b.part_graph(spark, d))))


def _points(spark, d):
    s = b.t(spark, d, "supplier")
    return s.groupBy(F.col("s_nationkey").cast("long").alias("id")).agg(F.avg("s_acctbal").alias("x"), F.count("*").cast("double").alias("y"))


@query(twins.mst_flexibility())
def mst_flexibility(spark, d):
    e = graph.complete_distances(_points(spark, d))
    tree = graph.minimum_spanning_forest(e)
    return report.mst_flexibility(tree, float(e.agg(F.max("w")).first()[0]))


@query(f"WITH {twins.spanning_tree()} SELECT u, v, round(w, 9) AS w FROM tree")
def spanning_tree(spark, d):
    return _round_all(graph.minimum_spanning_forest(graph.complete_distances(_points(spark, d))))


@query(f"WITH m AS ({CP}), p AS (SELECT c_custkey AS i, c_custkey * 8 // {ROWS['cp']} AS part FROM customer), g AS (SELECT c, count(DISTINCT part) - 1 AS k FROM m JOIN p ON i = r GROUP BY c) SELECT CAST(sum(k) AS BIGINT) AS connectivity, count(*) FILTER (k > 0) AS cut_cols FROM g")
def connectivity_cost(spark, d):
    m = b.customer_part(spark, d)
    return heuristics.connectivity_cost(m, m.spine.select("row", F.expr(f"row * 8 div {m.rows}").alias("part")))


@query(f"WITH m AS ({PG}) SELECT count(*) AS edge_cut FROM m WHERE r < c AND r * 8 // {ROWS['pp']} <> c * 8 // {ROWS['pp']}")
def edge_cut(spark, d):
    m = b.part_graph(spark, d)
    return heuristics.edge_cut(m, m.spine.select("row", F.expr(f"row * 8 div {m.rows}").alias("part")))


# ---- products

_B = f"bm AS (SELECT s_suppkey AS i, unnest(range(8)) AS k FROM supplier), bv AS (SELECT i, k, CAST((i * 7 + k * 3) % 11 AS DOUBLE) AS x FROM bm)"


def _dense(spark, d, n=8):
    e = b.t(spark, d, "supplier").select(F.col("s_suppkey").alias("row"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("k"))
    return e.withColumn("val", F.pmod(F.col("row") * 7 + F.col("k") * 3, F.lit(11)).cast("double"))


@query(f"WITH m AS ({PS}), {_B} SELECT r, k, CAST(sum(v * x) AS DOUBLE) AS v FROM m JOIN bv ON i = c GROUP BY 1, 2")
def spmm(spark, d):
    return _rc(linalg.spmm(b.part_supplier(spark, d), _dense(spark, d)))


@query(f"WITH m AS ({PS}), {_B} SELECT r, k, CAST(sum(v * x) AS DOUBLE) AS v FROM m JOIN bv ON i = c GROUP BY 1, 2")
def spmm_bsr(spark, d):
    return _rc(linalg.spmm_bsr(b.part_supplier(spark, d).to_bsr(16), 16, _dense(spark, d), 8))


@query(f"WITH m AS ({PS}) SELECT r, CAST(sum(v * (c % 7)) AS DOUBLE) AS v FROM m GROUP BY r")
def spmv(spark, d):
    return _rc(linalg.spmv(b.part_supplier(spark, d), b.t(spark, d, "supplier").select(F.col("s_suppkey").alias("row"), F.pmod("s_suppkey", F.lit(7)).cast("double").alias("val"))))


# ---- reports

AN, OPS, JOBS = b.ANALYSIS, b.OPERATIONS, b.JOBS
_PIV_COLS = ", ".join(f"max(block_density_16) FILTER (perm = '{a}') AS {a}" for a in b.ALGOS)
_PIVOT = f"an AS ({AN}), pv AS (SELECT matrix, {_PIV_COLS} FROM an WHERE perm_type = 'SYMMETRIC' GROUP BY matrix HAVING count(DISTINCT perm) >= 7)"
_BESTS = f"{_PIVOT}, lg AS (UNPIVOT pv ON {', '.join(b.ALGOS)} INTO NAME algo VALUE x), bs AS (SELECT matrix, arg_min(algo, (-x, algo)) AS best_algorithm, max(x) AS best, max(x) - min(x) <= 1e-12 AS all_tied FROM lg GROUP BY matrix), bt AS (SELECT bs.*, (SELECT count(*) FROM lg WHERE lg.matrix = bs.matrix AND abs(x - best) <= 1e-12) AS n_tied FROM bs)"


@query(f"WITH {_PIVOT} SELECT * FROM pv")
def affinity_pivot(spark, d):
    return report.affinity_pivot(b.analysis(spark, d), b.ALGOS)


@query(f"WITH {_BESTS} SELECT matrix, best_algorithm, best, n_tied, all_tied FROM bt")
def affinity_best(spark, d):
    return report.affinity_best(report.affinity_pivot(b.analysis(spark, d), b.ALGOS), b.ALGOS)


@query(f"WITH {_BESTS}, ba AS (SELECT matrix, max(block_density_16) AS baseline FROM an WHERE perm IS NULL GROUP BY 1) SELECT matrix, best_algorithm, best, n_tied, all_tied, baseline, round((best - baseline) / baseline * 100, 6) AS gain_pct FROM bt LEFT JOIN ba USING (matrix)")
def affinity_gain(spark, d):
    a = b.analysis(spark, d)
    g = report.affinity_gain(report.affinity_best(report.affinity_pivot(a, b.ALGOS), b.ALGOS), a)
    return g.withColumn("gain_pct", F.round("gain_pct", 6))


@query(f"WITH {_BESTS} SELECT best_algorithm, count(*) AS n FROM bt GROUP BY 1")
def value_counts(spark, d):
    return report.value_counts(report.affinity_best(report.affinity_pivot(b.analysis(spark, d), b.ALGOS), b.ALGOS), "best_algorithm")


_SEG = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(f"WITH j AS ({JOBS}) SELECT matrix, " + ", ".join(f"count(*) FILTER (perm = '{s}') AS {s}" for s in _SEG) + " FROM j GROUP BY matrix")
def crosstab(spark, d):
    return report.crosstab(b.jobs(spark, d), "matrix", "perm", _SEG)


@query(f"WITH j AS ({JOBS}), g AS (SELECT matrix, count(*) AS k FROM j GROUP BY 1 ORDER BY k DESC, matrix LIMIT 8) SELECT CASE WHEN g.matrix IS NULL THEN 'Other' ELSE j.matrix END AS label, count(*) AS n FROM j LEFT JOIN g ON j.matrix = g.matrix GROUP BY 1")
def top_groups_other(spark, d):
    return report.top_groups_other(b.jobs(spark, d), "matrix").groupBy("label").agg(F.count("*").alias("n"))


@query(f"WITH j AS ({JOBS}), g AS (SELECT status, matrix, count(*) AS n FROM j GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY status ORDER BY n DESC, matrix) AS pos FROM g) WHERE pos <= 3")
def top_per_group(spark, d):
    return report.top_per_group(b.jobs(spark, d), "status", "matrix")


@query("SELECT p_brand, count(*) AS size, round(avg(p_size), 4) AS p_size, round(avg(p_retailprice), 4) AS p_retailprice FROM part GROUP BY 1")
def cluster_profile(spark, d):
    return report.cluster_profile(b.t(spark, d, "part"), "p_brand", ["p_size", "p_retailprice"])


@query(f"WITH a AS ({AN}), o AS ({OPS}) SELECT o.matrix, kernel, o.perm, o.perm_type, time_operation_ms, time_order_ms, block_density_16, bandwidth_avg FROM o JOIN a ON o.matrix = a.matrix AND o.perm IS NOT DISTINCT FROM a.perm AND o.perm_type IS NOT DISTINCT FROM a.perm_type")
def join_ops_analysis(spark, d):
    return report.join_results(b.operations(spark, d), b.analysis(spark, d))


@query(f"WITH o AS ({OPS}), z AS (SELECT matrix, kernel, avg(time_operation_ms) AS t0 FROM o WHERE perm IS NULL GROUP BY 1, 2), r AS (SELECT matrix, kernel, perm, avg(time_operation_ms) AS t, avg(time_order_ms) AS k FROM o WHERE perm IS NOT NULL GROUP BY 1, 2, 3) SELECT matrix, kernel, perm, round(t0 / t, 6) AS speedup, round(CASE WHEN t0 > t THEN k / (t0 - t) END, 4) AS breakeven FROM r JOIN z USING (matrix, kernel)")
def speedup_breakeven(spark, d):
    return report.breakeven(b.operations(spark, d)).withColumns({"speedup": F.round("speedup", 6), "breakeven": F.round("breakeven", 4)})


_COR = f"WITH a AS ({AN}), x AS (SELECT *, rank() OVER (PARTITION BY matrix ORDER BY block_density_16) + (count(*) OVER (PARTITION BY matrix, block_density_16) - 1) / 2 AS rx, rank() OVER (PARTITION BY matrix ORDER BY bandwidth_avg) + (count(*) OVER (PARTITION BY matrix, bandwidth_avg) - 1) / 2 AS ry, row_number() OVER () AS i FROM a), k AS (SELECT p.matrix, sum(sign(q.rx - p.rx) * sign(q.ry - p.ry)) AS s, sum(abs(sign(q.rx - p.rx))) AS nx, sum(abs(sign(q.ry - p.ry))) AS ny FROM x p JOIN x q ON p.matrix = q.matrix AND p.i < q.i GROUP BY 1)"


@query(f"{_COR}, l AS (SELECT matrix, corr(block_density_16, bandwidth_avg) AS pe, corr(rx, ry) AS sp FROM x GROUP BY 1) SELECT l.matrix, round(pe, 6) AS pearson, round(sp, 6) AS spearman, round(s / sqrt(nx * ny), 6) AS kendall FROM l LEFT JOIN k ON l.matrix = k.matrix")
def correlations(spark, d):
    return _round_all(report.correlations(b.analysis(spark, d), "block_density_16", "bandwidth_avg", "matrix"), 6)


@query("SELECT l_returnflag, " + ", ".join(f"round(quantile_cont(l_extendedprice, {q}), 4) AS p{int(q * 100):02d}" for q in (0.05, 0.25, 0.5, 0.75, 0.95)) + " FROM lineitem GROUP BY 1")
def box_stats(spark, d):
    return _round_all(report.box_stats(b.t(spark, d, "lineitem"), "l_returnflag", "l_extendedprice"), 4)


@query(f"WITH j AS ({JOBS}), n AS (SELECT count(*) AS t FROM j) SELECT status, tag, perm, CAST(grouping(status, tag, perm) AS BIGINT) AS level, count(*) AS n, round(100.0 * count(*) / max(t), 6) AS pct, count(DISTINCT matrix) AS n_matrices, min(error) AS example FROM j, n GROUP BY ROLLUP (status, tag, perm)")
def status_rollup(spark, d):
    return report.status_rollup(b.jobs(spark, d)).withColumn("pct", F.round("pct", 6))


@query(f"WITH o AS (SELECT DISTINCT matrix, perm FROM ({OPS}) WHERE time_operation_ms > 25.5) SELECT m.matrix, a.perm FROM (SELECT DISTINCT p_brand AS matrix FROM part) m, (SELECT unnest({b._ALGO_LIST}) AS perm) a WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.matrix = m.matrix AND o.perm = a.perm)")
def missing_runs(spark, d):
    done = b.operations(spark, d).where("time_operation_ms > 25.5")
    perms = spark.createDataFrame([(a,) for a in b.ALGOS], "perm string")
    return report.missing_runs(b.t(spark, d, "part").select(F.col("p_brand").alias("matrix")), perms, done)


@query("SELECT b.matrix, p.perm, n.n_cols, s.block_size FROM (SELECT DISTINCT p_brand AS matrix FROM part) b, (SELECT unnest(['rcm', 'gray']) AS perm) p, (SELECT unnest([32, 256]) AS n_cols) n, (SELECT unnest([8, 16, 32]) AS block_size) s")
def experiment_grid(spark, d):
    m = b.t(spark, d, "part").select(F.col("p_brand").alias("matrix")).distinct()
    return report.experiment_grid(m, ["rcm", "gray"], [32, 256], [8, 16, 32])


def _shapes(spark, d):
    p = b.t(spark, d, "part")
    return p.select(F.col("p_name").alias("matrix"), F.col("p_brand").alias("family"), F.col("p_size").cast("long").alias("n_rows"), F.col("p_size").cast("long").alias("n_cols"), F.pmod("p_partkey", F.lit(37)).alias("nnz"), F.pmod("p_partkey", F.lit(11)).alias("bandwidth_max"), "p_partkey").withColumn("matrix", F.concat_ws("#", "matrix", F.col("p_partkey").cast("string"))).drop("p_partkey")


@query("WITH f AS (SELECT p_name || '#' || p_partkey AS matrix, p_brand AS family, CAST(p_size AS BIGINT) AS n_rows, CAST(p_size AS BIGINT) AS n_cols, p_partkey % 37 AS nnz, p_partkey % 11 AS bandwidth_max FROM part) SELECT * FROM f WHERE n_rows BETWEEN 5 AND 40 AND bandwidth_max >= 2 AND nnz <= 0.9 * n_rows * n_cols QUALIFY row_number() OVER (PARTITION BY family ORDER BY nnz DESC, matrix) = 1")
def corpus_filter(spark, d):
    return report.corpus_filter(_shapes(spark, d), one_per_family=True, square_only=True, min_size=5, max_size=40, min_bandwidth=2, max_density=0.9)


_NAMES = """SELECT CASE n_regionkey % 3 WHEN 0 THEN n_name WHEN 1 THEN 'ZOO__' || n_name || '-er-0.' || n_nationkey || '-CIFAR-10-seed' || n_regionkey || '_matrices__matrices__er__conv_' || n_nationkey
  ELSE 'ZOO__' || n_name || '_matrices' END AS matrix, n_regionkey, n_nationkey FROM nation"""


def _names(spark, d):
    zoo = F.concat(F.lit("ZOO__"), "n_name")
    vision = F.concat(zoo, F.lit("-er-0."), "n_nationkey", F.lit("-CIFAR-10-seed"), "n_regionkey", F.lit("_matrices__matrices__er__conv_"), "n_nationkey")
    name = F.when(F.col("n_regionkey") % 3 == 0, F.col("n_name")).when(F.col("n_regionkey") % 3 == 1, vision).otherwise(F.concat(zoo, F.lit("_matrices")))
    return b.t(spark, d, "nation").withColumn("matrix", name)


_CONFIG = "regexp_replace(coalesce(nullif(split_part(matrix, '__', 2), ''), matrix), '_matrices$', '')"
_ARCH = f"coalesce(nullif(regexp_extract({_CONFIG}, '{ARCH}', 1), ''), {_CONFIG})"
_PRUNER = "coalesce(nullif(split_part(matrix, '__', 4), ''), 'Unknown')"


@query(f"SELECT matrix, {_ARCH} AS arch, {_CONFIG} AS config, {_PRUNER} AS pruner, split_part(matrix, '__', 5) AS layer FROM ({_NAMES})")
def name_parts(spark, d):
    return _names(spark, d).select("matrix", *matrix_name())


@query(f"""SELECT matrix, CASE WHEN n_nationkey % 5 = 0 THEN 'g' || n_regionkey WHEN matrix LIKE 'ZOO!_!_%' ESCAPE '!' THEN {_ARCH} ELSE 'Unknown' END AS "group",
  CASE WHEN n_nationkey % 5 = 0 THEN 'k' || n_nationkey WHEN matrix LIKE 'ZOO!_!_%' ESCAPE '!' THEN {_PRUNER} ELSE 'Unknown' END AS kind FROM ({_NAMES})""")
def label_lookup(spark, d):
    n = _names(spark, d)
    heads = n.where("n_nationkey % 5 = 0").select("matrix", F.concat(F.lit("g"), "n_regionkey").alias("group"), F.concat(F.lit("k"), "n_nationkey").alias("kind"))
    return report.label_lookup(n.select("matrix"), heads, "ZOO")


@query(f"""WITH j AS ({JOBS}), t AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY n DESC, matrix) AS pos FROM (SELECT status, matrix, count(*) AS n FROM j GROUP BY ALL)),
  a AS (SELECT status, string_agg(matrix, chr(10) ORDER BY pos) AS top FROM t WHERE pos <= 3 GROUP BY 1) SELECT o_orderstatus AS status, round(quantile_cont(o_totalprice, 0.5), 4) AS o_totalprice, max(top) AS top
  FROM orders JOIN a ON status = o_orderstatus GROUP BY 1""")
def group_medians(spark, d):
    o = b.t(spark, d, "orders").join(b.t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(b.t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    o = o.select(F.col("o_orderstatus").alias("status"), F.col("n_name").alias("matrix"), "o_totalprice")
    return _round_all(report.group_medians(o, "status", "matrix", ["o_totalprice"]), 4)


@query("SELECT p_brand AS matrix, p_type AS suite FROM part WHERE p_size % 3 = 0 GROUP BY ALL")
def suite_rows(spark, d):
    p = b.t(spark, d, "part")
    suite = F.element_at(F.array(*[F.lit(x) for x in sorted(SUITES)]), (F.col("p_size") % 3 + 1).cast("int"))
    grid = p.select(F.col("p_brand").alias("matrix"), F.col("p_type").alias("container"), suite.alias("suite")).distinct()
    return select_suite(grid, "ai").select("matrix", F.col("container").alias("suite"))


@query("SELECT p_partkey, p_name FROM part WHERE p_brand IN (SELECT DISTINCT p_brand FROM part WHERE p_size < 5)")
def listed_rows(spark, d):
    p = b.t(spark, d, "part")
    names = p.where("p_size < 5").select(F.concat(F.lit("/some/where/"), "p_brand", F.lit(".mtx")).alias("path"))
    return keep_listed(p.select("p_partkey", "p_name", "p_brand"), names, "p_brand").select("p_partkey", "p_name")


@query("SELECT c_mktsegment AS stem, arg_min(c_name, c_custkey) AS path FROM customer GROUP BY 1")
def first_path(spark, d):
    return report.first_path(b.t(spark, d, "customer").select(F.col("c_mktsegment").alias("stem"), F.col("c_name").alias("path"), F.col("c_custkey").alias("line_no")))


# ---- clustering

_F = ["p_size", "p_retailprice"]


@query("WITH x AS (SELECT p_partkey, p_size::DOUBLE AS a, ln(1 + greatest(p_retailprice, 0)) AS z FROM part), s AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(z) AS mz, stddev_pop(z) AS sz FROM x) SELECT p_partkey, round((a - ma) / sa, 9) AS p_size, round((z - mz) / sz, 9) AS p_retailprice FROM x, s")
def preprocess_scale(spark, d):
    return _round_all(ml.preprocess(b.t(spark, d, "part"), _F, log=("p_retailprice",)).select("p_partkey", *_F))


@query("WITH t AS (SELECT c_mktsegment AS a, c_nationkey AS z, count(*) AS n FROM customer GROUP BY 1, 2), x AS (SELECT sum(n) AS n, sum(n * n) AS q FROM t GROUP BY a), y AS (SELECT sum(n) AS n, sum(n * n) AS q FROM t GROUP BY z), c AS (SELECT sum(n)::DOUBLE AS N, sum(n * (n - 1) / 2) AS s FROM t), k AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM x) AS sx, (SELECT sum(n * (n - 1) / 2) FROM y) AS sy, (SELECT -sum(x.n / c.N * ln(x.n / c.N)) FROM x, c) AS hx, (SELECT -sum(y.n / c.N * ln(y.n / c.N)) FROM y, c) AS hy), i AS (SELECT sum(t.n / c.N * ln(c.N * t.n / (ra.n * rb.n))) AS mi FROM t JOIN (SELECT a, sum(n) AS n FROM t GROUP BY 1) ra USING (a) JOIN (SELECT z, sum(n) AS n FROM t GROUP BY 1) rb USING (z), c) SELECT round((s - sx * sy / (N * (N - 1) / 2)) / ((sx + sy) / 2 - sx * sy / (N * (N - 1) / 2)), 9) AS ari, round(mi / ((hx + hy) / 2), 9) AS nmi FROM c, k, i")
def ari_nmi(spark, d):
    return _round_all(ml.agreement(b.t(spark, d, "customer"), "c_mktsegment", "c_nationkey"))


@query()
def kmeans_sweep(spark, d):
    p = b.t(spark, d, "part").groupBy(F.col("p_brand").alias("matrix")).agg(F.avg("p_size").alias("p_size"), F.avg("p_retailprice").alias("p_retailprice"))
    p = p.withColumn("group", F.substring("matrix", 1, 7))
    rows, best, _ = ml.sweep(ml.preprocess(p, _F, log=()), _F, label="group")
    return spark.createDataFrame([(*r, r[0] == best) for r in rows], "k int, inertia double, silhouette double, ari double, nmi double, best boolean")


@query()
def cluster_report(spark, d):
    """Profile of the best clustering: sizes and means, k-means and Ward labels side by side."""
    p = b.t(spark, d, "part").groupBy(F.col("p_brand").alias("matrix")).agg(F.avg("p_size").alias("p_size"), F.avg("p_retailprice").alias("p_retailprice"))
    _, _, done = ml.sweep(ml.preprocess(p, _F, log=()), _F)
    return report.cluster_profile(p.join(done, "matrix"), "cluster", ["p_size", "p_retailprice", "cluster_agg"])


# ---- event windows (an extension)


@query("SELECT date_trunc('hour', ts) AS window_start, user_id AS r, event_type AS c, count(*) AS n FROM events GROUP BY ALL")
def event_incidence(spark, d):
    from ..streaming.incidence import windowed_incidence

    return _rc(windowed_incidence(b.t(spark, d, "events"), "ts", "user_id", "event_type").withColumn("window_start", F.col("window_start").cast("timestamp_ntz")))
