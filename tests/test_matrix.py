import random

import pytest

from gridweave.functions import bits
from gridweave.operators import graph, metrics, ordering
from gridweave.operators import sketch as sk
from gridweave.operators.matrix import Axis, SparseMatrix, check_permutation, compose, from_bsr, identity, inverse


def matrix(spark, entries, rows, cols):
    return SparseMatrix.build(spark.createDataFrame(entries, "row long, col long, val double"), rows, cols)


def random_matrix(spark, seed, rows=40, cols=60, n=150):
    r = random.Random(seed)
    e = sorted({(r.randrange(rows), r.randrange(cols)) for _ in range(n)})
    return matrix(spark, [(i, j, 1.0) for i, j in e if i % 7], rows, cols), [(i, j) for i, j in e if i % 7]


def perm_list(p):
    return [r["old_idx"] for r in p.orderBy("new_pos").collect()]


def test_build_sums_mirrors_and_drops(spark):
    e = [(0, 1, 2.0), (0, 1, 3.0), (2, 2, None), (9, 0, 1.0), (-1, 0, 1.0)]
    m = matrix(spark, e, 3, 3)
    assert sorted(map(tuple, m.coo.collect())) == [(0, 1, 5.0), (2, 2, None)]
    s = SparseMatrix.build(spark.createDataFrame([(1, 0, 4.0), (2, 2, 1.0)], "row long, col long, val double"), 3, 3, "skew-symmetric")
    assert sorted(map(tuple, s.coo.collect())) == [(0, 1, -4.0), (1, 0, 4.0), (2, 2, 1.0)]


def test_splitmix64(spark):
    def model(x):
        mask = (1 << 64) - 1
        z = (x + bits.GAMMA) & mask
        z = ((z ^ (z >> 30)) * bits.MUL1) & mask
        z = ((z ^ (z >> 27)) * bits.MUL2) & mask
        return z ^ (z >> 31)

    xs = [0, 1, 2, 31, 12345, 2**40, 2**62 + 7]
    got = bits.splitmix64(spark.createDataFrame([(x,) for x in xs], "x long"), "x", "h", bits.SEED_1).collect()
    assert {r["x"]: r["h"] for r in got} == {x: bits.signed(model(x ^ bits.SEED_1)) for x in xs}


def test_permutations(spark):
    m, _ = random_matrix(spark, 1)
    p, q = ordering.random_rows(spark, 40, 1), ordering.random_rows(spark, 40, 2)
    assert sorted(perm_list(p)) == list(range(40)) and perm_list(p) != perm_list(q)
    assert perm_list(compose(inverse(p), p)) == list(range(40))
    a, b = perm_list(p), perm_list(q)
    assert perm_list(compose(q, p)) == [a[i] for i in b]
    with pytest.raises(ValueError, match="40"):
        check_permutation(identity(spark, 39), 40)
    with pytest.raises(ValueError, match="square"):
        m.apply(Axis.SYMMETRIC, p)


@pytest.mark.parametrize("seed", [3, 4])
def test_lexicographic_is_sorted_lists(spark, seed):
    m, e = random_matrix(spark, seed)
    s = sk.mask(m, 4)
    wins = {}
    for i, j in e:
        wins.setdefault(i, set()).add(j // 4)
    deg = {}
    for w in wins.values():
        for x in w:
            deg[x] = deg.get(x, 0) + 1
    rank = {w: k for k, w in enumerate(sorted(deg, key=lambda w: (-deg[w], w)))}
    want = sorted(range(40), key=lambda i: (sorted(rank[w] for w in wins.get(i, ())), i))
    assert perm_list(ordering.lexicographic(s, 40)) == want


def test_first_window_puts_empty_rows_last(spark):
    m = matrix(spark, [(1, 9, 1.0), (3, 2, 1.0)], 5, 10)
    assert perm_list(ordering.first_window(sk.mask(m, 2), 5)) == [3, 1, 0, 2, 4]
    with pytest.raises(ValueError):
        sk.mask(m, 0)


@pytest.mark.parametrize("seed", [5, 6])
def test_micro_clusters_are_the_greedy_runs(spark, seed):
    m, _ = random_matrix(spark, seed, cols=16, n=200)
    rs = sk.row_sketches(sk.mask(m, 4), m.rows)
    rows = sorted(map(tuple, rs.select("h1", "h2", "rare_win", "row_len", "row_id").collect()))
    groups, last = [], None
    for r in rows:
        bucket = ((r[0] >> 56) & 255) ^ 128
        if last is not None and bucket == last[1] and len(groups[-1]) < 3 and (r[0] == last[0][0] or r[2] == last[0][2]):
            groups[-1].append(r[4])
        else:
            groups.append([r[4]])
        last = (r, bucket)
    got = sk.micro_clusters(rs, 3).orderBy("micro_id", "pos_in_micro").collect()
    assert [(r["row"], r["micro_id"]) for r in got] == [(x, i) for i, g in enumerate(groups) for x in g]


def test_hybrid_is_a_bijection_with_empty_rows_first(spark):
    m, e = random_matrix(spark, 7)
    empty = sorted(set(range(40)) - {i for i, _ in e})
    p, stats = ordering.hybrid_stages(sk.mask(m, 4), 40, 4, 8)
    got = perm_list(p)
    assert sorted(got) == list(range(40)) and got[: len(empty)] == empty
    assert stats.first()["n_empty"] == len(empty)


def test_two_sided_never_gets_worse(spark):
    m, _ = random_matrix(spark, 8)
    r, c, counts = ordering.two_sided(m, 2, 2, 4)
    n = metrics.block_count(m.permute_rows(r).permute_cols(c), 4, 4).first()[0]
    assert n == min(counts)


def test_blocks_round_trip_and_upper_bound(spark):
    m, e = random_matrix(spark, 9)
    bsr = m.to_bsr(4)
    back = from_bsr(bsr, 4, 40, 60)
    assert sorted((r["row"], r["col"]) for r in back.coo.collect()) == sorted(e)
    want = set()
    for br, bc in {(i // 4, j // 4) for i, j in e}:
        want |= {(r, c) for r in range(br * 4 // 6, (br * 4 + 3) // 6 + 1) for c in range(bc * 4 // 6, (bc * 4 + 3) // 6 + 1)}
    assert metrics.block_count_bsr(bsr, 4, 6, 6).first()[0] == len(want)


def test_row_ptr_counts_empty_rows(spark):
    m = matrix(spark, [(1, 0, 1.0), (1, 2, 1.0), (3, 1, 1.0)], 5, 3)
    assert [tuple(r) for r in m.row_ptr().orderBy("row").collect()] == [(0, 0, 0), (1, 2, 0), (2, 0, 2), (3, 1, 2), (4, 0, 3)]


def test_components_and_spanning_forest(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 31)], "src long, dst long")
    got = {r["node"]: r["component"] for r in graph.components(chain).collect()}
    assert all(got[i] == 0 for i in range(21)) and got[31] == 30
    e = spark.createDataFrame([(0, 1, 1.0), (1, 2, 2.0), (0, 2, 2.5), (3, 4, 1.0)], "u long, v long, w double")
    assert sorted(map(tuple, graph.minimum_spanning_forest(e).collect())) == [(0, 1, 1.0), (1, 2, 2.0), (3, 4, 1.0)]
