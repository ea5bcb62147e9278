import pytest

from gridweave import api
from gridweave.operators import heuristics, ordering, report
from gridweave.operators.matrix import SparseMatrix


def square(spark):
    e = [(i, j) for i in range(12) for j in range(12) if abs(i - j) in (1, 5) and (i, j) != (3, 4) and (i, j) != (4, 3)]
    return SparseMatrix.build(spark.createDataFrame([(i, j, 1.0) for i, j in e], "row long, col long, val double"), 14, 14)


def test_entry_points(spark, tmp_path):
    p = tmp_path / "a.mtx"
    p.write_text("%%MatrixMarket matrix coordinate pattern general\n4 4 5\n1 1\n2 3\n3 1\n4 3\n4 4\n")
    rows, cols = api.two_sided(spark, str(p), 1, 2)
    assert sorted(r["old_idx"] for r in rows.collect()) == [0, 1, 2, 3] == sorted(r["old_idx"] for r in cols.collect())
    assert sorted(r["old_idx"] for r in api.hybrid(spark, str(p), W=2).collect()) == [0, 1, 2, 3]
    with pytest.raises(FileNotFoundError):
        api.hybrid(spark, str(tmp_path / "none.mtx"))


@pytest.mark.parametrize("f", [heuristics.rcm, heuristics.minimum_degree, heuristics.window_greedy, heuristics.gray_order, heuristics.partition_order, heuristics.lsh_order, heuristics.overlap_groups, heuristics.mst_order, ordering.by_degree])
def test_orders_are_bijections(spark, f):
    got = f(square(spark)).collect()
    assert sorted(r["old_idx"] for r in got) == list(range(14)) == sorted(r["new_pos"] for r in got)


def test_flexibility(spark):
    tree = spark.createDataFrame([(0, 1, 1.0), (1, 2, 2.0), (2, 3, 4.0)], "u long, v long, w double")
    assert report.mst_flexibility(tree, 5.0, 2.0).first()["psi"] == 1


def brute_burn(nodes, edges, k):
    """SlashBurn with sets: hubs in front, then the last giant, then the spokes of later rounds before those of earlier ones."""
    live, front, back = set(nodes), [], []
    near = {v: {y for x, y in edges if x == v} | {x for x, y in edges if y == v} for v in nodes}
    while len(live) > k or not front:
        hubs = sorted(live, key=lambda v: (-len(near[v] & live), v))[:k]
        front += hubs
        live -= set(hubs)
        comps, left = [], set(live)
        while left:
            comp, todo = set(), [min(left)]
            while todo:
                v = todo.pop()
                if v not in comp:
                    comp.add(v)
                    todo += near[v] & left
            left -= comp
            comps.append(comp)
        comps.sort(key=lambda c: (-len(c), min(c)))
        back = [v for _, v in sorted((-len(c), v) for c in comps[1:] for v in c)] + back
        live = comps[0] if comps else set()
    return front + sorted(live) + back


@pytest.mark.parametrize("n, p, k, local", [(180, 0.1, None, 10**6), (60, 0.05, 2, 10**6), (24, 0.12, 4, 0)])
def test_slashburn_against_sets(spark, n, p, k, local):
    import random

    r = random.Random(n)
    e = [(i, j) for i in range(n) for j in range(n) if i < j and r.random() < p]
    m = SparseMatrix.build(spark.createDataFrame([(i, j, 1.0) for i, j in e], "row long, col long, val double"), n, n)
    got = [r["old_idx"] for r in sorted(heuristics.slashburn(m, k, local).collect(), key=lambda r: r["new_pos"])]
    assert got == brute_burn(range(n), e, k or 1)
