"""Orders that run step by step, against literal models with sets and lists."""

import math
import random

import numpy as np
import pytest

from gridweave.operators import heuristics, metrics, ml, ordering, report
from gridweave.operators import sketch as sk
from gridweave.operators.matrix import SparseMatrix, compose, identity


def square(spark, n, p, seed):
    r = random.Random(seed)
    e = [(i, j) for i in range(n) for j in range(i + 1, n) if r.random() < p]
    m = SparseMatrix.build(spark.createDataFrame([(i, j, 1.0) for i, j in e] or [(0, 0, 1.0)], "row long, col long, val double"), n, n)
    near = {v: set() for v in range(n)}
    for i, j in e:
        near[i].add(j)
        near[j].add(i)
    return m, near


def sketch(spark, rows, wins, count, seed):
    r = random.Random(seed)
    e = sorted({(r.randrange(rows), r.randrange(wins)) for _ in range(count)})
    s = spark.createDataFrame(e, "row long, win long")
    of = {i: {w for x, w in e if x == i} for i in range(rows)}
    return s, of


def perm(df):
    return [r["old_idx"] for r in sorted(df.collect(), key=lambda r: r["new_pos"])]


def parts(near):
    """Components by least vertex, isolated ones too."""
    left, out = set(near), []
    while left:
        todo, comp = [min(left)], set()
        while todo:
            v = todo.pop()
            if v not in comp:
                comp.add(v)
                todo += near[v]
        left -= comp
        out.append(sorted(comp))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_rcm(spark, seed):
    m, near = square(spark, 40, 0.06, seed)

    def walk(comp, start):
        placed, levels = {start: 0}, [[start]]
        while levels[-1]:
            nxt = []
            for v in levels[-1]:
                for u in sorted(near[v] - set(placed), key=lambda u: (len(near[u]), u)):
                    placed[u] = len(placed)
                    nxt.append(u)
            levels.append(nxt)
        return [v for level in levels for v in level]

    want = []
    for comp in parts(near):
        first = min(comp, key=lambda v: (len(near[v]), v))
        want += walk(comp, walk(comp, first)[-1])[::-1]
    assert perm(heuristics.rcm(m)) == want
    assert perm(heuristics.rcm(m, local_edges=3)) == want


@pytest.mark.parametrize("seed", [3, 4])
def test_minimum_degree(spark, seed):
    m, near = square(spark, 30, 0.1, seed)
    want = []
    for comp in parts(near):
        g = {v: set(near[v]) for v in comp}
        while g:
            v = min(g, key=lambda v: (len(g[v]), v))
            around = g.pop(v)
            want.append(v)
            for u in around:
                g[u] = (g[u] | around) - {u, v}
    assert perm(heuristics.minimum_degree(m)) == want


@pytest.mark.parametrize("seed", [5, 6])
def test_window_greedy(spark, seed):
    m, near = square(spark, 25, 0.15, seed)
    want = []
    for comp in parts(near):
        order = [max(comp, key=lambda v: (len(near[v]), -v))]
        while len(order) < len(comp):
            last = order[-3:]
            gain = lambda u: sum((u in near[v]) + len(near[u] & near[v]) for v in last)  # noqa: E731, B023
            order.append(max((u for u in comp if u not in order), key=lambda u: (gain(u), -u)))
        want += order
    assert perm(heuristics.window_greedy(m, 3)) == want


@pytest.mark.parametrize("seed", [7, 8])
def test_wavefront(spark, seed):
    import pandas as pd

    r = random.Random(seed)
    pins = sorted({(r.randrange(15), r.randrange(12)) for _ in range(40)} | {(m, 11) for m in range(15)})
    got = ordering._wavefront(pd.DataFrame([(0, m, w) for m, w in pins], columns=["comp", "micro_id", "win"]))
    wins = {m: {w for x, w in pins if x == m} for m in range(15)}
    members = {w: {m for m, y in pins if y == w} for w in range(12)}
    order, used = [min(wins, key=lambda m: (len(wins[m]), m))], set()
    at = 0
    while at < len(order):
        fresh = sorted(wins[order[at]] - used)
        used |= set(fresh)
        score = {}
        for w in fresh:
            for m in sorted(members[w] - set(order)):
                score[m] = np.float32(score.get(m, np.float32(0)) + np.float32(1) / np.float32(len(members[w])))
        order += sorted(score, key=lambda m: (-score[m], len(wins[m]), m))
        at += 1
    assert got.sort_values("pos")["micro_id"].tolist() == order[::-1]


@pytest.mark.parametrize("seed", [9, 10])
def test_slab_packing(spark, seed):
    s, of = sketch(spark, 30, 10, 90, seed)
    empty = sum(not w for w in of.values())
    start = spark.createDataFrame([(k, v) for k, v in enumerate(sorted(of, key=lambda v: (bool(of[v]), v)))], "new_pos long, old_idx long")
    got = perm(ordering._pack_slabs(start, s, empty, 8, 4))
    order = perm(start)
    dist = lambda a, b: np.float32(1) - np.float32(len(of[a] & of[b])) / np.float32(len(of[a] | of[b]))
    for lo in range(empty, 30, 8):
        slab = order[lo : lo + 8]
        for i in range(len(slab) - 1):
            ahead = slab[i + 1 : i + 5]
            best = min(range(len(ahead)), key=lambda k: (dist(slab[i], ahead[k]), k))
            slab[i + 1], slab[i + 1 + best] = slab[i + 1 + best], slab[i + 1]
        order[lo : lo + 8] = slab
    assert got == order


@pytest.mark.parametrize("k", [0, 3, 7])
def test_centroid_rounds(spark, k):
    """Every row within tau of the nearest centre; centres come in turns, all rows left at the end are the rest."""
    s, of = sketch(spark, 30, 8, 70, 11)
    got = perm(ordering.cluster_centroids(s, 30, k, 0.6))
    assert sorted(got) == list(range(30))
    if k == 0:
        assert got == list(range(30))
        return
    hashed = lambda turn: [r["row"] for r in spark.range(30).selectExpr("id as row", f"xxhash64(id, 42, {turn}) as h").orderBy("h", "row").collect()]
    left, want, turn = set(range(30)), [], 0
    gap = lambda a, b: 1 - len(of[a] & of[b]) / len(of[a] | of[b]) if of[a] | of[b] else 0.0
    while len(left) >= k:
        centres = [v for v in hashed(turn) if v in left][:k]
        groups = [[] for _ in centres]
        for v in sorted(left):
            d, c = min((gap(v, x), i) for i, x in enumerate(centres))
            if d <= 0.6:
                groups[c].append(v)
        want += [v for g in groups for v in g]
        left -= {v for g in groups for v in g}
        turn += 1
    assert got == want + sorted(left)


@pytest.mark.parametrize("seed", [12, 13])
def test_cluster_chain(spark, seed):
    s, of = sketch(spark, 24, 9, 70, seed)
    n = 24
    deg = {w: sum(w in x for x in of.values()) for w in range(9)}
    idf = {w: math.log(n / (1 + d)) for w, d in deg.items()}
    mass = {v: round(sum(idf[w] for w in of[v]), 9) for v in of if of[v]}
    clusters = {}
    for r in ordering.similarity_clusters(s, n, 0.5).collect():
        clusters.setdefault(r["comp"], []).append(r["row"])
    want = []
    for comp in sorted(clusters, key=lambda c: (-max(mass[v] for v in clusters[c]), c)):
        left = sorted(clusters[comp], key=lambda v: (-mass[v], v))
        nxt, stripe, room = left[0], set(), 4
        while left:
            if not room:
                nxt, stripe, room = left[0], set(), 4
            want.append(nxt)
            left.remove(nxt)
            stripe |= of[nxt]
            room -= 1
            share = {v: sum(idf[w] for w in of[v] & stripe) for v in left if of[v] & stripe}
            if share:
                top = max(share.values())
                nxt = min(v for v in share if share[v] > top - 1e-9)
            elif left:
                nxt = left[0]
    got = perm(ordering.cluster_chain(s, n, 4, 0.5))
    assert got[: len(want)] == want and got[len(want) :] == sorted(v for v in of if not of[v])


def test_similarity_rounds_never_cost_more(spark):
    s, of = sketch(spark, 40, 30, 160, 14)
    m = SparseMatrix(s.selectExpr("row", "win as col", "cast(1 as double) as val"), 40, 30)
    rows, cols = ordering.similarity_rounds(m, 4, 4)
    assert sorted(perm(rows)) == list(range(40)) and sorted(perm(cols)) == list(range(30))
    cost = lambda x, y: sum(ordering.stripe_cost(sk.mask(m.permute_cols(y), 4), x, b) for b in (4, 16))
    assert cost(rows, cols) <= cost(identity(spark, 40), identity(spark, 30))


def test_stripe_refinement(spark):
    s, of = sketch(spark, 50, 12, 150, 20)
    start = ordering.random_rows(spark, 50)
    cost, orders = [ordering.stripe_cost(s, start, 4)], [start]
    for passes in (1, 2, 3):
        orders.append(ordering.stripe_refine(s, start, 4, passes))
        assert sorted(perm(orders[-1])) == list(range(50))
        cost.append(ordering.stripe_cost(s, orders[-1], 4))
    assert cost == sorted(cost, reverse=True) and cost[1] < cost[0]
    # By hand: a group's stripes filled anew, kept where they have fewer windows.
    order, want = perm(start), []
    for lo in range(0, 50, 12):
        old = order[lo : lo + 12]
        left, new = list(old), []
        while left:
            have = set()
            for k in range(min(4, len(left))):
                pick = left[0] if not k else min(left, key=lambda v: (len(of[v] - have), -len(of[v] & have), old.index(v)))  # noqa: B023
                left.remove(pick)
                new.append(pick)
                have |= of[pick]
        windows = lambda rows: sum(len(set().union(*(of[v] for v in rows[k : k + 4]))) for k in range(0, len(rows), 4))
        want += new if windows(new) < windows(old) else old
    assert perm(orders[1]) == want


@pytest.mark.parametrize("seed", [15, 16])
def test_mst_order(spark, seed):
    s, of = sketch(spark, 20, 12, 70, seed)
    m = SparseMatrix(s.selectExpr("row", "win as col", "cast(1 as double) as val"), 20, 12)
    sim = {(a, b): len(of[a] & of[b]) / len(of[a] | of[b]) for a in of for b in of if a != b and of[a] & of[b]}
    knn = {(min(a, b), max(a, b)) for a in of for b in sorted((b for x, b in sim if x == a), key=lambda b: (-sim[a, b], b))[:3]}
    up, tree = list(range(20)), []

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    for w, a, b in sorted((round(1 - round(sim[e], 12), 12), *e) for e in knn):
        if root(a) != root(b):
            up[root(a)] = root(b)
            tree.append((a, b, w))
    near = {}
    for a, b, w in tree:
        near.setdefault(a, []).append((w, b))
        near.setdefault(b, []).append((w, a))
    walks = []
    left = set(near)
    while left:
        comp, todo = set(), [min(left)]
        while todo:
            v = todo.pop()
            if v not in comp:
                comp.add(v)
                todo += [u for _, u in near[v]]
        left -= comp
        order = []

        def dfs(v):
            order.append(v)
            for _, u in sorted(near[v]):
                if u not in order:
                    dfs(u)

        dfs(max(comp, key=lambda v: (len(near[v]), -v)))
        walks.append((-len(order), min(comp), order))
    want = [v for _, _, o in sorted(walks) for v in o]
    assert perm(heuristics.mst_order(m, 1, 3)) == want + sorted(set(range(20)) - set(want))


def test_overlap_groups(spark):
    s, of = sketch(spark, 30, 6, 60, 17)
    m = SparseMatrix(s.selectExpr("row", "win as col", "cast(1 as double) as val"), 30, 6)
    runs = {}
    for r in sk.row_sketches(s, 30).collect():
        runs.setdefault(r["h1"], []).append(r["row_id"])
    group = {}
    for rows in runs.values():
        left = sorted(rows)
        while left:
            head, taken = left[0], []
            for v in left:
                if len(taken) < 3 and (v == head or len(of[v] & of[head]) >= 0.5 * len(of[v] | of[head])):
                    taken.append(v)
            group |= dict.fromkeys(taken, head)
            left = [v for v in left if v not in taken]
    want = sorted(group, key=lambda v: (group[v], v)) + [v for v in range(30) if v not in group]
    assert perm(heuristics.overlap_groups(m, 1, 3)) == want


def test_common_neighbour_walk(spark):
    m, near = square(spark, 30, 0.12, 18)
    got = perm(heuristics.community_walk(m))
    assert sorted(got) == list(range(30))
    label = {r["node"]: (r["c2"], r["c1"]) for r in heuristics.communities(m).collect()}
    assert [label[v] for v in got] == sorted(label[v] for v in got)
    adj = {0: {1, 2, 3}, 1: {0, 2}, 2: {0, 1, 3}, 3: {0, 2}, 4: {5}, 5: {4}}
    # 0 and 2 have most links; with 0, vertex 2 shares two neighbours.
    assert heuristics.common_neighbour_walk(adj) == [0, 2, 1, 3, 4, 5]


def test_small_parts(spark):
    m, near = square(spark, 12, 0.3, 19)
    moved, p = ordering.apply_first_window(m, 3)
    old = perm(p)
    assert {(old[r["row"]], r["col"]) for r in moved.coo.collect()} == {(r["row"], r["col"]) for r in m.coo.collect()}
    a, b = ordering.random_both(spark, 12, 9)
    assert sorted(perm(a)) == list(range(12)) and sorted(perm(b)) == list(range(9)) and perm(a) != perm(ordering.random_rows(spark, 12, 43))
    assert perm(compose(ordering.by_degree(m), a)) == [perm(a)[i] for i in perm(ordering.by_degree(m))]
    d = metrics.block_count(m, 3, 3).first()["n_blocks"]
    assert d == len({(r["row"] // 3, r["col"] // 3) for r in m.coo.collect()})


def test_dimension_and_speed(spark):
    from gridweave.operators import linalg

    df = spark.createDataFrame([("rcm",), ("gray",)], "perm string")
    got = {r["perm"]: r["kind"] for r in report.with_dimension(df, {"rcm": "graph"}, "perm", "kind").collect()}
    assert got == {"rcm": "graph", "gray": "Unknown"}
    a = SparseMatrix.build(spark.createDataFrame([(0, 1, 2.0), (1, 0, None)], "row long, col long, val double"), 2, 2)
    b = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "row long, vals array<double>")
    assert {r["row"]: r["vals"] for r in linalg.spmm_rows(a, b, 2).collect()} == {0: [6.0, 8.0], 1: [1.0, 2.0]}


def test_kmeans_ward_and_scores(spark):
    pts = [(f"m{i}", float(x), float(y), g) for i, (x, y, g) in enumerate([(0, 0, "a"), (0.2, 0, "a"), (5, 5, "b"), (5, 5.2, "b"), (9, 0, "c"), (9.1, 0.1, "c")])]
    df = spark.createDataFrame(pts, "matrix string, x double, y double, grp string")
    rows, best, done = ml.sweep(df, ["x", "y"], label="grp", restarts=4)
    assert best == 3 and [r[0] for r in rows] == [2, 3, 4, 5]
    of = {r["matrix"]: (r["cluster"], r["cluster_agg"]) for r in done.collect()}
    for side in (0, 1):
        assert of["m0"][side] == of["m1"][side] != of["m2"][side] == of["m3"][side] != of["m4"][side] == of["m5"][side]
    k3 = rows[1]
    assert k3[3] == pytest.approx(1.0) and k3[4] == pytest.approx(1.0)
    p = np.array([[x, y] for _, x, y, _ in pts])
    lab = np.array([0, 0, 1, 1, 2, 2])
    s = []
    for i in range(6):
        d = [math.dist(p[i], p[j]) for j in range(6)]
        a = d[i ^ 1]
        b = min(np.mean([d[j] for j in range(6) if lab[j] == c]) for c in range(3) if c != lab[i])
        s.append((b - a) / max(a, b))
    assert ml.silhouette(p, lab) == pytest.approx(np.mean(s)) and k3[2] == pytest.approx(np.mean(s))
    with pytest.raises(ValueError):
        ml.points_of(df, ["x", "y"], "matrix", 10)
    assert len(ml.TRIMMED) == 17 == len(set(ml.TRIMMED))


def test_elimination_in_bits_and_sets(spark):
    """Components of more vertices than the bits are for begin in sets; fill stays small in memory."""
    import tracemalloc

    m, near = square(spark, 60, 0.08, 30)
    assert perm(heuristics.minimum_degree(m)) == perm(heuristics.minimum_degree(m, bits_below=20)) == perm(heuristics.minimum_degree(m, bits_below=0))
    r = np.random.default_rng(31)
    e = np.unique(r.integers(0, 3000, (60_000, 2)), axis=0)
    e = e[e[:, 0] != e[:, 1]]
    e = np.unique(np.concatenate([e, e[:, ::-1]]), axis=0)
    tracemalloc.start()
    order = heuristics.eliminate(np.arange(3000), e[:, 0], e[:, 1])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(order) == list(range(3000)) and most < 40e6  # sets took over 150 MB for the fill


def test_window_greedy_by_heap(spark):
    m, near = square(spark, 40, 0.1, 32)
    assert perm(heuristics.window_greedy(m, 3)) == perm(heuristics.window_greedy(m, 3, scan_below=0))


def test_common_neighbour_walk_literal():
    r = random.Random(33)
    for n, p in ((30, 0.1), (60, 0.3), (200, 0.5)):
        adj = {v: set() for v in range(n)}
        for i in range(n):
            for j in range(i + 1, n):
                if r.random() < p:
                    adj[i].add(j)
                    adj[j].add(i)
        adj = {v: x for v, x in adj.items() if x}
        left, want, back = set(adj), [], []
        for start in sorted(adj, key=lambda v: (-len(adj[v]), v)):
            v = start if start in left else None
            while v is not None:
                want.append(v)
                back.append(v)
                left.discard(v)
                here, near = v, adj[v] & left
                while not near and back:
                    here = back[-1]
                    near = {u for u in left if adj[u] & adj[here]}
                    if not near:
                        back.pop()
                v = min(near, key=lambda u: (-len(adj[u] & adj[here]), u), default=None)
        assert heuristics.common_neighbour_walk(adj) == want


def test_wavefront_holds_arrays():
    """A component's incidences take some arrays, not sets and lists of Python numbers."""
    import tracemalloc

    import pandas as pd

    r = np.random.default_rng(0)
    t = pd.DataFrame({"comp": 0, "micro_id": np.repeat(np.arange(30_000), 4), "win": r.integers(0, 3_000, 120_000)}).drop_duplicates()
    tracemalloc.start()
    got = ordering._wavefront(t)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(got["micro_id"]) == list(range(30_000)) and peak < 100 * len(t)


def test_hybrid_leaves_few_tables(spark):
    """Tables written on the way go when their result is written."""
    import os

    from gridweave.plans.storage import shared_dir

    s, _ = sketch(spark, 60, 20, 150, 30)
    held = lambda: {x for x in os.listdir(shared_dir(spark).removeprefix("file://")) if x.startswith("gridweave-")}
    before = held()
    p, stats = ordering.hybrid_stages(s, 60, 4, 8)
    assert len(held() - before) <= 4 and stats.first()["macro_components"] > 0 and sorted(perm(p)) == list(range(60))


@pytest.mark.parametrize("seed, k, cap, tau", [(31, 3, 4, 0.3), (32, 5, 2, 0.2), (33, 64, 64, 0.5), (34, 4, 8, 0.4)])
def test_close_pairs(spark, seed, k, cap, tau):
    """The candidate pairs within tau, whatever the caps on index and candidates."""
    s, _ = sketch(spark, 40, 9, 130, seed)
    want = {(r["row"], r["cand"]) for r in ordering.candidate_pairs(s, 40, k, cap).where(f"jaccard >= {tau}").collect()}
    got = [(r["row"], r["cand"]) for r in ordering.close_pairs(s, 40, tau, k, cap).collect()]
    assert want and sorted(got) == sorted(want)


def test_cluster_chain_compares_pairs_in_place(spark, monkeypatch):
    """No table of all candidate pairs is made."""
    s, _ = sketch(spark, 40, 9, 130, 35)
    monkeypatch.setattr(ordering, "candidate_pairs", None)
    assert sorted(perm(ordering.cluster_chain(s, 40, 4, 0.5))) == list(range(40))


def test_stripe_costs_in_one_pass(spark):
    s, _ = sketch(spark, 150, 12, 400, 36)
    for p in (None, ordering.random_rows(spark, 150)):
        want = sum(ordering.stripe_cost(s, identity(spark, 150) if p is None else p, b) for b in (1, 4, 16, 32, 64, 24))
        assert ordering.stripe_costs(s, p, [1, 4, 16, 32, 64, 24]) == want


@pytest.mark.parametrize("entries", [10, 60, 1000])
def test_rows_compared_by_ranges(spark, entries, monkeypatch):
    """All pairs within tau and each row's nearest, over ranges of any length, without a table of all pairs."""
    from gridweave.operators import overlap

    s, of = sketch(spark, 40, 15, 120, 40)
    monkeypatch.setattr(overlap.by_ranges, "__defaults__", (entries,))
    monkeypatch.setattr(metrics, "pair_jaccard", None)
    sim = {(a, b): len(of[a] & of[b]) / len(of[a] | of[b]) for a in of for b in of if a != b and of[a] & of[b]}
    got = {(r["a"], r["b"]): r["d"] for r in overlap.within(s, 0.6).collect()}
    assert got == {e: 1.0 - x for e, x in sim.items() if 1.0 - x <= 0.6}
    want = {(a, b) for a in of for b in sorted((b for x, b in sim if x == a), key=lambda b: (-sim[a, b], b))[:3]}
    assert {(r["u"], r["v"]) for r in heuristics.knn(s, 40, 3).collect()} == want


def test_spanning_tree_by_joins_and_by_task(spark):
    s, _ = sketch(spark, 30, 9, 90, 41)
    m = SparseMatrix(s.selectExpr("row", "win as col", "cast(1 as double) as val"), 30, 9)
    assert perm(heuristics.mst_order(m, 1, 3)) == perm(heuristics.mst_order(m, 1, 3, local_edges=0))


def test_centroid_rounds_in_one_task(spark, monkeypatch):
    """As by joins, with rows alike and rows without windows; rounds write no tables."""
    r = random.Random(42)
    sets = [sorted(r.sample(range(12), r.randrange(1, 4))) for _ in range(15)] * 3 + [[]] * 5
    s = spark.createDataFrame([(i, w) for i, x in enumerate(sets) for w in x], "row long, win long")
    want = [perm(ordering.cluster_centroids(s, 50, 4, 0.5, max_rounds=n, local=0)) for n in (None, 2)]
    written, first = [], ordering.materialize
    monkeypatch.setattr(ordering, "materialize", lambda df, *a, **b: written.append(df) or first(df, *a, **b))
    assert [perm(ordering.cluster_centroids(s, 50, 4, 0.5, max_rounds=n)) for n in (None, 2)] == want and len(written) <= 6


def linked(n, k, seed):
    """(at, to): n vertices in random cliques of four, k a vertex."""
    p = np.random.default_rng(seed).integers(0, n, (n * k // 4, 4))
    e = np.concatenate([p[:, [i, j]] for i in range(4) for j in range(4) if i != j])
    e = np.unique(e[e[:, 0] != e[:, 1]], axis=0)
    return np.concatenate([[0], np.cumsum(np.bincount(e[:, 0], minlength=n))]), e[:, 1].astype(np.int32)


def test_elimination_by_elements_holds_no_fill():
    """The order is that on bits; a component's fill, most of n * n here, is never held."""
    import tracemalloc

    n = 4000
    at, to = linked(n, 12, 40)
    late = np.zeros(n, bool)
    late[np.diff(at) > 45] = True
    assert late.any()
    tracemalloc.start()
    got = heuristics.eliminate_by_elements(at, to, late)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    src = np.repeat(np.arange(n), np.diff(at))
    keep = ~late[src] & ~late[to]
    assert got == heuristics.eliminate(np.flatnonzero(~late), src[keep], to[keep])
    assert most < 30 * len(to)  # sets would hold the fill


@pytest.mark.parametrize("bundle", [1, 40, 10**6])
def test_components_come_to_tasks_as_streams(spark, monkeypatch, bundle):
    """Interleaved components in pieces and bundles: kernels get each one's sorted neighbours; vertices without edges stay where they are."""
    from gridweave.operators import packed

    monkeypatch.setattr(packed, "BUNDLE", bundle)
    monkeypatch.setattr(packed, "PIECE", 16)
    monkeypatch.setattr(packed, "ENTRIES", 50)
    m, near = square(spark, 90, 0.015, 41)
    comps = parts(near)
    assert len(comps) > 3
    g = packed.pattern(m)
    label = packed.components(g)
    assert {v: int(label[v]) for v in range(90)} == {v: min(c) for c in comps for v in c}
    seen = packed.ordered(g, label, lambda at, to: [*range(len(at) - 1)][::-1]).collect()
    assert sorted((r["comp"], r["pos"], r["row"]) for r in seen) == [(min(c), i, v) for c in sorted(comps, key=min) if len(c) > 1 for i, v in enumerate(sorted(c, reverse=True))]

    def check(at, to):
        rows = [to[i:j].tolist() for i, j in zip(at[:-1], at[1:])]
        assert all(x == sorted(set(x)) and all(v in rows[u] for u in x) for v, x in enumerate(rows)) and to.dtype == np.int32
        return sorted(range(len(rows)), key=lambda v: (len(rows[v]), v))

    got = sorted((r["comp"], r["pos"], r["row"]) for r in packed.ordered(g, label, check).collect())
    assert got == [(min(c), i, v) for c in sorted(comps, key=min) if len(c) > 1 for i, v in enumerate(sorted(c, key=lambda v: (len(near[v]), v)))]


def test_slashburn_rounds_leave_the_edges_alone():
    """Rounds of a connected graph go over its vertices: no round copies or reads all edges."""
    import tracemalloc

    n = 3000
    at, to = linked(n, 40, 42)
    read = []

    class Counted(np.ndarray):
        def __getitem__(self, i):
            x = super().__getitem__(i)
            read.append(np.size(x))
            return np.asarray(x)

    tracemalloc.start()
    a, b = heuristics.burn(at, to.view(Counted), 3, 0, n // 3 + 2)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    rounds = len(set(a.tolist()))
    assert rounds > 500 and sum(read) < 40 * len(to)  # not all edges in every round
    assert most < 4 * len(to)  # two columns of 64 bits were held and filtered
    assert sorted(heuristics.by_rounds(a, b).tolist()) == list(range(n))


def test_window_greedy_keeps_no_entry_a_gain(monkeypatch):
    """Large components keep a number a vertex and the largest of each block, no matter how often gains move."""
    import tracemalloc

    held = []
    monkeypatch.setattr(heuristics, "_streamed", lambda m, kernel: held.append(kernel), raising=False)
    monkeypatch.setattr(heuristics, "_per_component", lambda m, kernel: held.append(kernel))
    heuristics.window_greedy(None, 3)
    heuristics.window_greedy(None, 3, scan_below=0)
    at, to = linked(3000, 40, 44)
    tracemalloc.start()
    order = held[1](at, to)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert order == held[0](at, to) and sorted(order) == list(range(3000))
    assert most < 8e6  # a heap of all gains, as it was, took tuples for every move
