"""Documented ordering heuristics: graph, bit-pattern, partition and community orders, each as a permutation table.

Sequential kernels run a component a task; that is their ceiling, and components above it want partition orders instead.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits
from ..plans.ship import ship
from ..plans.storage import materialize, settled
from . import graph, overlap, packed, sketch as sk
from .matrix import SparseMatrix, dense_index, order_by


def _per_component(m: SparseMatrix, kernel, far=None, local_edges: int = 8_000_000) -> DataFrame:
    """Order of each component's vertices by a kernel(at, to) -> list, a component a task; components by least vertex; square matrices.

    A kernel has the vertices numbered in the order of their ids, see adjacency. far(edges with component, degrees) -> (component, row, pos) orders components of more than local_edges directed edges by joins, where there is one.
    """
    if m.rows != m.cols:
        raise ValueError(f"needs a square matrix, not {m.rows} x {m.cols}")
    ship(m.coo.sparkSession)
    e = settled(graph.edges_of(m))
    comp = graph.components(e)
    e = materialize(e.join(comp, F.col("src") == F.col("node")).select("component", "src", "dst"))

    def run(t: pd.DataFrame) -> pd.DataFrame:
        nodes, at, to = adjacency(t["src"].to_numpy(), t["dst"].to_numpy())
        order = nodes[np.asarray(kernel(at, to), np.int64)]
        return pd.DataFrame({"comp": [int(t["component"].iloc[0])] * len(order), "row": order, "pos": range(len(order))})

    near, done = e, None
    if far is not None:
        large = materialize(e.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > local_edges).select("component"))
        if not large.isEmpty():
            near = e.join(F.broadcast(large), "component", "left_anti")  # fewer than edges / local_edges
            done = far(materialize(e.join(F.broadcast(large), "component")))
    small = near.groupBy("component").applyInPandas(run, "comp long, row long, pos long")
    done = small if done is None else small.unionByName(done)
    spine = m.spine.join(materialize(done), "row", "left").select("row", F.coalesce("comp", "row").alias("comp"), F.coalesce("pos", F.lit(0)).alias("pos"))
    return order_by(spine, [F.asc("comp"), F.asc("pos"), F.asc("row")], rows=m.rows)


def _streamed(m: SparseMatrix, kernel) -> DataFrame:
    """As _per_component, from packed rows: a component's edges are held once, in 32 bits each, up to packed.MOST vertices."""
    if m.rows != m.cols or not packed.fits(m):
        return _per_component(m, kernel)
    g = packed.pattern(m)
    done = packed.ordered(g, packed.components(g), kernel)
    spine = m.spine.join(done, "row", "left").select("row", F.coalesce("comp", "row").alias("comp"), F.coalesce("pos", F.lit(0)).alias("pos"))
    return order_by(spine, [F.asc("comp"), F.asc("pos"), F.asc("row")], rows=m.rows)


def adjacency(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, at, to): ids in ascending order, and the neighbours of the v-th in to[at[v] : at[v + 1]], as places among them, ascending."""
    nodes = np.unique(src)
    s, d = np.searchsorted(nodes, src), np.searchsorted(nodes, dst)
    by = np.argsort(s * len(nodes) + d, kind="stable")
    return nodes, np.concatenate([[0], np.cumsum(np.bincount(s, minlength=len(nodes)))]), d[by]


def _two_steps(at: np.ndarray, to: np.ndarray, v: int) -> np.ndarray:
    """Neighbours of v's neighbours, each as often as there is a way to it."""
    near = to[at[v] : at[v + 1]]
    n = at[near + 1] - at[near]
    return to[np.repeat(at[near] - np.cumsum(n) + n, n) + np.arange(n.sum())]


def rcm(m: SparseMatrix, local_edges: int = 8_000_000) -> DataFrame:
    """Reverse level order from a low-degree vertex far out, neighbours by ascending degree.

    A component of more than local_edges directed edges goes level by level: a join finds the next level, each vertex's place follows from that of its
    first parent, its degree and its id.
    """

    def kernel(at, to):
        adj = dict(enumerate(map(set, np.split(to, at[1:-1]))))
        deg = {v: len(n) for v, n in adj.items()}

        def walk(start):
            order, seen = [start], {start}
            for v in order:
                new = sorted(adj[v] - seen, key=lambda u: (deg[u], u))
                seen.update(new)
                order += new
            return order

        far = walk(min(adj, key=lambda v: (deg[v], v)))[-1]
        return walk(far)[::-1]

    def far(e: DataFrame) -> DataFrame:
        deg = materialize(e.groupBy("component", F.col("src").alias("node")).agg(F.count("*").alias("deg")))
        start = deg.groupBy("component").agg(F.min_by("node", F.struct("deg", "node")).alias("node"))
        last = _level_walk(e, deg, start).groupBy("component").agg(F.max_by("node", "pos").alias("node"))
        walked = _level_walk(e, deg, materialize(last))
        return walked.select(F.col("component").alias("comp"), F.col("node").alias("row"), (-F.col("pos")).alias("pos"))

    return _per_component(m, kernel, far, local_edges)


def _level_walk(e: DataFrame, deg: DataFrame, start: DataFrame) -> DataFrame:
    """(component, node, pos) of a breadth-first walk from each component's start; vertices of a level by first parent, degree and id."""
    front = materialize(start.select("component", "node", F.lit(0).cast("long").alias("pos")))
    seen, turn = front, 0
    while True:
        nxt = front.join(e.select(F.col("src").alias("node"), F.col("dst").alias("next")), "node").groupBy("component", F.col("next").alias("node")).agg(F.min("pos").alias("parent"))
        nxt = materialize(nxt.join(seen.select("node"), "node", "left_anti").join(deg.select("node", "deg"), "node"))
        if nxt.isEmpty():
            return seen
        placed = materialize(dense_index(nxt, [F.asc(c) for c in ("component", "parent", "deg", "node")], "at", rows=nxt.count()))
        base = placed.groupBy("component").agg(F.min("at").alias("base"))
        ahead = front.groupBy("component").agg((F.max("pos") + 1).alias("ahead"))
        front = materialize(placed.join(base, "component").join(ahead, "component").select("component", "node", (F.col("at") - F.col("base") + F.col("ahead")).alias("pos")))
        turn += 1
        seen = materialize(seen.unionByName(front)) if turn % 8 == 0 else seen.unionByName(front)


#: Vertices that a component may have for elimination on a matrix of bits (8 MB).
BITS = 8192


def minimum_degree(m: SparseMatrix, dense: float = 10.0, bits_below: int = BITS) -> DataFrame:
    """Elimination by exact least degree; vertices of over dense * sqrt(n) neighbours come last.

    Fill makes most of a component's rest a clique. Up to bits_below vertices neighbours are rows of a matrix of bits, in larger components see eliminate_by_elements.
    """

    def kernel(at, to):
        n = len(at) - 1
        late = np.diff(at) > max(16, dense * n**0.5)
        if n - late.sum() > bits_below:
            return eliminate_by_elements(at, to, late) + np.flatnonzero(late).tolist()
        s, keep = np.repeat(np.arange(n), np.diff(at)), ~late[to]
        keep &= ~late[s]
        return eliminate(np.flatnonzero(~late), s[keep], to[keep]) + np.flatnonzero(late).tolist()

    return _streamed(m, kernel)


def eliminate_by_elements(at: np.ndarray, to: np.ndarray, late: np.ndarray) -> list[int]:
    """The vertices that aren't late in the order of elimination by least degree, ties by id.

    The neighbours of an eliminated vertex are an element, a set that stands for the edges between all of them and takes in the elements that the vertex was in: memory is in
    proportion to the edges given. A degree is counted when a vertex comes up as the least by what is known: elimination of a neighbour of degree d leaves at least d - 1, and one less than before.
    """
    n = len(at) - 1
    gone = np.iinfo(np.int32).max
    live, mark = ~late, np.zeros(n, bool)
    edge = np.concatenate([[0], np.cumsum(live[to], dtype=np.int32 if len(to) < gone else np.int64)])
    least = np.where(live, edge[at[1:]] - edge[at[:-1]], gone).astype(np.int32)
    del edge
    of: dict[int, list[int]] = {}  # elements of a vertex, or those taken in by them
    held: dict[int, np.ndarray] = {}  # members of an element, large ones as marks
    into: dict[int, int] = {}
    left, order = int(live.sum()), []

    def found(e):
        while e in into:
            up = into[e]
            if up in into:
                into[e] = into[up]
            e = up
        return e

    while left:
        v = int(least.argmin())
        mark[:] = False
        near = to[at[v] : at[v + 1]]
        near = near[live[near]]
        mark[near] = True
        mine = of[v] = list({found(e) for e in of.get(v, ())})
        for e in mine:
            if held[e].dtype == bool:
                np.logical_or(mark, held[e], out=mark)
            else:
                mark[held[e]] = True
        mark[v] = False
        d = int(np.count_nonzero(mark))
        if d != least[v]:
            least[v] = d
            if least.argmin() != v:
                continue
        if d == left - 1:  # a clique is left: any order eliminates it alike
            order += np.flatnonzero(live).tolist()
            break
        order.append(v)
        live[v], least[v], left = False, gone, left - 1
        del of[v]
        fresh = np.ones(len(near), bool)  # not in an element that is taken in
        for e in mine:
            into[e], x = v, held.pop(e)
            fresh &= ~x[near] if x.dtype == bool else x[np.minimum(np.searchsorted(x, near), len(x) - 1)] != near
        for u in near[fresh].tolist():
            of.setdefault(u, []).append(v)
        x = np.flatnonzero(mark)
        least[x] = np.maximum(least[x] - 1, d - 1)
        held[v] = mark.copy() if d > n // 8 else x.astype(np.int32)
    return order


def eliminate(ids: np.ndarray, src: np.ndarray, dst: np.ndarray) -> list[int]:
    """The ids (ascending) in the order of elimination by least degree, ties by id; a row of bits has a vertex's neighbours."""
    n, one = len(ids), np.uint64(1)
    s, d = np.searchsorted(ids, src), np.searchsorted(ids, dst)
    g = np.zeros((n, -(-n // 64)), np.uint64)
    bit = lambda v: one << (v & 63).astype(np.uint64)
    np.bitwise_or.at(g, (s, d >> 6), bit(d))
    deg, gone, left, order = np.bincount(s, minlength=n).astype(np.int64), np.iinfo(np.int64).max, n, []
    lanes = max(1, (1 << 18) // max(1, g.shape[1]))
    while left:
        v = int(deg.argmin())
        if deg[v] == left - 1:  # a clique is left: any order eliminates it alike
            order += np.flatnonzero(deg < gone).tolist()
            break
        row = g[v].copy()
        around = np.flatnonzero(np.unpackbits(row.view(np.uint8), bitorder="little"))
        order.append(v)
        deg[v], left, off = gone, left - 1, ~bit(np.int64(v))
        for lo in range(0, len(around), lanes):
            u = around[lo : lo + lanes]
            x = g[u] | row
            x[:, v >> 6] &= off
            x[np.arange(len(u)), u >> 6] &= ~bit(u)
            g[u], deg[u] = x, np.bitwise_count(x).sum(axis=1)
    return ids[order].tolist()


def window_greedy(m: SparseMatrix, window: int = 8, scan_below: int = 1 << 17) -> DataFrame:
    """Next is the vertex with most links and shared neighbours to the last `window` ones (ties by least id).

    Components of less than scan_below vertices are scanned for it, larger ones keep the largest gain of each 1024 vertices.
    """

    def kernel(at, to):
        n, size = len(at) - 1, 1024
        gain, order, scan = np.zeros(-(-n // size) * size, np.int32), [], n < scan_below
        gain[n:] = -1 << 30  # as that of a vertex that has its place
        blocks = gain.reshape(-1, size)
        top, moved = blocks.max(axis=1), np.zeros(len(blocks), bool)
        nxt, ways = int(np.diff(at).argmax()), deque()  # ways: those of the last vertices
        more, less = np.int32(1), np.int32(-1)  # numbers of the same kind, or add.at takes many times as long
        while True:
            order.append(nxt)
            gain[nxt] -= 1 << 30
            if len(order) == n:
                return order
            ways.append(np.concatenate([_two_steps(at, to, nxt), to[at[nxt] : at[nxt + 1]]]).astype(np.int64))
            for u, by in ((ways[-1], more), (ways.popleft(), less)) if len(ways) > window else ((ways[-1], more),):
                np.add.at(gain, u, by)
                if not scan:
                    moved[u >> 10] = True
            if scan:
                nxt = int(gain.argmax())
                continue
            b = np.flatnonzero(moved)
            top[b] = blocks[b].max(axis=1) if len(b) < len(blocks) // 4 else blocks.max(axis=1)[b]
            moved[b] = False
            k = int(top.argmax())
            nxt = k * size + int(blocks[k].argmax())

    return _streamed(m, kernel)


def _shared(at: np.ndarray, to: np.ndarray, v: int) -> tuple[np.ndarray, np.ndarray]:
    """(u, k): vertices that share k > 0 neighbours with v, ascending; v too."""
    x = _two_steps(at, to, v)
    if len(x) < len(at) // 16:
        return np.unique(x, return_counts=True)
    k = np.bincount(x, minlength=len(at) - 1)
    u = np.flatnonzero(k)
    return u, k[u]


def community_walk(m: SparseMatrix, levels: int = 2) -> DataFrame:
    """Communities, coarsest first, each walked greedily: next is the unvisited neighbour with most neighbours in common with the vertex at hand.

    Where there is none, the walk jumps to the unvisited vertex with most neighbours in common with the last visited one that has such. Starts
    are vertices of highest degree; ties fall to the least id. A community is a task.
    """
    ship(m.coo.sparkSession)
    e = settled(graph.edges_of(m))
    c = communities(m, levels)
    own = c.select(F.col("node").alias("src"), F.col("c1").alias("own"))
    hint = _hint(graph.vertices(m))
    inside = e.join(hint(own), "src").join(hint(own.select(F.col("src").alias("dst"), F.col("own").alias("other"))), "dst").where("own = other").select("own", "src", "dst")

    def run(t: pd.DataFrame) -> pd.DataFrame:
        nodes, at, to = adjacency(t["src"].to_numpy(), t["dst"].to_numpy())
        order = nodes[np.array(_walk(at, to), np.int64)]
        return pd.DataFrame({"row": order, "pos": range(len(order))})

    walked = materialize(inside.groupBy("own").applyInPandas(run, "row long, pos long"))
    spine = c.withColumnRenamed("node", "row").where(F.col("row") < m.rows).join(walked, "row", "left")
    return order_by(spine, [*[F.asc(f"c{k}") for k in range(levels, 0, -1)], F.col("pos").asc_nulls_last(), F.asc("row")], rows=m.rows)


def common_neighbour_walk(adj: dict[int, set[int]]) -> list[int]:
    """Every vertex once; see community_walk."""
    edges = np.array([(v, u) for v, x in adj.items() for u in x], np.int64).reshape(-1, 2)
    nodes, at, to = adjacency(edges[:, 0], edges[:, 1])
    return nodes[np.array(_walk(at, to), np.int64)].tolist()


def _walk(at: np.ndarray, to: np.ndarray) -> list[int]:
    """The common neighbour walk; those that a vertex shares with all others are counted at once."""
    n = len(at) - 1
    left, order, back = np.ones(n, bool), [], []
    for start in np.argsort(-np.diff(at), kind="stable").tolist():
        v = start if left[start] else None
        while v is not None:
            order.append(v)
            back.append(v)
            left[v] = False
            near = to[at[v] : at[v + 1]]
            near = near[left[near]]
            u, k = _shared(at, to, v)
            if len(near):
                spot = np.minimum(np.searchsorted(u, near), len(u) - 1)
                v = int(near[np.where(u[spot] == near, k[spot], 0).argmax()])
                continue
            v = None
            while back:
                # Stuck: back along the walk to a vertex that still shares neighbours with unvisited ones.
                some = left[u]
                if some.any():
                    v = int(u[some][k[some].argmax()])
                    break
                back.pop()
                if back:
                    u, k = _shared(at, to, back[-1])
    return order


def gray_order(m: SparseMatrix, width: int = 32, sparse_most: int = 32, group: int | None = None) -> DataFrame:
    """Rows by the Gray rank of their column bitmap, sparse rows (by entry count) before dense ones, empty rows first.

    Sparse rows lie in groups of like density first: entries div group, group being a sixteenth of the mean row (1 at least) when
    it isn't given.
    """
    if group is None:
        group = max(1, m.nnz() // max(1, m.rows) // 16)
    g = gray_bitmaps(m, width).withColumn("dense", (F.col("cnt") > sparse_most).cast("int"))
    g = g.withColumn("density", F.when(F.col("dense") == 0, F.expr(f"cnt div {int(group)}")).otherwise(0))
    spine = m.spine.join(g, "row", "left")
    return order_by(spine, [F.col("dense").asc_nulls_first(), F.asc("density"), F.asc("gray_rank"), F.asc("row")], rows=m.rows)


def gray_bitmaps(m: SparseMatrix, width: int = 32) -> DataFrame:
    """(row, cnt, bitmap, gray_rank): one bit a column stripe; the rank is the place of the bitmap in the Gray code."""
    b = m.coo.groupBy("row").agg(F.count("*").alias("cnt"), F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.expr(f"cast(col * {width} div {m.cols} as int)"))).alias("bitmap"))
    r = F.col("bitmap")
    for s in (1, 2, 4, 8, 16, 32):
        r = r.bitwiseXOR(F.shiftrightunsigned(r, s)) if s < width else r
    return b.select("row", "cnt", "bitmap", r.alias("gray_rank"))


def _hint(n: int):
    """Broadcasts a table of a row for each of n vertices, where these are few."""
    return F.broadcast if n * 24 <= graph.VERTICES else lambda df: df


def label_propagation(edges: DataFrame, rounds: int = 8) -> DataFrame:
    """(node, label): each round a vertex takes its neighbours' most frequent label, ties to the least; own label counts once."""
    edges = settled(edges)
    lab = materialize(edges.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node")))
    hint = _hint(lab.count())  # as many in every round
    for _ in range(rounds):
        votes = edges.join(hint(lab.withColumnRenamed("node", "dst")), "dst").select(F.col("src").alias("node"), "label").unionByName(lab)
        new = votes.groupBy("node", "label").agg(F.count("*").alias("n")).groupBy("node").agg(F.max_by("label", F.struct("n", (-F.col("label")).alias("o"))).alias("label"))
        new = materialize(new)
        if new.join(lab.withColumnRenamed("label", "old"), "node").where("label <> old").isEmpty():
            return new
        lab = new
    return lab


def communities(m: SparseMatrix, levels: int = 2, rounds: int = 6) -> DataFrame:
    """(node, c1 .. cL): label communities, then communities of communities; isolated vertices are their own."""
    e = graph.edges_of(m)
    n = graph.vertices(m)
    out = m.coo.sparkSession.range(n).select(F.col("id").alias("node"))
    top = "node"
    for k in range(1, levels + 1):
        lab = label_propagation(e, rounds)
        out = materialize(out.join(lab.select(F.col("node").alias(top if k > 1 else "__n"), F.col("label").alias(f"c{k}")), on=(F.col("node") == F.col("__n")) if k == 1 else [top], how="left").drop("__n").withColumn(f"c{k}", F.coalesce(f"c{k}", top)))
        up = lambda c: lab.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
        e = materialize(e.join(up("src"), "src").join(up("dst"), "dst").select(F.col("lsrc").alias("src"), F.col("ldst").alias("dst")).where("src <> dst").distinct())
        top = f"c{k}"
    return out


def community_order(m: SparseMatrix, levels: int = 2) -> DataFrame:
    """Vertices by their communities, coarsest first, then by degree and id."""
    c = communities(m, levels).where(F.col("node") < m.rows).withColumnRenamed("node", "row").join(m.row_counts(), "row")
    return order_by(c, [*[F.asc(f"c{k}") for k in range(levels, 0, -1)], F.desc("cnt"), F.asc("row")], rows=m.rows)


def parts(m: SparseMatrix, nparts: int = 128, eps: float = 0.03) -> DataFrame:
    """(row, part): communities laid end to end and cut into nparts of at most (1 + eps) n / nparts rows.

    A substitute for k-way partitioners: the parts are balanced, the cut is what the communities give.
    """
    order = community_order(m)
    most = max(1, int((1 + eps) * m.rows / nparts)) if m.rows >= nparts else 1
    return order.select(F.col("old_idx").alias("row"), F.least(F.expr(f"new_pos div {max(most, -(-m.rows // nparts))}"), F.lit(nparts - 1)).alias("part"))


def partition_order(m: SparseMatrix, nparts: int = 128, eps: float = 0.03) -> DataFrame:
    """Stable order by part."""
    return order_by(parts(m, nparts, eps), [F.asc("part"), F.asc("row")], rows=m.rows)


def connectivity_cost(m: SparseMatrix, part: DataFrame) -> DataFrame:
    """One row: sum over columns of (parts the column's rows lie in - 1), and columns that are cut."""
    g = m.coo.join(part, "row").groupBy("col").agg((F.countDistinct("part") - 1).alias("k"))
    return g.agg(F.sum("k").alias("connectivity"), F.sum((F.col("k") > 0).cast("long")).alias("cut_cols"))


def edge_cut(m: SparseMatrix, part: DataFrame) -> DataFrame:
    """One row: undirected edges between different parts."""
    p = lambda c: part.select(F.col("row").alias(c), F.col("part").alias(f"p{c}"))
    return graph.edges_of(m).where("src < dst").join(p("src"), "src").join(p("dst"), "dst").where("psrc <> pdst").agg(F.count("*").alias("edge_cut"))


def slashburn(m: SparseMatrix, k: int | None = None, local_edges: int = 1 << 28) -> DataFrame:
    """Rounds: the k hubs go to the front, vertices outside the giant component to the back, the giant goes on while it is larger than k.

    One task takes all rounds over packed rows, 32 bits for each directed edge. Rounds are joins while there are more than local_edges of these, or vertices than packed.MOST.
    """
    ship(m.coo.sparkSession)
    n = graph.vertices(m)
    k = k or max(1, n // 1000)
    last = n // k + 2  # a round places k vertices at least
    if n <= packed.MOST and local_edges:
        g = packed.pattern(m)
        if g.degree.sum() <= local_edges:
            done = packed.ordered(g, np.zeros(n, np.int32), lambda at, to: by_rounds(*burn(at, to, k, 0, last)))
            spine = m.spine.join(done, "row", "left").select("row", F.coalesce("pos", "row").alias("pos"))
            return order_by(spine, [F.asc("pos"), F.asc("row")], rows=m.rows)
    local_edges = min(local_edges, 8_000_000)  # for the one task that ends the rounds, as tables
    e = settled(graph.edges_of(m))
    live = materialize(m.coo.sparkSession.range(n).select(F.col("id").alias("node")))
    placed, turn = [], 0
    while e.count() > local_edges:
        deg = live.join(e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("d")), "node", "left").na.fill(0, ["d"])
        hub = materialize(deg.orderBy(F.desc("d"), "node").limit(k).select("node", F.lit(turn).cast("long").alias("a"), (-F.col("d")).alias("b")))
        placed.append(hub)
        e = materialize(e.join(hub.select(F.col("node").alias("src")), "src", "left_anti").join(hub.select(F.col("node").alias("dst")), "dst", "left_anti"))
        rest = live.join(hub, "node", "left_anti")
        comp = materialize(rest.join(graph.components(e), "node", "left").select("node", F.coalesce("component", "node").alias("c")))
        sizes = materialize(comp.groupBy("c").agg(F.count("*").alias("s")))
        giant = sizes.orderBy(F.desc("s"), "c").first()
        if giant is None:
            live = comp.select("node")
            break
        # Later rounds' spokes come before earlier ones'.
        spokes = comp.where(F.col("c") != giant["c"]).join(sizes, "c").select("node", F.lit(2 * last - turn).cast("long").alias("a"), (-F.col("s")).alias("b"))
        placed.append(materialize(spokes))
        live = materialize(comp.where(F.col("c") == giant["c"]).select("node"))
        e = materialize(e.join(live.select(F.col("node").alias("src")), "src", "left_semi"))
        turn += 1
        if giant["s"] <= k:
            placed.append(live.select("node", F.lit(last).cast("long").alias("a"), F.lit(0).cast("long").alias("b")))
            live = live.limit(0)
            break

    def run(t: pd.DataFrame) -> pd.DataFrame:
        src, dst = t["src"].to_numpy(), t["dst"].to_numpy()
        node, link = np.unique(src), src != dst
        s, d = np.searchsorted(node, src[link]), np.searchsorted(node, dst[link])
        at = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=len(node)))])
        a, b = burn(at, d[np.argsort(s * len(node) + d)], k, turn, last)
        return pd.DataFrame({"node": node, "a": a, "b": b})

    marks = live.select(F.col("node").alias("src"), F.col("node").alias("dst"))  # vertices without edges, too
    every = e.join(live.withColumnRenamed("node", "src"), "src", "left_semi").select("src", "dst").union(marks).withColumn("every", F.lit("")).groupBy("every").applyInPandas(run, "node long, a long, b long")
    for p in placed:
        every = every.unionByName(p)
    return order_by(materialize(every).where(F.col("node") < m.rows), [F.asc("a"), F.asc("b"), F.asc("node")], "node")


def by_rounds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Vertices by a, b and id."""
    return np.lexsort((np.arange(len(a)), b, a))


def burn(at: np.ndarray, to: np.ndarray, k: int, turn: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of each vertex: slashburn's rounds from turn on; the neighbours of the v-th are to[at[v] : at[v + 1]], ascending.

    Every vertex points to its least live neighbour if that is less than itself; trees of these are linked by the edges of their roots and by those of all vertices outside the largest set, so a round
    needn't read the edges within the giant.
    """
    n = len(at) - 1
    size = np.diff(at)
    a, b, live, deg, spot = np.full(n, last), np.zeros(n, np.int64), np.ones(n, bool), size.copy(), at[:-1].copy()
    ids = np.arange(n)

    def rows(v):
        """The live neighbours of some vertices, each with its own."""
        u = to[np.repeat(at[v] - (np.cumsum(size[v]) - size[v]), size[v]) + np.arange(size[v].sum())]
        keep = live[u]
        return np.repeat(v, size[v])[keep], u[keep]

    while len(ids):
        d = deg[ids]
        if len(ids) > k:
            least = np.partition(d, len(d) - k)[len(d) - k]
            above = ids[d > least]
            hubs = np.concatenate([above, ids[d == least][: k - len(above)]])
        else:
            hubs = ids
        a[hubs], b[hubs], live[hubs] = turn, -deg[hubs], False
        np.subtract.at(deg, rows(hubs)[1], 1)
        ids = ids[live[ids]]
        if not len(ids):
            break
        linked = ids[deg[ids] > 0]
        late = linked[~live[to[spot[linked]]]]
        while len(late):
            spot[late] += 1
            late = late[~live[to[spot[late]]]]
        up = np.arange(n)
        up[linked] = np.minimum(linked, to[spot[linked]])
        up = _shortened(up)
        roots = linked[up[linked] == linked]
        up = _joined(up, *rows(roots))
        most = np.bincount(up[ids], minlength=n).argmax()
        up = _joined(up, *rows(linked[up[linked] != most]))
        s = np.bincount(up[ids], minlength=n)
        giant = int(s.argmax())  # of equal ones that of the least vertex
        small = ids[up[ids] != giant]
        a[small], b[small], live[small] = 2 * last - turn, -s[up[small]], False
        if s[giant] <= k:
            break
        ids, turn = ids[live[ids]], turn + 1
    return a, b


def _shortened(up: np.ndarray) -> np.ndarray:
    """The root of each, by halving the ways."""
    while ((nxt := up[up]) != up).any():
        up = nxt
    return up


def _joined(up: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sets by their least member, those of x and y joined for each pair; up: sets by their least member."""
    while True:
        p, q = up[x], up[y]
        apart = p != q
        if not apart.any():
            return up
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(up, np.maximum(p, q), np.minimum(p, q))
        up = _shortened(up)


def knn(sketch: DataFrame, rows: int, k: int = 16, most_degree: int | None = None) -> DataFrame:
    """(u, v, w): each row's k nearest by Jaccard, exact without most_degree (see pair_jaccard); w is the distance."""
    if most_degree is not None:
        few = sk.window_degree(sketch).where(F.col("deg") <= most_degree)
        sketch = sketch.join(few.select("win"), "win")
    both = overlap.nearest(sketch, k)
    r = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("jaccard"), "b"))
    return both.withColumn("r", r).where(F.col("r") <= k).select(F.col("a").alias("u"), F.col("b").alias("v"), (1 - F.round("jaccard", 12)).alias("w"))


def mst_order(m: SparseMatrix, w: int = 1, k: int = 16, local_edges: int = 4_000_000) -> DataFrame:
    """Depth-first over the spanning forest of the k-NN graph, from each tree's vertex of highest degree, nearest child first.

    A component's tree is found by the task that walks it; components of more than local_edges edges get theirs by rounds of joins.
    """
    ship(m.coo.sparkSession)
    e = materialize(knn(sk.mask(m, w), m.rows, k).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "w").distinct())
    comp = graph.components(e.select(F.col("u").alias("src"), F.col("v").alias("dst")))
    e = e.join(comp, F.col("u") == F.col("node")).select("component", "u", "v", "w")
    large = materialize(e.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > local_edges).select("component"))
    if not large.isEmpty():
        few = F.broadcast(large)  # fewer than edges / local_edges
        tree = graph.minimum_spanning_forest(e.join(few, "component").select("u", "v", "w"))
        e = e.join(few, "component", "left_anti").unionByName(tree.join(comp, F.col("u") == F.col("node")).select("component", "u", "v", "w"))

    def walk(t: pd.DataFrame) -> pd.DataFrame:
        adj: dict[int, list] = {}
        for u, v, d in spanning_tree(t):
            adj.setdefault(u, []).append((d, v))
            adj.setdefault(v, []).append((d, u))
        stack, order, seen = [max(adj, key=lambda v: (len(adj[v]), -v))], [], set()
        while stack:
            v = stack.pop()
            if v not in seen:
                seen.add(v)
                order.append(v)
                stack += [x for _, x in sorted(adj[v], reverse=True) if x not in seen]
        return pd.DataFrame({"comp": [int(t["component"].iloc[0])] * len(order), "row": order, "pos": range(len(order)), "size": [len(order)] * len(order)})

    done = e.groupBy("component").applyInPandas(walk, "comp long, row long, pos long, size long")
    return order_by(m.spine.join(materialize(done), "row", "left"), [F.col("size").desc_nulls_last(), F.asc("comp"), F.asc("pos"), F.asc("row")], rows=m.rows)


def spanning_tree(t: pd.DataFrame) -> list[tuple[int, int, float]]:
    """(u, v, w) of the least spanning forest of edges u < v, ties by (w, u, v)."""
    by = np.lexsort((t["v"], t["u"], t["w"]))
    u, v, w = (t[c].to_numpy()[by] for c in ("u", "v", "w"))
    nodes = np.unique(np.concatenate([u, v]))
    up, keep = list(range(len(nodes))), []
    for i, (a, b) in enumerate(zip(np.searchsorted(nodes, u).tolist(), np.searchsorted(nodes, v).tolist())):
        while up[a] != a:
            up[a] = a = up[up[a]]
        while up[b] != b:
            up[b] = b = up[up[b]]
        if a != b:
            up[a] = b
            keep.append(i)
            if len(keep) == len(nodes) - 1:
                break
    return list(zip(u[keep].tolist(), v[keep].tolist(), w[keep].tolist()))


def lsh_order(m: SparseMatrix, w: int = 1, hashes: int = 4, most: int = 128) -> DataFrame:
    """Clusters of rows with the same MinHash; those of more than `most` rows are split by the next one, as often as there are hashes.

    Clusters lie in the order of their hashes, rows of a cluster in their own; empty rows last.
    """
    s = sk.mask(m, w)
    d = s.select("win").distinct()
    names = [f"h{i}" for i in range(hashes)]
    for i, name in enumerate(names):
        d = bits.splitmix64(d, "win", name, (i + 1) * bits.GAMMA & (1 << 64) - 1)
    sig = s.join(d, "win").groupBy("row").agg(*[F.min(bits.flipped(F.col(n))).alias(n) for n in names])
    keys = [names[0]]
    for name in names[1:]:
        # Counts are joined, not windowed: a cluster of any size is spread over tasks.
        size = sig.groupBy(*keys).agg(F.count("*").alias("__n"))
        same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
        on = same[0]
        for c in same[1:]:
            on = on & c
        sig = sig.alias("a").join(size.alias("b"), on).select(*[F.col(f"a.{c}").alias(c) for c in sig.columns if c != name], F.when(F.col("__n") > most, F.col(f"a.{name}")).alias(name))
        keys.append(name)
    return order_by(m.spine.join(sig.withColumn("__some", F.lit(0)), "row", "left"), [F.col("__some").asc_nulls_last(), *[F.col(n).asc_nulls_first() for n in names], F.asc("row")], rows=m.rows)


def overlap_groups(m: SparseMatrix, w: int = 1, block: int = 32, tau: float = 0.5) -> DataFrame:
    """Greedy groups of at most block rows of one LSH run that overlap their first row by tau; stable order by group."""
    ship(m.coo.sparkSession)
    s = materialize(sk.mask(m, w))
    sig = sk.signatures(s).join(sk.row_sketches(s, m.rows).select(F.col("row_id").alias("row"), "h1"), "row")

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("row")
        rows, sets, group = t["row"].tolist(), [frozenset(x) for x in t["wins"]], {}
        for i in range(len(rows)):
            if i in group:
                continue
            group[i], size = rows[i], 1
            for j in range(i + 1, len(rows)):
                if size == block:
                    break
                if j not in group and len(sets[i] & sets[j]) >= tau * len(sets[i] | sets[j]):
                    group[j], size = rows[i], size + 1
        return pd.DataFrame({"row": rows, "grp": [group[i] for i in range(len(rows))]})

    g = sig.groupBy("h1").applyInPandas(run, "row long, grp long")
    return order_by(m.spine.join(materialize(g), "row", "left"), [F.col("grp").asc_nulls_last(), F.asc("row")], rows=m.rows)
