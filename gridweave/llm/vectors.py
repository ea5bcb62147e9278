"""Embedding near-dedup: exact cosine pairs above a threshold by dual traversal of cover trees."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize
from .graph import Sets, components

#: Radius of the cover tree's root, from which 0.7 comes two levels below (unit vectors are at most 2 apart, and unrelated ones about 1.4);
#: numbers that a block of rows holds; numbers that dealing hands on at once.
TOP, BLOCK, BATCH = 2.8, 1 << 19, 1 << 19
#: A node with more pairs of children with its partners than this is a matrix product of its own.
WIDE = 4096


class CoverTree:
    """Cover tree over rows of x (unit vectors), level by level; the radius halves from one to the next.

    The centres of a level are a net of its radius r over all rows. Nesting: they are centres of the next level. Covering: each row is within r
    of a centre, and each new centre within r of its parent on the level above. Separation: centres of a level are more than r
    apart. A node with one row stands for all its levels below, as it would be its own only child. Nodes are split until they have one row or r is
    below stop; then rows are members of the node with the nearest centre. far is the covering radius as it is, the largest distance of a row below a node.
    """

    def __init__(self, x: np.ndarray, stop: float):
        self.x, n = x, len(x)
        self.centre, self.children, self.depth = [np.zeros(min(n, 1), np.int64)], {}, [np.zeros(min(n, 1), np.int64)]
        node_of = np.zeros(n, np.int64)
        crowded, centres = np.zeros(int(n > 1), np.int64), np.zeros(min(n, 1), np.int64)  # nodes with rows besides their centre; all centres
        radius, size, level = TOP, min(n, 1), 0
        while radius >= stop and len(crowded):
            radius, level = radius / 2, level + 1
            held = np.concatenate(self.centre)[crowded]
            active = np.flatnonzero(np.isin(node_of, crowded))
            new = self._net(np.setdiff1d(active, held, assume_unique=True), centres, radius)
            here, centres = np.concatenate([held, new]), np.concatenate([centres, new])
            parent = np.concatenate([crowded, node_of[new]])
            by = np.argsort(parent, kind="stable")
            cut = np.searchsorted(parent[by], crowded)
            self.children |= dict(zip(crowded.tolist(), np.split(size + by, cut[1:])))
            near = self._nearest(active, here)
            node_of[active] = size + near
            crowded = size + np.flatnonzero(np.bincount(near, minlength=len(here)) > 1)
            self.centre.append(here)
            self.depth.append(np.full(len(here), level))
            size += len(here)
        self.centre, self.depth = np.concatenate(self.centre), np.concatenate(self.depth)
        self.last = np.ones(size, bool)
        self.last[list(self.children)] = False
        rows = np.bincount(node_of, minlength=size)
        self.alone, self.far = self.last & (rows == 1), np.zeros(size)
        self.members = dict(zip(range(size), _split(node_of, size)))
        # Rows below each node that was split, from the last level up; distances are exact to rounding, which the margin of a search covers.
        below = {}
        for node in sorted(self.children, reverse=True):
            below[node] = np.concatenate([below.pop(c) if c in below else self.members[c] for c in self.children[node].tolist()])
            self._spread(node, below[node])
        for node in np.flatnonzero(self.last & (rows > 1)).tolist():
            self._spread(node, self.members[node])
        # Children one after the other, from kid_at on; of a last node, itself.
        kids = [self.children.get(i, one) for i, one in enumerate(np.arange(size).reshape(-1, 1))]
        self.kid_n = np.array([len(k) for k in kids], np.int64)
        self.kids, self.kid_at = np.concatenate([*kids, np.zeros(0, np.int64)]), np.cumsum(self.kid_n) - self.kid_n

    def _spread(self, node: int, rows: np.ndarray) -> None:
        self.far[node] = float(np.sqrt(max(0.0, 2 - 2 * float((self.x[rows] @ self.x[self.centre[node]]).min()))))

    def _net(self, rest: np.ndarray, centres: np.ndarray, radius: float) -> np.ndarray:
        """Rows of rest that are more than radius from all centres and from one another, till none is left."""
        least, out = 1 - radius * radius / 2, [np.zeros(0, np.int64)]  # least: cosine of rows that far apart
        for lo in range(0, len(centres), 1024):
            if len(rest):
                rest = rest[(self.x[rest] @ self.x[centres[lo : lo + 1024]].T).max(axis=1) < least]
        while len(rest):
            some, rest = rest[:256], rest[256:]
            close, kept = self.x[some] @ self.x[some].T >= least, []
            gone = np.zeros(len(some), bool)
            for i in range(len(some)):
                if not gone[i]:
                    kept.append(i)
                    gone |= close[i]
            new = some[kept]
            out.append(new)
            if len(rest):
                rest = np.concatenate([r[(self.x[r] @ self.x[new].T).max(axis=1) < least] for r in np.split(rest, range(8192, len(rest), 8192))])
        return np.concatenate(out)

    def _nearest(self, rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
        """The place of each row's nearest centre; a centre's own."""
        at = np.full(len(self.x), -1)
        at[centres] = np.arange(len(centres))
        rest = rows[at[rows] < 0]
        for lo in range(0, len(rest), 1024):
            some = rest[lo : lo + 1024]
            at[some] = (self.x[some] @ self.x[centres].T).argmax(axis=1)
        return at[rows]


def _split(group: np.ndarray, n: int) -> list[np.ndarray]:
    """Places of each of the groups 0 .. n - 1."""
    by = np.argsort(group, kind="stable")
    return np.split(by, np.searchsorted(group[by], np.arange(1, n)))


def dual(a: CoverTree, b: CoverTree, reach: float, visit) -> None:
    """visit(rows of a, rows of b, how) for all that may be within reach; a pair of nodes goes when its centres are too far apart for their radii.

    how: block (all with all), pairs (one by one), self (all with all of one node). Children of both nodes are compared at once. a may
    be b: then each pair of rows comes once, but for self; and in pairs a row may come with itself.
    """
    stack = []

    def go_on(u: np.ndarray, v: np.ndarray, same) -> None:
        """Keep near node pairs for the next step, none twice; of pairs of single rows, nothing is left to do."""
        once = ~same | (u <= v)
        u, v = u[once], v[once]
        single = a.alone[u] & b.alone[v]
        if single.any():
            visit(a.centre[u[single]], b.centre[v[single]], "pairs")
        if not single.all():
            stack.append((u[~single], v[~single]))

    if len(a.x) and len(b.x):
        stack.append((np.zeros(1, np.int64), np.zeros(1, np.int64)))
    while stack:
        p, q = stack.pop()
        done = a.last[p] & b.last[q]
        for u, v in zip(p[done].tolist(), q[done].tolist()):
            visit(a.members[u], b.members[v], "self" if a is b and u == v else "block")
        p, q = p[~done], q[~done]
        by = np.argsort(p, kind="stable")
        p, q = p[by], q[by]
        product = a.kid_n[p] * b.kid_n[q]
        head = np.flatnonzero(np.diff(p, prepend=-1))
        wide = np.add.reduceat(product, head) > WIDE if len(p) else np.zeros(0, bool)
        for lo, hi in zip(head[wide].tolist(), np.append(head, len(p))[1:][wide].tolist()):
            # A node's children and those of all its partners, as matrix products; children with rows of their own only come first.
            mine = a.kids[a.kid_at[p[lo]] : a.kid_at[p[lo]] + a.kid_n[p[lo]]]
            size = b.kid_n[q[lo:hi]]
            other = b.kids[np.repeat(b.kid_at[q[lo:hi]] - np.cumsum(size) + size, size) + np.arange(size.sum())]
            same = np.repeat(q[lo:hi] == p[lo], size) if a is b else np.zeros(len(other), bool)
            order = np.argsort(b.far[other], kind="stable")
            other, same = other[order], same[order]
            flat = int((b.far[other] == 0).sum())
            for at in range(0, len(mine), 256):
                some = mine[at : at + 256]
                dot = a.x[a.centre[some]] @ b.x[b.centre[other]].T
                span = (reach + a.far[some]).astype(np.float32)[:, None]
                far = b.far[other[flat:]].astype(np.float32)[None]
                for off, hit in ((0, dot[:, :flat] >= _cosine(span)), (flat, dot[:, flat:] >= _cosine(span + far))):
                    rows = np.flatnonzero(hit.any(axis=1))
                    i, j = np.nonzero(hit[rows])
                    if len(i):
                        go_on(some[rows[i]], other[off + j], same[off + j])
        p, q, product = (z[~np.repeat(wide, np.diff(np.append(head, len(p))))] for z in (p, q, product))
        steps = np.searchsorted(np.cumsum(product), np.arange(1, product.sum() // (64 * WIDE) + 1) * 64 * WIDE)
        for p_, q_, n in zip(*(np.split(z, steps) for z in (p, q, product))):  # the others many at a time
            of = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            width = b.kid_n[q_][of]
            u, v = a.kids[a.kid_at[p_][of] + at // width], b.kids[b.kid_at[q_][of] + at % width]
            near = np.einsum("ij,ij->i", a.x[a.centre[u]], b.x[b.centre[v]]) >= _cosine(reach + a.far[u] + b.far[v])
            go_on(u[near], v[near], (p_ == q_)[of][near] if a is b else np.zeros(1, bool))


def _cosine(distance: np.ndarray) -> np.ndarray:
    """Cosine of unit vectors at a distance; below any cosine from 2 on."""
    return np.where(distance < 2, 1 - distance * distance / 2, -2).astype(np.float32)


def block_pairs(left: np.ndarray, right: np.ndarray | None, weight_left, weight_right, threshold: float):
    """Links within left, or between left and right: per row the weight it links to, and a spanning forest of the links.

    Rows are float64. Cosine of raw rows is dot / (norm * norm) in double precision; products of unit rows in single precision, with a margin
    for rounding, say which pairs need that.
    """
    raw = left if right is None else np.concatenate([left, right])
    weight = np.asarray(weight_left if right is None else np.concatenate([weight_left, weight_right]), np.int64)
    norms = np.sqrt((raw * raw).sum(axis=1))
    x = (raw / norms[:, None]).astype(np.float32)
    links, sets, edges = np.zeros(len(raw), np.int64), Sets(len(raw)), []
    reach, cut = math.sqrt(max(0.0, 2 - 2 * threshold)) + 5e-3, 0 if right is None else len(left)

    def visit(p: np.ndarray, q: np.ndarray, how: str) -> None:
        q = q + cut
        if how != "pairs":
            i, j = np.nonzero(x[p] @ x[q].T >= threshold - 1e-5)
            if how == "self":
                i, j = i[i < j], j[i < j]
            p, q = p[i], q[j]
        for at in range(0, len(p), 1 << 18):
            u, v = p[at : at + (1 << 18)], q[at : at + (1 << 18)]
            exact = (np.einsum("ij,ij->i", raw[u], raw[v]) / (norms[u] * norms[v]) >= threshold) & (u != v)
            u, v = u[exact], v[exact]
            np.add.at(links, u, weight[v])
            np.add.at(links, v, weight[u])
            for y, z in zip(u.tolist(), v.tolist()):
                if sets.join(y, z):
                    edges.append((y, z))

    tree = CoverTree(x[:cut] if cut else x, reach / 4)
    dual(tree, CoverTree(x[cut:], reach / 4) if cut else tree, reach, visit)
    return links, edges


def near_vectors(vectors: DataFrame, threshold: float = 0.9, vec: str = "embedding", id_col: str = "vec_id", cell_rows: int | None = None, sample: int = 4096) -> DataFrame:
    """(id, n_links, component_id, kept), a row for each row of vectors.

    Vectors that are null, empty, zero or hold null or non-finite numbers link with nothing. Equal vectors are one class; its
    copies link with one another and are counted by weight, never as pairs. Classes lie in cells around centres (a net like the
    top of the cover tree, fitted on at most sample vectors taken by hash; every vector is indexed), a cell for cell_rows classes, with
    covering radii from all members. A vector is dealt to the cells that its distance from their centres and these radii cannot
    rule out, in blocks of about cell_rows rows by hash (None: 2 ** 19 numbers), so a hot cell is many tasks. Each block pair is the dual
    traversal of two cover trees and returns counts and a spanning forest, at most its own rows. Ids must be integers; repeated ids
    count as rows of their own. Vectors of different lengths do not link. An empty table gives no rows.
    """
    v, i = F.col(vec), F.col(id_col)
    d = F.transform(v, lambda y: y.cast("double"))
    fine = v.isNotNull() & (F.size(v) > 0) & ~F.exists(d, lambda y: y.isNull() | F.isnan(y) | (F.abs(y) == float("inf")))
    norm = F.aggregate(d, F.lit(0.0), lambda s, y: s + y * y)
    rows = vectors.select(i.alias("id"), F.when(fine & (norm > 0), d).alias("v")).withColumn("__n", F.monotonically_increasing_id())
    key = F.when(F.col("v").isNotNull(), F.struct(F.xxhash64("v").alias("h1"), F.xxhash64("v", F.lit(1)).alias("h2")))
    rows = materialize(rows.select("id", "v", key.alias("key")))
    classes = rows.where("key is not null").groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v"))
    classes = materialize(classes)
    total = classes.count()
    kinds = [r[0] for r in classes.select(F.size("v")).distinct().limit(2).collect()]
    cell_rows = cell_rows or max(1024, BLOCK // max([1, *kinds]))
    cells = max(1, min(sample // 4, total // cell_rows))
    centres = []
    if cells > 1 and len(kinds) == 1:
        bound = int(-(2**63) + min(1.0, 2.0 * sample / total) * (2**64 - 1))
        got = classes.where(F.xxhash64("rep", F.lit(3)) <= F.lit(min(bound, 2**63 - 1))).orderBy("rep").limit(sample).select("v").collect()
        x = np.array([r[0] for r in got], float)
        x /= np.sqrt((x * x).sum(axis=1))[:, None]
        pick = [0]
        far = ((x - x[0]) ** 2).sum(axis=1)
        while len(pick) < min(cells, len(x)):
            pick.append(int(np.argmax(far)))
            far = np.minimum(far, ((x - x[pick[-1]]) ** 2).sum(axis=1))
        centres = [x[p] for p in pick]
    hub = np.array(centres)

    def assign(batches):
        for b in batches:
            if not b.num_rows:
                continue
            if len(hub):
                x = np.array(b.column("v").to_pylist(), float)
                x /= np.sqrt((x * x).sum(axis=1))[:, None]
                d2 = 2 - 2 * (x @ hub.T)
                cell, far = d2.argmin(axis=1), np.sqrt(np.maximum(0, d2.min(axis=1)))
            else:
                cell, far = np.array([len(y) for y in b.column("v").to_pylist()]), np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("copies"), b.column("v"), pa.array(cell.astype(np.int32)), pa.array(far)], ["rep", "copies", "v", "cell", "far"])

    placed = materialize(classes.select("rep", "copies", "v").mapInArrow(assign, "rep long, copies long, v array<double>, cell int, far double"))
    # One row a cell: at most sample / 4, or one for each vector length.
    size = {r["cell"]: (r["n"], r["far"]) for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}
    blocks = {c: max(1, math.ceil(n / cell_rows)) for c, (n, _) in size.items()}
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    links, found = _links(placed, hub, size, blocks, reach + 1e-6, threshold)
    comp = materialize(components(found).select(F.col("node").alias("rep"), "component"))
    found_links = links.groupBy("rep").agg(F.sum("n").alias("n"))
    per = classes.select("key", "rep", "copies").join(found_links, "rep", "left").join(comp, "rep", "left")
    per = materialize(per.select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    out = rows.select("id", "key").join(broadcast_if_small(per, total, 64), "key", "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col(id_col) == F.col("component_id"))


def _links(placed: DataFrame, hub: np.ndarray, size: dict, blocks: dict[int, int], reach: float, threshold: float):
    """Rows (rep, n) of links by weight and (src, dst) of a forest, from each block pair of cells that may hold links."""
    radius = np.array([size[c][1] if c in size else -np.inf for c in range(len(hub))])

    def deal(batches):
        for b in batches:
            if not b.num_rows:
                continue
            rep, cell = b.column("rep").to_numpy(), b.column("cell").to_numpy()
            block = (rep.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64)
            if len(hub):
                x = np.array(b.column("v").to_pylist(), float)
                x /= np.sqrt((x * x).sum(axis=1))[:, None]
                may = np.sqrt(np.maximum(0, 2 - 2 * (x @ hub.T))) <= radius + reach
                may[np.arange(len(cell)), cell] = True
            # A row is dealt to as many tasks as there are blocks, so rows are handed on some at a time.
            width = max(1, len(b.column("v").values) // b.num_rows)
            take, task, side = [], [], []

            def some(b=b):
                at = pa.array(take, pa.int64())
                return pa.RecordBatch.from_arrays([pa.array(task, pa.string()), pa.array(side, pa.int32()), *(b.column(n).take(at) for n in ("rep", "copies", "v"))], ["task", "side", "rep", "copies", "v"])

            for i, (c, h) in enumerate(zip(cell.tolist(), block.tolist())):
                mine = h % blocks[c]
                for other in np.flatnonzero(may[i]).tolist() if len(hub) else [c]:
                    for k in range(blocks[other]):
                        one, two = (c, mine), (other, k)
                        first, last = min(one, two), max(one, two)
                        take.append(i), task.append("%d:%d:%d:%d" % (*first, *last)), side.append(int(one != first))
                        if len(take) * width >= BATCH:
                            yield some()
                            take, task, side = [], [], []
            if take:
                yield some()

    def work(t: pa.Table) -> pa.Table:
        side, rep, copies = t["side"].to_numpy(), t["rep"].to_numpy(), t["copies"].to_numpy()
        flat = t["v"].combine_chunks()
        x = np.asarray(flat.flatten()).reshape(len(rep), -1)
        order = np.argsort(side, kind="stable")
        side, rep, copies, x = side[order], rep[order], copies[order], x[order]
        cut = int((side == 0).sum())
        name = t["task"][0].as_py().split(":")
        if name[:2] == name[2:]:
            links, edges = block_pairs(x, None, copies, None, threshold)
        elif 0 < cut < len(rep):
            links, edges = block_pairs(x[:cut], x[cut:], copies[:cut], copies[cut:], threshold)
        else:
            links, edges = np.zeros(len(rep), np.int64), []
        has = np.nonzero(links)[0]
        rows = [rep[has], links[has], np.full(len(has), -1), rep[[e[0] for e in edges]] if edges else rep[:0], np.zeros(len(edges), np.int64), rep[[e[1] for e in edges]] if edges else rep[:0]]
        return pa.Table.from_arrays([pa.array(np.concatenate([rows[k], rows[k + 3]]).astype(np.int64)) for k in range(3)], ["rep", "n", "other"])

    done = placed.mapInArrow(deal, "task string, side int, rep long, copies long, v array<double>").groupBy("task").applyInArrow(work, "rep long, n long, other long")
    done = materialize(done)
    # An edge has n = 0, as every count is over 0.
    return done.where("n > 0").select("rep", "n"), done.where("n = 0").select(F.col("rep").alias("src"), F.col("other").alias("dst"))


def op8(vectors: DataFrame) -> DataFrame:
    return near_vectors(vectors)
