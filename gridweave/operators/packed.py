"""Patterns as packed rows: the sorted columns of some rows as bytes, with array kernels that go over them.

Vectors of a number a row are held by the driver and broadcast, so matrices have up to MOST rows and columns.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ship import ship
from ..plans.storage import materialize, scratch
from .matrix import SparseMatrix

#: Rows or columns (a vector of doubles: 64 MB); entries of a range of rows, of a piece, and dealt at once; rows that a piece does not part.
MOST, ENTRIES, PIECE, BATCH, GROUP = 8 << 20, 1 << 20, 1 << 18, 1 << 19, 16
#: Ranges of rows counted before they are put together; edges of the three blocks of a task that counts triangles; ways of two edges, and marks, at once.
BINS, FINE, BLOCKS, WAYS, MARKS = 4096, 64, 12 << 20, 1 << 20, 16 << 20
#: Directed edges of small components that share a task; edges that a job which counts triangles deals (1 GB).
BUNDLE, DEALT = 1 << 20, 1 << 28


def fits(m: SparseMatrix) -> bool:
    return max(m.rows, m.cols) <= MOST


def _columns(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1 .. of size numbers each, end to end."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


def pack(pairs: DataFrame, rows: int, cols: int, both: bool = False) -> DataFrame:
    """(lo, n, entries, loops, blocks, adjacent, sizes, cols): for pieces of rows lo .. lo + n - 1 their numbers of entries and their sorted columns, 32 bits each.

    blocks are those of GROUP x GROUP, adjacent the entries below another of the piece. pairs: (row, col), none twice; both: their mirrors are added, loops and
    repeated ones dropped. Entries are dealt to ranges of rows as sorted differences.
    """
    ship(pairs.sparkSession)
    width = GROUP * max(1, -(-rows // (GROUP * BINS)))
    ends = pairs.select("row").union(pairs.select(F.col("col").alias("row"))) if both else pairs
    held = np.zeros(-(-rows // width) + 1, np.int64)
    for r in ends.groupBy(F.expr(f"row div {width}").alias("b")).count().collect():  # BINS at most
        held[r["b"]] = r["count"]
    ranges = (np.cumsum(held) - held) // ENTRIES
    starts = np.flatnonzero(np.diff(ranges, prepend=-1)) * width

    def deal(batches):
        def out(rows_, cols_):
            r, c = np.concatenate(rows_), np.concatenate(cols_)
            if both:
                r, c = np.concatenate([r, c])[(k := np.tile(r != c, 2))], np.concatenate([c, r])[k]
            code = np.sort(r * cols + c)
            at = [*np.searchsorted(code, starts * cols), len(code)]
            some = [k for k in range(len(starts)) if at[k] < at[k + 1]]
            steps = np.diff(code, prepend=0)
            wide = [bool(at[k + 1] - at[k] > 1 and steps[at[k] + 1 : at[k + 1]].max() >= 1 << 32) for k in some]
            data = [steps[at[k] + 1 : at[k + 1]].astype(np.int64 if w else np.uint32).tobytes() for k, w in zip(some, wide)]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([int(code[at[k]]) for k in some], pa.int64()), pa.array(wide, pa.bool_()), pa.array(data, pa.binary())], ["part", "first", "wide", "data"])

        rows_, cols_, n = [], [], 0
        for batch in batches:
            r, c = _columns(batch, "row", "col")
            rows_.append(r), cols_.append(c)
            n += len(r)
            if n >= BATCH:
                yield out(rows_, cols_)
                rows_, cols_, n = [], [], 0
        if n:
            yield out(rows_, cols_)

    def build(t: pa.Table) -> pa.Table:
        code = []
        for first, wide, data in zip(t["first"].to_pylist(), t["wide"].to_pylist(), t["data"]):
            steps = np.frombuffer(data.as_buffer(), np.int64 if wide else np.uint32)
            code.append(np.cumsum(np.concatenate([[first], steps]), dtype=np.int64))
        code = np.sort(np.concatenate(code))
        if both:
            code = code[np.diff(code, prepend=-1) != 0]
        row, col = code // cols, code % cols
        group = np.flatnonzero(np.diff(row // GROUP, prepend=-1))
        cuts = [0, *group[1:][np.diff(group // PIECE) > 0], len(code)]
        found = []
        for i, j in zip(cuts[:-1], cuts[1:]):
            r, c, x = row[i:j], col[i:j], code[i:j]
            lo, n = int(r[0]), int(r[-1] - r[0] + 1)
            above = x - cols
            spot = np.searchsorted(x, above)
            found.append((lo, n, int(j - i), int((r == c).sum()), len(np.unique(r // GROUP * (cols // GROUP + 1) + c // GROUP)), int((x[spot] == above).sum()), np.bincount(r - lo, minlength=n).astype(np.int32).tobytes(), c.astype(np.int32).tobytes()))
        return pa.Table.from_arrays([pa.array(x, pa.binary() if k > 5 else pa.int64()) for k, x in enumerate(zip(*found))], ["lo", "n", "entries", "loops", "blocks", "adjacent", "sizes", "cols"])

    dealt = pairs.select(F.col("row").cast("long"), F.col("col").cast("long")).mapInArrow(deal, "part int, first long, wide boolean, data binary")
    return materialize(dealt.groupBy("part").applyInArrow(build, "lo long, n long, entries long, loops long, blocks long, adjacent long, sizes binary, cols binary"))


def _pieces(batches):
    """(lo, sizes, cols) of each piece."""
    for batch in batches:
        for lo, sizes, cols in zip(batch.column("lo").to_pylist(), batch.column("sizes"), batch.column("cols")):
            yield lo, np.frombuffer(sizes.as_buffer(), np.int32), np.frombuffer(cols.as_buffer(), np.int32)


def lines(packed: DataFrame) -> DataFrame:
    """(idx, d, first, last) of each row with entries: their number, least and largest column."""

    def run(batches):
        for lo, size, col in _pieces(batches):
            some = np.flatnonzero(size)
            end = np.cumsum(size)[some]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (lo + some, size[some], col[end - size[some]], col[end - 1])], ["idx", "d", "first", "last"])

    return materialize(packed.select("lo", "sizes", "cols").mapInArrow(run, "idx long, d long, first long, last long"))


def adjacent(m: SparseMatrix, packed: DataFrame) -> int:
    """Entries right below another: those within pieces, and those between the first row of a piece and the row before."""
    first = packed.select(F.col("lo").alias("row"))
    near = lambda shift: m.coo.select(F.col("row"), "col").join(F.broadcast(first.select((F.col("row") - shift).alias("row"))), "row", "left_semi")  # noqa: E731 - a row a piece
    across = near(0).select((F.col("row") - 1).alias("row"), "col").join(near(1), ["row", "col"], "left_semi").count()
    return across + (packed.agg(F.sum("adjacent")).first()[0] or 0)


@dataclass(frozen=True)
class Graph:
    """Edges both ways without loops: tables of pack() with what is added to their rows and columns; number of vertices, edges of each."""

    parts: list[tuple[DataFrame, int, int]]
    n: int
    degree: np.ndarray

    def pull(self, x: np.ndarray, kernel, kind, rest, span: tuple[int, int] | None = None) -> np.ndarray:
        """kernel (a ufunc) over x of each vertex's neighbours, or rest; span: vertices lo .. hi - 1 only, at least."""
        out = np.full(self.n, rest, kind)
        sent = self.parts[0][0].sparkSession.sparkContext.broadcast(x)
        for table, src, dst in self.parts:

            def run(batches, dst=dst):
                v = sent.value
                for lo, size, col in _pieces(batches):
                    some = np.flatnonzero(size)
                    got = np.full(len(size), rest, kind)
                    got[some] = kernel.reduceat(v[dst:][col], (np.cumsum(size) - size)[some])
                    yield pa.RecordBatch.from_arrays([pa.array([lo], pa.int64()), pa.array([got.tobytes()], pa.binary())], ["lo", "got"])

            if span is not None:
                table = table.where((F.col("lo") + src < span[1]) & (F.col("lo") + F.col("n") + src > span[0]))
            for r in table.select("lo", "sizes", "cols").mapInArrow(run, "lo long, got binary").collect():
                got = np.frombuffer(r["got"], kind)
                out[r["lo"] + src : r["lo"] + src + len(got)] = got
        sent.destroy()
        return out


def graph(parts: list[tuple[DataFrame, int, int]], n: int) -> Graph:
    degree = np.zeros(n, np.int64)
    for table, src, _ in parts:
        for r in table.select("lo", "sizes").collect():
            size = np.frombuffer(r["sizes"], np.int32)
            degree[r["lo"] + src : r["lo"] + src + len(size)] = size
    return Graph(parts, n, degree)


def pattern(m: SparseMatrix) -> Graph:
    """graph.edges_of(m) as packed rows, in one part."""
    n, shift = (m.rows, 0) if m.rows == m.cols else (m.rows + m.cols, m.rows)
    e = m.coo.select("row", (F.col("col") + shift).alias("col")).where("row <> col")
    return graph([(pack(e, n, n, both=not m.mirrored), 0, 0)], n)


def ordered(g: Graph, label: np.ndarray, kernel) -> DataFrame:
    """(comp, row, pos): the vertices of each label in the order of kernel(at, to), for a graph of one part whose edges join equal labels only.

    The kernel has them numbered by their ids, the neighbours of the v-th in to[at[v] : at[v + 1]], ascending. A label is a task, or shares one with
    other small ones; its edges come as a stream and are held once, in 32 bits each. Labels without edges are left out.
    """
    (table, _, _), sc = g.parts[0], g.parts[0][0].sparkSession.sparkContext
    edges = np.bincount(label, g.degree, g.n).astype(np.int64)
    few = np.where(edges < BUNDLE, edges, 0)
    task = (np.cumsum(few) - few) // BUNDLE
    large = np.flatnonzero(edges >= BUNDLE)
    task[large] = np.arange(len(large)) + task.max(initial=0) + 1
    sent = sc.broadcast((np.where(edges > 0, task, -1)[label].astype(np.int32), label.astype(np.int32), g.degree.astype(np.int32)))

    def deal(batches):
        own = sent.value[0]
        for lo, size, col in _pieces(batches):
            of, some, start = own[lo : lo + len(size)], size > 0, np.cumsum(size) - size
            each = np.unique(of[some]).tolist()
            for t in each:
                rows = np.flatnonzero(some & (of == t))
                cols = col if len(each) == 1 else col[_ragged(start[rows], size[rows])]
                yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([lo + int(rows[0])], pa.int64()), pa.array([cols.tobytes()], pa.binary())], ["task", "first", "cols"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, of, degree = sent.value
        nodes = None
        for batch in batches:
            if nodes is None:
                nodes = np.flatnonzero(own == batch.column("task")[0].as_py())
                size = degree[nodes]
                at = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
                place, to = np.zeros(len(own), np.int32), np.empty(at[-1], np.int32)
                place[nodes] = np.arange(len(nodes), dtype=np.int32)
            for first, cols in zip(batch.column("first").to_pylist(), batch.column("cols")):
                got = np.frombuffer(cols.as_buffer(), np.int32)
                spot = at[place[first]]  # rows of a piece that are the task's follow each other
                to[spot : spot + len(got)] = place[got]
        comp = of[nodes]
        cut = np.append(np.flatnonzero(np.diff(np.sort(comp), prepend=-1)), len(nodes))
        if len(cut) > 2:
            by = np.argsort(comp, kind="stable")
            place = np.empty(len(nodes), np.int32)
            place[by] = np.arange(len(nodes)) - np.repeat(cut[:-1], np.diff(cut))
            to = place[to[_ragged(at[by], size[by])]]
            nodes, comp, at = nodes[by], comp[by], np.concatenate([[0], np.cumsum(size[by], dtype=np.int64)])
        del place
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
            order = nodes[i:j][np.asarray(kernel(at[i : j + 1] - at[i], to[at[i] : at[j]]), np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (comp[i:j], order, np.arange(j - i))], ["comp", "row", "pos"])

    dealt = table.select("lo", "sizes", "cols").mapInArrow(deal, "task int, first long, cols binary")
    out = materialize(dealt.groupBy("task").applyInArrow(run, "comp long, row long, pos long"))
    sent.destroy()
    return out


def components(g: Graph) -> np.ndarray:
    """The least vertex reachable from each: every label moves to the least one next to it, chains of moves are shortened, until none moves."""
    label = np.arange(g.n, dtype=np.int32)
    while True:
        to = np.arange(g.n, dtype=np.int32)
        np.minimum.at(to, label, np.minimum(label, g.pull(label, np.minimum, np.int32, np.iinfo(np.int32).max)))
        while (to[to] != to).any():
            to = to[to]
        moved = to[label]
        if (moved == label).all():
            return label
        label = moved


def bfs(g: Graph, source: int, label: np.ndarray) -> np.ndarray:
    """Levels from a source, -1 where it doesn't reach; label: components(g)."""
    level = np.full(g.n, -1, np.int32)
    level[source], depth = 0, 0
    left = label == label[source]
    left[source] = False
    while len(todo := np.flatnonzero(left)):
        near = g.pull((level == depth).astype(np.uint8), np.maximum, np.uint8, 0, (int(todo[0]), int(todo[-1]) + 1))
        new = todo[near[todo] > 0]
        depth += 1
        level[new], left[new] = depth, False
    return level


def pagerank(g: Graph, alpha: float = 0.85, rounds: int = 10) -> np.ndarray:
    """As graph.pagerank: a fixed number of rounds, dangling mass spread evenly."""
    alone = g.degree == 0
    rank = np.full(g.n, 1.0 / g.n)
    for _ in range(rounds):
        got = g.pull(rank / np.maximum(g.degree, 1), np.add, np.float64, 0.0)
        rank = (1 - alpha) / g.n + alpha * (got + rank[alone].sum() / g.n)
    return rank


def _tasks(count: np.ndarray, most: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The coarse range of each fine one, and triples of coarse ranges with edges between all three.

    Of the numbers of ranges whose triples have up to most edges (or the least that can be had) it is the largest that sends few more edges than the best.
    """
    found = []
    for p in range(1, len(count) + 1):
        coarse = np.arange(len(count)) * p // len(count)
        c = np.zeros((p, p), np.int64)
        np.add.at(c, (coarse[:, None], coarse[None, :]), count)
        i, j, k = np.nonzero((c[:, :, None] > 0) & (c[:, None, :] > 0) & (c[None, :, :] > 0))
        sent = c[i, j] + np.where(j != k, c[i, k], 0) + np.where(i != j, c[j, k], 0)  # each block once
        found.append((int(sent.max(initial=0)), int(sent.sum()), coarse, list(zip(i.tolist(), j.tolist(), k.tolist()))))
    most = max(most, min(x[0] for x in found))
    fewest = min(x[1] for x in found if x[0] <= most)
    return [x[2:] for x in found if x[0] <= most and x[1] <= 1.25 * fewest][-1]


def _closed(size_a, dst_a, size_b, dst_b, size_c, dst_c, width: int) -> int:
    """Edges (u, v) of a and (v, w) of c with (u, w) in b: rows u, u and v; columns v, w and w counted from the start of their range, w under width."""
    start_b, start_c = np.cumsum(size_b) - size_b, np.cumsum(size_c) - size_c
    ways = np.concatenate([[0], np.cumsum(size_c[dst_a], dtype=np.int64)])
    edge = np.concatenate([[0], np.cumsum(size_a)])
    done, total, n = ways[edge], 0, len(size_a)
    batch = max(1, MARKS // width)
    mark = np.zeros(min(batch, n) * width, bool)
    u = 0
    while u < n:
        to = min(n, u + batch, max(u + 1, int(np.searchsorted(done, done[u] + WAYS, "right")) - 1))
        if done[to] > done[u]:
            rows = np.arange(u, to)
            b = dst_b[start_b[u] : start_b[to - 1] + size_b[to - 1]] + np.repeat((rows - u) * width, size_b[u:to])
            mark[b] = True
            owner = np.repeat((rows - u) * width, size_a[u:to])
            e = edge[u]
            while e < edge[to]:
                f = min(edge[to], max(e + 1, int(np.searchsorted(ways, ways[e] + WAYS, "right")) - 1))
                v = dst_a[e:f]
                at = dst_c[_ragged(start_c[v], size_c[v])] + np.repeat(owner[e - edge[u] : f - edge[u]], size_c[v])
                total += int(np.count_nonzero(mark[at]))
                e = f
            mark[b] = False
        u = to
    return total


def closure(pairs: DataFrame, n: int) -> DataFrame:
    """graph.triangles of the edges (row, col) of n vertices, each given once or more, one way or both."""
    spark = pairs.sparkSession
    with scratch(spark):
        g = graph([(pack(pairs, n, n, both=True), 0, 0)], n)
        wedges = int((g.degree * (g.degree - 1) // 2).sum()) if g.degree.any() else None
        found = triangles(g)
    return spark.createDataFrame([(wedges, found, 3.0 * found / wedges if wedges else 0.0)], "wedges long, triangles long, triangle_closure_rate double")


def triangles(g: Graph, most: int = BLOCKS) -> int:
    """Triangles of a graph of one part. Vertices are ranked by degree and edges point to the higher rank, blocks of them by ranges of both ends go to tasks of three ranges, wedges never leave a task.

    A job takes as many tasks as DEALT allows, and its shuffle goes before the next.
    """
    (table, _, _), spark = g.parts[0], g.parts[0][0].sparkSession
    sc = spark.sparkContext
    by = np.argsort(g.degree, kind="stable")
    rank = np.empty(g.n, np.int32)
    rank[by] = np.arange(g.n, dtype=np.int32)
    sent = sc.broadcast(rank)
    reach = np.cumsum(g.degree[by])
    fine = np.unique(np.searchsorted(reach, np.arange(FINE) * (reach[-1] / FINE if g.n else 0), "left")) if g.n and reach[-1] else np.zeros(1, np.int64)
    fine[0] = 0

    def up(batches):
        """(source, target) of each piece's edges that point up, by ranks."""
        r = sent.value
        for lo, size, col in _pieces(batches):
            src, dst = np.repeat(r[lo : lo + len(size)], size), r[col]
            keep = src < dst
            yield src[keep], dst[keep]

    def counted(batches):
        c = np.zeros((len(fine), len(fine)), np.int64)
        for src, dst in up(batches):
            at = (np.searchsorted(fine, src, "right") - 1) * len(fine) + np.searchsorted(fine, dst, "right") - 1
            c += np.bincount(at, minlength=c.size).reshape(c.shape)
        yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary())], ["c"])

    read = table.select("lo", "sizes", "cols")
    count = sum((np.frombuffer(r["c"], np.int64).reshape(len(fine), -1) for r in read.mapInArrow(counted, "c binary").collect()), np.zeros((len(fine), len(fine)), np.int64))
    coarse, tasks = _tasks(count, most)
    cut = np.append(fine[np.flatnonzero(np.diff(coarse, prepend=-1))], g.n)
    held = np.zeros((len(cut), len(cut)), np.int64)
    np.add.at(held, (coarse[:, None], coarse[None, :]), count)
    load = [sum(int(held[x]) for x in {(i, j), (i, k), (j, k)}) for i, j, k in tasks]
    job = ((np.cumsum(load) - load) // DEALT).tolist()

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, task = [[], [], []], None
        for batch in batches:
            task = batch.column("task")[0].as_py()
            for role, *bits in zip(batch.column("roles").to_pylist(), *(batch.column(x) for x in ("rows", "sizes", "cols"))):
                bits = [np.frombuffer(x.as_py(), np.int32) for x in bits]  # copies, so that the batch can go
                for k in range(3):
                    if role >> k & 1:
                        held[k].append(bits)
        side = []
        for k, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
            base, end = int(cut[tasks[task][a]]), int(cut[tasks[task][a] + 1])
            size = np.zeros(end - base, np.int32)
            for rows, n, _ in held[k]:
                size[rows - base] = n
            start = np.cumsum(size, dtype=np.int64) - size
            cols = np.empty(int(size.sum(dtype=np.int64)), np.int32)
            while held[k]:
                rows, n, c = held[k].pop()
                cols[_ragged(start[rows - base], n)] = c - np.int32(cut[tasks[task][b]])
            side += [size, cols]
        yield pa.RecordBatch.from_arrays([pa.array([_closed(*side, int(cut[tasks[task][2] + 1] - cut[tasks[task][2]]))], pa.int64())], ["found"])

    total = 0
    for turn in sorted(set(job)):
        roles: dict = {}
        for t, (i, j, k) in enumerate(tasks):
            if job[t] == turn:
                for role, block in enumerate(((i, j), (i, k), (j, k))):
                    roles[t, block] = roles.get((t, block), 0) | 1 << role
        some = np.zeros(len(cut) ** 2, bool)
        some[[a * len(cut) + b for _, (a, b) in roles]] = True
        wanted = spark.createDataFrame([(t, a, b, r) for (t, (a, b)), r in roles.items()], "task int, a int, b int, roles int")

        def blocks(batches, some=some):
            for src, dst in up(batches):
                key = (np.searchsorted(cut, src, "right") - 1) * len(cut) + np.searchsorted(cut, dst, "right") - 1
                order = np.argsort(key, kind="stable")
                order = order[some[key[order]]]
                key, src, dst = key[order], src[order], dst[order]
                at = [*np.flatnonzero(np.diff(key, prepend=-1)), len(key)]
                out = []
                for i, j in zip(at[:-1], at[1:]):
                    row = np.flatnonzero(np.diff(src[i:j], prepend=-1))
                    out.append((int(key[i] // len(cut)), int(key[i] % len(cut)), src[i:j][row].tobytes(), np.diff(np.append(row, j - i)).astype(np.int32).tobytes(), dst[i:j].tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["a", "b", "rows", "sizes", "cols"])

        dealt = read.mapInArrow(blocks, "a int, b int, rows binary, sizes binary, cols binary").join(F.broadcast(wanted), ["a", "b"])
        total += dealt.select("task", "roles", "rows", "sizes", "cols").groupBy("task").applyInArrow(close, "found long").agg(F.sum("found")).first()[0] or 0
        del dealt
        if job[-1]:
            gc.collect()
            sc._jvm.System.gc()
    sent.destroy()
    return total
