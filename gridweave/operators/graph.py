"""Graphs of sparse matrices: components, distances, page rank, triangles, spanning trees."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import materialize, settled
from .matrix import SparseMatrix, dense_index

#: Bytes that a side counted beforehand may have to be broadcast; of a side that comes to each vertex once at most.
SMALL, VERTICES = 8 << 20, 32 << 20


def edges_of(m: SparseMatrix) -> DataFrame:
    """(src, dst) both ways, distinct, no loops: pattern of A or its transpose; rectangular ones as bipartite, columns after rows."""
    shift = 0 if m.rows == m.cols else m.rows
    e = m.coo.select(F.col("row").alias("src"), (F.col("col") + shift).alias("dst")).where("src <> dst")
    if m.mirrored:
        return e
    return e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def vertices(m: SparseMatrix) -> int:
    return m.rows if m.rows == m.cols else m.rows + m.cols


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (src, dst); component is the least node reachable.

    Each round maps every node to the least of itself and its neighbours and contracts the edges by that
    map, until no edge is left. Rounds end in written tables, so lineage stays short. Nodes with very many edges are
    pre-aggregated before the shuffle; joins on them are split by AQE.
    """
    edges = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    edges = materialize(edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct())
    labels = materialize(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("component")))
    while True:
        edges = edges.where("a <> b")
        if edges.isEmpty():
            return labels
        step = materialize(edges.select(F.explode(F.array(F.struct(F.col("b").alias("node"), F.col("a").alias("to")), F.struct(F.col("a").alias("node"), F.col("a").alias("to")))).alias("x")).groupBy("x.node").agg(F.min("x.to").alias("to")))
        moved = lambda df, c, s=step: df.join(s.select(F.col("node").alias(c), F.col("to").alias("__to")), c, "left").withColumn(c, F.coalesce("__to", c)).drop("__to")
        labels = materialize(moved(labels, "component"))
        both = moved(moved(edges, "a"), "b")
        edges = materialize(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())


def matrix_components(m: SparseMatrix) -> DataFrame:
    """(node, component) for every vertex, isolated ones by themselves."""
    spine = m.coo.sparkSession.range(vertices(m)).select(F.col("id").alias("node"))
    return spine.join(components(edges_of(m)), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def component_summary(m: SparseMatrix) -> DataFrame:
    g = matrix_components(m).groupBy("component").agg(F.count("*").alias("n"))
    return g.agg(F.count("*").alias("n_components"), (F.max("n") / F.sum("n")).alias("largest_comp_frac"))


def bfs(edges: DataFrame, sources: DataFrame, max_depth: int = 10_000) -> DataFrame:
    """(source, node, level): levels from each source; a frontier join a round, until it is empty.

    A vertex has its sources as bits, 64 in a word, so an edge is a row for 64 sources and a frontier at most a row a vertex and word.
    """
    edges = settled(edges)
    given = materialize(dense_index(sources.select("node").distinct(), [F.asc("node")], "k").select("node", F.expr("k div 64").alias("word"), F.expr("cast(k % 64 as int)").alias("at")))
    front = materialize(given.groupBy("node", "word").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("bits")).withColumn("level", F.lit(0)))
    seen, depth = front, 0
    while depth < max_depth:
        depth += 1
        few = front.select(F.col("node").alias("src"), "word", "bits")
        few = F.broadcast(few) if front.count() * 24 <= VERTICES else few
        nxt = edges.join(few, "src").groupBy(F.col("dst").alias("node"), "word").agg(F.bit_or("bits").alias("bits"))
        old = seen.groupBy("node", "word").agg(F.bit_or("bits").alias("old"))
        new = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0).cast("long"))))
        front = materialize(nxt.join(old, ["node", "word"], "left").select("node", "word", new.alias("bits"), F.lit(depth).alias("level")).where("bits <> 0"))
        if front.isEmpty():
            break
        seen = materialize(seen.unionByName(front)) if depth % 8 == 0 else seen.unionByName(front)
    each = seen.select("node", "level", "word", F.expr("explode(filter(sequence(0, 63), i -> (shiftright(bits, i) & 1L) = 1L))").alias("at"))
    return each.join(given.select(F.col("node").alias("source"), "word", "at"), ["word", "at"]).select("source", "node", "level")


def pseudo_diameter(m: SparseMatrix, seed: int = 0) -> DataFrame:
    """One row from two sweeps: from a linked vertex taken by hash, then from the farthest vertex reached (least id on ties).

    bfs_depth_mean is of the distances over 0 in the second sweep; pseudo_diameter_norm is over ln of the number of vertices. Without edges
    all are NULL.
    """
    e = materialize(edges_of(m))
    pick = e.select(F.col("src").alias("node")).distinct().orderBy(F.md5(F.concat_ws(":", F.lit(seed), "node").cast("string")), "node").limit(1)
    first = bfs(e, pick)
    far = materialize(first.orderBy(F.desc("level"), "node").limit(1).select("node"))
    d = F.max("level").cast("double")
    n = vertices(m)
    return bfs(e, far).agg(
        d.alias("pseudo_diameter"), (d / F.lit(math.log(n) if n > 1 else None)).alias("pseudo_diameter_norm"), F.coalesce(F.avg(F.when(F.col("level") > 0, F.col("level"))), 0 * d).alias("bfs_depth_mean"), d.alias("bfs_depth_max")
    )


def pagerank(m: SparseMatrix, alpha: float = 0.85, rounds: int = 10) -> DataFrame:
    """(node, rank) after a fixed number of rounds; dangling mass is spread evenly.

    The graph goes both ways, so a vertex without an edge out has none in: all of these have one rank, a number that follows from the round before.
    Ranks add up to 1 in every round. Each round reads the ranks once and ends in a written table; ranks
    of few vertices are broadcast, so edges move only as partial sums.
    """
    n = vertices(m)
    e = edges_of(m)
    deg = e.groupBy("src").agg(F.count("*").alias("deg"))
    e = materialize(e.join(deg, "src")) if n * 24 > SMALL else materialize(e.join(F.broadcast(deg), "src"))  # n rows
    linked = materialize(e.select(F.col("src").alias("node")).distinct())
    alone = n - linked.count()
    ranks, rest = linked.withColumn("rank", F.lit(1.0 / n)), 1.0 / n
    for k in range(rounds):
        give = ranks.withColumnRenamed("node", "src")
        give = F.broadcast(give) if n * 24 <= SMALL else give  # n rows
        got = e.join(give, "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("deg")).alias("got"))
        base = (1 - alpha) / n + alpha * alone * rest / n
        ranks, rest = got.select("node", (F.lit(base) + alpha * F.col("got")).alias("rank")), base
        if k < rounds - 1:
            ranks = materialize(ranks)
    spine = m.coo.sparkSession.range(n).select(F.col("id").alias("node"))
    return spine.join(ranks, "node", "left").select("node", F.coalesce("rank", F.lit(rest)).alias("rank"))


def triangles(edges: DataFrame) -> DataFrame:
    """One row: wedges, closed wedges and closure rate, exact. Edges point from lower to higher degree, so no hub opens many wedges."""
    deg = edges.groupBy("src").agg(F.count("*").alias("d"))
    w = deg.agg(F.sum(F.col("d") * (F.col("d") - 1) / 2).cast("long").alias("wedges"))
    e = edges.join(deg.withColumnRenamed("d", "ds"), "src").join(deg.select(F.col("src").alias("dst"), F.col("d").alias("dd")), "dst")
    up = e.where((F.col("ds") < F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst")))).select("src", "dst")
    wedge = up.join(up.select("src", F.col("dst").alias("other")), "src").where("dst < other").select("dst", "other")
    closed = wedge.join(edges.select(F.col("src").alias("dst"), F.col("dst").alias("other")), ["dst", "other"], "left_semi").agg(F.count("*").alias("triangles"))
    return closed.join(F.broadcast(w)).select("wedges", "triangles", F.when(F.col("wedges") > 0, 3.0 * F.col("triangles") / F.col("wedges")).otherwise(0.0).alias("triangle_closure_rate"))


def minimum_spanning_forest(edges: DataFrame) -> DataFrame:
    """(u, v, w) of a minimum spanning forest of edges (u, v, w): Boruvka rounds, ties by (w, u, v)."""
    e = materialize(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "w").where("u <> v"))
    comp = materialize(e.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("c", F.col("node")))
    tree = None
    while True:
        live = e.join(comp.select(F.col("node").alias("u"), F.col("c").alias("cu")), "u").join(comp.select(F.col("node").alias("v"), F.col("c").alias("cv")), "v").where("cu <> cv")
        both = live.select("cu", F.struct("w", "u", "v").alias("e")).union(live.select("cv", F.struct("w", "u", "v").alias("e")))
        pick = materialize(both.groupBy("cu").agg(F.min("e").alias("e")).select("e.*").distinct())
        if pick.isEmpty():
            return tree if tree is not None else pick.select("u", "v", "w")
        tree = materialize(pick.select("u", "v", "w") if tree is None else tree.unionByName(pick.select("u", "v", "w")))
        merged = components(tree.select(F.col("u").alias("src"), F.col("v").alias("dst")))
        comp = materialize(comp.join(merged, "node", "left").select("node", F.coalesce("component", "node").alias("c")))


def complete_distances(points: DataFrame) -> DataFrame:
    """(u, v, w) of all pairs of a small point table (id, x, y); the pairs are what the complete graph is."""
    return points.select(F.col("id").alias("u"), F.col("x").alias("ux"), F.col("y").alias("uy")).join(
        points.select(F.col("id").alias("v"), F.col("x").alias("vx"), F.col("y").alias("vy")), F.col("u") < F.col("v")
    ).select("u", "v", F.sqrt(F.pow(F.col("ux") - F.col("vx"), 2) + F.pow(F.col("uy") - F.col("vy"), 2)).alias("w"))
