"""Structural fingerprint of a matrix: degree statistics, banding, blocks, overlap and graph shape."""

from __future__ import annotations

import math
import time
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import materialize, scratch, settled
from . import graph, metrics, packed
from .matrix import SparseMatrix, dense_index


def degrees(m: SparseMatrix, side: str = "row") -> DataFrame:
    """(idx, d) for every row or column, empty ones included."""
    counted = m.row_degrees if side == "row" else m.col_degrees
    if counted is not None:
        return counted
    spine = m.spine if side == "row" else m.col_spine
    return spine.join(m.coo.groupBy(side).agg(F.count("*").alias("d")), side, "left").select(F.col(side).alias("idx"), F.coalesce("d", F.lit(0)).cast("long").alias("d"))


def skew(c: Column, n: Column) -> Column:
    """m3 / m2 ** 1.5, 0 below three values or without spread."""
    return F.when(n < 3, F.lit(0.0)).otherwise(F.coalesce(F.skewness(c), F.lit(0.0)))


def degree_stats(m: SparseMatrix, side: str = "row") -> DataFrame:
    d = degrees(m, side)
    x = F.col("d").cast("double")
    share = lambda c: F.avg(c.cast("int").cast("double"))
    p = F.percentile(x, F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)))
    out = d.agg(
        F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.max("d").alias("max"), p.alias("p"), skew(x, F.count("*")).alias("skew"),
        share(F.col("d") == 0).alias("frac_empty"), share(F.col("d") == 1).alias("frac_deg1"), share(F.col("d") > 50).alias("frac_gt50"),
    )
    named = {"mean": F.col("mean"), "std": F.col("std"), "cv": F.when(F.col("mean") > 0, F.col("std") / F.col("mean")).otherwise(0.0), "max": F.col("max"), "p50": F.col("p")[0], "p90": F.col("p")[1], "p99": F.col("p")[2]}
    named |= {k: F.col(k) for k in ("skew", "frac_empty", "frac_deg1", "frac_gt50")}
    return out.select(*[v.alias(f"{side}_{k}") for k, v in named.items()])


def gini(values: DataFrame, c: str = "d") -> DataFrame:
    """One row: 2 sum(i x_i) / (n sum x) - (n + 1) / n over ascending values, 0 when empty or all zero.

    Equal values are counted first, so ranks are sums over distinct values and no window spans the rows.
    """
    g = values.groupBy(F.col(c).alias("x")).agg(F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(Window.orderBy("x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    g = g.withColumn("b", before)
    ranked = g.agg(F.sum(F.col("x") * (F.col("k") * F.col("b") + F.col("k") * (F.col("k") + 1) / 2.0)).alias("s"), F.sum(F.col("x") * F.col("k")).alias("t"), F.sum("k").alias("n"))
    return ranked.select(F.when(F.coalesce("t", F.lit(0)) > 0, 2.0 * F.col("s") / (F.col("n") * F.col("t")) - (F.col("n") + 1.0) / F.col("n")).otherwise(0.0).alias("gini"))


def powerlaw_alpha(m: SparseMatrix) -> DataFrame:
    """One row: 1 - 1 / slope of ln(degree) on ln(rank) over the top max(50, n // 5) positive degrees; NULL where it has no meaning."""
    d = degrees(m, "row").select("d")
    if m.rows != m.cols:
        d = d.unionAll(degrees(m, "col").select("d"))
    d = d.where("d > 0")
    n = d.agg(F.count("*").alias("n"))
    ranked = dense_index(d, [F.desc("d")], "r").join(F.broadcast(n)).where("n >= 50").where(F.col("r") < F.greatest(F.lit(50), F.expr("n div 5")))
    fit = ranked.agg(F.regr_slope(F.ln("d"), F.ln(F.col("r") + 1)).alias("s"), F.min("d").alias("lo"), F.max("d").alias("hi"))
    return fit.select(F.when((F.col("lo") < F.col("hi")) & (F.col("s") < 0), 1.0 - 1.0 / F.col("s")).alias("powerlaw_alpha"))


def degree_correlation(m: SparseMatrix) -> DataFrame:
    r, c = degrees(m, "row"), degrees(m, "col").withColumnRenamed("d", "e")
    return r.join(c, "idx").agg(F.corr("d", "e").alias("row_col_deg_corr"))


def pattern_symmetric(m: SparseMatrix) -> DataFrame:
    """One row: 1 when every entry has its mirror, compared as patterns."""
    flip = m.coo.select(F.col("col").alias("row"), F.col("row").alias("col"))
    return m.coo.join(flip, ["row", "col"], "left_anti").agg((F.count("*") == 0).cast("int").alias("pattern_symmetric"))


def picked(entries: DataFrame, sample: int, seed: int) -> DataFrame:
    """(row, col) of up to sample entries: the first by hash."""
    return entries.select("row", "col").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "row", "col").cast("string")), "row", "col").limit(sample)


def edge_jaccard(m: SparseMatrix, sample: int = 2000, most: int = 5000, seed: int = 0, among: DataFrame | None = None) -> DataFrame:
    """One row over up to sample entries (all when there are no more, else by hash): overlap of the entry's row with its column's row.

    Empty sets and sets over most elements are left out. Of a rectangular matrix the row's columns meet the rows of the entry's column. Only sets
    that the sample needs are gathered. among: a larger sample by the same seed, where there is one.
    """
    pick = materialize(picked(m.coo if among is None else among, sample, seed))

    def sets(wanted: DataFrame, key: str, member: str, name: str) -> DataFrame:
        """(key, name): members of up to most of the wanted keys; at most 2 * sample of them."""
        held = m.coo.select(F.col(key).alias("__k"), F.col(member).alias("__v")).join(F.broadcast(wanted.select(F.col(wanted.columns[0]).alias("__k")).distinct()), "__k", "left_semi")
        few = held.groupBy("__k").agg(F.count("*").alias("__n")).where(F.col("__n") <= most).select("__k")
        return held.join(F.broadcast(few), "__k").groupBy("__k").agg(F.collect_set("__v").alias(name))

    if m.rows == m.cols:
        s = sets(pick.select("row").union(pick.select("col")), "row", "col", "s")
        p = pick.join(s.withColumnRenamed("__k", "row"), "row").join(s.select(F.col("__k").alias("col"), F.col("s").alias("t")), "col")
    else:
        p = pick.join(sets(pick.select("row"), "row", "col", "s").withColumnRenamed("__k", "row"), "row")
        p = p.join(sets(pick.select("col"), "col", "row", "t").withColumnRenamed("__k", "col"), "col")
    p = p.select((F.size(F.array_intersect("s", "t")) / F.size(F.array_union("s", "t"))).alias("j"))
    return p.agg(F.avg("j").alias("edge_jaccard_mean"), F.percentile("j", F.lit(0.9)).alias("edge_jaccard_p90"), F.avg((F.col("j") > 0.5).cast("int").cast("double")).alias("edge_jaccard_frac_gt05"))


def graph_degrees(m: SparseMatrix) -> DataFrame:
    """(idx, d) of each vertex of the matrix's graph: pattern of A or its transpose, loops counted; rectangular ones as bipartite, columns after rows."""
    if m.rows != m.cols:
        return degrees(m, "row").unionByName(degrees(m, "col").select((F.col("idx") + m.rows).alias("idx"), "d"))
    if m.mirrored:
        return degrees(m, "row")
    both = m.coo.select("row", "col").union(m.coo.select("col", "row")).distinct()
    return m.spine.join(both.groupBy("row").agg(F.count("*").alias("d")), "row", "left").select(F.col("row").alias("idx"), F.coalesce("d", F.lit(0)).cast("long").alias("d"))


def hub_coverage(m: SparseMatrix) -> DataFrame:
    """One row: the top 1 % of the graph's degrees (one at least) over all, and the largest over the mean.

    Equal degrees are counted first, so the top is a sum over distinct values and no window spans the vertices.
    """
    g = graph_degrees(m).groupBy("d").agg(F.count("*").alias("k"))
    n = graph.vertices(m)
    top = max(1, n // 100)
    before = F.coalesce(F.sum("k").over(Window.orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = g.withColumn("b", before).agg(F.sum(F.col("d") * F.greatest(F.lit(0), F.least(F.col("k"), F.lit(top) - F.col("b")))).alias("h"), F.sum(F.col("d") * F.col("k")).alias("t"), F.max("d").alias("m"))
    return s.select(F.when(F.col("t") > 0, F.col("h") / F.col("t")).otherwise(0.0).alias("hub1pct_coverage"), F.when(F.col("t") > 0, F.col("m") / (F.col("t") / F.lit(n))).otherwise(0.0).alias("hub_prominence"))


def assortativity(m: SparseMatrix, sample: int = 5000, seed: int = 0, among: DataFrame | None = None) -> DataFrame:
    """One row: correlation of the row degrees at both ends of up to sample entries; 0 when one side is constant. among: as in edge_jaccard."""
    pick = picked(m.coo if among is None else among, sample, seed)
    d = degrees(m, "row")
    e = pick.join(d.select(F.col("idx").alias("row"), F.col("d").alias("du")), "row").join(d.select(F.col("idx").alias("col"), F.col("d").alias("dv")), "col")
    g = e.agg(F.corr("du", "dv").alias("c"), F.stddev_pop("du").alias("su"), F.stddev_pop("dv").alias("sv"))
    return g.select(F.when((F.col("su") > 0) & (F.col("sv") > 0), F.col("c")).otherwise(0.0).alias("assortativity"))


def betweenness(m: SparseMatrix, pivots: int = 64, most_nodes: int = 50_000, seed: int = 0) -> DataFrame:
    """(node, score): Brandes' dependency sums from pivots taken by hash, level by level as joins; square matrices up to most_nodes."""
    if m.rows != m.cols or m.rows > most_nodes:
        return m.coo.sparkSession.createDataFrame([], "node long, score double")
    e = graph.materialize(graph.edges_of(m))
    src = e.select(F.col("src").alias("node")).distinct().orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(pivots)
    levels = graph.materialize(graph.bfs(e, src))
    top = levels.agg(F.max("level")).first()[0] or 0
    step = levels.select("source", F.col("node").alias("src"), "level").join(e, "src").join(levels.select("source", F.col("node").alias("dst"), F.col("level").alias("to")), ["source", "dst"])
    step = graph.materialize(step.where("to = level + 1").select("source", "src", "dst", "level"))
    paths = levels.where("level = 0").select("source", "node", F.lit(1.0).alias("sigma"))
    every = [paths]
    for k in range(top):
        nxt = step.where(F.col("level") == k).join(every[-1].withColumnRenamed("node", "src"), ["source", "src"]).groupBy("source", F.col("dst").alias("node")).agg(F.sum("sigma").alias("sigma"))
        every.append(graph.materialize(nxt))
    delta, total = every[-1].select("source", "node", F.lit(0.0).alias("delta")), None
    for k in range(top - 1, -1, -1):
        below = every[k + 1].join(delta, ["source", "node"]).select("source", F.col("node").alias("dst"), ((1 + F.col("delta")) / F.col("sigma")).alias("f"))
        up = step.where(F.col("level") == k).join(below, ["source", "dst"]).groupBy("source", F.col("src").alias("node")).agg(F.sum("f").alias("f"))
        delta = graph.materialize(every[k].join(up, ["source", "node"], "left").select("source", "node", (F.col("sigma") * F.coalesce("f", F.lit(0.0))).alias("delta")))
        if k:
            total = delta if total is None else total.unionByName(delta)
    if total is None:
        return src.select("node", F.lit(0.0).alias("score"))
    return total.groupBy("node").agg(F.sum("delta").alias("score"))


#: The columns of a fingerprint and their order, as feature files have them.
COLUMNS = (
    "matrix", "status", "n_rows", "n_cols", "nnz", "density", "is_square", "pattern_symmetric", "log_n_rows", "log_nnz", "log_density", "row_mean", "row_std", "row_cv", "row_max", "row_p50", "row_p90", "row_p99", "row_gini",
    "row_skew", "row_frac_empty", "row_frac_deg1", "row_frac_gt50", "col_mean", "col_std", "col_cv", "col_max", "col_p50", "col_p90", "col_p99", "col_gini", "col_skew", "col_frac_empty", "col_frac_deg1", "col_frac_gt50",
    "row_col_deg_corr", "bandwidth_max", "bandwidth_avg", "bandwidth_norm", "frac_nnz_band32", "frac_nnz_band128", "diag_frac", "avg_row_spread", "max_row_spread", "profile", "avg_col_spread", "max_col_spread",
    "vert_adj_ratio", "block16_occupied", "block16_density", "block_fill_gain", "jaccard_mean", "jaccard_max", "jaccard_frac_gt05", "edge_jaccard_mean", "edge_jaccard_p90", "edge_jaccard_frac_gt05", "n_components",
    "largest_comp_frac", "bfs_depth_mean", "bfs_depth_max", "pseudo_diameter", "pseudo_diameter_norm", "pagerank_max", "pagerank_std", "hub1pct_coverage", "hub_prominence", "triangle_closure_rate", "powerlaw_alpha",
    "assortativity", "approx_betweenness_mean", "approx_betweenness_max", "load_s", "feat_s",
)
_LONGS = {"n_rows", "n_cols", "nnz", "is_square", "pattern_symmetric", "row_max", "col_max", "bandwidth_max", "max_row_spread", "profile", "max_col_spread", "block16_occupied", "n_components"}
#: Types of a fingerprint's columns, as a schema string.
SCHEMA = ", ".join(f"{c} {'string' if c in ('matrix', 'status') else 'long' if c in _LONGS else 'double'}" for c in COLUMNS)


def _missing(*names: str) -> dict[str, Column]:
    return {c: F.lit(None).cast("double") for c in names}


def _in_range(m: SparseMatrix) -> bool:
    inside = (F.col("row") >= 0) & (F.col("row") < m.rows) & (F.col("col") >= 0) & (F.col("col") < m.cols)
    return m.coo.where(~F.coalesce(inside, F.lit(False))).isEmpty()


def _by_joins(m: SparseMatrix, seed: int) -> list[DataFrame]:
    """The parts of a fingerprint that go over the pattern many times, as joins: for matrices of any size."""
    ranks = graph.pagerank(m).agg(F.max("rank").alias("pagerank_max"), F.stddev_pop("rank").alias("pagerank_std"))
    parts = [metrics.spread(m), metrics.vertical_adjacency(m).drop("n_adjacent"), metrics.block_count(m, 16, 16).withColumnRenamed("n_blocks", "block16_occupied"), graph.component_summary(m), graph.pseudo_diameter(m, seed), ranks]
    return parts + ([graph.triangles(graph.edges_of(m)).select("triangle_closure_rate")] if m.rows == m.cols else [])


def _by_arrays(m: SparseMatrix, nnz: int, seed: int) -> tuple[SparseMatrix, list[DataFrame]]:
    """The same from the pattern as packed rows and columns, and the matrix with its degrees: entries are shuffled once a side, then read where they lie."""
    spark, n = m.coo.sparkSession, graph.vertices(m)
    rows = packed.pack(m.coo.select("row", "col"), m.rows, m.cols)
    by_row = packed.lines(rows)
    cols = rows if m.mirrored else packed.pack(m.coo.select(F.col("col").alias("row"), F.col("row").alias("col")), m.cols, m.rows)
    by_col = by_row if m.mirrored else packed.lines(cols)
    spread = lambda t: t.agg(F.avg(F.col("last") - F.col("first")), F.max(F.col("last") - F.col("first")), F.sum(F.col("last") - F.col("first")), F.count("*")).first()
    r, c = spread(by_row), spread(by_col)
    sums = rows.agg(F.sum("blocks"), F.sum("loops")).first()
    if m.rows != m.cols:
        tables, linked = [(rows, 0, m.rows), (cols, m.rows, 0)], by_row.select("idx").union(by_col.select(F.col("idx") + m.rows))
    elif m.mirrored and not sums[1]:
        tables, linked = [(rows, 0, 0)], by_row.select("idx")
    else:
        tables = [(packed.pack(m.coo.select("row", "col"), n, n, both=True), 0, 0)]
        linked = packed.lines(tables[0][0]).select("idx")
    g = packed.graph(tables, n)
    label = packed.components(g)
    start = linked.orderBy(F.md5(F.concat_ws(":", F.lit(seed), "idx").cast("string")), "idx").first()
    depth = mean = None
    if start is not None:
        level = packed.bfs(g, start["idx"], label)
        level = packed.bfs(g, int(level.argmax()), label)
        depth, mean = float(level.max()), float(level[level > 0].mean())
    rank = packed.pagerank(g)
    found = {
        "avg_row_spread double": r[0], "max_row_spread long": r[1], "profile long": r[2], "avg_col_spread double": c[0], "max_col_spread long": c[1],
        "vert_adj_ratio double": packed.adjacent(m, rows) / (nnz - c[3]) if nnz > c[3] else 0.0, "block16_occupied long": sums[0],
        "n_components long": len(np.unique(label)), "largest_comp_frac double": float(np.bincount(label).max() / n),
        "pseudo_diameter double": depth, "pseudo_diameter_norm double": None if depth is None or n < 2 else depth / math.log(n), "bfs_depth_mean double": mean, "bfs_depth_max double": depth,
        "pagerank_max double": float(rank.max()), "pagerank_std double": float(rank.std()),
    }
    if m.rows == m.cols:
        wedges = int((g.degree * (g.degree - 1) // 2).sum())
        found["triangle_closure_rate double"] = 3.0 * packed.triangles(g) / wedges if wedges else 0.0
    every = lambda spine, t: materialize(spine.toDF("idx").join(t.select("idx", "d"), "idx", "left").select("idx", F.coalesce("d", F.lit(0)).cast("long").alias("d")))
    by_row = every(m.spine, by_row)
    m = replace(m, row_degrees=by_row, col_degrees=by_row if m.mirrored else every(m.col_spine, by_col))
    return m, [spark.createDataFrame([tuple(found.values())], ", ".join(found))]


def fingerprint(m: SparseMatrix, name: str, seed: int = 0, with_betweenness: bool = False, most_nodes: int = 50_000) -> DataFrame:
    """One row of all COLUMNS but the times (NULL), worked out at once; what is written on the way is deleted then.

    Square matrices only: row_col_deg_corr, pattern_symmetric, assortativity (else NULL), diag_frac and triangle_closure_rate (else 0). Sampled features
    take their sample by hash. Triangles are exact. Up to packed.MOST rows and columns go by arrays, more by joins. Betweenness on demand, for up to most_nodes rows. A matrix without
    entries has zeros where a mean would be undefined.
    """
    spark = m.coo.sparkSession
    with scratch(spark):
        row = _fingerprint(m, name, seed, with_betweenness, most_nodes)
        return spark.createDataFrame(row.collect(), row.schema)


def _fingerprint(m: SparseMatrix, name: str, seed: int, with_betweenness: bool, most_nodes: int) -> DataFrame:
    """The row as a join of one-row aggregates over the matrix, which is written once."""
    m = replace(m, coo=settled(m.coo))
    square, size = m.rows == m.cols, float(m.rows) * float(m.cols)
    nnz = m.nnz()
    density = nnz / size if size else 0.0
    base = m.coo.sparkSession.createDataFrame(
        [(name, "ok", m.rows, m.cols, nnz, density, int(square), math.log1p(m.rows), math.log1p(nnz), math.log1p(density))],
        "matrix string, status string, n_rows long, n_cols long, nnz long, density double, is_square long, log_n_rows double, log_nnz double, log_density double",
    )
    among = materialize(picked(m.coo, 5000, seed))
    if nnz and packed.fits(m) and _in_range(m):
        m, parts = _by_arrays(m, nnz, seed)
    else:
        parts = _by_joins(m, seed)
    parts += [
        degree_stats(m, "row"), gini(degrees(m, "row")).withColumnRenamed("gini", "row_gini"), degree_stats(m, "col"), gini(degrees(m, "col")).withColumnRenamed("gini", "col_gini"),
        metrics.bandwidth(m).drop("bandwidth_lower", "bandwidth_upper"), edge_jaccard(m, seed=seed, among=among), hub_coverage(m), powerlaw_alpha(m),
    ]
    if square:
        parts += [degree_correlation(m), assortativity(m, seed=seed, among=among)]
        parts.append(m.coo.sparkSession.createDataFrame([(1,)], "pattern_symmetric int") if m.mirrored else pattern_symmetric(m))
    if with_betweenness and square and m.rows <= most_nodes:
        pairs = (m.rows - 1) * (m.rows - 2)
        pivots = min(m.rows, 256)
        # Scores as shares of all pairs, for a sample of sources as if all had been taken.
        score = F.col("score") * (m.rows / pivots / pairs if pairs else 0.0)
        parts.append(betweenness(m, pivots, most_nodes, seed).agg((F.sum(score) / F.lit(m.rows)).alias("approx_betweenness_mean"), F.max(score).alias("approx_betweenness_max")))
    out = base
    for p in parts:
        out = out.join(F.broadcast(p))  # one row each
    out = out.withColumn("block16_density", F.when(F.col("block16_occupied") > 0, F.col("nnz") / (F.col("block16_occupied") * 256)).otherwise(0.0))
    out = out.withColumn("block_fill_gain", F.when(F.col("density") > 0, F.col("block16_density") / F.col("density")).otherwise(0.0))
    # The older names of the sampled overlaps stay.
    out = out.withColumns({"jaccard_mean": F.col("edge_jaccard_mean"), "jaccard_max": F.col("edge_jaccard_p90"), "jaccard_frac_gt05": F.col("edge_jaccard_frac_gt05")})
    lacking = _missing(*(c for c in COLUMNS if c not in out.columns))
    if not square:
        lacking |= {"triangle_closure_rate": F.lit(0.0), "diag_frac": F.lit(0.0)}
    return out.withColumns(lacking).select(*[F.col(c).cast("long") if c in _LONGS else F.col(c) for c in COLUMNS])


def extract(spark, path: str, seed: int = 0, with_betweenness: bool = False, most_nodes: int = 50_000) -> DataFrame:
    """The fingerprint of a matrix file with the seconds it took to load and to work out; an error row where that fails."""
    from ..sources.mtx import read_mtx

    name, began = path.rsplit("/", 1)[-1], time.perf_counter()
    try:
        m = read_mtx(spark, path)
        m = m.with_coo(materialize(m.coo))
        loaded = time.perf_counter()
        row = fingerprint(m, name, seed, with_betweenness, most_nodes).first()
    except Exception as e:  # noqa: BLE001 - any failure is a row of the corpus
        return error_row(spark, name, f"{type(e).__name__}: {str(e).splitlines()[0][:200] if str(e) else ''}")
    times = {"load_s": round(loaded - began, 3), "feat_s": round(time.perf_counter() - began, 3)}
    return spark.createDataFrame([tuple({**row.asDict(), **times}[c] for c in COLUMNS)], SCHEMA)


def error_row(spark, name: str, message: str) -> DataFrame:
    """The fingerprint row of a matrix that could not be read: name and status only."""
    return spark.createDataFrame([(name, f"error: {message}", *[None] * (len(COLUMNS) - 2))], SCHEMA)


def write_fingerprint(row: DataFrame, path: str) -> None:
    """One CSV part with a header; missing values are empty."""
    row.select(*COLUMNS).coalesce(1).write.mode("overwrite").csv(path, header=True, emptyValue="", nullValue="")


def merge_fingerprints(spark, folder: str, out: str) -> DataFrame:
    """All feature files below a folder as one table in COLUMNS' order, columns by name, written as CSV."""
    from ..sources.files import read_results

    t = read_results(spark, folder, SCHEMA)
    t.orderBy("matrix").coalesce(1).write.mode("overwrite").csv(out, header=True, emptyValue="", nullValue="")
    return t
