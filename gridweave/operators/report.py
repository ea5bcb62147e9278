"""Reporting over result tables: pivots, best methods, gains, correlations, status rollups."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ship import ship

TIE = 1e-12


def affinity_pivot(analysis: DataFrame, algos: list[str], metric: str = "block_density_16", perm_type: str = "SYMMETRIC", least: int = 7) -> DataFrame:
    """(matrix, one column an algorithm): largest metric, matrices with at least `least` algorithms."""
    p = analysis.where((F.col("perm_type") == perm_type) & F.col("perm").isin(*algos)).groupBy("matrix").pivot("perm", algos).agg(F.max(metric))
    return p.where(reduce(lambda a, b: a + b, [F.col(a).isNotNull().cast("int") for a in algos]) >= least)


def affinity_best(pivot: DataFrame, algos: list[str], tie: float = TIE) -> DataFrame:
    """(matrix, best_algorithm, best, n_tied, all_tied): the first column wins ties."""
    cols = [F.col(a) for a in algos]
    best, worst = F.greatest(*cols), F.least(*cols)
    first = F.coalesce(*[F.when(F.col(a) == best, F.lit(a)) for a in algos])
    tied = reduce(lambda a, b: a + b, [F.when(F.abs(c - best) <= tie, 1).otherwise(0) for c in cols])
    return pivot.select("matrix", first.alias("best_algorithm"), best.alias("best"), tied.cast("long").alias("n_tied"), (best - worst <= tie).alias("all_tied"))


def affinity_gain(best: DataFrame, analysis: DataFrame, metric: str = "block_density_16") -> DataFrame:
    """best with baseline (rows without a permutation) and gain_pct."""
    base = analysis.where(F.col("perm").isNull()).groupBy("matrix").agg(F.max(metric).alias("baseline"))
    return best.join(base, "matrix", "left").withColumn("gain_pct", (F.col("best") - F.col("baseline")) / F.col("baseline") * 100)


def with_dimension(df: DataFrame, mapping: dict[str, str], key: str, name: str, missing: str = "Unknown") -> DataFrame:
    """df with a label from a static dictionary (broadcast, its size is the code's)."""
    d = df.sparkSession.createDataFrame(list(mapping.items()), f"{key} string, {name} string")
    return df.join(F.broadcast(d), key, "left").withColumn(name, F.coalesce(name, F.lit(missing)))


def value_counts(df: DataFrame, c: str) -> DataFrame:
    return df.groupBy(c).agg(F.count("*").alias("n")).orderBy(F.desc("n"), c)


def crosstab(df: DataFrame, a: str, b: str, values: list) -> DataFrame:
    return df.groupBy(a).pivot(b, values).count().na.fill(0)


def top_groups_other(df: DataFrame, c: str, n: int = 8, other: str = "Other") -> DataFrame:
    """(c, label): the n most frequent values keep their name."""
    top = df.groupBy(c).agg(F.count("*").alias("k")).orderBy(F.desc("k"), F.asc(c)).limit(n).select(c, F.lit(True).alias("__top"))
    return df.join(F.broadcast(top), c, "left").withColumn("label", F.when(F.col("__top"), F.col(c)).otherwise(F.lit(other))).drop("__top")


def top_per_group(df: DataFrame, group: str, c: str, n: int = 3) -> DataFrame:
    g = df.groupBy(group, c).agg(F.count("*").alias("n"))
    return g.withColumn("pos", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), c)).cast("long")).where(F.col("pos") <= n)


def group_medians(df: DataFrame, group: str, c: str, values: list[str], n: int = 3) -> DataFrame:
    """One row a group: its n most frequent values of c, joined by line breaks, at the medians of some columns."""
    top = top_per_group(df, group, c, n).groupBy(group).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", c))), lambda x: x[c]), "\n").alias("top"))  # n values at most
    mid = df.groupBy(group).agg(*[F.percentile(F.col(v).cast("double"), F.lit(0.5)).alias(v) for v in values])
    return mid.join(top, group)


def cluster_profile(df: DataFrame, group: str, values: list[str]) -> DataFrame:
    return df.groupBy(group).agg(F.count("*").alias("size"), *[F.round(F.avg(v), 4).alias(v) for v in values])


def join_results(operations: DataFrame, analysis: DataFrame) -> DataFrame:
    """Inner join on (matrix, perm, perm_type), baselines (NULL permutations) with baselines."""
    a = analysis.select(*[F.col(c).alias(f"__{c}") if c in ("matrix", "perm", "perm_type") else F.col(c) for c in analysis.columns])
    on = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in ("matrix", "perm", "perm_type")])
    return operations.join(a, on).drop("__matrix", "__perm", "__perm_type")


def correlations(df: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """(by, pearson, spearman, kendall): average ranks for ties; Kendall's tau-b by sorting and counting inversions, a group a task."""
    ship(df.sparkSession)
    w = lambda c: Window.partitionBy(by).orderBy(c)
    size = lambda c: F.count("*").over(Window.partitionBy(by, c))
    r = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("rx", F.rank().over(w(x)) + (size(x) - 1) / 2).withColumn("ry", F.rank().over(w(y)) + (size(y) - 1) / 2)
    lin = r.groupBy(by).agg(F.corr(x, y).alias("pearson"), F.corr("rx", "ry").alias("spearman"))

    def tau(t: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({by: t[by].iloc[:1], "kendall": [kendall(t["rx"].to_numpy(), t["ry"].to_numpy())]})

    t = r.select(by, "rx", "ry").groupBy(by).applyInPandas(tau, f"`{by}` {df.schema[by].dataType.simpleString()}, kendall double")
    return lin.join(t, by, "left")


def kendall(x: np.ndarray, y: np.ndarray) -> float | None:
    """Tau-b in n log n; None without two different values on both sides."""

    def pairs(*keys: np.ndarray) -> int:
        """Pairs of equal values."""
        k = np.unique(np.stack(keys), axis=1, return_counts=True)[1]
        return int((k * (k - 1) // 2).sum())

    n = len(x) * (len(x) - 1) // 2
    nx, ny = n - pairs(x), n - pairs(y)
    if not nx or not ny:
        return None
    v = y[np.lexsort((y, x))]

    def swaps(v: np.ndarray) -> tuple[int, np.ndarray]:
        if len(v) < 2:
            return 0, v
        (a, left), (b, right) = swaps(v[: len(v) // 2]), swaps(v[len(v) // 2 :])
        over = len(left) * len(right) - int(np.searchsorted(left, right, side="right").sum())
        return a + b + over, np.sort(np.concatenate([left, right]), kind="stable")

    discordant = swaps(v)[0]
    return float((nx + ny - n + pairs(x, y) - 2 * discordant) / np.sqrt(float(nx) * ny))


def breakeven(operations: DataFrame) -> DataFrame:
    """(matrix, kernel, perm, speedup, breakeven): runs until the ordering time is earned back, NULL where the order doesn't gain."""
    base = operations.where(F.col("perm").isNull()).groupBy("matrix", "kernel").agg(F.avg("time_operation_ms").alias("t0"))
    r = operations.where(F.col("perm").isNotNull()).groupBy("matrix", "kernel", "perm").agg(F.avg("time_operation_ms").alias("t"), F.avg("time_order_ms").alias("cost"))
    j = r.join(base, ["matrix", "kernel"])
    return j.select("matrix", "kernel", "perm", (F.col("t0") / F.col("t")).alias("speedup"), F.when(F.col("t0") > F.col("t"), F.col("cost") / (F.col("t0") - F.col("t"))).alias("breakeven"))


def box_stats(df: DataFrame, by: str, v: str) -> DataFrame:
    p = F.percentile(F.col(v).cast("double"), F.array(*[F.lit(q) for q in (0.05, 0.25, 0.5, 0.75, 0.95)]))
    names = ("p05", "p25", "p50", "p75", "p95")
    return df.groupBy(by).agg(p.alias("p")).select(by, *[F.col("p")[i].alias(n) for i, n in enumerate(names)])


def status_rollup(jobs: DataFrame) -> DataFrame:
    """Jobs by status, then tag and perm: counts, share of all and distinct matrices; an example error of each group."""
    total = jobs.agg(F.count("*").alias("t"))
    g = jobs.rollup("status", "tag", "perm").agg(F.count("*").alias("n"), F.countDistinct("matrix").alias("n_matrices"), F.min("error").alias("example"), F.grouping_id().alias("level"))
    return g.join(F.broadcast(total)).select("status", "tag", "perm", F.col("level").cast("long").alias("level"), "n", (100.0 * F.col("n") / F.col("t")).alias("pct"), "n_matrices", "example")


def missing_runs(matrices: DataFrame, perms: DataFrame, done: DataFrame) -> DataFrame:
    """(matrix, perm) of the expected grid that have no run; both sides of the grid are parameter lists."""
    return matrices.select("matrix").distinct().join(F.broadcast(perms.select("perm").distinct())).join(done.select("matrix", "perm"), ["matrix", "perm"], "left_anti")


def experiment_grid(matrices: DataFrame, perms: list[str], n_cols: list[int], block_sizes: list[int]) -> DataFrame:
    """Every matrix with every setting, by exploding the settings."""
    lits = lambda v: F.explode(F.array(*[F.lit(x) for x in v]))
    return matrices.select("matrix").withColumn("perm", lits(perms)).withColumn("n_cols", lits(n_cols)).withColumn("block_size", lits(block_sizes))


def corpus_filter(features: DataFrame, one_per_family: bool = False, keep_full: list[str] = (), square_only: bool = False, min_size: int = 0, max_size: int | None = None, min_bandwidth: int = 0, max_density: float | None = None, exclude: list[str] = (), drop_diagonal: bool = False) -> DataFrame:
    """Matrices that pass the corpus rules; of a family the one with most entries (ties by name) unless kept in full."""
    f = features.where(F.col("n_rows") >= min_size)
    if square_only:
        f = f.where("n_rows = n_cols")
    if max_size is not None:
        f = f.where(F.col("n_rows") <= max_size)
    if min_bandwidth:
        f = f.where(F.col("bandwidth_max") >= min_bandwidth)
    if max_density is not None:
        f = f.where(F.col("nnz") <= max_density * F.col("n_rows") * F.col("n_cols"))
    if drop_diagonal:
        f = f.where("bandwidth_max > 0")
    if exclude:
        f = f.where(~F.col("matrix").isin(*exclude))
    if one_per_family:
        r = F.row_number().over(Window.partitionBy("family").orderBy(F.desc("nnz"), "matrix"))
        full = F.col("family").isin(*keep_full) if keep_full else F.lit(False)
        f = f.withColumn("__r", r).where((F.col("__r") == 1) | full).drop("__r")
    return f


def label_lookup(df: DataFrame, headers: DataFrame, collection: str) -> DataFrame:
    """(matrix, group, kind): from the matrix's header; without a group there, model family and pruner of names that start with the collection; else Unknown."""
    from ..sources.files import matrix_name

    arch, _, pruner, _ = matrix_name("matrix")
    own, lacks = F.startswith("matrix", F.lit(f"{collection}__")), F.col("__g").isNull()
    d = df.join(headers.select("matrix", F.col("group").alias("__g"), F.col("kind").alias("__k")), "matrix", "left")
    unknown = F.lit("Unknown")
    return d.select(
        *df.columns,
        F.when(lacks & own, arch).otherwise(F.coalesce("__g", unknown)).alias("group"),
        F.when(lacks & own, pruner).otherwise(F.coalesce("__k", unknown)).alias("kind"),
    )


def first_path(paths: DataFrame) -> DataFrame:
    """(stem, path): the first path (by line) of each stem."""
    return paths.groupBy("stem").agg(F.min_by("path", "line_no").alias("path"))


def mst_flexibility(tree: DataFrame, diameter: float, eps: float = 2.0) -> DataFrame:
    """One row: the largest psi with psi * diameter <= eps * sum of the n - 1 - psi lightest tree edges."""
    w = Window.orderBy("w", "u", "v").rowsBetween(Window.unboundedPreceding, 0)
    s = tree.select(F.row_number().over(Window.orderBy("w", "u", "v")).alias("k"), F.sum("w").over(w).alias("s"))
    n = s.agg(F.max("k").alias("e"))
    ok = s.join(F.broadcast(n)).select((F.col("e") - F.col("k")).alias("psi"), "s").where(F.col("psi") * diameter <= eps * F.col("s"))
    return ok.agg(F.max("psi").cast("long").alias("psi"))
