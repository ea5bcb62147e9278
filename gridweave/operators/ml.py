"""Clustering of fingerprints: scaling, k-means sweep with silhouettes, agreement with labels, Ward baseline."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ship import ship

#: Features that no relabelling of rows or columns changes.
TRIMMED = (
    "log_n_rows", "log_nnz", "log_density", "row_mean", "row_cv", "row_gini", "row_frac_deg1", "row_frac_gt50", "row_col_deg_corr", "hub_prominence", "edge_jaccard_mean", "edge_jaccard_p90",
    "largest_comp_frac", "pseudo_diameter_norm", "hub1pct_coverage", "triangle_closure_rate", "assortativity",
)


def preprocess(df: DataFrame, features: list[str], log: tuple[str, ...] = ("nnz", "density")) -> DataFrame:
    """df with features coerced to numbers, log1p of the log ones (negatives as 0), gaps as medians (then 0), standardised by population deviation; constants become 0."""
    num = df.withColumns({c: F.expr(f"try_cast(`{c}` as double)") for c in features})
    num = num.withColumns({c: F.log1p(F.greatest(F.col(c), F.lit(0.0))) for c in features if c in log})
    med = num.agg(*[F.median(c).alias(c) for c in features]).first()
    num = num.withColumns({c: F.coalesce(c, F.lit(float(med[c] or 0.0))) for c in features})
    st = num.agg(*[F.avg(c).alias(f"{c}_m") for c in features], *[F.stddev_pop(c).alias(f"{c}_s") for c in features]).first()
    return num.withColumns({c: (F.col(c) - F.lit(float(st[f"{c}_m"] or 0.0))) / F.lit(float(st[f"{c}_s"] or 0.0) or 1.0) for c in features})


def points_of(df: DataFrame, features: list[str], key: str, limit: int = 64 << 20) -> tuple[list, np.ndarray]:
    """Keys and points of a fingerprint table (a row a matrix) in the order of the keys; ValueError beyond limit bytes."""
    n = df.count()
    if n * 8 * (len(features) + 1) > limit:
        raise ValueError(f"{n} rows of {len(features)} features are no table of fingerprints")
    rows = df.select(key, *features).orderBy(key).collect()
    return [r[0] for r in rows], np.array([r[1:] for r in rows], float).reshape(n, len(features))


def silhouette(points: np.ndarray, labels: np.ndarray) -> float:
    """Mean Euclidean silhouette, a block of rows against all at a time; singletons score 0."""
    names, at = np.unique(labels, return_inverse=True)
    size, total = np.bincount(at), 0.0
    if len(names) < 2:
        return 0.0
    member = np.zeros((len(points), len(names)))
    member[np.arange(len(points)), at] = 1.0
    for lo in range(0, len(points), 512):
        some, own = points[lo : lo + 512], at[lo : lo + 512]
        d = np.sqrt(((some[:, None] - points[None]) ** 2).sum(axis=2)) @ member
        i = np.arange(len(some))
        a = d[i, own] / np.maximum(size[own] - 1, 1)
        d = d / size
        d[i, own] = np.inf
        b = d.min(axis=1)
        top = np.maximum(a, b)
        total += np.where((size[own] > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1.0), 0.0).sum()
    return float(total / len(points))


def kmeans(points: np.ndarray, k: int, seed: int, rounds: int = 300) -> tuple[float, np.ndarray]:
    """Inertia and labels of Lloyd's rounds from seeded k-means++ centres, until no label changes; empty clusters keep their centre."""
    rng = np.random.default_rng([seed, k])
    centres = points[[rng.integers(len(points))]]
    near = ((points - centres[0]) ** 2).sum(axis=1)
    while len(centres) < k:
        pick = rng.choice(len(points), p=near / near.sum()) if near.sum() > 0 else rng.integers(len(points))
        centres = np.concatenate([centres, points[[pick]]])
        near = np.minimum(near, ((points - points[pick]) ** 2).sum(axis=1))
    labels = None
    for _ in range(rounds):
        d = ((points[:, None] - centres[None]) ** 2).sum(axis=2)
        new = d.argmin(axis=1)
        if labels is not None and (new == labels).all():
            break
        labels = new
        centres = np.array([points[labels == c].mean(axis=0) if (labels == c).any() else centres[c] for c in range(k)])
    return float(((points - centres[labels]) ** 2).sum()), labels


def sweep(df: DataFrame, features: list[str], key: str = "matrix", kmin: int = 2, kmax: int = 15, restarts: int = 20, seed: int = 0, label: str | None = None):
    """(rows of (k, inertia, silhouette, ari, nmi), best k, (key, cluster, cluster_agg)): of each k the best restart by inertia.

    The best k has the largest silhouette; cluster_agg are Ward clusters at that k. ari and nmi are against a label column, NULL without one. Every fit
    is a task of its own: the points, of bounded size, go with the tasks. k ends below the number of rows.
    """
    spark = df.sparkSession
    ship(spark)
    keys, points = points_of(df, features, key)
    top = min(kmax, len(points) - 1)
    if top < kmin:
        return [], None, df.select(key).withColumns({"cluster": F.lit(0), "cluster_agg": F.lit(0)})
    codes = None
    if label:
        names = {r[0]: r[1] for r in df.select(key, label).collect()}
        codes = np.unique([str(names[k]) for k in keys], return_inverse=True)[1]

    def fit(frames):
        for f in frames:
            for k, r in zip(f["k"].tolist(), f["restart"].tolist()):
                inertia, labels = kmeans(points, k, seed + r)
                yield pd.DataFrame({"k": [k], "restart": [r], "inertia": [inertia], "labels": [labels.tolist()]})

    tries = spark.range(kmin, top + 1).select(F.col("id").cast("int").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(restarts - 1))).alias("restart")).repartition(max(2, spark.sparkContext.defaultParallelism))
    fits = tries.mapInPandas(fit, "k int, restart int, inertia double, labels array<int>")
    best = fits.groupBy("k").agg(F.min_by("labels", F.struct("inertia", "restart")).alias("labels"), F.min("inertia").alias("inertia")).orderBy("k").collect()  # a row for each k
    out = []
    for r in best:
        own = np.array(r["labels"])
        ari, nmi = scores(codes, own) if codes is not None else (None, None)
        out.append((r["k"], float(r["inertia"]), silhouette(points, own), ari, nmi))
    at = max(range(len(out)), key=lambda i: (out[i][2], -i))
    agg = ward(points, out[at][0])
    done = spark.createDataFrame([(k, int(c), int(a)) for k, c, a in zip(keys, best[at]["labels"], agg)], f"`{key}` {df.schema[key].dataType.simpleString()}, cluster int, cluster_agg int")
    return out, out[at][0], done


def scores(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Adjusted Rand index and normalised mutual information of two labellings on the driver; agreement() does the same for tables."""
    t = np.zeros((a.max() + 1, b.max() + 1))
    np.add.at(t, (a, b), 1)
    n, ra, rb = t.sum(), t.sum(axis=1), t.sum(axis=0)
    two = lambda x: (x * (x - 1) / 2).sum()
    exp, top = two(ra) * two(rb) / max(n * (n - 1) / 2, 1), (two(ra) + two(rb)) / 2
    h = lambda x: float(-(x[x > 0] / n * np.log(x[x > 0] / n)).sum())
    i, j = np.nonzero(t)
    mi = float((t[i, j] / n * np.log(n * t[i, j] / (ra[i] * rb[j]))).sum())
    mean = (h(ra) + h(rb)) / 2
    return (1.0 if top == exp else float((two(t) - exp) / (top - exp))), (mi / mean if mean > 0 else 1.0)


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: adjusted Rand index and normalised mutual information (arithmetic mean) of two labellings."""
    t = df.groupBy(a, b).agg(F.count("*").alias("n"))
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2.0)
    ra, rb = t.groupBy(a).agg(F.sum("n").alias("na")), t.groupBy(b).agg(F.sum("n").alias("nb"))
    tot = t.agg(F.sum("n").cast("double").alias("every"), two("n").alias("s"))
    n_of = tot.select("every")
    h = lambda df, c: df.join(F.broadcast(n_of)).agg(F.coalesce(-F.sum(F.col(c) / F.col("every") * F.ln(F.col(c) / F.col("every"))), F.lit(0.0)).alias(f"h_{c}"), two(c).alias(f"s_{c}"))
    j = t.join(ra, a).join(rb, b).join(F.broadcast(n_of))
    mi = j.agg(F.sum(F.col("n") / F.col("every") * F.ln(F.col("every") * F.col("n") / (F.col("na") * F.col("nb")))).alias("mi"))
    r = tot.join(F.broadcast(h(ra, "na"))).join(F.broadcast(h(rb, "nb"))).join(F.broadcast(mi))  # one row each
    exp = F.col("s_na") * F.col("s_nb") / (F.col("every") * (F.col("every") - 1) / 2.0)
    top = (F.col("s_na") + F.col("s_nb")) / 2.0
    mean = (F.col("h_na") + F.col("h_nb")) / 2.0
    return r.select(F.when(top == exp, 1.0).otherwise((F.col("s") - exp) / (top - exp)).alias("ari"), F.when(mean > 0, F.col("mi") / mean).otherwise(1.0).alias("nmi"))


def ward(points: np.ndarray, k: int) -> np.ndarray:
    """Agglomerative clusters by Ward's criterion of a fingerprint table's rows (a corpus of thousands, on the driver)."""
    size = np.ones(len(points))
    d = ((points[:, None] - points[None]) ** 2).sum(axis=2) / 2.0
    np.fill_diagonal(d, np.inf)
    label, live = np.arange(len(points)), len(points)
    while live > k:
        i, j = sorted(np.unravel_index(int(np.argmin(d)), d.shape))
        merged = ((size[i] + size) * d[i] + (size[j] + size) * d[j] - size * d[i, j]) / (size[i] + size[j] + size)
        d[i], d[:, i] = merged, merged
        d[i, i], d[j], d[:, j] = np.inf, np.inf, np.inf
        size[i] += size[j]
        label[label == j] = i
        live -= 1
    return np.unique(label, return_inverse=True)[1]
