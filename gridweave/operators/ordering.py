"""Row orderings: each takes a sketch or matrix and returns a permutation table (new_pos, old_idx)."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bits
from ..plans.ship import ship
from ..plans.storage import materialize, release, scratch, settled
from . import metrics, overlap, sketch as sk
from .graph import VERTICES, components
from .matrix import Axis, SparseMatrix, compose, dense_index, identity, order_by


def random_rows(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """Rows in the order of a hash of the row and the seed: a random order that every run repeats."""
    r = spark.range(n).select(F.col("id").alias("row")).withColumn("__k", F.md5(F.concat_ws(":", F.lit(int(seed)), F.col("row")).cast("string")))
    return order_by(r, [F.asc("__k"), F.asc("row")], rows=n)


def random_both(spark: SparkSession, rows: int, cols: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    return random_rows(spark, rows, seed), random_rows(spark, cols, seed + 1)


def by_degree(m: SparseMatrix, ascending: bool = True) -> DataFrame:
    """Rows by entry count, stable; empty rows are rows of degree 0."""
    return order_by(m.row_counts(), [F.asc("cnt") if ascending else F.desc("cnt"), F.asc("row")], rows=m.rows)


def first_window(sketch: DataFrame, rows: int) -> DataFrame:
    """Rows by their first window, ties by row, empty rows last."""
    spine = sketch.sparkSession.range(rows).select(F.col("id").alias("row"))
    first = spine.join(sketch.groupBy("row").agg(F.min("win").alias("w")), "row", "left")
    return order_by(first, [F.col("w").asc_nulls_last(), F.asc("row")], rows=rows)


def lexicographic(sketch: DataFrame, rows: int) -> DataFrame:
    """Rows by their windows' popularity ranks, compared as sorted lists; a prefix is before its extension, empty rows first."""
    spine = sketch.sparkSession.range(rows).select(F.col("id").alias("row"))
    ranked = sketch.join(sk.column_rank(sketch).select("win", "rank"), "win")
    sig = spine.join(sk.signatures(ranked, "rank"), "row", "left").select("row", F.coalesce("wins", F.array().cast("array<bigint>")).alias("sig"))
    return order_by(sig, [F.asc("sig"), F.asc("row")], rows=rows)


def multilevel(m: SparseMatrix, widths=(16, 8, 4, 1)) -> DataFrame:
    return lexicographic(sk.multilevel(m, widths), m.rows)


# ---- MinHash micro-clusters, wavefront over their graph, slab packing


def hybrid_stages(sketch: DataFrame, rows: int, w_block: int = 32, lookahead: int = 64, hub_frac: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Permutation and one row of statistics: n_empty, n_hub_windows, n_micro, macro_incidences, macro_components."""
    spark = sketch.sparkSession
    ship(spark)
    w_block = max(1, int(w_block))
    sketch = materialize(sketch)
    with scratch(spark):  # what is written on the way takes more than the results
        micro = materialize(sk.micro_clusters(sk.row_sketches(sketch, rows, hub_frac), w_block), keep=True)
    pins = materialize(sk.macro_incidence(sketch, micro, rows, hub_frac), keep=True)
    # Micro-clusters with a window in common are tied to the least of them.
    ties = pins.join(pins.groupBy("win").agg(F.min("micro_id").alias("dst")), "win").select(F.col("micro_id").alias("src"), "dst")
    with scratch(spark):
        comp = materialize(components(ties).select(F.col("node").alias("micro_id"), F.col("component").alias("comp")), keep=True)
    walked = pins.join(comp, "micro_id").groupBy("comp").applyInPandas(_wavefront, "comp long, micro_id long, pos long, seed_size long, seed_id long")
    walked = materialize(walked)
    n_pins, n_comp = pins.count(), comp.select("comp").distinct().count()
    release(pins)
    release(comp)
    macro = dense_index(walked, [F.asc("seed_size"), F.asc("seed_id"), F.asc("pos")], "macro_pos").select("micro_id", "macro_pos")
    spine = spark.range(rows).select(F.col("id").alias("row"))
    placed = spine.join(micro, "row", "left").join(macro, "micro_id", "left")
    perm = order_by(placed, [F.col("macro_pos").asc_nulls_first(), F.asc("pos_in_micro"), F.asc("row")], rows=rows)
    n_empty = rows - sketch.select("row").distinct().count()
    if lookahead > 1 and rows - n_empty > 2:
        perm = _pack_slabs(perm, sketch, n_empty, max(w_block * 32, lookahead * 4), lookahead)
    stats = micro.agg(F.countDistinct("micro_id").alias("n_micro")).select(
        F.lit(n_empty).cast("long").alias("n_empty"),
        F.lit(sk.hubs(sketch, rows, hub_frac).count()).cast("long").alias("n_hub_windows"),
        "n_micro",
        F.lit(n_pins).cast("long").alias("macro_incidences"),
        F.lit(n_comp).cast("long").alias("macro_components"),
    )
    return perm, stats


def _wavefront(t: pd.DataFrame) -> pd.DataFrame:
    """Reverse level order of one component: from its smallest micro-cluster, next ones by shared-window weight.

    Each window is spread once. Ties in weight and size fall to the id. A component is arrays of its incidences both ways.
    """
    ids, m = np.unique(t["micro_id"].to_numpy(), return_inverse=True)
    w = np.unique(t["win"].to_numpy(), return_inverse=True)[1]
    n = len(ids)
    size, deg = np.bincount(m), np.bincount(w)
    at, start = (np.concatenate([[0], np.cumsum(x)]) for x in (size, deg))
    wins, micros = w[np.lexsort((w, m))].astype(np.int32), m[np.lexsort((m, w))].astype(np.int32)
    inc = np.float32(1.0) / deg.astype(np.float32)
    placed, spread, score, order = np.zeros(n, bool), np.zeros(len(deg), bool), np.zeros(n, np.float32), np.empty(n, np.int64)
    order[0] = seed = int(size.argmin())
    placed[seed], end = True, 1
    for k in range(n):
        own = wins[at[order[k]] : at[order[k] + 1]]
        own = own[~spread[own]]
        if not len(own):
            continue
        spread[own] = True
        many = deg[own]
        other = micros[np.repeat(start[own] - np.cumsum(many) + many, many) + np.arange(many.sum())]
        free = ~placed[other]
        other = other[free]
        np.add.at(score, other, np.repeat(inc[own], many)[free])  # in the windows' order, in single precision
        found = np.unique(other)
        found = found[np.lexsort((found, size[found], -score[found]))]
        score[found], placed[found] = 0, True
        order[end : end + len(found)] = found
        end += len(found)
    return pd.DataFrame({"comp": int(t["comp"].iloc[0]), "micro_id": ids[order[::-1]], "pos": np.arange(n), "seed_size": int(size[seed]), "seed_id": int(ids[seed])})


def _pack_slabs(perm: DataFrame, sketch: DataFrame, n_empty: int, chunk: int, lookahead: int) -> DataFrame:
    """Within chunks of the non-empty part, bring the nearest of the next rows up behind each row, one after the other."""
    sig = sk.signatures(sketch).withColumnRenamed("row", "old_idx")
    body = perm.where(F.col("new_pos") >= n_empty).join(sig, "old_idx").withColumn("chunk", F.expr(f"(new_pos - {n_empty}) div {chunk}"))

    def pack(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("new_pos")
        rows, size = t["old_idx"].to_numpy(), t["wins"].map(len).to_numpy()
        n, win = len(rows), np.unique(np.concatenate(t["wins"].tolist()), return_inverse=True)[1]
        at, order = np.concatenate([[0], np.cumsum(size)]), np.arange(n)
        holder = np.repeat(order, size)[np.argsort(win, kind="stable")]
        deg = np.bincount(win)
        start = np.cumsum(deg) - deg
        for i in range(n - 2):
            own = win[at[order[i]] : at[order[i] + 1]]
            many = deg[own]
            ahead = order[i + 1 : i + 1 + lookahead]
            if many.sum() == len(own):
                continue  # shares nothing: all are at distance 1
            both = np.bincount(holder[np.repeat(start[own] - np.cumsum(many) + many, many) + np.arange(many.sum())], minlength=n)[ahead]
            best = i + 1 + int((np.float32(1.0) - both.astype(np.float32) / (size[order[i]] + size[ahead] - both).astype(np.float32)).argmin())
            order[i + 1], order[best] = order[best], order[i + 1]
        return pd.DataFrame({"new_pos": t["new_pos"].to_numpy(), "old_idx": rows[order]})

    packed = body.groupBy("chunk").applyInPandas(pack, "new_pos long, old_idx long")
    return perm.where(F.col("new_pos") < n_empty).unionByName(packed)


def hybrid(m: SparseMatrix, w: int = 32, w_block: int = 32, lookahead: int = 64, hub_frac: float = 0.05) -> DataFrame:
    """Permutation by MinHash micro-clusters, reverse wavefront and slab packing; no windows at all give identity."""
    if m.cols == 0 or m.rows == 0:
        return identity(m.coo.sparkSession, m.rows)
    return hybrid_stages(sk.mask(m, w), m.rows, w_block, lookahead, hub_frac)[0]


# ---- compositions


def apply_first_window(m: SparseMatrix, w: int) -> tuple[SparseMatrix, DataFrame]:
    """Rows by first window, applied."""
    perm = first_window(sk.mask(m, w), m.rows)
    return m.permute_rows(perm), perm


def pre_permuted(m: SparseMatrix, order, seed: int = 42) -> DataFrame:
    """An order of a scrambled matrix, as an order of the matrix itself: both sides are scrambled alike where it is square, else its rows.

    order takes the scrambled matrix and returns a permutation of its rows.
    """
    first = random_rows(m.coo.sparkSession, m.rows, seed)
    return compose(order(m.apply(Axis.SYMMETRIC if m.rows == m.cols else Axis.ROW, first)), first)


def two_sided(m: SparseMatrix, w: int = 4, max_iters: int = 4, block: int = 32) -> tuple[DataFrame, DataFrame, list[int]]:
    """Lexicographic order of rows and columns in turn while the count of occupied blocks falls.

    Returns the best row and column permutations and the counts. Each round ends in written tables.
    """
    spark = m.coo.sparkSession
    m = m.with_coo(materialize(m.coo))
    best_r, best_c = identity(spark, m.rows), identity(spark, m.cols)
    rows, cols, cur = best_r, best_c, m
    counts = [metrics.block_count(cur, block, block).first()[0]]
    for _ in range(max_iters):
        p = materialize(lexicographic(sk.mask(cur, w), cur.rows))
        rows = materialize(compose(p, rows))
        cur = cur.permute_rows(p)
        q = materialize(lexicographic(sk.mask(cur.transpose(), w), cur.cols))
        cols = materialize(compose(q, cols))
        cur = cur.with_coo(materialize(cur.permute_cols(q).coo))
        counts.append(metrics.block_count(cur, block, block).first()[0])
        if counts[-1] >= min(counts[:-1]):
            break
        best_r, best_c = rows, cols
    return best_r, best_c, counts


# ---- clustering by Jaccard similarity


def cluster_centroids(sketch: DataFrame, rows: int, k: int, tau: float = 0.5, seed: int = 42, max_rounds: int | None = None, local: int = 8_000_000) -> DataFrame:
    """Rounds of k centroids, taken by hash from the rows not yet clustered; rows go to the nearest within tau; the rest at the end.

    A row without a shared window is at distance 1. A centroid takes itself, so rows div k rounds are enough; max_rounds ends
    sooner, with the rows left as the rest. Pairs within tau are found once; up to `local` rows and pairs, one task then takes all rounds, beyond it
    a round is joins.
    """
    spark = sketch.sparkSession
    if k == 0:
        return identity(spark, rows)
    ship(spark)
    k = min(k, max(rows, 1))
    sketch = settled(sketch)
    sizes = materialize(spark.range(rows).select(F.col("id").alias("row")).join(sketch.groupBy("row").agg(F.count("*").alias("n")), "row", "left").na.fill(0, ["n"]))
    links = materialize(overlap.within(sketch, tau)) if rows <= local else None
    if links is not None and links.count() <= local:

        def run(t: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
            turn, c = _rounds(*(t[x].to_numpy() for x in ("row", "n", "h")), *(near[x].to_numpy() for x in ("a", "b", "d")), k, max_rounds)
            return pd.DataFrame({"row": t["row"], "turn": turn, "c": c})

        one = F.lit("")
        hashed = sizes.withColumn("h", F.xxhash64("row", F.lit(seed))).withColumn("one", one).groupBy("one")
        every = hashed.cogroup(links.withColumn("one", one).groupBy("one")).applyInPandas(run, "row long, turn long, c long")
        return order_by(materialize(every), [F.asc("turn"), F.asc("c"), F.asc("row")], rows=rows)
    left, done, turn = sizes, [], 0
    while (max_rounds is None or turn < max_rounds) and left.count() >= k:
        pick = materialize(left.orderBy(F.xxhash64("row", F.lit(seed), F.lit(turn)), "row").limit(k).select(F.col("row").alias("centre"), F.col("n").alias("m"), (F.row_number().over(Window.orderBy(F.xxhash64("row", F.lit(seed), F.lit(turn)), "row")) - 1).alias("c")))
        wins = pick.join(sketch.withColumnRenamed("row", "centre"), "centre").select("c", "m", "win")
        near = left.join(sketch, "row").join(wins, "win").groupBy("row", "c").agg(F.count("*").alias("i"), F.first("n").alias("n"), F.first("m").alias("m"))
        near = near.select("row", "c", (1.0 - F.col("i") / (F.col("n") + F.col("m") - F.col("i"))).alias("d"))
        empty = left.where("n = 0").select("row").join(F.broadcast(pick.where("m = 0").select("c").limit(1))).select("row", "c", F.lit(0.0).alias("d"))
        got = near.union(empty).groupBy("row").agg(F.min(F.struct("d", "c")).alias("b")).where(F.col("b.d") <= tau)
        got = materialize(got.select("row", F.col("b.c").alias("c"), F.lit(turn).alias("turn")))
        done.append(got)
        if len(done) == 16:  # keep the plan short
            done = [materialize(reduce(DataFrame.unionByName, done))]
        left, turn = materialize(left.join(got, "row", "left_anti")), turn + 1
    every = left.select("row", F.lit(0).alias("c"), F.lit(1 << 30).alias("turn"))
    for g in done:
        every = every.unionByName(g)
    return order_by(every, [F.asc("turn"), F.asc("c"), F.asc("row")], rows=rows)


def _rounds(row: np.ndarray, n: np.ndarray, h: np.ndarray, a: np.ndarray, b: np.ndarray, d: np.ndarray, k: int, max_rounds: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(turn, c) of each row, see cluster_centroids; h: the hash of row and seed; (a, b, d): pairs within tau, both ways."""
    by = np.argsort(row)
    a, b = by[np.searchsorted(row, a, sorter=by)], by[np.searchsorted(row, b, sorter=by)]
    order = np.argsort(a, kind="stable")
    b, d, at = b[order], d[order], np.concatenate([[0], np.cumsum(np.bincount(a, minlength=len(row)))])
    turns, centre, best = np.full(len(row), 1 << 30), np.zeros(len(row), np.int64), np.full(len(row), np.inf)
    left, turn = np.arange(len(row)), 0
    while (max_rounds is None or turn < max_rounds) and len(left) >= k:
        x = bits.xxhash64_int(h[left], turn)
        few = left[least := x <= np.partition(x, k - 1)[k - 1]]
        empty = False
        for c, v in enumerate(few[np.lexsort((row[few], x[least]))[:k]].tolist()):
            if n[v]:
                to, gap = np.append(b[at[v] : at[v + 1]], v), np.append(d[at[v] : at[v + 1]], 0.0)
            elif empty:
                continue
            else:  # rows without windows are alike
                empty, to, gap = True, left[n[left] == 0], 0.0
            near = (turns[to] >= turn) & (gap < best[to])
            to = to[near]
            best[to], centre[to], turns[to] = np.broadcast_to(gap, near.shape)[near], c, turn
        left, turn = left[turns[left] > turn], turn + 1
    return turns, centre


def candidate_pairs(sketch: DataFrame, rows: int, k: int = 64, cap: int = 64) -> DataFrame:
    """(row, cand, jaccard): for each row up to cap others from the capped inverted index, in window order, with exact overlap.

    Caps on index and candidates are this operator's definition: it finds groups, not all pairs.
    """
    idx = sk.inverted_index(sketch, rows, k)
    cand = idx.join(idx.select("win", F.col("row").alias("cand"), F.col("pos").alias("cpos")), "win").where("row <> cand").groupBy("row", "cand").agg(F.min(F.struct("win", "cpos")).alias("at"))
    cand = cand.withColumn("__r", F.row_number().over(Window.partitionBy("row").orderBy("at", "cand"))).where(F.col("__r") <= cap).select("row", "cand")
    sig = sk.signatures(sketch)
    both = cand.join(sig, "row").join(sig.select(F.col("row").alias("cand"), F.col("wins").alias("other")), "cand")
    return both.select("row", "cand", (1.0 - metrics.jaccard_distance(F.col("wins"), F.col("other"))).alias("jaccard"))


def close_pairs(sketch: DataFrame, rows: int, tau: float, k: int = 64, cap: int = 64) -> DataFrame:
    """(row, cand): the candidate_pairs whose Jaccard is tau or more, tau > 0.

    The rows of a window in the index are compared where they are, so only pairs within tau are ever written; the others are counted just
    for rows of which such a pair may lie beyond cap.
    """
    idx = materialize(sk.inverted_index(sketch, rows, k))
    held = idx.join(sk.signatures(sketch), "row")
    held = held.withColumn("bucket", F.pmod(F.xxhash64("win"), F.lit(-(-idx.count() // 8192) or 1)))

    def near(t: pd.DataFrame) -> pd.DataFrame:
        out = []
        by = t["win"].to_numpy().argsort(kind="stable")
        win, row, pos, wins = (t[c].to_numpy()[by] for c in ("win", "row", "pos", "wins"))
        for g in np.split(np.arange(len(t)), np.flatnonzero(np.diff(win)) + 1):
            i, j = overlaps(wins[g], tau)
            out.append(pd.DataFrame({"row": row[g[i]], "cand": row[g[j]], "win": win[g[i]], "cpos": pos[g[j]]}))
        return pd.concat(out)

    pairs = held.groupBy("bucket").applyInPandas(near, "row long, cand long, win long, cpos long")
    pairs = materialize(pairs.groupBy("row", "cand").agg(F.min(F.struct("win", "cpos")).alias("at")))
    # Candidates before a pair are as many as their places in the index at most.
    of = idx.join(pairs.select("row").distinct(), "row", "left_semi").select("row", "win").join(idx.groupBy("win").agg((F.count("*") - 1).alias("n")), "win")
    ahead = F.sum("n").over(Window.partitionBy("row").orderBy("win").rowsBetween(Window.unboundedPreceding, -1))
    ahead = of.select("row", "win", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    sure = F.col("ahead") + F.col("at.cpos") - 1 < cap
    sure |= (F.col("ahead") == 0) & (k <= cap + 1)  # in its first window a row has k - 1 others
    pairs = materialize(pairs.join(ahead, (pairs["row"] == ahead["row"]) & (F.col("at.win") == ahead["win"])).select(pairs["row"], "cand", sure.alias("sure")))
    open_rows = pairs.where("not sure").select("row").distinct()
    every = idx.join(open_rows, "row", "left_semi").select("row", "win").join(idx.select("win", F.col("row").alias("cand"), F.col("pos").alias("cpos")), "win")
    every = every.where("row <> cand").groupBy("row", "cand").agg(F.min(F.struct("win", "cpos")).alias("at"))
    within = every.withColumn("__r", F.row_number().over(Window.partitionBy("row").orderBy("at", "cand"))).where(F.col("__r") <= cap).select("row", "cand")
    return pairs.where("sure").select("row", "cand").unionByName(pairs.where("not sure").select("row", "cand").join(within, ["row", "cand"], "left_semi"))


def overlaps(wins: list, tau: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), i <> j: places of sets, as arrays, whose Jaccard is tau or more."""
    n, size = len(wins), np.array([len(w) for w in wins])
    x, many = np.unique(np.concatenate(list(wins)), return_inverse=True, return_counts=True)[1:]
    of, both = np.repeat(np.arange(n), size), np.zeros((n, n))
    code = np.where(many > 1, np.cumsum(many > 1) - 1, -1)[x]
    of, code = of[code >= 0], code[code >= 0]
    for lo in range(0, int(code.max(initial=-1)) + 1, 4096):
        here = (code >= lo) & (code < lo + 4096)
        a = np.zeros((n, int(min(4096, code.max() + 1 - lo))), np.float32)
        a[of[here], code[here] - lo] = 1
        both += a @ a.T
    alike = 1.0 - (1.0 - both / (size[:, None] + size - both)) >= tau
    np.fill_diagonal(alike, False)
    return np.nonzero(alike)


def similarity_clusters(sketch: DataFrame, rows: int, tau: float = 0.5, k: int = 64, cap: int = 64) -> DataFrame:
    """(row, comp, mass): components of candidate pairs with Jaccard >= tau; comp is the least row."""
    ship(sketch.sparkSession)
    pairs = close_pairs(sketch, rows, tau, k, cap) if tau > 0 else materialize(candidate_pairs(sketch, rows, k, cap).where(F.col("jaccard") >= tau))
    comp = components(pairs.select(F.col("row").alias("src"), F.col("cand").alias("dst")))
    deg = sk.window_degree(sketch).select("win", F.ln(F.lit(float(rows)) / (1 + F.col("deg"))).alias("idf"))
    mass = sketch.join(deg, "win").groupBy("row").agg(F.round(F.sum("idf"), 9).alias("mass"))
    out = mass.join(comp.withColumnRenamed("node", "row"), "row", "left")
    return out.select("row", F.coalesce("component", "row").alias("comp"), "mass")


def cluster_chain(sketch: DataFrame, rows: int, bs: int = 32, tau: float = 0.5, k: int = 64, cap: int = 64) -> DataFrame:
    """Clusters by their heaviest row, each chained greedily: the next row shares most window weight with the stripe being filled."""
    ship(sketch.sparkSession)
    sketch = settled(sketch)  # read again and again
    with scratch(sketch.sparkSession):
        cl = materialize(similarity_clusters(sketch, rows, tau, k, cap), keep=True)
    deg = sk.window_degree(sketch).select("win", F.ln(F.lit(float(rows)) / (1 + F.col("deg"))).alias("idf"))
    head = materialize(cl.groupBy("comp").agg(F.count("*").alias("n"), F.max("mass").alias("head")).where("n > 1").select("comp", "head"))
    several = materialize(cl.join(head, "comp"))  # a row by itself needs no chain
    sig = sketch.join(several.select("row"), "row", "left_semi").join(deg, "win").groupBy("row").agg(F.collect_list(F.struct("win", "idf")).alias("w"))

    def chain(t: pd.DataFrame) -> list[int]:
        t = t.sort_values(["mass", "row"], ascending=[False, True])
        heavy, wins = t["row"].tolist(), dict(zip(t["row"], ({x["win"]: x["idf"] for x in w} for w in t["w"])))
        rows_of: dict[int, list[int]] = {}
        for r, w in wins.items():
            for x in w:
                rows_of.setdefault(x, []).append(r)
        order, left, at = [], set(wins), 0
        while left:
            while heavy[at] not in left:
                at += 1
            nxt, stripe, share = heavy[at], set(), {}
            for _ in range(min(bs, len(left))):
                order.append(nxt)
                left.discard(nxt)
                share.pop(nxt, None)
                for x, idf in wins[nxt].items():
                    if x not in stripe:
                        stripe.add(x)
                        for r in rows_of[x]:
                            if r in left:
                                share[r] = share.get(r, 0.0) + idf
                nxt = max(share, key=lambda r: (share[r], -r)) if share else next((r for r in heavy[at:] if r in left), None)
        return order

    def chains(t: pd.DataFrame) -> pd.DataFrame:
        orders = [chain(g) for _, g in t.groupby("comp")]
        return pd.DataFrame({"row": [r for o in orders for r in o], "pos": [i for o in orders for i in range(len(o))]})

    bucket = F.pmod(F.xxhash64("comp"), F.lit(-(-several.count() // 4096) or 1))  # small clusters share a task
    chained = materialize(several.join(sig, "row").groupBy(bucket.alias("bucket")).applyInPandas(chains, "row long, pos long"))
    spine = sketch.sparkSession.range(rows).select(F.col("id").alias("row"))
    every = spine.join(cl, "row", "left").join(chained.join(several.select("row", "head"), "row"), "row", "left")
    every = every.select("row", "comp", F.coalesce("head", "mass").alias("mass"), F.coalesce("pos", F.lit(0)).alias("pos"))
    return order_by(every, [F.col("mass").desc_nulls_last(), F.asc("comp"), F.asc("pos"), F.asc("row")], rows=rows)


def anchor_order(sketch: DataFrame, rows: int, k: int = 8) -> DataFrame:
    """Rows by their k rarest windows, rarest first; empty rows last. This definition is ours."""
    top = F.slice(F.transform(F.sort_array(F.collect_list(F.struct("deg", "win"))), lambda x: x["win"]), 1, k)
    sig = sketch.join(sk.window_degree(sketch), "win").groupBy("row").agg(top.alias("sig"))
    spine = sketch.sparkSession.range(rows).select(F.col("id").alias("row"))
    return order_by(spine.join(sig, "row", "left"), [F.col("sig").asc_nulls_last(), F.asc("row")], rows=rows)


def stripe_cost(sketch: DataFrame, perm: DataFrame, bs: int) -> int:
    """Distinct (stripe of bs rows, window) under an order."""
    p = sketch.join(perm.withColumnRenamed("old_idx", "row"), "row")
    return p.select(F.expr(f"new_pos div {bs}").alias("s"), "win").distinct().count()


def stripe_costs(sketch: DataFrame, perm: DataFrame | None, scales: list[int]) -> int:
    """Sum of stripe_cost over scales, in one pass for powers of two up to 64: a stripe of 64 rows is a word a window. No order: rows as they are."""
    fit = [b for b in scales if b in (1, 2, 4, 8, 16, 32, 64)]
    p = sketch.withColumnRenamed("row", "at")
    if perm is not None:
        few = F.broadcast if perm.count() * 24 <= VERTICES else lambda df: df
        p = sketch.join(few(perm.select(F.col("old_idx").alias("row"), F.col("new_pos").alias("at"))), "row")
    words = p.groupBy(F.expr("at div 64"), "win").agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("x"))
    total = F.lit(0)
    for b in fit:
        x, held = F.col("x"), sum(1 << i for i in range(0, 64, b))
        for shift in (1, 2, 4, 8, 16, 32):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift)) if shift < b else x
        total = total + F.bit_count(x.bitwiseAND(F.lit(held - (1 << 64) if held >> 63 else held)))
    rest = sum(p.select(F.expr(f"at div {b}").alias("s"), "win").distinct().count() for b in scales if b not in fit)
    return (words.agg(F.sum(total)).first()[0] or 0) + rest


def stripe_refine(sketch: DataFrame, perm: DataFrame, bs: int, passes: int = 1, span: int = 3) -> DataFrame:
    """An order with rows moved between span neighbouring stripes of bs rows where that lowers stripe_cost; it never rises. This definition is ours.

    A pass fills the stripes of a group anew: each begins with the first row left and takes the row that adds fewest windows (ties: most shared,
    then the earlier). Groups begin one stripe later from pass to pass. A group is a task's row set, span * bs rows.
    """
    ship(sketch.sparkSession)
    sig = sk.signatures(sketch).withColumnRenamed("row", "old_idx")

    def fill(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("new_pos")
        rows, wins = t["old_idx"].to_numpy(), [np.zeros(0, np.int64) if w is None else w for w in t["wins"]]
        n, size = len(rows), np.array([len(w) for w in wins])
        code, many = np.unique(np.concatenate(wins), return_inverse=True, return_counts=True)[1:]
        cuts = np.unique(t["new_pos"].to_numpy() // bs, return_index=True)[1]
        stripes, of = np.diff(np.append(cuts, n)), np.repeat(np.arange(n), size)
        cost = len(np.unique(np.repeat(np.arange(len(stripes)), stripes)[of] * len(many) + code))
        own = np.split(code, np.cumsum(size)[:-1])
        shared = np.where(many > 1, np.cumsum(many > 1) - 1, -1)  # windows of one row count for that row only
        holds = np.zeros((int((many > 1).sum()), n), np.uint8)
        holds[shared[code][shared[code] >= 0], of[shared[code] >= 0]] = 1
        top = int(size.max()) + 1
        left, order, now, gone = np.ones(n, bool), [], 0, np.iinfo(np.int64).max
        for length in stripes.tolist():
            have, add = np.zeros(len(many), bool), size.copy()
            for k in range(length):
                pick = int(np.where(left, add * top + top - (size - add), gone).argmin()) if k else int(left.argmax())
                left[pick] = False
                order.append(pick)
                now += int(add[pick])
                new = own[pick][~have[own[pick]]]
                have[new] = True
                new = shared[new]
                add -= holds[new[new >= 0]].sum(axis=0, dtype=np.int64)
        if now >= cost:
            order = list(range(n))
        return pd.DataFrame({"new_pos": t["new_pos"].to_numpy(), "old_idx": rows[order]})

    for k in range(passes):
        body = perm.join(sig, "old_idx", "left").withColumn("group", F.expr(f"(new_pos + {(span - k % span) % span * bs}) div {span * bs}"))
        perm = materialize(body.groupBy("group").applyInPandas(fill, "new_pos long, old_idx long"))
    return perm


def similarity_rounds(m: SparseMatrix, w: int = 4, bs: int | None = None, tau: float = 0.5, k: int = 64, iters: int = 2, both_sides: bool = True, refine_passes: int = 0) -> tuple[DataFrame, DataFrame]:
    """Per round the cheaper of cluster chain and anchor order for rows, then columns, by stripe cost, refined by some passes; never worse than identity."""
    spark = m.coo.sparkSession
    bs = bs or w
    scales = lambda n: [s for s in (4, 16, 64, bs) if 0 < s <= n]
    m = m.with_coo(materialize(m.coo))
    rows, cols, cur = identity(spark, m.rows), identity(spark, m.cols), m
    for _ in range(iters):
        better = False
        for side in ("row", "col") if both_sides else ("row",):
            at = cur if side == "row" else cur.transpose()
            s = materialize(sk.mask(at, w))
            cost = lambda p, s=s, at=at: stripe_costs(s, p, scales(at.rows))
            options = [stripe_refine(s, materialize(o), bs, refine_passes) for o in (cluster_chain(s, at.rows, bs, tau, k), anchor_order(s, at.rows))]
            price = [cost(None), *map(cost, options)]
            if min(price) == price[0]:
                continue
            better, p = True, options[price.index(min(price)) - 1]
            cur = cur.permute_rows(p) if side == "row" else cur.permute_cols(p)
            cur = cur.with_coo(materialize(cur.coo))
            if side == "row":
                rows = materialize(compose(p, rows))
            else:
                cols = materialize(compose(p, cols))
        if not better:
            break
    return rows, cols
