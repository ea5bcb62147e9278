"""Window sketches of rows: which runs of W columns a row touches, and what follows from that."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits
from ..plans.storage import materialize
from .matrix import SparseMatrix, dense_index


def _check(w: int) -> None:
    if w <= 0:
        raise ValueError("window width must be positive")


def mask(m: SparseMatrix, w: int) -> DataFrame:
    """(row, win): windows of w columns that each row touches."""
    _check(w)
    return m.coo.select("row", F.expr(f"col div {int(w)}").alias("win")).distinct()


def mask_bsr(bsr: DataFrame, b: int, w: int, rows: int) -> DataFrame:
    """mask() of the entries that blocks hold."""
    _check(w)
    e = bsr.select("brow", "bcol", F.posexplode("vals").alias("k", "v")).where("v <> 0")
    return e.select((F.col("brow") * b + F.expr(f"k div {b}")).alias("row"), F.expr(f"(bcol * {b} + k % {b}) div {w}").alias("win")).where(F.col("row") < rows).distinct()


def multilevel(m: SparseMatrix, widths=(16, 8, 4, 1)) -> DataFrame:
    """Sketches at several widths side by side: the windows of each width come after those of the widths before."""
    if not widths:
        raise ValueError("no window widths")
    levels, offset = [], 0
    for w in widths:
        _check(w)
        levels.append(F.struct(F.lit(int(w)).cast("long").alias("w"), F.lit(offset).cast("long").alias("o")))
        offset += math.ceil(m.cols / w)
    e = m.coo.select("row", "col", F.explode(F.array(*levels)).alias("l"))
    return e.select("row", (F.expr("col div l.w") + F.col("l.o")).alias("win")).distinct()


def window_degree(sketch: DataFrame) -> DataFrame:
    return sketch.groupBy("win").agg(F.count("*").alias("deg"))


def column_rank(sketch: DataFrame) -> DataFrame:
    """(win, deg, rank): most popular window first, ties by window."""
    return dense_index(window_degree(sketch), [F.desc("deg"), F.asc("win")], "rank")


def hub_cutoff(rows: int, hub_frac: float = 0.05) -> int:
    return max(64, math.ceil(hub_frac * rows))


def hubs(sketch: DataFrame, rows: int, hub_frac: float = 0.05) -> DataFrame:
    """(win, deg): windows that more rows touch than the cut-off."""
    return window_degree(sketch).where(F.col("deg") > hub_cutoff(rows, hub_frac))


def row_sketches(sketch: DataFrame, rows: int, hub_frac: float = 0.05) -> DataFrame:
    """(row_id, h1, h2, rare_win, row_len): two MinHashes over non-hub windows and the rarest shared one.

    h1 and h2 have the top bit flipped, so that their signed order is the unsigned one. Rows of hubs only take all their
    windows. The hash is computed once a window, then joined.
    """
    cut = hub_cutoff(rows, hub_frac)
    d = window_degree(sketch)
    d = bits.splitmix64(d, "win", "h1", bits.SEED_1)
    d = bits.splitmix64(d, "win", "h2", bits.SEED_2)
    d = d.withColumns({"h1": bits.flipped(F.col("h1")), "h2": bits.flipped(F.col("h2")), "hub": F.col("deg") > cut})
    rare = F.when(F.col("hub"), F.col("deg")).otherwise(F.when(F.col("deg") >= 2, F.col("deg")).otherwise(F.lit(rows + 1).cast("long")))
    d = d.withColumn("pick", F.struct(rare.alias("deg"), F.col("win").alias("win")))
    plain = lambda c: F.min(F.when(~F.col("hub"), F.col(c)))
    g = sketch.join(d, "win").groupBy("row").agg(
        *[F.coalesce(plain(c), F.min(c)).alias(c) for c in ("h1", "h2", "pick")], F.count("*").alias("row_len")
    )
    return g.select(F.col("row").alias("row_id"), "h1", "h2", F.col("pick.win").alias("rare_win"), "row_len")


def micro_clusters(rs: DataFrame, w_block: int = 32, stretch: int = 1 << 20) -> DataFrame:
    """(row, micro_id, pos_in_micro): runs of sketch-sorted rows with the same h1 or rarest window as the row before.

    Runs end after w_block rows and where the top byte of h1 changes. The order is cut in stretches of equal length, so no run of
    equal hashes is one task; where a run began and how many began before is carried over the cuts, by a row a stretch.
    """
    order = ["h1", "h2", "rare_win", "row_len", "row_id"]
    w_block = max(1, int(w_block))
    top = lambda c: F.shiftrightunsigned(c, 56)
    t = dense_index(rs, [F.asc(c) for c in order], "__i").withColumn("__s", F.expr(f"__i div {stretch}"))
    by = Window.partitionBy("__s").orderBy("__i")
    ends = t.groupBy((F.col("__s") + 1).alias("__s")).agg(F.max_by(F.struct("h1", "rare_win"), "__i").alias("__end"))
    t = t.join(F.broadcast(ends), "__s", "left")  # a row a stretch
    before = F.coalesce(F.lag(F.struct("h1", "rare_win")).over(by), "__end")
    goes_on = (top(before["h1"]) == top("h1")) & ((before["h1"] == F.col("h1")) | (before["rare_win"] == F.col("rare_win")))
    t = t.withColumn("__cut", F.when(~F.coalesce(goes_on, F.lit(False)), F.col("__i")))
    t = materialize(t.select(F.col("row_id").alias("row"), "__i", "__s", F.max("__cut").over(by).alias("__from")))
    earlier = Window.orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    carried = t.groupBy("__s").agg(F.max("__from").alias("__last")).select("__s", F.max("__last").over(earlier).alias("__carried"))
    t = t.join(F.broadcast(carried), "__s")  # a row a stretch
    t = t.withColumn("pos_in_micro", F.pmod(F.col("__i") - F.coalesce("__from", "__carried"), F.lit(w_block)).cast("long")).withColumn("__head", (F.col("pos_in_micro") == 0).cast("long"))
    heads = t.groupBy("__s").agg(F.sum("__head").alias("__n")).select("__s", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__ahead"))
    t = t.join(F.broadcast(heads), "__s")  # a row a stretch
    return t.select("row", (F.col("__ahead") + F.sum("__head").over(by) - 1).cast("long").alias("micro_id"), "pos_in_micro")


def macro_incidence(sketch: DataFrame, micro: DataFrame, rows: int, hub_frac: float = 0.05) -> DataFrame:
    """(micro_id, win): non-hub windows of each micro-cluster's rows, all windows where there are hubs only."""
    hub = hubs(sketch, rows, hub_frac).select("win", F.lit(True).alias("hub"))
    pins = sketch.join(micro.select("row", "micro_id"), "row").select("micro_id", "win").distinct().join(hub, "win", "left")
    only = pins.groupBy("micro_id").agg(F.min(F.coalesce("hub", F.lit(False))).alias("only"))
    return pins.join(only, "micro_id").where(F.col("hub").isNull() | F.col("only")).select("micro_id", "win")


def inverted_index(sketch: DataFrame, rows: int, k: int = 64) -> DataFrame:
    """(win, row, pos): of each window the k rows with most mass, mass being the sum of ln(rows / (1 + deg)) over a row's windows.

    This definition is ours. The window function keeps k rows a window before the sort ends (WindowGroupLimit).
    """
    idf = window_degree(sketch).select("win", F.ln(F.lit(float(rows)) / (1 + F.col("deg"))).alias("idf"))
    e = sketch.join(idf, "win")
    mass = e.groupBy("row").agg(F.round(F.sum("idf"), 9).alias("mass"))
    top = F.row_number().over(Window.partitionBy("win").orderBy(F.desc("mass"), F.asc("row")))
    return sketch.join(mass, "row").withColumn("pos", top.cast("long")).where(F.col("pos") <= k).select("win", "row", "pos")


def signatures(sketch: DataFrame, value: str = "win") -> DataFrame:
    """(row, wins): sorted windows of each row that has any."""
    return sketch.groupBy("row").agg(F.sort_array(F.collect_set(value)).alias("wins"))
