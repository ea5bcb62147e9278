"""Exact comparison of all rows of a sketch that share a window, by pairs of row ranges."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ship import ship
from ..plans.storage import materialize, settled
from . import sketch as sk

#: (row, window) entries of a range of rows: 8 MB as numbers.
ENTRIES = 1 << 20


def by_ranges(sketch: DataFrame, kernel, schema: str, entries: int = ENTRIES) -> DataFrame:
    """What kernel(a, b) makes of ranges of rows, for each pair that has a window in common; columns by schema.

    a and b are tables (row, wins); a range by itself comes once, as kernel(a, None), two ranges once. A range has about so many entries as given,
    and goes to a task with each range that it shares a window with, so no pairs of rows are ever shuffled but what the kernel keeps.
    """
    ship(sketch.sparkSession)
    sketch = settled(sketch)
    cuts = sketch.agg(F.count("*").alias("n"), F.max("row").alias("top")).first()
    span = max(1, -(-((cuts["top"] or 0) + 1) // max(1, -(-cuts["n"] // entries))))
    part = F.expr(f"row div {span}")
    held = sketch.select(part.alias("p"), "win").distinct()
    pairs = held.join(held.withColumnRenamed("p", "q"), "win").where("p <= q").select("p", "q").distinct()
    pairs = materialize(pairs)  # at most the ranges squared
    ends = pairs.select("p", "q", F.lit(0).alias("side"), F.col("p").alias("own")).union(pairs.where("p < q").select("p", "q", F.lit(1), "q"))
    dealt = sk.signatures(sketch).withColumn("own", part).join(F.broadcast(ends), "own").select("p", "q", "side", "row", "wins")

    def run(t: pd.DataFrame) -> pd.DataFrame:
        a, b = t[t["side"] == 0], t[t["side"] == 1]
        return kernel(a, b if len(b) else None)

    return dealt.groupBy("p", "q").applyInPandas(run, schema)


class Rows:
    """The rows of a range as arrays: ids, sizes, and their windows end to end."""

    def __init__(self, t: pd.DataFrame):
        self.row, self.size = t["row"].to_numpy(), t["wins"].map(len).to_numpy()
        self.win = np.concatenate(t["wins"].tolist())
        self.at = np.concatenate([[0], np.cumsum(self.size)])


def shared(a: Rows, b: Rows):
    """For each row of a in turn: (k, j, n), its place, the places in b of the rows that share windows with it, ascending, and how many."""
    wins = np.unique(b.win)
    code = np.searchsorted(wins, b.win)
    holder = np.repeat(np.arange(len(b.row)), b.size)[np.argsort(code, kind="stable")].astype(np.int32)
    deg = np.bincount(code, minlength=len(wins))
    start = np.cumsum(deg) - deg
    spot = np.minimum(np.searchsorted(wins, a.win), len(wins) - 1)
    known = wins[spot] == a.win
    for k in range(len(a.row)):
        s = slice(a.at[k], a.at[k + 1])
        own = spot[s][known[s]]
        if not len(own):
            continue
        both = np.bincount(np.concatenate([holder[start[w] : start[w] + deg[w]] for w in own.tolist()]), minlength=len(b.row))
        j = np.flatnonzero(both)
        yield k, j, both[j]


def within(sketch: DataFrame, tau: float) -> DataFrame:
    """(a, b, d): all pairs, both ways, of different rows that share a window, at Jaccard distance d <= tau."""

    def close(a: Rows, b: Rows) -> list[pd.DataFrame]:
        out = []
        for k, j, n in shared(a, b):
            d = 1.0 - n / (a.size[k] + b.size[j] - n)
            few = (d <= tau) & (b.row[j] != a.row[k])
            if few.any():
                out.append(pd.DataFrame({"a": a.row[k], "b": b.row[j[few]], "d": d[few]}))
        return out

    def kernel(a: pd.DataFrame, b: pd.DataFrame | None) -> pd.DataFrame:
        x = Rows(a)
        out = close(x, x if b is None else Rows(b))
        if b is not None:
            out += [t.rename(columns={"a": "b", "b": "a"})[["a", "b", "d"]] for t in out]
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "d": []})

    return by_ranges(sketch, kernel, "a long, b long, d double")


def nearest(sketch: DataFrame, k: int) -> DataFrame:
    """(a, b, jaccard): of each row and range the k most alike rows by Jaccard, ties by the least; those of all ranges are among them."""

    def top(a: Rows, b: Rows) -> list[pd.DataFrame]:
        out = []
        for i, j, n in shared(a, b):
            other = b.row[j] != a.row[i]
            j, n = j[other], n[other]
            x = n / (a.size[i] + b.size[j] - n)
            if len(x) > k:
                keep = x >= np.partition(x, len(x) - k)[len(x) - k]
                j, x = j[keep], x[keep]
            by = np.lexsort((b.row[j], -x))[:k]
            out.append((np.full(len(by), a.row[i]), b.row[j[by]], x[by]))
        return out

    def kernel(a: pd.DataFrame, b: pd.DataFrame | None) -> pd.DataFrame:
        x = Rows(a)
        if b is None:
            out = top(x, x)
        else:
            y = Rows(b)
            out = top(x, y) + top(y, x)
        return pd.DataFrame({c: np.concatenate([o[i] for o in out]) if out else [] for i, c in enumerate(("a", "b", "jaccard"))})

    return by_ranges(sketch, kernel, "a long, b long, jaccard double")
