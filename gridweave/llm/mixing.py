"""Mixing sources to target weights: capped water-filling and seeded repetition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, broadcast_if_small, materialize, whole_text

#: Documents that a sampling cell takes on average; it holds as many more as the rate asks for, up to a factor.
CELL, FACTOR = 128, 128


def water_fill(sources: DataFrame, max_epochs: float) -> DataFrame:
    """sources (size long, weight double, ...) plus target double: shares by weight of all sizes, capped at max_epochs * size.

    Clamping sources over their cap and resharing the excess until none is above ends at one level
    L with target = min(cap, L * weight). In the order of cap / weight the clamped sources come first, so
    prefix sums give L without a loop. One row a source; the table is the aggregate, never the documents.
    """
    order = Window.orderBy(F.col("__ratio"), F.col("__tie")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    staged = (
        sources.withColumn("__cap", F.lit(float(max_epochs)) * F.col("size"))
        .withColumn("__ratio", F.col("__cap") / F.col("weight"))
        .withColumn("__tie", F.col("rank"))
        .withColumn("__all", F.sum(F.col("size").cast("double")).over(every))
        .withColumn("__weights", F.sum("weight").over(every))
        .withColumn("__capped", F.coalesce(F.sum("__cap").over(order), F.lit(0.0)))
        .withColumn("__used", F.coalesce(F.sum("weight").over(order), F.lit(0.0)))
        .withColumn("__level", (F.col("__all") - F.col("__capped")) / (F.col("__weights") - F.col("__used")))
        .withColumn("__open", F.min(F.when(F.col("__ratio") >= F.col("__level"), F.struct("__ratio", "__tie", "__level"))).over(every))
    )
    level = F.col("__open")["__level"]
    return staged.withColumn("target", F.least(F.col("__cap"), F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))).drop(
        "__cap", "__ratio", "__tie", "__all", "__weights", "__capped", "__used", "__level", "__open"
    )


def mix(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_epochs: float = 3.0, seed: int = 17, passes: int = 6) -> DataFrame:
    """docs plus times: how often the mix takes the row (a column of that name in docs is replaced).

    Sources ranked by code point (null last) weigh weights[0], weights[1], ..., repeating. A row is
    taken floor(target / source_size) times; the fraction left is sampled by seeded hash order: each
    source is split by hash into cells whose share is about 128 rows (so of 128 / fraction rows, 16384 at most), and a cell takes rows in hash order
    while they fit its share; further passes fill what is left with later rows that fit. So a hot source is many
    cells, no order spans a source, each cell comes within its smallest rows of its share, and rows of up to some dozen mean
    sizes have their chance at low rates, too. max_epochs must be whole.
    Null or empty texts have size 0; ties fall to the id; repeated rows are rows of their own.
    An empty table gives no rows. Columns named __* are the operator's own; all others are carried as they are.
    """
    size = F.size(F.regexp_extract_all(whole_text(), F.lit(WORD), F.lit(0))).cast("long").alias("size")
    names = [c for c in docs.columns if c != "times"]
    boxed = docs.select("doc_id", "source", size, F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"))
    return _mixed(boxed, boxed, weights, max_epochs, seed, passes).select("__row.*", "times")


def mix_sizes(docs: DataFrame, **options) -> DataFrame:
    """mix() over (doc_id, source) alone: texts are read once, for their sizes, and not shuffled."""
    sized = docs.select("doc_id", "source", F.size(F.regexp_extract_all(whole_text(), F.lit(WORD), F.lit(0))).cast("long").alias("size"))
    sized = materialize(sized)
    opts = {"weights": (1.0, 2.0, 3.0), "max_epochs": 3.0, "seed": 17, "passes": 6} | options
    return _mixed(sized, sized, **opts)


def source_targets(sized: DataFrame, weights, max_epochs: float) -> DataFrame:
    """One row a source: source, source_size, n, rank, weight, target."""
    per = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    rank = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).cast("int")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.col("rank"), F.lit(len(weights))) + 1)
    return water_fill(per.withColumn("rank", rank).withColumn("weight", w), max_epochs).withColumnRenamed("size", "source_size")


def _mixed(sized: DataFrame, counted: DataFrame, weights, max_epochs: float, seed: int, passes: int) -> DataFrame:
    targets = materialize(source_targets(counted.select("source", "size"), weights, max_epochs)).withColumnRenamed("source", "__source")
    targets = broadcast_if_small(targets, targets.count(), 128)
    df = sized.join(targets, F.col("source").eqNullSafe(F.col("__source")), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    df = (
        df.withColumn("__rate", rate)
        .withColumn("__whole", F.floor("__rate").cast("long"))
        .withColumn("__cell", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.greatest(F.lit(1), F.ceil(F.col("n") * F.greatest(F.col("__rate") - F.col("__whole"), F.lit(1 / FACTOR)) / CELL))))
        .withColumn("__at", F.xxhash64("doc_id", F.lit(seed)))
    )
    cell = Window.partitionBy("source", "__cell")
    upto = cell.orderBy("__at", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__gap", (F.col("__rate") - F.col("__whole")) * F.sum("size").over(cell)).withColumn("__took", F.lit(False))
    for _ in range(passes):
        fits = ~F.col("__took") & (F.col("__rate") > F.col("__whole")) & (F.col("size") <= F.col("__gap"))
        df = df.withColumn("__run", F.sum(F.when(fits, F.col("size")).otherwise(0)).over(upto))
        df = df.withColumn("__new", fits & (F.col("__run") <= F.col("__gap")))
        df = df.withColumn("__gap", F.col("__gap") - F.sum(F.when(F.col("__new"), F.col("size")).otherwise(0)).over(cell)).withColumn("__took", F.col("__took") | F.col("__new"))
    # Nothing more fits: the smallest row left goes in if that brings the cell nearer to its share.
    left = cell.orderBy(F.col("__took").cast("int") + (F.col("size") == 0).cast("int"), "size", "__at", "doc_id")
    df = df.withColumn("__took", F.col("__took") | ((F.row_number().over(left) == 1) & (F.col("__rate") > F.col("__whole")) & (F.col("size") < 2 * F.col("__gap"))))
    times = (F.col("__whole") + F.col("__took").cast("long")).alias("times")
    keep = [c for c in sized.columns if c != "size"]
    return df.select(*keep, "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), times)


def op3(docs: DataFrame) -> DataFrame:
    return mix_sizes(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))
