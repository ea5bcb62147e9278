"""Sparse matrices as (row, col, val) tables with their dimensions, and permutations as (new_pos, old_idx) tables."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.storage import materialize, plan_bytes

#: Above this estimate a global order is dealt over range partitions instead of one task.
ONE_TASK = 64 << 20
ONE_TASK_ROWS = 4 << 20


class Axis(Enum):
    """How a permutation applies: rows, both sides alike, or rows and columns apart."""

    ROW = "ROW"
    SYMMETRIC = "SYMMETRIC"
    ASYMMETRIC = "ASYMMETRIC"


@dataclass(frozen=True)
class SparseMatrix:
    """coo: (row, col, val), 0-based, no repeated entry; val NULL means 1. rows and cols count empty ones too.

    mirrored: the pattern is known to have each entry's mirror; row_degrees and col_degrees: (idx, d) where they have been counted; with_coo forgets them.
    """

    coo: DataFrame
    rows: int
    cols: int
    mirrored: bool = False
    row_degrees: DataFrame | None = None
    col_degrees: DataFrame | None = None

    @property
    def spine(self) -> DataFrame:
        return self.coo.sparkSession.range(self.rows).select(F.col("id").alias("row"))

    @property
    def col_spine(self) -> DataFrame:
        return self.coo.sparkSession.range(self.cols).select(F.col("id").alias("col"))

    def with_coo(self, coo: DataFrame, rows: int | None = None, cols: int | None = None) -> SparseMatrix:
        return SparseMatrix(coo, self.rows if rows is None else rows, self.cols if cols is None else cols)

    @staticmethod
    def build(entries: DataFrame, rows: int, cols: int, symmetry: str = "general") -> SparseMatrix:
        """From raw entries: out-of-range ones go, off-diagonal ones are mirrored by symmetry, repeated ones are summed."""
        e = entries.select(F.col("row").cast("long"), F.col("col").cast("long"), F.col("val").cast("double"))
        e = e.where((F.col("row") >= 0) & (F.col("row") < rows) & (F.col("col") >= 0) & (F.col("col") < cols))
        if symmetry in ("symmetric", "hermitian", "skew-symmetric"):
            sign = F.lit(-1.0 if symmetry == "skew-symmetric" else 1.0)
            val = F.when(F.col("val").isNull() & (sign > 0), F.lit(None)).otherwise(sign * F.coalesce("val", F.lit(1.0)))
            e = e.unionByName(e.where("row <> col").select(F.col("col").alias("row"), F.col("row").alias("col"), val.alias("val")))
        return SparseMatrix(merge_repeats(e), rows, cols)

    # -- counts

    def nnz(self) -> int:
        return self.coo.count()

    def row_counts(self) -> DataFrame:
        return self.spine.join(self.coo.groupBy("row").agg(F.count("*").alias("cnt")), "row", "left").na.fill(0, ["cnt"])

    def row_ptr(self) -> DataFrame:
        """(row, nzcount, row_ptr): entries of each row and of all rows before it, empty rows included."""
        return running_sum(self.row_counts(), ["row"], "cnt", "row_ptr", self.rows).select("row", F.col("cnt").alias("nzcount"), "row_ptr")

    # -- entry filters

    def binarise(self) -> SparseMatrix:
        return self.with_coo(self.coo.withColumn("val", F.lit(1.0)))

    def drop_zeros(self) -> SparseMatrix:
        return self.with_coo(self.coo.where(F.coalesce("val", F.lit(1.0)) != 0))

    # -- shape and order

    def transpose(self) -> SparseMatrix:
        return SparseMatrix(self.coo.select(F.col("col").alias("row"), F.col("row").alias("col"), "val"), self.cols, self.rows)

    def permute_rows(self, perm: DataFrame) -> SparseMatrix:
        p = perm.select(F.col("old_idx").alias("row"), F.col("new_pos").alias("__new"))
        return self.with_coo(self.coo.join(p, "row").select(F.col("__new").alias("row"), "col", "val"))

    def permute_cols(self, perm: DataFrame) -> SparseMatrix:
        p = perm.select(F.col("old_idx").alias("col"), F.col("new_pos").alias("__new"))
        return self.with_coo(self.coo.join(p, "col").select("row", F.col("__new").alias("col"), "val"))

    def apply(self, axis: Axis, perm: DataFrame, col_perm: DataFrame | None = None) -> SparseMatrix:
        """Apply a permutation after checking its length; ASYMMETRIC with one permutation moves rows only."""
        check_permutation(perm, self.rows, "row")
        if axis is Axis.ROW:
            return self.permute_rows(perm)
        if axis is Axis.SYMMETRIC:
            if self.rows != self.cols:
                raise ValueError(f"SYMMETRIC needs a square matrix, not {self.rows} x {self.cols}")
            return self.permute_rows(perm).permute_cols(perm)
        if col_perm is not None:
            check_permutation(col_perm, self.cols, "column")
            return self.permute_rows(perm).permute_cols(col_perm)
        return self.permute_rows(perm)

    # -- blocks

    def to_bsr(self, b: int) -> DataFrame:
        """(brow, bcol, vals): occupied b x b blocks, row-major with zero padding at the edges; absent values are 1."""
        if b <= 0:
            raise ValueError("block size must be positive")
        at = (F.pmod("row", F.lit(b)) * b + F.pmod("col", F.lit(b))).cast("int")
        blocks = self.coo.groupBy(F.expr(f"row div {b}").alias("brow"), F.expr(f"col div {b}").alias("bcol")).agg(
            F.map_from_entries(F.collect_list(F.struct(at.alias("k"), F.coalesce("val", F.lit(1.0)).alias("v")))).alias("m")
        )
        return blocks.select("brow", "bcol", F.transform(F.sequence(F.lit(0), F.lit(b * b - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("vals"))


def merge_repeats(entries: DataFrame) -> DataFrame:
    """Sum of repeated entries; an entry that only ever lacked a value stays without one when single."""
    g = entries.groupBy("row", "col").agg(F.count("*").alias("n"), F.sum(F.coalesce("val", F.lit(1.0))).alias("s"), F.max(F.col("val")).alias("any"))
    return g.select("row", "col", F.when((F.col("n") == 1) & F.col("any").isNull(), F.lit(None).cast("double")).otherwise(F.col("s")).alias("val"))


def from_bsr(bsr: DataFrame, b: int, rows: int, cols: int) -> SparseMatrix:
    """Entries of blocks; padding and stored zeros go."""
    e = bsr.select("brow", "bcol", F.posexplode("vals").alias("k", "val")).where("val <> 0")
    return SparseMatrix(e.select((F.col("brow") * b + F.expr(f"k div {b}")).alias("row"), (F.col("bcol") * b + F.pmod("k", F.lit(b))).alias("col"), "val"), rows, cols)


def permute_bsr(bsr: DataFrame, perm: DataFrame) -> DataFrame:
    """Block rows moved by a permutation of block rows."""
    return bsr.join(perm.withColumnRenamed("old_idx", "brow"), "brow").select(F.col("new_pos").alias("brow"), "bcol", "vals")


# ---- permutations


def check_permutation(perm: DataFrame, n: int, what: str = "row") -> None:
    """Raise unless perm is a bijection on 0 .. n - 1; one aggregate."""
    r = perm.agg(F.count("*").alias("c"), F.countDistinct("old_idx").alias("o"), F.countDistinct("new_pos").alias("p"), F.min(F.least("old_idx", "new_pos")).alias("lo"), F.max(F.greatest("old_idx", "new_pos")).alias("hi")).first()
    if r["c"] != n:
        raise ValueError(f"{what} permutation has {r['c']} entries, the matrix has {n} {what}s")
    if n and (r["o"] != n or r["p"] != n or r["lo"] != 0 or r["hi"] != n - 1):
        raise ValueError(f"{what} permutation is not a bijection on 0 .. {n - 1}")


def inverse(perm: DataFrame) -> DataFrame:
    return perm.select(F.col("old_idx").alias("new_pos"), F.col("new_pos").alias("old_idx"))


def compose(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """First inner, then outer: out[i] = inner[outer[i]]."""
    mid = inner.select(F.col("new_pos").alias("__mid"), F.col("old_idx").alias("__old"))
    return outer.join(mid, F.col("old_idx") == F.col("__mid")).select("new_pos", F.col("__old").alias("old_idx"))


def identity(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("new_pos"), F.col("id").alias("old_idx"))


# ---- global order without one task


def fits_one_task(df: DataFrame, rows: int | None = None) -> bool:
    """Whether df is small enough to be ordered by one window: by its number of rows where it is known; else what it reads is
    small and, as joins and generators can multiply that, so is the number of rows it comes to."""
    if rows is not None:
        return rows <= ONE_TASK_ROWS
    if plan_bytes(df) > ONE_TASK:
        return False
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return not any(x in plan for x in ("Join ", "Generate ", "MapIn", "FlatMap")) or df.count() <= ONE_TASK_ROWS


def dense_index(df: DataFrame, order: list, name: str, rows: int | None = None) -> DataFrame:
    """df with name: the 0-based place of each row in a total order.

    Small inputs take one window. Larger ones are dealt by range, numbered in each partition and shifted by
    the rows of the partitions before; only one count a partition is gathered. rows: how many df has, where that is known.
    """
    if fits_one_task(df, rows):
        return df.withColumn(name, (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
    dealt = df.repartitionByRange(*order).withColumn("__dealt", F.spark_partition_id())
    dealt = materialize(dealt.withColumn("__spot", (F.row_number().over(Window.partitionBy("__dealt").orderBy(*order)) - 1).cast("long")))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__dealt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = dealt.groupBy("__dealt").agg(F.count("*").alias("__n")).select("__dealt", before.alias("__ahead"))
    return dealt.join(F.broadcast(shift), "__dealt").withColumn(name, F.col("__spot") + F.col("__ahead")).drop("__dealt", "__spot", "__ahead")  # a row a partition


def running_sum(df: DataFrame, order: list, value: str, name: str, rows: int | None = None) -> DataFrame:
    """df with name: the sum of value over the rows before, in a total order; dealt as in dense_index."""
    rows_before = lambda *by: (Window.partitionBy(*by) if by else Window).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    if fits_one_task(df, rows):
        return df.withColumn(name, F.coalesce(F.sum(value).over(rows_before()), F.lit(0)))
    dealt = df.repartitionByRange(*order).withColumn("__dealt", F.spark_partition_id())
    dealt = materialize(dealt.withColumn("__spot", F.coalesce(F.sum(value).over(rows_before("__dealt")), F.lit(0))))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__dealt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = dealt.groupBy("__dealt").agg(F.sum(value).alias("__n")).select("__dealt", before.alias("__ahead"))
    return dealt.join(F.broadcast(shift), "__dealt").withColumn(name, F.col("__spot") + F.col("__ahead")).drop("__dealt", "__spot", "__ahead")


def order_by(df: DataFrame, order: list, row: str = "row", rows: int | None = None) -> DataFrame:
    """Permutation (new_pos, old_idx) that lists rows in the order; row should be its last key. rows: their number, where known."""
    return dense_index(df, order, "new_pos", rows).select("new_pos", F.col(row).alias("old_idx"))


def absent_as_one(c: str = "val") -> Column:
    return F.coalesce(F.col(c), F.lit(1.0))
