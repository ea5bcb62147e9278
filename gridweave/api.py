"""Entry points from a matrix file to a permutation."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession

from .operators import ordering
from .operators.matrix import SparseMatrix
from .sources.mtx import read_mtx

log = logging.getLogger("gridweave")


def _matrix(spark: SparkSession, source: str | SparseMatrix) -> SparseMatrix:
    """A matrix given or read from a path; FileNotFoundError when there is none, ValueError when it has no rows or no size line."""
    if isinstance(source, SparseMatrix):
        return source
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        raise FileNotFoundError(source)
    return read_mtx(spark, source)


def two_sided(spark: SparkSession, matrix: str | SparseMatrix, W: int = 4, max_iters: int = 4) -> tuple[DataFrame, DataFrame]:
    """Row and column permutations that alternate while fewer 32 x 32 blocks are occupied."""
    rows, cols, counts = ordering.two_sided(_matrix(spark, matrix), W, max_iters)
    log.info("occupied blocks by round: %s", counts)
    return rows, cols


def multilevel(spark: SparkSession, matrix: str | SparseMatrix, Ws=(16, 8, 4, 1)) -> DataFrame:
    return ordering.multilevel(_matrix(spark, matrix), Ws)


def hybrid(spark: SparkSession, matrix: str | SparseMatrix, W: int = 32, W_block: int = 32, lookahead_C: int = 64, hub_frac: float = 0.05) -> DataFrame:
    return ordering.hybrid(_matrix(spark, matrix), W, W_block, lookahead_C, hub_frac)
