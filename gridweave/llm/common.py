"""What the operators of this subpackage share: paths, sizes, materialised tables, let-bindings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ship import ship
from ..plans.storage import UNKNOWN, materialize, plan_bytes, shared_dir

__all__ = ["SPACE", "WORD", "broadcast_if_small", "buckets_for", "let", "materialize", "plan_bytes", "shared_dir", "table", "whole_text"]

#: Separators are space and \\t \\n \\v \\f \\r only; a word is a maximal run of anything else.
WORD = "[^\\x20\\x09-\\x0D]+"
SPACE = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def buckets_for(df: DataFrame, text: str = "text", mb_each: float = 4.0, least: int = 64) -> int:
    """A bucket count that follows the input: about mb_each MB of stored input a bucket.

    Sources without file statistics are measured by the bytes of their texts, at half for compression.
    """
    size = plan_bytes(df)
    if size >= UNKNOWN:
        size = (df.agg(F.sum(F.octet_length(text))).first()[0] or 0) // 2
    return max(least, math.ceil(size / (mb_each * 1e6)))


def let(value: Column, body) -> Column:
    """Bind value once for body(variable): higher-order bodies would evaluate it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int, limit: int = 8 << 20) -> DataFrame:
    """Hint a broadcast only when the counted rows fit the limit; else the join shuffles (AQE splits skew)."""
    return F.broadcast(df) if rows * row_bytes <= limit else df
