"""Written intermediate tables in the cluster's shared folder, and the plan's own size estimate."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from .ship import ship


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a temporary one in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="gridweave-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def materialize(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write df once as Parquet under the shared folder and read it back: lineage ends there.

    A lost executor costs nothing, as the files outlive it; the files go when the JVM ends, with the scratch() around unless they
    are kept, or by release(). Shuffle files behind a table that took LONG seconds go at once, not when the driver's heap happens to fill.
    """
    spark = df.sparkSession
    ship(spark)
    path, began = f"{shared_dir(spark)}/gridweave-{uuid.uuid4().hex}", time.perf_counter()
    df.write.parquet(path)
    if time.perf_counter() - began > LONG:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    if keep:
        _WRITTEN[id(out)] = path
        weakref.finalize(out, _WRITTEN.pop, id(out), None)
    elif _OPEN:
        _OPEN[-1].append(path)
    return out


def settled(df: DataFrame) -> DataFrame:
    """df, written first if it takes more than a filter and columns of a stored table to read again."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return df if all(x.lstrip(":+- ").startswith(("Project ", "Filter ", "Relation ")) for x in plan.strip().split("\n")) else materialize(df)


#: Paths written within each open scratch(), and of tables kept, by DataFrame.
_OPEN: list[list[str]] = []
_WRITTEN: dict[int, str] = {}


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that materialize() writes within are deleted at the end, unless they are kept: what is read afterwards must be."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(df: DataFrame) -> None:
    """Delete the table behind a DataFrame that materialize() returned; of any other, nothing."""
    if path := _WRITTEN.pop(id(df), None):
        at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def plan_bytes(df: DataFrame) -> int:
    """Stored size of all that the plan reads, by Catalyst's file statistics (no job runs); at least UNKNOWN where a source has none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


#: Seconds; see materialize().
LONG = 5
#: What a source without statistics counts as, or more.
UNKNOWN = 1 << 60
