"""Permutation files, matrix lists, job logs, feature tables, zipped arrays and packed binary matrices."""

from __future__ import annotations

import csv
import io
import struct
import urllib.parse
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.matrix import SparseMatrix, dense_index
from ..plans.ship import ship


def read_perm(spark: SparkSession, path: str) -> list[DataFrame]:
    """One permutation, or a row and a column one: 1-based numbers on one line, on two, or one a line when there are more lines.

    A file of one number a line is read in splits; the other forms are lines that a task reads whole.
    """
    t = spark.read.text(path).select(F.trim("value").alias("line"), F.monotonically_increasing_id().alias("at")).where("line <> ''")
    value = lambda c: (F.expr(f"try_cast({c} as bigint)") - 1).alias("old_idx")
    first = t.limit(3).collect()
    if len(first) > 2:
        numbers = t.select("at", F.posexplode(F.split("line", "\\s+")).alias("k", "v"))
        return [dense_index(numbers, [F.asc("at"), F.asc("k")], "new_pos").select("new_pos", value("v"))]
    lines = [t.where(F.col("at") == r["at"]) for r in first]
    return [x.select(F.posexplode(F.split("line", "\\s+")).alias("k", "v")).select(F.col("k").cast("long").alias("new_pos"), value("v")) for x in lines]


def write_perm(perms: list[DataFrame], path: str, one_line: int = 1 << 20) -> None:
    """One line a permutation, 1-based, in order of the new places; a single one of more than one_line rows as a number a line, in ordered parts."""
    if len(perms) == 1 and perms[0].count() > one_line:
        perms[0].repartitionByRange("new_pos").sortWithinPartitions("new_pos").select((F.col("old_idx") + 1).cast("string").alias("value")).write.mode("overwrite").text(path)
        return
    lines = None
    for k, p in enumerate(perms):
        line = p.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("new_pos", "old_idx"))), lambda x: (x["old_idx"] + 1).cast("string")), " ").alias("value")).withColumn("k", F.lit(k))
        lines = line if lines is None else lines.unionByName(line)
    lines.orderBy("k").coalesce(1).select("value").write.mode("overwrite").text(path)


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, path) of a list file; blank and # lines are skipped."""
    t = spark.read.text(path).select(F.trim("value").alias("path")).where("path <> '' and not startswith(path, '#')")
    return dense_index(t.withColumn("__i", F.monotonically_increasing_id()), [F.asc("__i")], "line_no").select("line_no", "path")


def candidates(entry: str, root: str, folder: str = "datasets") -> list[str]:
    """Where a list entry may be: as given, under the root, in the data folder under its own name, or right there."""
    name = entry.rsplit("/", 1)[-1]
    stem = name.rsplit(".", 1)[0] if "." in name[1:] else name
    return [entry, f"{root}/{entry}", f"{root}/{folder}/{stem}/{name}", f"{root}/{folder}/{name}"]


def resolve_list(spark: SparkSession, path: str, root: str, folder: str = "datasets") -> DataFrame:
    """(line_no, entry, path): each list entry with the first place that has its file, NULL where none has.

    One listing of the root answers for all entries but absolute ones, which are looked up by the file system they name.
    """
    e = read_list(spark, path).withColumnRenamed("path", "entry")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def is_file(p: str) -> bool:
        at = hadoop(p)
        fs = at.getFileSystem(conf)
        return fs.exists(at) and fs.getFileStatus(at).isFile()

    found = [(r["line_no"], r["entry"], next((c for c in candidates(r["entry"], root, folder) if is_file(c)), None)) for r in e.collect()]  # a list file's lines
    return spark.createDataFrame(found, "line_no long, entry string, path string")


def default_matrices(spark: SparkSession, root: str, folder: str = "datasets", name: str = "matrices_list_filtered.txt") -> DataFrame:
    """(path): the listed matrices that are there; without a list, or when it names none, all .mtx files of the data folder, sorted."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    at = hadoop(f"{root}/{folder}/{name}")
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        listed = resolve_list(spark, f"{root}/{folder}/{name}", root, folder).where("path is not null").select("path")
        if not listed.isEmpty():
            return listed
    return find_matrices(spark, f"{root}/{folder}")


#: The list file of each suite of matrices.
SUITES = {"ai": "ai_matrices.txt", "extended": "matrices_extended.txt", "standard": "matrices_list_filtered.txt"}


def select_suite(grid: DataFrame, suite: str) -> DataFrame:
    """The rows of an experiment grid (with a column suite) that belong to one suite; ValueError for an unknown one."""
    if suite not in SUITES:
        raise ValueError(f"unknown suite {suite!r}; there are {', '.join(sorted(SUITES))}")
    return grid.where(F.col("suite") == suite)


def keep_listed(df: DataFrame, names: DataFrame, c: str = "matrix") -> DataFrame:
    """Rows of df whose matrix is in a curated list (path): compared by file name without folder and suffix."""
    stem = lambda x: F.regexp_replace(F.element_at(F.split(x, "/"), -1), "\\.mtx$", "")
    return df.withColumn("__stem", stem(F.col(c))).join(names.select(stem(F.col("path")).alias("__stem")).distinct(), "__stem", "left_semi").drop("__stem")


def find_matrices(spark: SparkSession, root: str) -> DataFrame:
    """(path) of all .mtx files below a folder, sorted and distinct."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.mtx").load(root).select("path").distinct().orderBy("path")


def write_manifest(paths: DataFrame, path: str) -> None:
    paths.select("path").distinct().orderBy("path").coalesce(1).write.mode("overwrite").text(path)


def fetch_status(jobs: DataFrame) -> DataFrame:
    """(status, n) of a manifest of fetched, skipped and failed files."""
    return jobs.groupBy("status").agg(F.count("*").alias("n"))


def read_job_logs(spark: SparkSession, path: str, labels: list[str] | None = None) -> DataFrame:
    """(path, a column a timer label in ms): mean of `<Timer>[label] 1.23 ms` lines of each log."""
    t = spark.read.option("recursiveFileLookup", True).text(path).select(F.input_file_name().alias("path"), "value").where(F.col("value").startswith("<Timer>["))
    e = t.select("path", F.regexp_extract("value", "^<Timer>\\[(\\w+)\\]", 1).alias("label"), F.expr("try_cast(regexp_extract(value, '\\\\] ([0-9.]+) ms', 1) as double)").alias("ms"))
    g = e.where("label <> ''").groupBy("path")
    return (g.pivot("label", labels) if labels else g.pivot("label")).agg(F.avg("ms"))


def read_json_payloads(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Analysis payloads: lines of logs that are JSON objects, by a given schema."""
    t = spark.read.option("recursiveFileLookup", True).text(path).where(F.trim("value").startswith("{"))
    return t.select(F.from_json("value", schema).alias("j")).where("j is not null").select("j.*")


def read_results(spark: SparkSession, paths, schema: str) -> DataFrame:
    """CSV files with a header, and those in folders below, as one table of a schema: columns by name, in any order; missing ones are NULL, others go.

    Files are read by the headers they share; only these and the files' names reach the driver. What a column's type can't hold is NULL.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(paths).select(F.input_file_name().alias("path"), "value", F.monotonically_increasing_id().alias("at"))
    heads = lines.groupBy("path").agg(F.min_by("value", "at").alias("head")).groupBy("head").agg(F.sort_array(F.collect_list("path")).alias("paths")).orderBy("head").collect()
    want = spark.createDataFrame([], schema)
    for r in heads:
        names = next(csv.reader([r["head"]]))
        own = StructType([StructField(n, StringType()) for n in names])
        t = spark.read.schema(own).csv([urllib.parse.unquote(p) for p in r["paths"]], header=True)
        cols = [F.expr(f"try_cast(`{f.name}` as {f.dataType.simpleString()})").alias(f.name) if f.name in names else F.lit(None).cast(f.dataType).alias(f.name) for f in want.schema.fields]
        want = want.unionByName(t.select(*cols))
    return want


def merge_results(spark: SparkSession, folder: str, schema: str, out: str) -> DataFrame:
    """All CSV files of a folder as one table in the schema's column order, written as CSV."""
    t = read_results(spark, folder, schema)
    t.write.mode("overwrite").csv(out, header=True, emptyValue="")
    return t


def write_report(df: DataFrame, path: str) -> None:
    """A small report as one CSV part; missing values are empty."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True, emptyValue="", nullValue="")


# Pruning methods in names of pruned vision models.
PRUNERS = ("erk", "er", "grasp", "prospr", "snip", "synflow", "uniform")
ARCH = "^(.+?)-(?:" + "|".join(PRUNERS) + ")-[0-9.]+-CIFAR-10-seed[0-9]+$"


def matrix_name(c: str = "matrix") -> list:
    """Columns arch, config, pruner, layer of names like COLLECTION__config_matrices__matrices__pruner__layer.

    The model family is the config without its pruner, sparsity, data set and seed, or all of it where it has none. A name without parts is its own
    config; a missing pruner is Unknown, a missing layer empty.
    """
    p = F.split(F.regexp_replace(F.col(c), "\\.mtx$", ""), "__")
    config = F.regexp_replace(F.coalesce(F.get(p, F.lit(1)), p[0]), "_matrices$", "")
    arch = F.regexp_extract(config, ARCH, 1)
    return [
        F.when(arch != "", arch).otherwise(config).alias("arch"),
        config.alias("config"),
        F.coalesce(F.get(p, F.lit(3)), F.lit("Unknown")).alias("pruner"),
        F.when(F.size(p) > 4, F.array_join(F.slice(p, F.lit(5), F.greatest(F.size(p) - 4, F.lit(0))), "__")).otherwise("").alias("layer"),
    ]


# ---- arrays in files


def _coo(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[int, int]]:
    """Row, column, value and shape from npz bytes: compressed rows or columns, coordinates, or one dense array (flattened to two axes)."""
    z = np.load(io.BytesIO(raw), allow_pickle=False)
    names = set(z.files)
    if {"data", "indices", "indptr"} <= names:
        by, at = np.repeat(np.arange(len(z["indptr"]) - 1), np.diff(z["indptr"])), z["indices"]
        fmt = bytes(z["format"].item()).decode() if "format" in names and z["format"].dtype.kind == "S" else str(z["format"]) if "format" in names else "csr"
        r, c = (at, by) if fmt == "csc" else (by, at)
        v = z["data"]
        shape = tuple(int(x) for x in z["shape"]) if "shape" in names else (int(r.max(initial=-1)) + 1, int(c.max(initial=-1)) + 1)
    elif {"row", "col", "data"} <= names:
        r, c, v = z["row"], z["col"], z["data"]
        shape = tuple(int(x) for x in z["shape"]) if "shape" in names else (int(r.max(initial=-1)) + 1, int(c.max(initial=-1)) + 1)
    elif len(z.files) == 1:
        a = z[z.files[0]]
        a = a.reshape(a.shape[0], -1)
        r, c = np.nonzero(a)
        v, shape = a[r, c], a.shape
    else:
        raise ValueError(f"no matrix in arrays {sorted(names)}")
    if v.dtype == np.float16:
        v = v.astype(np.float32)
    return r.astype(np.int64), c.astype(np.int64), v.astype(np.float64), (int(shape[0]), int(shape[1]))


_ENTRIES = "matrix string, rows long, cols long, row long, col long, val double"


def _frame(name: str, raw: bytes) -> pd.DataFrame:
    r, c, v, shape = _coo(raw)
    return pd.DataFrame({"matrix": name, "rows": shape[0], "cols": shape[1], "row": r, "col": c, "val": v})


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """(matrix, rows, cols, row, col, val) of npz files, a file a task row; entries as stored."""
    ship(spark)

    def run(frames):
        for f in frames:
            for p, raw in zip(f["path"], f["content"]):
                yield _frame(p.rsplit("/", 1)[-1].removesuffix(".npz"), raw)

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npz").load(path).select("path", "content").mapInPandas(run, _ENTRIES)


def read_zip(spark: SparkSession, path: str, limit: int | None = None, dry_run: bool = False) -> DataFrame:
    """Entries of the npz members of zip files, named by member path with / as __; dry_run lists (matrix, bytes) only."""
    ship(spark)
    out = "matrix string, bytes long" if dry_run else _ENTRIES

    def run(frames):
        for f in frames:
            for raw in f["content"]:
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    for i in sorted((i for i in z.infolist() if i.filename.endswith(".npz")), key=lambda i: i.filename)[:limit]:
                        name = i.filename.removesuffix(".npz").replace("/", "__")
                        yield pd.DataFrame({"matrix": [name], "bytes": [i.file_size]}) if dry_run else _frame(name, z.read(i))

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, out)


def read_bmtx(spark: SparkSession, path: str) -> SparseMatrix:
    """A packed binary matrix: rows, cols, entries as three u64, index width and value width as bytes, then (row, col[, value]) tuples."""
    ship(spark)
    head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 26).alias("h")).first()["h"]
    rows, cols, _, wi, wv = struct.unpack("<QQQBB", bytes(head))
    kind = np.dtype([("r", f"<u{wi}"), ("c", f"<u{wi}")] + ([("v", f"<f{wv}")] if wv else []))

    def run(frames):
        for f in frames:
            for raw in f["content"]:
                a = np.frombuffer(raw, kind, offset=26)
                yield pd.DataFrame({"row": a["r"].astype(np.int64), "col": a["c"].astype(np.int64), "val": a["v"].astype(np.float64) if wv else [None] * len(a)})

    return SparseMatrix.build(spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "row long, col long, val double"), rows, cols)


def grid_parts(m: SparseMatrix, p: int, q: int) -> DataFrame:
    """Entries dealt over a p x q grid of row and column blocks, a partition a cell."""
    rb, cb = F.expr(f"row * {p} div {max(1, m.rows)}"), F.expr(f"col * {q} div {max(1, m.cols)}")
    return m.coo.withColumn("row_blk", rb).withColumn("col_blk", cb).repartition(p * q, "row_blk", "col_blk")
