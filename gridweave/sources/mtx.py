"""Matrix Market coordinate files as matrices, and matrices as files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matrix import SparseMatrix

MIRRORED = ("symmetric", "hermitian", "skew-symmetric")


@dataclass(frozen=True)
class Header:
    rows: int
    cols: int
    stored: int
    symmetry: str
    group: str | None
    kind: str | None


def parse_banner(line: str) -> str:
    """Symmetry from the banner's last word, of four words at least; anything else is general."""
    words = line.strip().lower().split()
    return words[-1] if len(words) >= 4 and words[-1] in MIRRORED else "general"


def parse_header(lines) -> Header:
    """From a file's first lines: banner, `% name:` and `% kind:` comments, then the first line of three whole numbers."""
    symmetry, group, kind = "general", None, None
    for line in lines:
        s = line.strip()
        if s.startswith("%%"):
            symmetry = parse_banner(s)
        elif s.startswith("%"):
            body = s.lstrip("% ")
            if body.startswith("name:"):
                group = body[5:].strip().split("/")[0] or None
            elif body.startswith("kind:"):
                kind = body[5:].strip() or None
        elif s and not s.startswith("#"):
            w = s.split()
            if len(w) == 3 and all(x.isdigit() for x in w):
                return Header(int(w[0]), int(w[1]), int(w[2]), symmetry, group, kind)
            raise ValueError(f"expected a size line `rows cols entries`, found: {s[:80]!r}")
    raise ValueError("no size line")


def read_header(spark: SparkSession, path: str) -> Header:
    """The head of the file by Spark's reader, so any store that Spark reads will do.

    Only the banner, the named comments before the size line, and that line reach the driver, however many comments there are.
    """
    t = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at"))
    size = t.where(~F.trim("value").rlike("^[%#]|^\\s*$")).limit(1).collect()
    named = t.where(F.trim("value").rlike("^%%|^%[% ]*(name|kind):"))
    if size:
        named = named.where(F.col("at") < size[0]["at"])
    lines = [r["value"] for r in named.orderBy("at").limit(1000).collect()]
    return parse_header([*lines, *(r["value"] for r in size)])


def read_mtx(spark: SparkSession, path: str, strict: bool = False) -> SparseMatrix:
    """A coordinate file as a matrix: 1-based to 0-based, mirrored by symmetry, repeated entries summed.

    Entries are all lines with two or more words that are whole numbers first; other lines are skipped, those out of range too.
    Of complex values the real part is read; a missing value is NULL. strict raises when their number isn't the header's.
    """
    h = read_header(spark, path)
    if h.rows == 0:
        raise ValueError("matrix has no rows")
    w = F.split(F.trim(F.regexp_replace("value", "[\\t\\r ]+", " ")), " ")
    lines = spark.read.text(path).where(~F.trim("value").rlike("^[%#]|^\\s*$"))
    e = lines.select(w.alias("w"), F.monotonically_increasing_id().alias("at")).where(F.size("w") >= 2)
    # The size line is the first line that isn't a comment.
    e = e.where(F.col("at") > F.lit(lines.select(F.monotonically_increasing_id().alias("at")).agg(F.min("at")).first()[0]))
    e = e.select(F.expr("try_cast(w[0] as bigint) - 1").alias("row"), F.expr("try_cast(w[1] as bigint) - 1").alias("col"), F.expr("try_cast(get(w, 2) as double)").alias("val")).where("row is not null and col is not null")
    if strict and (n := e.count()) != h.stored:
        raise ValueError(f"header says {h.stored} entries, found {n}")
    return SparseMatrix.build(e, h.rows, h.cols, h.symmetry)


def read_edge_list(spark: SparkSession, path: str, rows: int, cols: int) -> SparseMatrix:
    """0-based `row col [val]` lines."""
    w = F.split(F.trim(F.regexp_replace("value", "[\\t\\r ,]+", " ")), " ")
    e = spark.read.text(path).select(w.alias("w")).where(F.size("w") >= 2)
    return SparseMatrix.build(e.select(F.expr("try_cast(w[0] as bigint)").alias("row"), F.expr("try_cast(w[1] as bigint)").alias("col"), F.expr("try_cast(get(w, 2) as double)").alias("val")), rows, cols)


def write_mtx(m: SparseMatrix, path: str) -> None:
    """A folder of text parts in coordinate form without explicit zeros, ordered by row and column; the head is the first part."""
    m = m.drop_zeros()
    spark = m.coo.sparkSession
    pattern = m.coo.where("val is not null").isEmpty()
    head = spark.createDataFrame([(0, f"%%MatrixMarket matrix coordinate {'pattern' if pattern else 'real'} general\n{m.rows} {m.cols} {m.nnz()}")], "k int, value string")
    val = F.lit("") if pattern else F.concat(F.lit(" "), F.coalesce("val", F.lit(1.0)).cast("string"))
    body = m.coo.select(F.lit(1).alias("k"), "row", "col", F.concat((F.col("row") + 1).cast("string"), F.lit(" "), (F.col("col") + 1).cast("string"), val).alias("value"))
    every = head.select("k", F.lit(-1).cast("long").alias("row"), F.lit(-1).cast("long").alias("col"), "value").unionByName(body)
    every.repartitionByRange("k", "row", "col").sortWithinPartitions("k", "row", "col").select("value").write.mode("overwrite").text(path)


def header_table(spark: SparkSession, paths: str) -> DataFrame:
    """(path, group, kind) of many files from their comments, without reading entries on the driver."""
    t = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.mtx").text(paths).select(F.input_file_name().alias("path"), "value").where(F.col("value").startswith("%"))
    name, kind = F.regexp_extract("value", "%\\s*name:\\s*([^/\\s]+)/", 1), F.regexp_extract("value", "%\\s*kind:\\s*(.+?)\\s*$", 1)
    pick = lambda c: F.max(F.when(c != "", c))
    return t.groupBy("path").agg(pick(name).alias("group"), pick(kind).alias("kind"))
