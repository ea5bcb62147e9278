"""From raw documents to packed training sequences, a stage a function; each stage's result is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.llm import lines, mixing, packing, quality, shingles
from gridweave.llm.common import broadcast_if_small, materialize, table
from gridweave.plans.storage import release, scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules keep; null and empty texts go, repeated rows are judged alike."""
    return quality.keep_good(docs).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines on over a hundredth of their source's documents, five at least; n_chars follows the text.

    A source is no site: its most common line is on a tenth of its documents, others on a fiftieth; under a hundredth copies prevail.
    A document of nothing else stays whole: copies are the next stage's work. A null text stays null; documents without a source are one
    site; repeated rows count each.
    """
    out = lines.drop_boilerplate(docs.select(*COLUMNS), "source", "text", ratio=0.01, min_pages=5, spare_whole=True)
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the least id; documents without shingles or without an id stay.

    Rows that share an id are one document: those with one text, too, leave one row (that of the least other columns), different texts under
    one id all stay or go together. Only rows of such ids are shuffled for that.
    """
    docs = docs.select(*COLUMNS)
    found = shingles.jaccard_components(docs)
    dropped = materialize(found.where("doc_id <> component_id").select("doc_id").distinct())
    left = docs.join(broadcast_if_small(dropped, dropped.count(), 16), "doc_id", "left_anti")
    twice = materialize(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if not (n := twice.count()):
        return left.select(*COLUMNS)
    twice = broadcast_if_small(twice, n, 16)
    rest = F.struct(*[F.col(c) for c in COLUMNS if c not in ("doc_id", "text")])
    one = left.join(twice, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(rest).alias("rest")).select("doc_id", "text", "rest.*")
    return left.join(twice, "doc_id", "left_anti").select(*COLUMNS).unionByName(one.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those without a source are one source, null texts and empty ones have no words and follow their source's rate."""
    mixed = mixing.mix(docs.select(*COLUMNS)).where("times > 0")
    return mixed.withColumn("__time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens; a null text is one end token, repeated rows are packed each on its own."""
    return packing.pack(docs, packing.tokenizer_path(), packing.tokenizer_path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: EM, components, hash-ordered sampling and token packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over all documents. Once a stage is written, what it read and wrote on the way is deleted."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch(spark):
            done = materialize(stage(spark, docs, sf_dir), keep=True)
        release(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
