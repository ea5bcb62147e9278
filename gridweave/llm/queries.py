"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import language, lines, mixing, packing, quality, scoring, secrets, shingles, substrings, vectors
from .common import table


def _on(name, op):
    return lambda spark, sf_dir: op(table(spark, sf_dir, name))


def queries():
    return {
        "op1_secret_scan": _on("documents", secrets.op1),
        "op2_line_dedup": _on("pages", lines.op2),
        "op3_mixing": _on("documents", mixing.op3),
        "op4_packing": _on("documents", packing.op4),
        "op5_language_id": _on("documents", language.op5),
        "op6_quality_rules": _on("documents", quality.op6),
        "op7_substring_dedup": _on("documents", substrings.op7),
        "op8_embedding_dedup": _on("embeddings", vectors.op8),
        "op9_jaccard_join": _on("documents", shingles.op9),
        "op10_lm_scoring": _on("documents", scoring.op10),
    }


def oracle_sql():
    return {"op2_line_dedup": lines.OP2_SQL}
