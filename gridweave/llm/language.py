"""Language identification by error-correcting output codes over byte n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ship import ship

#: Hashed byte trigrams; the table of a language has 2**BITS counts whatever the corpus holds.
BITS = 14
DIM = 1 << BITS
#: Fixed odd multipliers of the trigram hash.
M1, M2, M3 = 0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35
SLICE = 1 << 20


def trigrams(text: str) -> np.ndarray:
    """Counts of hashed byte trigrams of the whole text (A-Z lowered), a slice of 1 MB at a time."""
    raw = np.frombuffer(b" " + text.encode("utf-8", "surrogatepass").lower() + b" ", np.uint8)
    out = np.zeros(DIM, np.int64)
    for at in range(0, max(1, len(raw) - 2), SLICE):
        a = raw[at : at + SLICE + 2].astype(np.uint32)
        if len(a) > 2:
            out += np.bincount((a[:-2] * np.uint32(M1) ^ a[1:-1] * np.uint32(M2) ^ a[2:] * np.uint32(M3)) >> np.uint32(32 - BITS), minlength=DIM)
    return out


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k x bits matrix of +1 / -1: every split of the languages up to 7 of them, else 24 log2(k) seeded random splits."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 7:
        return np.array([[1 if i == 0 or (c >> (i - 1)) & 1 else -1 for c in range(2 ** (k - 1) - 1)] for i in range(k)], float)
    rng, cols = np.random.default_rng(seed), []
    while len(cols) < int(np.ceil(24 * np.log2(k))):
        c = rng.choice([-1.0, 1.0], k)
        if abs(c.sum()) < k:
            cols.append(c)
    return np.array(cols).T


def fit(counts: dict[str, np.ndarray], smooth: float = 0.5):
    """Language names, codewords, and for each bit the weights of a binary naive-Bayes trigram classifier."""
    names = sorted(counts)
    share = np.array([(counts[n] + smooth) / (counts[n].sum() + smooth * DIM) for n in names])
    code = codewords(len(names))
    if len(names) < 2:
        return names, code, np.zeros((DIM, code.shape[1]), np.float32)
    sides = [np.array([share[code[:, b] == s].mean(axis=0) for s in (1, -1)]) for b in range(code.shape[1])]
    return names, code, np.array([np.log(s[0]) - np.log(s[1]) for s in sides]).T.astype(np.float32)


def decode(f: np.ndarray, code: np.ndarray):
    """Loss-weighted decoding: exponential loss of each bit's margin against each codeword; index, score, runner-up."""
    loss = np.exp(np.clip(-code * f, -30, 30)).sum(axis=1)
    p = 1.0 / loss
    p /= p.sum()
    order = np.argsort(-p, kind="stable")
    return order[0], float(p[order[0]]), float(p[order[1]]) if len(p) > 1 else 0.0


def train_counts(docs: DataFrame, text: str, label: str) -> DataFrame:
    """(lang, at, n): trigram counts of all rows given, summed where they lie, then by (lang, at)."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c = trigrams(t)
                sums[lang] = sums.get(lang, 0) + c
        for lang, c in sums.items():
            at = np.nonzero(c)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], ["lang", "at", "n"])

    part = docs.select(F.col(text).alias("t"), F.col(label).alias("l")).mapInArrow(run, "lang string, at int, n long")
    return part.groupBy("lang", "at").agg(F.sum("n").alias("n"))


def language_id(docs: DataFrame, training: DataFrame, text: str = "text", label: str = "lang", id_col: str = "doc_id", scale: float = 4.0, gap: float = 0.2, most_labels: int = 256) -> DataFrame:
    """(id, lang_pred, score, ambiguous) for each row of docs, learned from training's texts and non-null labels.

    Texts that are null or hold no letter get `und`, score 0. With no labelled text, all get `und`; with one label, all
    others get it. The driver holds a table of labels x 2**14 counts, whatever the rows; more than most_labels labels are refused with
    ValueError, as they are no languages. Repeated rows are learned and predicted alike; an empty table gives no rows. Columns but id, text and label are not read. Prediction reads the text alone, whole, in slices. ambiguous: the runner-up is within gap.
    """
    ship(docs.sparkSession)
    got = train_counts(training.where(F.col(label).isNotNull() & F.col(text).isNotNull()), text, label)
    got = got.limit(most_labels * DIM + 1).toPandas()
    counts = {}
    for lang, part in got.groupby("lang"):
        counts[lang] = np.zeros(DIM)
        counts[lang][part["at"].to_numpy()] = part["n"].to_numpy()
    if len(counts) > most_labels or len(got) > most_labels * DIM:
        raise ValueError(f"more than {most_labels} labels in {label}")
    names, code, weights = fit(counts)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            langs, scores, close = [], [], []
            for t in b.column(1).to_pylist():
                if not t or not names or not any(map(str.isalpha, t)):
                    langs.append("und"), scores.append(0.0), close.append(False)
                    continue
                c = trigrams(t)
                best, p, second = decode(scale * (c.astype(np.float32) @ weights).astype(float) / max(1, c.sum()), code)
                langs.append(names[best]), scores.append(p), close.append(bool(p - second < gap))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(close, pa.bool_())], [id_col, "lang_pred", "score", "ambiguous"])

    return docs.select(id_col, F.col(text).alias("__text")).mapInArrow(run, f"{id_col} {kind}, lang_pred string, score double, ambiguous boolean")


def held_out(mod: int, rest: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(mod)) == rest


def op5(docs: DataFrame) -> DataFrame:
    out = language_id(docs, docs.where(~held_out(3, 1)))
    return out.select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score", "ambiguous")
