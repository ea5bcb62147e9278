"""The pipeline's stages on a small corpus: each keeps what it should and returns the columns of documents."""

import re

import pytest

import corpus_pipeline as pipeline
from gridweave.llm import quality, shingles

from gridweave.llm import mixing, packing

from .test_operators import CLASH, DOCS, brute_links, by_id, corpus, words


def test_stages(spark):
    stops = lambda t: t and re.sub(r"((?:[^ \n]+ ){9}[^ \n]+) ", r"\1. ", t)
    rows = [(i, stops(t), lang, s, n) for i, t, lang, s, n in corpus(7, 80) if i != 906]
    docs = spark.createDataFrame(rows, DOCS)
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_duplicates", "mix_sources", "pack_sequences"]
    judged = {r["doc_id"] for r in quality.op6(docs).where("kept").collect()}
    seen = {}
    for name, stage in pipeline.STAGES:
        docs = pipeline.materialize(stage(spark, docs, ""))
        seen[name] = docs.collect()
        if name != names[-1]:
            assert docs.columns == list(pipeline.COLUMNS)
    assert {r["doc_id"] for r in seen["quality_rules"]} == judged
    assert {r["doc_id"] for r in seen["line_dedup"]} == judged
    links = brute_links([tuple(r) for r in seen["line_dedup"]])
    assert {r["doc_id"] for r in seen["near_duplicates"]} == {i for i, (_, c) in links.items() if i == c}
    assert {r["doc_id"] for r in seen["mix_sources"]} <= {r["doc_id"] for r in seen["near_duplicates"]}
    assert max(r["length"] for r in seen["pack_sequences"]) <= 1024
    assert shingles.op9(spark.createDataFrame([tuple(r) for r in seen["near_duplicates"]], DOCS)).where("doc_id <> component_id").count() == 0


def test_line_dedup_drops_shared_lines(spark):
    """A line on 3 % of a large source's documents or on 6 of a small one's 40 goes; unique lines and those on 4 documents stay."""
    text = lambda i, n: "\n".join([f"own {i}"] + ["shared line"] * (i % 1000 < n) + ["on four"] * (i % 1000 < 4) + [f"last {i}"])
    rows = [(i, text(i, 12), "en", "large", 0) for i in range(400)] + [(i, text(i, 6), "en", "small", 0) for i in range(1000, 1040)]
    got = {r["doc_id"]: r for r in pipeline.line_dedup(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    assert len(got) == len(rows)
    for i, t, _, _, n in rows:
        want = t.replace("shared line\n", "")
        assert got[i]["text"] == want and got[i]["n_chars"] == (len(want) if want != t else n)


def test_repeated_rows_leave_one(spark):
    t = " ".join(f"w{i}" for i in range(30))
    rows = [(5, t, "en", "a", 1), (5, t, "en", "a", 1), (5, t, "de", "a", 1), (5, "something else entirely", "en", "a", 1), (7, t, "en", "b", 1), (7, "other words under seven", "en", "b", 1)]
    rows += [(None, t, "en", "a", 1), (9, None, None, None, None), (9, None, None, None, None), (10, "", "en", "a", 0)]
    got = by_id(pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOCS), ""))
    assert [(r["doc_id"], r["text"], r["lang"]) for r in got] == sorted(
        [(5, t, "de"), (5, "something else entirely", "en"), (None, t, "en"), (9, None, None), (10, "", "en")], key=lambda r: tuple(map(str, (r[0], r[1], r[2])))
    )


@pytest.mark.parametrize("name, stage", pipeline.STAGES)
def test_stages_on_awkward_tables(spark, name, stage):
    """Empty tables, nulls in every column, columns with the stages' own names: same rows as without these columns."""
    from pyspark.sql import functions as F

    none = spark.createDataFrame([], DOCS)
    assert stage(spark, none, "").count() == 0
    rows = [*corpus(9, 30), (None, None, None, None, None), (None, "a b", None, None, 3)]
    docs = spark.createDataFrame(rows, DOCS)
    extra = docs.withColumns({c: F.lit("clash") for c in (*CLASH, "component_id", "times", "__row", "rest", "doc", "host", "count")})
    plain, clashing = stage(spark, docs, ""), stage(spark, extra, "")
    assert plain.columns == clashing.columns
    drop = ("sequence_id", "offset") if name == "pack_sequences" else ()
    assert by_id(plain.drop(*drop)) == by_id(clashing.drop(*drop))


def test_mix_and_packing_follow_their_operators(spark):
    docs = spark.createDataFrame([r for r in corpus(11, 40) if r[0] != 906], DOCS)
    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.op3(docs).collect()}
    mixed = [r["doc_id"] for r in pipeline.mix_sources(spark, docs, "").collect()]
    for i, (words_taken, size) in taken.items():
        if size:
            assert mixed.count(i) * size == words_taken
    packed = pipeline.pack_sequences(spark, docs, "").collect()
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in packed) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in packing.op4(docs).collect())
    assert len({r["sequence_id"] for r in packed}) <= packed[0]["bound"] + 1


def test_line_dedup_of_texts(spark):
    """Against counts by hand: source, documents of a line, lines over a hundredth and five at least."""
    from collections import Counter

    rows = corpus(13, 120)
    got = {}
    for r in pipeline.line_dedup(spark, spark.createDataFrame(rows, DOCS), "").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    trim = lambda x: x.strip(" \t\n\v\f\r")
    total = Counter(s for _, _, _, s, _ in rows)
    seen = Counter((s, x) for _, t, _, s, _ in rows for x in {trim(x) for x in (t or "").split("\n")} if x)
    for i, t, _, s, _ in rows:
        common = lambda x: x and seen[s, x] >= 5 and seen[s, x] > 0.01 * total[s]  # noqa: E731, B023
        lines = (t or "").split("\n")
        left = [x for x in lines if not common(trim(x))]
        want = t if t is None or not words("\n".join(left)) else "\n".join(left)
        assert want in got[i], i
