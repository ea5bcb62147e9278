"""Graph operators where one word, one task or one batch isn't enough, against literal models."""

import random

import pyarrow as pa
import pytest

from gridweave.operators import features, graph, packed
from gridweave.operators.matrix import SparseMatrix


def undirected(spark, n, p, seed):
    r = random.Random(seed)
    near = {v: set() for v in range(n)}
    for i in range(n):
        for j in range(i + 1, n):
            if r.random() < p:
                near[i].add(j)
                near[j].add(i)
    return spark.createDataFrame([(u, v) for u, x in near.items() for v in x], "src long, dst long"), near


def test_bfs_from_more_sources_than_a_word_has_bits(spark, monkeypatch):
    e, near = undirected(spark, 90, 0.03, 40)
    want = set()
    for s in range(70):
        level, todo = {s: 0}, [s]
        for v in todo:
            for u in near[v]:
                if u not in level:
                    level[u] = level[v] + 1
                    todo.append(u)
        want |= {(s, v, k) for v, k in level.items()}
    widest, plain = [], graph.materialize

    def watched(df, *a, **b):
        out = plain(df, *a, **b)
        widest.extend(r["count"] for r in out.groupBy("level").count().collect()) if "bits" in out.columns else None
        return out

    monkeypatch.setattr(graph, "materialize", watched)
    got = [tuple(r) for r in graph.bfs(e, spark.range(70).withColumnRenamed("id", "node")).select("source", "node", "level").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert widest and max(widest) <= 2 * 90  # a row a vertex and word, not one a vertex and source


def test_vectors_are_dealt_in_small_batches(spark, monkeypatch):
    """A row dealt to very many blocks doesn't make one batch of all its copies."""
    from gridweave.llm import vectors

    sizes, make = [], pa.RecordBatch.from_arrays
    held = {}

    class Placed:
        def mapInArrow(self, f, schema):
            held["deal"] = f
            raise StopIteration

    with pytest.raises(StopIteration):
        vectors._links(Placed(), vectors.np.zeros((0, 0)), {}, {4: 3000}, 0.5, 0.9)
    b = make([pa.array(range(20)), pa.array([1] * 20), pa.array([[1.0, 2.0, 3.0, 4.0]] * 20), pa.array([4] * 20, pa.int32()), pa.array([0.0] * 20)], ["rep", "copies", "v", "cell", "far"])
    monkeypatch.setattr(vectors, "BATCH", 1 << 14, raising=False)
    tasks = set()
    for x in held["deal"]([b]):
        sizes.append(x.num_rows)
        tasks |= set(zip(x["rep"].to_pylist(), x["task"].to_pylist()))
    assert sum(sizes) == len(tasks) == 20 * 3000 and max(sizes) <= 1 << 12


def test_symmetric_pattern_is_read_as_it_is(spark):
    """The graph of a matrix that is known to be symmetric needs no shuffle, nor a second written copy."""
    from gridweave.operators.matrix import SparseMatrix
    from gridweave.plans.storage import materialize, settled

    e, near = undirected(spark, 20, 0.2, 42)
    coo = materialize(e.selectExpr("src as row", "dst as col", "1.0D as val"))
    m = SparseMatrix(coo, 20, 20, mirrored=True)
    found = graph.edges_of(m)
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString() and settled(found) is found
    want = {(u, v) for u, x in near.items() for v in x}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want == {tuple(r) for r in graph.edges_of(m.with_coo(coo)).collect()}
    assert not m.with_coo(coo).mirrored


@pytest.mark.parametrize("kind", ["mirrored", "loops", "square", "rectangular"])
def test_packed_fingerprint_parts_equal_joins(spark, monkeypatch, kind):
    """The parts of a fingerprint from packed rows are those from joins, with many ranges of rows and blocks of edges."""
    r = random.Random(3)
    rows, cols = (300, 300) if kind != "rectangular" else (300, 170)
    e = {(int(rows * r.random() ** 2), r.randrange(cols)) for _ in range(1500)}
    e = {(a, b) for a, b in e if not 120 <= a < 140 and not 120 <= b < 140}
    if kind in ("mirrored", "loops"):
        e = {x for a, b in e for x in ((a, b), (b, a)) if a != b or kind == "loops"}
    m = SparseMatrix(spark.createDataFrame([(a, b, 1.0) for a, b in sorted(e)], "row long, col long, val double"), rows, cols, kind in ("mirrored", "loops"))
    monkeypatch.setattr(packed, "ENTRIES", 200)
    monkeypatch.setattr(packed.triangles, "__defaults__", (300,))
    known, found = features._by_arrays(m, len(e), 0)
    got, want = {}, {}
    for p in found:
        got |= p.first().asDict()
    for p in features._by_joins(m, 0):
        want |= p.first().asDict()
    assert got.keys() == want.keys()
    assert got == pytest.approx(want, rel=1e-9)
    for side in ("row", "col"):
        assert sorted(features.degrees(known, side).collect()) == sorted(features.degrees(m, side).collect())


def test_fingerprint_shuffles_no_wedges(spark, monkeypatch):
    """A fingerprint neither opens wedges by joins nor shuffles ranks, and leaves none of its tables."""
    for name in ("triangles", "pagerank", "components"):
        monkeypatch.setattr(graph, name, lambda *a, **k: pytest.fail("a join over all edges"))
    e = [(a, b, 1.0) for a, b in [(0, 1), (1, 2), (2, 0), (2, 3)]]
    m = SparseMatrix(spark.createDataFrame(e + [(b, a, v) for a, b, v in e], "row long, col long, val double"), 5, 5, True)
    row = features.fingerprint(m, "t").first()
    assert (row["n_components"], row["pseudo_diameter"]) == (2, 2.0)
    assert row["triangle_closure_rate"] == pytest.approx(3 / 5)


def test_triangles_query_shuffles_no_wedges(spark, monkeypatch):
    """The query counts closed wedges within tasks, over several jobs; pairs may come often and either way."""
    from gridweave.plans import catalogue

    monkeypatch.setattr(graph, "triangles", lambda *a: pytest.fail("wedges are joined"))
    assert catalogue.queries()["triangles"](spark, "/root/testdata/sf0.001").first()["triangles"] >= 0
    monkeypatch.setattr(packed, "DEALT", 1500)
    monkeypatch.setattr(packed.triangles, "__defaults__", (700,))
    r = random.Random(43)
    e = {(min(x), max(x)) for x in ((int(80 * r.random() ** 2), r.randrange(80)) for _ in range(700)) if x[0] != x[1]}
    near = {v: {b for a, b in e if a == v} | {a for a, b in e if b == v} for v in range(80)}
    want = sum(len(near[a] & near[b]) for a, b in e) // 3
    given = [*e, *[(b, a) for a, b in sorted(e)[:50]], *sorted(e)[:30]]
    row = packed.closure(spark.createDataFrame(given, "row long, col long"), 80).first()
    assert (row["triangles"], row["wedges"]) == (want, sum(len(x) * (len(x) - 1) // 2 for x in near.values()))
    none = packed.closure(spark.createDataFrame([(1, 1)], "row long, col long"), 5).first()
    assert tuple(none) == (None, 0, 0.0)
