import io

import numpy as np
import pytest

from gridweave.operators.ml import ward
from gridweave.sources import files, mtx


def entries(m):
    return sorted(map(tuple, m.coo.select("row", "col", "val").collect()))


def test_general_and_comments(spark, tmp_path):
    p = tmp_path / "a.mtx"
    p.write_text("%%MatrixMarket matrix coordinate real general\r\n% name: G/a\r\n% kind: graph\r\n\r\n4 5 4\r\n1 2 1.5\r\n# note\r\n1 2 0.5\r\n4 5 -1\r\n9 9 1\r\n0 1 1\r\n")
    m = mtx.read_mtx(spark, str(p))
    assert (m.rows, m.cols) == (4, 5) and entries(m) == [(0, 1, 2.0), (3, 4, -1.0)]
    h = mtx.read_header(spark, str(p))
    assert (h.group, h.kind) == ("G", "graph")


def test_symmetric_pattern_and_skew(spark, tmp_path):
    p = tmp_path / "s.mtx"
    p.write_text("%%MatrixMarket matrix coordinate pattern symmetric\n3 3 2\n2 1\n3 3\n")
    assert entries(mtx.read_mtx(spark, str(p))) == [(0, 1, None), (1, 0, None), (2, 2, None)]
    p.write_text("%%MatrixMarket matrix coordinate complex hermitian\n2 2 1\n2 1 3 4\n")
    assert entries(mtx.read_mtx(spark, str(p))) == [(0, 1, 3.0), (1, 0, 3.0)]


def test_no_size_line(spark, tmp_path):
    p = tmp_path / "x.mtx"
    p.write_text("%%MatrixMarket matrix array real general\n3 3\n1\n")
    with pytest.raises(ValueError):
        mtx.read_mtx(spark, str(p))


def test_write_and_read_again(spark, tmp_path):
    p = tmp_path / "w.mtx"
    p.write_text("%%MatrixMarket matrix coordinate real general\n3 3 3\n1 1 2\n2 3 0\n3 1 4\n")
    mtx.write_mtx(mtx.read_mtx(spark, str(p)), str(tmp_path / "out"))
    text = "".join(f.read_text() for f in sorted((tmp_path / "out").glob("part-*")))
    assert text.splitlines()[1:] == ["3 3 2", "1 1 2.0", "3 1 4.0"]


@pytest.mark.parametrize("text,want", [("2 1 3\n", [[1, 0, 2]]), ("2 1\n1 3 2\n", [[1, 0], [0, 2, 1]]), ("3\n1\n2\n", [[2, 0, 1]])])
def test_permutation_files(spark, tmp_path, text, want):
    p = tmp_path / "a.perm"
    p.write_text(text)
    got = files.read_perm(spark, str(p))
    assert [[r["old_idx"] for r in x.orderBy("new_pos").collect()] for x in got] == want
    files.write_perm(got, str(tmp_path / "again"))
    again = "".join(f.read_text() for f in sorted((tmp_path / "again").glob("part-*")))
    assert again.split() == text.split()
    if len(got) == 1:
        files.write_perm(got, str(tmp_path / "long"), one_line=2)
        assert [r["old_idx"] for r in files.read_perm(spark, str(tmp_path / "long"))[0].orderBy("new_pos").collect()] == want[0]


def test_npz_zip_and_logs(spark, tmp_path):
    import zipfile

    a = np.array([[0, 2.0], [0, 0], [1.0, 0]])
    buf = io.BytesIO()
    np.savez(buf, a)
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "m.npz").write_bytes(buf.getvalue())
    got = files.read_npz(spark, str(tmp_path / "n")).collect()
    assert sorted((r["matrix"], r["rows"], r["row"], r["col"], r["val"]) for r in got) == [("m", 3, 0, 1, 2.0), ("m", 3, 2, 0, 1.0)]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("x/y.npz", buf.getvalue())
    assert {r["matrix"] for r in files.read_zip(spark, str(tmp_path / "z.zip")).collect()} == {"x__y"}
    assert files.read_zip(spark, str(tmp_path / "z.zip"), dry_run=True).count() == 1
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.txt").write_text("hi\n<Timer>[spmm] 2.0 ms\n<Timer>[spmm] 4.0 ms\n<Timer>[io] 1 ms\n")
    r = files.read_job_logs(spark, str(tmp_path / "log"), ["spmm", "io"]).first()
    assert (r["spmm"], r["io"]) == (3.0, 1.0)


def test_names_and_ward(spark):
    names = [
        "ZOO__CONV-6-er-0.8-CIFAR-10-seed0_matrices__matrices__er__convs1_0.mtx", "ZOO__Wide-Resnet-28-2-synflow-0.95-CIFAR-10-seed11_matrices__matrices__synflow__a__b",
        "ZOO__llama-8B-Instruct_matrices__matrices__wanda__mlp_up_proj", "ZOO__only_matrices", "plain",
    ]
    df = spark.createDataFrame([(n,) for n in names], "matrix string")
    got = [tuple(r) for r in df.select(*files.matrix_name()).collect()]
    assert got == [
        ("CONV-6", "CONV-6-er-0.8-CIFAR-10-seed0", "er", "convs1_0"), ("Wide-Resnet-28-2", "Wide-Resnet-28-2-synflow-0.95-CIFAR-10-seed11", "synflow", "a__b"),
        ("llama-8B-Instruct", "llama-8B-Instruct", "wanda", "mlp_up_proj"), ("only", "only", "Unknown", ""), ("plain", "plain", "Unknown", ""),
    ]
    assert ward(np.array([[0.0], [0.1], [5.0], [5.1]]), 2).tolist() == [0, 0, 1, 1]


def test_lists_and_suites(spark, tmp_path):
    data = tmp_path / "datasets"
    (data / "a").mkdir(parents=True)
    for p in (data / "a" / "a.mtx", data / "b.mtx", tmp_path / "c.mtx"):
        p.write_text("%%MatrixMarket matrix coordinate real general\n1 1 1\n1 1 1\n")
    lst = data / "matrices_list_filtered.txt"
    lst.write_text(f"# head\n\n/elsewhere/a.mtx\nb.mtx\n  c.mtx  \n{tmp_path}/c.mtx\nnone.mtx\n")
    got = files.resolve_list(spark, str(lst), str(tmp_path)).orderBy("line_no").collect()
    assert [r["path"] for r in got] == [f"{data}/a/a.mtx", f"{data}/b.mtx", f"{tmp_path}/c.mtx", f"{tmp_path}/c.mtx", None]
    assert files.default_matrices(spark, str(tmp_path)).count() == 4
    lst.write_text("none.mtx\n")
    assert [r["path"].rsplit("/", 1)[-1] for r in files.default_matrices(spark, str(tmp_path)).collect()] == ["a.mtx", "b.mtx"]
    files.write_manifest(files.find_matrices(spark, str(data)), str(tmp_path / "manifest"))
    assert spark.read.text(str(tmp_path / "manifest")).count() == 2
    with pytest.raises(ValueError):
        files.select_suite(spark.createDataFrame([("a", "ai")], "matrix string, suite string"), "other")
    kept = files.keep_listed(spark.createDataFrame([("a.mtx",), ("x",)], "matrix string"), spark.createDataFrame([("/p/a.mtx",)], "path string"))
    assert [r["matrix"] for r in kept.collect()] == ["a.mtx"]
    assert {r["status"]: r["n"] for r in files.fetch_status(spark.createDataFrame([("ok",), ("ok",), ("failed",)], "status string")).collect()} == {"ok": 2, "failed": 1}


def test_edge_lists_headers_and_packed(spark, tmp_path):
    import struct

    (tmp_path / "e.txt").write_text("0 1 2.5\n2\t0\n9 9 1\n")
    assert entries(mtx.read_edge_list(spark, str(tmp_path / "e.txt"), 3, 3)) == [(0, 1, 2.5), (2, 0, None)]
    p = tmp_path / "h" / "x.mtx"
    p.parent.mkdir()
    p.write_text("%%MatrixMarket matrix coordinate real symmetric\n" + "% filler\n" * 12_000 + "% name: Grp/x\n% kind: a graph\n2 2 1\n2 1 7\n")
    assert [(r["group"], r["kind"]) for r in mtx.header_table(spark, str(p.parent)).collect()] == [("Grp", "a graph")]
    h = mtx.read_header(spark, str(p))
    assert (h.rows, h.symmetry, h.group, h.kind) == (2, "symmetric", "Grp", "a graph")
    assert entries(mtx.read_mtx(spark, str(p))) == [(0, 1, 7.0), (1, 0, 7.0)]
    (tmp_path / "m.bmtx").write_bytes(struct.pack("<QQQBB", 3, 2, 2, 4, 8) + struct.pack("<IId", 0, 1, 1.5) + struct.pack("<IId", 2, 0, -1.0))
    m = files.read_bmtx(spark, str(tmp_path / "m.bmtx"))
    assert (m.rows, m.cols, entries(m)) == (3, 2, [(0, 1, 1.5), (2, 0, -1.0)])
    grid = files.grid_parts(m, 3, 2).collect()
    assert sorted((r["row_blk"], r["col_blk"]) for r in grid) == [(0, 1), (2, 0)]


def test_result_files(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.csv").write_text("b,a\n1.5,x\n")
    (tmp_path / "r" / "c.csv").write_text("a,b\ny,2\n")
    t = files.merge_results(spark, str(tmp_path / "r"), "a string, b double", str(tmp_path / "out"))
    assert sorted(map(tuple, t.collect())) == [("x", 1.5), ("y", 2.0)] == sorted(map(tuple, spark.read.csv(str(tmp_path / "out"), header=True, schema="a string, b double").collect()))
    files.write_report(spark.createDataFrame([("q", None)], "a string, b double"), str(tmp_path / "report"))
    assert "".join(f.read_text() for f in (tmp_path / "report").glob("part-*")) == "a,b\nq,\n"
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "j.txt").write_text('noise\n{"nnz": 3, "kind": "k"}\n')
    assert [tuple(r) for r in files.read_json_payloads(spark, str(tmp_path / "log"), "nnz long, kind string").collect()] == [(3, "k")]


def test_fingerprint_files(spark, tmp_path, capsys):
    from gridweave import __main__ as cli
    from gridweave.operators import features

    p = tmp_path / "t.mtx"
    p.write_text("%%MatrixMarket matrix coordinate pattern symmetric\n4 4 4\n2 1\n3 2\n3 1\n4 3\n")
    assert cli.main(["features", str(p), "--out", str(tmp_path / "f" / "t.csv"), "--with-betweenness"]) == 0
    assert cli.main(["features", str(tmp_path / "none.mtx"), "--out", str(tmp_path / "f" / "n.csv")]) == 0
    assert cli.main(["features", "--merge", str(tmp_path / "f"), "--out", str(tmp_path / "all")]) == 0
    t = {r["matrix"]: r for r in spark.read.csv(str(tmp_path / "all"), header=True, schema=features.SCHEMA).collect()}
    assert set(t) == {"t.mtx", "none.mtx"} and t["none.mtx"]["status"].startswith("error: ") and t["none.mtx"]["nnz"] is None
    r = t["t.mtx"]
    assert len(features.COLUMNS) == 74 and r["status"] == "ok" and (r["n_rows"], r["nnz"], r["n_components"], r["pattern_symmetric"]) == (4, 8, 1, 1)
    assert r["triangle_closure_rate"] == pytest.approx(3 / 5) and r["pseudo_diameter"] == 2 and r["row_max"] == 3 and r["load_s"] >= 0
    # Of the paths between pairs only the two from vertex 3 to 0 and 1 pass through vertex 2.
    assert r["approx_betweenness_max"] == pytest.approx(2 / 3) and r["approx_betweenness_mean"] == pytest.approx(2 / 3 / 4)
    assert cli.main([str(p)]) == 0 and "4 rows" in capsys.readouterr().out and cli.main([str(tmp_path / "none.mtx")]) == 1
    assert cli.main(["features", str(p)]) == 0 and capsys.readouterr().out.startswith("matrix,status,n_rows")


def test_fingerprint_without_entries(spark):
    from gridweave.operators import features
    from gridweave.operators.matrix import SparseMatrix

    m = SparseMatrix.build(spark.createDataFrame([], "row long, col long, val double"), 3, 2)
    r = features.fingerprint(m, "none").first()
    assert (r["nnz"], r["density"], r["row_mean"], r["n_components"], r["block16_occupied"], r["hub1pct_coverage"]) == (0, 0.0, 0.0, 5, 0, 0.0)
