"""Binary files read in ranges by several tasks."""

import numpy as np
import pytest

from weftgraph.sources import ranged


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def graph(tmp_path):
    rng = np.random.default_rng(4)
    n, m = 500, 3000
    src = np.sort(np.where(rng.random(m) < 0.5, 17, rng.integers(40, n - 30, m)))  # a hub, rows without edges at both ends
    dst, w = rng.integers(0, n, m), rng.integers(1, 99, m)
    start = np.searchsorted(src, np.arange(n))
    (tmp_path / "g.bcsr").write_bytes(b"".join(x.astype("<u4").tobytes() for x in (np.array([n, m]), start, dst)))
    (tmp_path / "g.bcsrw").write_bytes(b"".join(x.astype("<u4").tobytes() for x in (np.array([m]), w)))
    return tmp_path, sorted(zip(src.tolist(), dst.tolist(), w.tolist(), strict=True))


@pytest.mark.parametrize("edges", [1, 7, 500, 10_000])
def test_one_file_many_tasks(spark, graph, edges):
    path, want = graph
    if edges == 1:
        reader = ranged.CsrReader({"path": str(path), "edges": "1", "weighted": "true"})
        parts = reader.partitions()
        assert len(parts) == 3000
        got = [r for p in parts[::97] for b in reader.read(p) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        assert got == [want_row for want_row in got if want_row in set(want)] and len(got) == len(parts[::97])
        return
    df = ranged.read_csr(spark, f"{path}/g.bcsr", weighted=True, edges=edges)
    assert df.rdd.getNumPartitions() == -(-3000 // edges) and rows(df) == want


def test_tasks_do_not_grow_with_the_ranges(spark, graph):
    """1,500 ranges of two edges and 1,200 of one number are shared by a bounded number of tasks."""
    path, want = graph
    df = ranged.read_csr(spark, f"{path}/g.bcsr", weighted=True, edges=2)
    most = max(512, 8 * spark.sparkContext.defaultParallelism)
    assert df.rdd.getNumPartitions() == most and rows(df) == want
    np.save(path / "x.npy", np.arange(1200))
    df = ranged.read_npy(spark, f"{path}/x.npy", 1)
    assert df.rdd.getNumPartitions() == most and rows(df) == [(i, [float(i)]) for i in range(1200)]


def test_blocks_of_row_starts(spark, graph, monkeypatch):
    monkeypatch.setattr(ranged, "BLOCK", 13)
    reader = ranged.CsrReader({"path": str(graph[0]), "edges": "700", "weighted": "true"})
    got = [r for p in reader.partitions() for b in reader.read(p) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert sorted(got) == graph[1]


def test_written_blocks_come_back(spark, tmp_path):
    edges = [(0, 5, 1), (0, 6, 2), (9, 0, 3), (9, 0, 3), (41, 2, 7)]  # blocks 1 to 3 have no edge
    ranged.write_csr(spark.createDataFrame(edges, "src long, dst long, w long"), f"{tmp_path}/out", 10)
    assert rows(ranged.read_csr(spark, f"{tmp_path}/out", weighted=True, edges=2, rows_per_file=10)) == sorted(edges)
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith(".")]


def test_a_cut_file_is_an_error(spark, graph):
    path = graph[0] / "g.bcsr"
    path.write_bytes(path.read_bytes()[:-4])
    with pytest.raises(Exception, match="ends before"):
        ranged.read_csr(spark, str(path), edges=500).count()


def test_arrays(spark, tmp_path):
    x = np.arange(700, dtype="<f4").reshape(100, 7)
    np.save(tmp_path / "a.npy", x)
    np.save(tmp_path / "b.npy", x[:3] > 300)
    df = ranged.read_npy(spark, str(tmp_path), 9)
    assert df.rdd.getNumPartitions() == 13
    got = {r["id"]: r["x"] for r in df.collect()}
    assert [got[i] for i in range(100)] == x.tolist() and [got[100 + i] for i in range(3)] == (x[:3] > 300).astype(float).tolist()
    np.save(tmp_path / "c.npy", np.arange(5))
    assert {r["id"]: r["x"] for r in ranged.read_npy(spark, f"{tmp_path}/c.npy", 2).collect()} == {i: [float(i)] for i in range(5)}
    np.save(tmp_path / "d.npy", np.asfortranarray(x))
    with pytest.raises(Exception, match="row order"):
        ranged.read_npy(spark, f"{tmp_path}/d.npy").count()
    ranged.write_npy(df, f"{tmp_path}/again", 40)
    assert {r["id"]: r["x"] for r in ranged.read_npy(spark, f"{tmp_path}/again", 11).collect()} == got


def test_no_files(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert ranged.read_csr(spark, f"{tmp_path}/none").count() == 0 and ranged.read_npy(spark, f"{tmp_path}/none").count() == 0
