"""The command line, its report, documents and timings; files; the order of dense ids."""

import csv
import gzip
import json

import pytest

from tessera import cli
from tessera.operators import graph, sketches, triangles
from tessera.plans import report
from tessera.sources import edges as sources

LINES = "# a graph\n0 1\n0 2\n0 3\n1 2\n1 3\n2 3 9\n3 4\n\n4 5\n5 5\n1 0\n"


@pytest.fixture()
def path(tmp_path):
    file = tmp_path / "graph.txt.gz"
    file.write_bytes(gzip.compress(LINES.encode()))
    return str(file)


def test_self_test(spark, capsys):
    assert cli.main(["--self-test"], spark) == 0
    assert "passed" in capsys.readouterr().out


@pytest.mark.parametrize("extra", [["--no-remap"], [], ["--partitions", "3"]])
def test_report_and_document(spark, path, tmp_path, capsys, extra):
    out = tmp_path / "r.json"
    assert cli.main([path, "--run", "exact,hybrid,pure,score,vertex", "--precision", "12", "--threshold", "1", "--json-out", str(out), "--csv-out", str(tmp_path / "r.csv"), *extra], spark) == 0
    text = capsys.readouterr().out
    assert "1.00x" in text and "100.0%" in text and "0.0000%" in text
    found = json.loads(out.read_text())
    assert found["graph"]["nodes"] == 6 and found["graph"]["edges"] == 8 and found["truth_source"] == "exact" and found["settings"]["threshold"] == 1
    rows = {r["method"]: r for r in found["results"]}
    assert all(rows[m]["estimate"] == 4 for m in ("exact", "score", "vertex"))
    assert abs(rows["pure"]["estimate"] - 4) < 0.1 and rows["pure"]["coverage"] == 1 and 0 < rows["hybrid"]["coverage"] < 1
    assert rows["exact"]["speedup"] == 1 and rows["exact"]["coverage"] is None
    with open(tmp_path / "r.csv") as f:
        assert {r["method"] for r in csv.DictReader(f)} == set(rows)


def test_report_without_truth_and_known_truth(spark, path, capsys):
    assert cli.main([path, "--run", "hybrid", "--threshold", "100"], spark) == 0
    assert cli.main([path, "--run", "hybrid", "--threshold", "100", "--truth", "0"], spark) == 0
    assert "inf" in capsys.readouterr().out


def test_refusals(spark, path, capsys):
    for argv in ([], [path, "--run", "nothing"], [path, "--precision", "3"], [path, "--one-indexed"], [path, "--threshold", "-1"]):
        with pytest.raises(SystemExit):
            cli.main(argv, spark)
    assert cli.main([path, "--run", "pure", "--max-sketch-gb", "0.000001"], spark) == 1
    assert "exceed" in capsys.readouterr().err
    fwd = graph.orient(sources.read_edges(spark, path))
    with pytest.raises(MemoryError):
        sketches.dense(graph.adjacency(fwd), 16, sketches.S, 0, 0, 1e-6)


def test_timings(spark, path):
    rows = report.timings(sources.read_edges(spark, path), [1, 9], repeat=1, warmup=0)
    assert rows.columns == ["strategy", "gamma", "time_ms", "throughput_edges_per_sec", "speedup_vs_exact", "light_pct", "heavy_pct", "cls_ms", "exact_ms", "hll_ms"]
    found = {r.strategy: r for r in rows.collect()}
    assert set(found) == {"all_exact_input", "all_exact_sorted", "all_hll", "hybrid_g1", "hybrid_g9"}
    assert found["hybrid_g9"].light_pct == 100 and 0 < found["hybrid_g1"].light_pct < 100 and found["all_exact_input"].speedup_vs_exact == 1


def test_edge_scores(spark, path):
    fwd = graph.orient(sources.read_edges(spark, path))
    got = {tuple(sorted((r.src, r.dst))): r.score for r in triangles.edge_scores(fwd).collect()}
    assert got == {(a, b): 2 for a in range(4) for b in range(a + 1, 4)}


@pytest.mark.parametrize("buckets", [1, 4, 50])
def test_dense_ids_of_uneven_keys(spark, buckets):
    keys = [2**62, -(2**61), *range(200), *(2**53 + k for k in range(5))]
    df = spark.createDataFrame([(k, "x", 1.0) for k in keys], "k bigint, part string, n double")
    got = {r.k: r.id for r in sources.dense(df, "k", buckets).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}
