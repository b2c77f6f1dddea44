"""Counts in cells: the same sums as the joins of arrays, without an array on disk for each edge."""

import os
import random

import numpy as np
import pytest

from tessera.operators import blocks, graph, hybrid, triangles
from tessera.operators.sketches import C, S, X


def written(spark) -> int:
    """Bytes of shuffle files that stand now."""
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return sum(os.path.getsize(f"{d}/{x}") for top in dirs for d, _, names in os.walk(str(top)) for x in names if x.startswith("shuffle_") and x.endswith(".data"))


@pytest.fixture(scope="module")
def some(spark):
    """Edges among 600 far and negative ids, over 250 a node, and their triangles."""
    rng = random.Random(3)
    ids = [rng.randrange(-(1 << 62), 1 << 62) for _ in range(600)]
    pairs = {tuple(sorted((rng.choice(ids), rng.choice(ids)))) for _ in range(120_000)}
    pairs = [p for p in pairs if p[0] != p[1]]
    place = {x: k for k, x in enumerate(ids)}
    a = np.zeros((600, 600), np.float32)
    for u, v in pairs:
        a[place[u], place[v]] = a[place[v], place[u]] = 1
    return spark.createDataFrame(pairs, "u bigint, v bigint"), round(float(((a @ a) * a).sum(dtype=np.float64)) / 6)


@pytest.mark.parametrize("run", ["count", "wedges", "hybrid", "report", "sweep"])
def test_no_array_is_written_for_each_edge(spark, some, run, request):
    from tessera.plans import report

    edges, want = some
    fwd = graph.orient(edges)
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of any size
    before = written(spark)
    if run in ("count", "wedges"):
        assert getattr(triangles, run)(fwd).first().triangles == want
    elif run == "hybrid":
        assert hybrid.hybrid(fwd, 1000).first().total == want
    elif run == "report":
        rows = {r.method: r for r in report.methods(fwd, 1000, 8).collect()}
        assert rows["exact"].estimate == rows["hybrid"].estimate == want
    else:
        assert {r.total for r in hybrid.sweep(fwd, [(8, 1000), (10, 1000), (10, 2000)]).collect()} == {want}
    assert written(spark) - before < 14_000_000  # arrays alone, as the joins ship them: over 100 neighbours, 800 bytes, an edge


@pytest.mark.parametrize("profile", [S, C, X])
def test_sums_equal_those_of_single_edges(spark, some, monkeypatch, profile):
    monkeypatch.setattr(blocks, "SMALL", 4_000)  # several blocks
    fwd = graph.orient(some[0].where("u % 4 = 0")).persist()
    want = hybrid.summary(hybrid.edge_details(fwd, 8, 6, profile, 12)).first()
    got = hybrid.hybrid(fwd, 8, 6, profile, 12).first()
    fwd.unpersist()
    for c in want.asDict():
        assert got[c] == pytest.approx(want[c], rel=1e-9), c


def test_no_edge(spark):
    fwd = spark.createDataFrame([], "src bigint, dst bigint")
    assert triangles.count(fwd).first().triangles == 0
    assert [r.total for r in hybrid.sweep(fwd, [(4, 0), (5, 0)]).collect()] == [0.0, 0.0]


@pytest.mark.parametrize("wedges, marks", [(3, 8), (50, 1 << 12), (1 << 19, 1 << 20)])
def test_supports_in_pieces_of_any_size(monkeypatch, wedges, marks):
    monkeypatch.setattr(blocks, "WEDGES", wedges)
    monkeypatch.setattr(blocks, "MARKS", marks)
    rng = np.random.default_rng(1)
    lists = [np.sort(rng.choice(500, rng.integers(1, 40), replace=False)) for _ in range(60)]
    size = np.array([len(x) for x in lists])
    a, b = np.sort(rng.integers(0, 60, 400)), rng.integers(0, 60, 400)
    got = blocks.supports(a, b, np.cumsum(size) - size, size, np.concatenate(lists).astype(np.int32), 500)
    assert got.tolist() == [len(np.intersect1d(lists[x], lists[y])) for x, y in zip(a, b, strict=True)]


def test_lists_survive_packing():
    top = (1 << 63) - 1
    src, lists = np.array([5, -top - 1, top, 0]), [[7, 8, 1 << 40], [-top - 1 + 3, -1, 0, 1 << 61], [-top - 1], [-1, 127, 254, 383]]
    size = np.array([len(x) for x in lists])
    with np.errstate(over="ignore"):
        data = blocks.encode(src, size, np.concatenate([np.array(x, np.int64) for x in lists]))
        assert blocks.decode(src, size, data).tolist() == sum(lists, [])
