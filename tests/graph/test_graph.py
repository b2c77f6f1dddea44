import gzip
import itertools
import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import hashing
from tessera.operators import graph, hybrid, sampling, sketches, triangles
from tessera.operators.sketches import C, S, X
from tessera.plans import fixtures, report
from tessera.sources import edges as sources
from tessera.sources.shared import shared_dir


def edges_of(spark, pairs):
    return sources.canonical(spark.createDataFrame(list(pairs), "u bigint, v bigint"))


def total(edges):
    return triangles.triangles(edges).first().triangles


def brute(pairs):
    near = {}
    for a, b in {(min(p), max(p)) for p in pairs if p[0] != p[1]}:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return sum(len(near[a] & near[b]) for a in near for b in near[a] if a < b) // 3


GRAPHS = {
    "empty": [],
    "edge": [(1, 2)],
    "triangle": [(1, 2), (2, 3), (3, 1)],
    "tail": [(a, b) for a in range(4) for b in range(a + 1, 4)] + [(3, 4), (4, 5)],
    "complete": list(itertools.combinations(range(9), 2)),
    "star": [(0, k) for k in range(1, 20)],
    "bipartite": [(a, 100 + b) for a in range(6) for b in range(6)],
    "messy": [(2, 1), (1, 2), (1, 2), (3, 3), (3, 1), (2, 3), (-5, 2), (-5, 1)],
    "random": [(random.Random(k).randrange(60), random.Random(k + 10**6).randrange(60)) for k in range(700)],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_every_exact_form_agrees(spark, name):
    edges = edges_of(spark, GRAPHS[name]).cache()
    want = brute(GRAPHS[name])
    fwd = graph.orient(edges).cache()
    assert total(edges) == want
    assert triangles.wedges(fwd).first().triangles == want
    assert triangles.listed(fwd).count() == want
    assert triangles.edge_score_third(edges).first().triangles == want
    assert triangles.vertex_third(fwd).first().triangles == want
    assert (triangles.edge_support(fwd).agg(F.sum("support").alias("t")).first().t or 0) == want
    m = edges.count()
    assert triangles.edge_support(fwd).count() == m == fwd.count()
    deg = graph.degrees(edges)
    assert (deg.agg(F.sum("deg").alias("t")).first().t or 0) == 2 * m
    assert (graph.degree_histogram(deg).agg(F.sum("node_count").alias("t")).first().t or 0) == graph.nodes(edges).count()


def test_closed_forms():
    assert brute(GRAPHS["complete"]) == math.comb(9, 3) and brute(GRAPHS["tail"]) == 4
    assert brute(GRAPHS["star"]) == brute(GRAPHS["bipartite"]) == 0


def test_orientation_is_acyclic_and_bounded(spark):
    edges = edges_of(spark, GRAPHS["random"])
    deg = {r.node: r.deg for r in graph.degrees(edges).collect()}
    fwd = [(r.src, r.dst) for r in graph.orient(edges).collect()]
    assert all((deg[a], a) < (deg[b], b) for a, b in fwd)
    assert graph.forward_degrees(graph.orient(edges)).agg(F.max("d_out").alias("m")).first().m <= math.isqrt(2 * len(fwd)) + 1


# ---- sources


def test_files_plain_and_gzip(spark, tmp_path):
    text = "# head\n% other\n\n 1\t2\t0.5\n2 1\n3\n4 4\n\t+7 1_0\r\n"
    plain, packed = tmp_path / "g.txt", tmp_path / "g.txt.gz"
    plain.write_text(text)
    packed.write_bytes(gzip.compress(text.encode()))
    for path, parts in ((plain, None), (packed, 3)):
        got = {(r.u, r.v) for r in sources.read_edges(spark, str(path), partitions=parts).collect()}
        assert got == {(1, 2), (7, 10)}
    assert {(r.u, r.v) for r in sources.read_edges(spark, str(plain), one_indexed=True).collect()} == {(0, 1), (6, 9)}


@pytest.mark.parametrize("text,message", [("1 2\n3 x\n", "expected integer"), ("1 -2\n", "negative")])
def test_bad_ids_raise(spark, tmp_path, text, message):
    (tmp_path / "g.txt").write_text(text)
    with pytest.raises(Exception, match=message):
        sources.read_edges(spark, str(tmp_path / "g.txt")).collect()


ODD = ["1 2", " \t1\t 2 9 9", "1\x0b2\x0c3", "\x1c1\x1f2\x85", "\xa01\xa0 2\xa0", "# 1 2", "\x0b# 1 2", "\t%1 2", "1#2 3", "a b", "é  ü x", "7", "", " \t ", "\x85", "007 +8", "-0 1_0", "1.0 2", "1\x002 3", "99999999999999999999 1", "1 2\x0b3", "1\xa0x 5 6"]


def test_fields_of_odd_lines(spark):
    got = {r.line: (r.a, r.b) for r in sources.parse(spark.createDataFrame(list(enumerate(ODD)), "line bigint, value string")).collect()}
    want = {i: [x for x in re.split(sources.SPACE, line) if x] for i, line in enumerate(ODD)}
    assert got == {i: tuple(f[:2]) for i, f in want.items() if len(f) > 1 and f[0][0] not in "#%"}


@pytest.mark.parametrize("a,x", [("0", 0), ("-0", 0), ("007", 7), ("+8", 8), ("1_0", 10), ("-9223372036854775808", -(2**63)), ("9223372036854775808", None), ("1.0", None), ("1e3", None), ("1\x00", None), ("_1", None), ("٣", None)])
def test_integers_as_written(spark, a, x):
    pairs = sources.integer_pairs(spark.createDataFrame([(0, a, "5")], "line bigint, a string, b string"))
    if x is None:
        with pytest.raises(Exception, match="expected integer"):
            pairs.collect()
    else:
        assert [tuple(r) for r in pairs.collect()] == [(0, x, 5)]


def test_each_line_is_parsed_once(spark, tmp_path):
    (tmp_path / "g.txt").write_text("1 2\n")
    plan = sources.read_edges(spark, str(tmp_path / "g.txt"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") + plan.count("regexp_extract_all(") == 1
    assert plan.count("regexp_replace(") <= 4  # marks of a number, for numbers that are not plain


@pytest.mark.parametrize("codec", ["none", "gzip"])
def test_edge_text_goes_share_by_share(spark, codec):
    sf, folder = "/root/testdata/sf0.001", shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    got = [tuple(r) for r in fixtures.edges_read_back(spark, sf, codec, shares=3).collect()]
    assert sorted(got) == sorted(tuple(r) for r in fixtures.part_graph(spark, sf).collect())
    left = set(os.listdir(folder)) - before
    assert len(left) == 1 and next(iter(left)).startswith("pairs-")  # the text is gone


def test_labels_in_order_of_appearance(spark, tmp_path):
    (tmp_path / "g.txt").write_text("b,a\nc,c\n;x,y\na,,\nb,a\nd,\n")
    pairs = sources.parse(sources.read_lines(spark, str(tmp_path / "g.txt")), ",", ";")
    labels = {r.label: r.id for r in sources.intern_labels(pairs).collect()}
    assert labels == {"b": 0, "a": 1, "c": 2, "": 3, "d": 4}
    assert {(r.u, r.v) for r in sources.read_edges(spark, str(tmp_path / "g.txt"), ",", ";", remapped=True).collect()} == {(0, 1), (1, 3), (3, 4)}
    assert sources.read_edges(spark, str(tmp_path / "g.txt"), ",", ";", remapped=True, dedup=False).count() == 4


def test_dense_ids(spark):
    keys = [-(2**40), -3, 0, 1, 2, 5, 2**40, 2**41]
    got = {r.k: r.id for r in sources.dense(spark.createDataFrame([(k,) for k in keys], "k bigint"), "k", buckets=3).collect()}
    assert got == {k: i for i, k in enumerate(keys)}
    assert sources.dense(spark.range(0).toDF("k"), "k").count() == 0


def test_literals_and_sinks(spark, tmp_path):
    assert total(sources.from_triangles(spark, [(1, 2, 3), (2, 3, 4)])) == 2
    assert total(sources.self_test_graph(spark)) == 4
    hist = graph.degree_histogram(graph.degrees(sources.self_test_graph(spark))).orderBy("degree")
    sources.write_csv(hist, str(tmp_path / "csv"))
    sources.write_json(hist, str(tmp_path / "json"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["degree", "node_count", "fraction"]
    assert spark.read.json(str(tmp_path / "json")).count() == hist.count()
    doc = graph.statistics_document(graph.degrees(sources.self_test_graph(spark)), sources.self_test_graph(spark), True, 2).first().document
    assert '"top_degrees":[{"node":3,"degree":4}' in doc and '"used_edges":8' in doc


def test_multigraph_degrees(spark):
    raw = spark.createDataFrame([(1, 2), (2, 1), (1, 1)], "u bigint, v bigint")
    assert {r.node: r.deg for r in graph.degrees(sources.canonical(raw, dedup=False)).collect()} == {1: 2, 2: 2}


def test_degree_statistics(spark):
    deg = spark.createDataFrame([(k, d) for k, d in enumerate([1, 1, 2, 3, 4, 7, 8, 8])], "node bigint, deg bigint")
    s = graph.degree_summary(deg).first()
    d = np.array([1, 1, 2, 3, 4, 7, 8, 8.0])
    assert (s.active_nodes, s.degree_sum, s.min_degree, s.max_degree, s.degree_1_nodes) == (8, 34, 1, 8, 2)
    assert abs(s.std_degree - d.std()) < 1e-9 and abs(s.density_active_nodes - 34 / 56) < 1e-12
    assert [(r.bucket, r.node_count) for r in graph.degree_log2_buckets(deg).orderBy("degree_low").collect()] == [("[1,1]", 2), ("[2,3]", 2), ("[4,7]", 2), ("[8,15]", 2)]
    assert [(r.node, r.degree) for r in graph.top_degrees(deg, 3).collect()] == [(6, 8), (7, 8), (5, 7)] and graph.top_degrees(deg, 0).count() == 0
    nothing = graph.degree_summary(deg.where("false")).first()
    assert (nothing.active_nodes, nothing.degree_sum, nothing.avg_degree, nothing.density_active_nodes) == (0, 0, 0.0, 0.0)


# ---- sketches

M64 = (1 << 64) - 1


def py_mix(z):
    z = (z ^ (z >> 30)) * hashing.MULTIPLIER_1 & M64
    z = (z ^ (z >> 27)) * hashing.MULTIPLIER_2 & M64
    return z ^ (z >> 31)


def py_register(x, p, profile):
    if profile is X:
        h = (x & 0xFFFFFFFF) ^ hashing.MURMUR_SEED
        for _ in range(2):
            h = (h ^ h >> 16) * hashing.MURMUR_MULTIPLIER & 0xFFFFFFFF
        h ^= h >> 16
        rest, rho = (h << p & 0xFFFFFFFF) | 1, 1
        for bit in range(31 - p, -1, -1):
            if rest >> bit & 1:
                break
            rho += 1
        return h >> (32 - p), rho
    h = py_mix(x & M64) if profile is S else py_mix((x + hashing.GAMMA) & M64)
    j, w = (h >> (64 - p), h & ((1 << (64 - p)) - 1)) if profile is S else (h & ((1 << p) - 1), h >> p)
    return j, 64 - p - w.bit_length() + 1


IDS = [0, 1, 2, 3, 77, 2**31 - 1, 2**40 + 5, 2**62 + 1, -1, -12345]


def test_hash_literals(spark):
    got = [r.h & M64 for r in hashing.with_hash64(spark.createDataFrame([(0,), (1,), (2,)], "x bigint"), F.col("x"), "h").orderBy("x").collect()]
    assert got == [0, 6238072747940578789, 15839785061582574730]


@pytest.mark.parametrize("p", [4, 8, 10, 16])
@pytest.mark.parametrize("profile", [S, C, X])
def test_registers_equal_loops(spark, p, profile):
    want = [py_register(x, p, profile) for x in IDS]
    got = sketches.with_register(spark.createDataFrame([(x,) for x in IDS], "x bigint").coalesce(1), F.col("x"), p, profile)
    assert [(r.j, r.rho) for r in got.collect()] == want
    nj, nr = sketches.np_register(np.array(IDS), p, profile, 0)
    assert list(zip(nj.tolist(), nr.tolist(), strict=True)) == want


def test_bit_length_is_exact():
    xs = [0, 1, 2**32 - 1, 2**32, 2**53 + 1, 2**56 - 1, 2**63, 2**64 - 1]
    assert sketches.np_bit_length(np.array(xs, np.uint64)).tolist() == [x.bit_length() for x in xs]


def test_dense_equals_sparse(spark):
    fwd = graph.orient(edges_of(spark, GRAPHS["random"]))
    for p, profile in ((4, S), (8, C), (8, X)):
        sparse = {(r.node, r.j): r.rho for r in sketches.registers(fwd, p, profile, theta=3).collect()}
        packed = {(r.node, j): v for r in sketches.dense(graph.adjacency(fwd), p, profile, 3).collect() for j, v in enumerate(r.regs) if v}
        assert sparse == packed
        est = {r.node: r.estimate for r in sketches.cardinalities(sketches.registers(fwd, p, profile, theta=3), p, profile).collect()}
        for r in sketches.dense(graph.adjacency(fwd), p, profile, 3).collect():
            assert abs(est[r.node] - sketches.np_estimate(np.frombuffer(r.regs, np.uint8)[None, :], p, profile)[0]) < 1e-9


def test_precision_and_memory_guards():
    for p in (3, 17):
        with pytest.raises(ValueError):
            sketches.check(p)
    assert sketches.memory_bytes(10) == 1024
    with pytest.raises(MemoryError):
        sketches.guard(2**30, 8, 1.0)
    assert [sketches.alpha(m) for m in (16, 32, 64)] == [0.673, 0.697, 0.709]


def test_hybrid_invariants(spark):
    fwd = graph.orient(edges_of(spark, GRAPHS["random"])).cache()
    exact, m = brute(GRAPHS["random"]), fwd.count()
    for profile in (S, C, X):
        far = hybrid.hybrid(fwd, 10**6, 8, profile).first()
        assert far.total == exact and far.n_approx == 0 and far.n_exact == far.n_edges == m
        near = hybrid.hybrid(fwd, 5, 8, profile).first()
        assert near.n_exact + near.n_approx == m and near.n_approx > 0
        assert abs(near.exact_sum + near.hll_sum - near.total) < 1e-6
    for r in hybrid.edge_details(fwd, 5).collect():
        assert 0 <= r.s_clamped <= max(r.proxy, 0) and r.proxy == min(r.deg_u, r.deg_v)
    fell = hybrid.hybrid(fwd, 5, 8, S, theta=7).first()
    assert fell.n_fallback > 0 and fell.n_fallback + fell.n_approx == hybrid.hybrid(fwd, 5, 8, S).first().n_approx
    assert hybrid.pure(fwd, 8).first().n_edges == m
    empty = hybrid.hybrid(fwd.where("false"), 5).first()
    assert (empty.total, empty.n_edges, empty.clamp_ratio) == (0.0, 0, 0.0)


def test_sampling(spark):
    edges = edges_of(spark, GRAPHS["random"]).cache()
    fwd = graph.orient(edges).cache()
    exact = brute(GRAPHS["random"])
    for f in (sampling.doulion, sampling.doulion_rand):
        assert f(edges, 1.0).first().estimate == exact
        assert f(edges.where("false"), 0.5).first().estimate == 0.0
    assert sampling.doulion_forward(fwd, 0.6).first().estimate == sampling.doulion(edges, 0.6).first().estimate
    each = [sampling.doulion(edges, 0.6, s).first().estimate for s in range(42, 47)]
    assert [r.estimate for r in sampling.doulion_seeds(fwd, 0.6, 5).orderBy("seed").collect()] == each
    r = sampling.doulion_repeated(fwd, 0.6, 5).first()
    assert abs(r.mean_estimate - np.mean(each)) < 1e-6 and abs(r.std_estimate - np.std(each)) < 1e-6


def test_reports(spark):
    edges = edges_of(spark, GRAPHS["random"])
    rows = {r.method: r for r in report.experiment(edges, {"exact", "hybrid", "doulion", "score", "vertex", "pure"}, gamma=5, q=0.5).collect()}
    assert rows["exact"].rel_error == rows["score"].rel_error == rows["vertex"].bias == 0 and rows["hybrid"].rel_error < 1
    assert report.experiment(edges, {"hybrid"}, gamma=10**6, truth=brute(GRAPHS["random"])).first().bias == 0
    for bad in (({"other"}, 8, 1), ({"exact"}, 3, 1), ({"exact"}, 8, -1)):
        with pytest.raises(ValueError):
            report.validate(*bad)
    assert len(report.SWEEP) == 5
