"""Every registered graph query against its DuckDB SQL on the smallest tables, compared as the driver does."""

import os

import duckdb
import pytest

from tessera.plans import catalogue, fixtures, report, sql
from tessera.sources.shared import shared_dir

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def normal(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(map(repr, df.astype(object).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    want = duck.sql(catalogue.oracle_sql()[name]).df()
    a, b = normal(got), normal(want)
    assert a[0] == b[0]
    assert a[1] == b[1], (a[1][:3], b[1][:3])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def brute(duck):
    """Neighbours and edges of g1."""
    near = {}
    edges = duck.sql(fixtures.EDGE_SQL["g1"]).fetchall()
    for u, v in edges:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    return near, edges


def test_whole_graph_operators_see_every_edge(spark, duck):
    near, edges = brute(duck)
    run = lambda name: catalogue.queries()[name](spark, SF)
    total = sum(len(near[u] & near[v]) for u, v in edges) // 3
    key = lambda x: (len(near[x]), x)
    support = {tuple(sorted((r.src, r.dst))): r.support for r in run("edge_support_g1").collect()}
    above = {x: {y for y in near[x] if key(y) > key(x)} for x in near}
    assert support == {e: len(above[e[0]] & above[e[1]]) for e in map(tuple, edges)}
    listed = {tuple(sorted(r)) for r in run("triangle_list_g1").collect()}
    assert len(listed) == total == run("triangles_wedge_join_g1").first().triangles
    assert all(b in near[a] and c in near[a] and c in near[b] for a, b, c in listed)
    assert run("pure_hll_c_g1").first().n_edges == run("all_hll_x_g1").first().n_edges == len(edges)


def test_whole_graph_thresholds_route_both_ways(spark, duck):
    got = {(r.p, r.gamma): r for r in catalogue.queries()["hybrid_sweep_p_gamma_g1"](spark, SF).collect()}
    assert set(got) == set(report.SWEEP)
    for p, g in report.SWEEP:
        text = sql.with_graph("SELECT round(sum(s_clamped), 2), sum(CASE WHEN hll THEN 1 ELSE 0 END), sum(CASE WHEN hll AND s_hat <> s_clamped THEN 1 ELSE 0 END) FROM y", "g1", "y", regs=(p, "s", g), gamma=f">= {g}")
        assert tuple(got[p, g])[2:] == duck.sql(text).fetchall()[0]
    assert got[8, 64].n_approx > 0
    fall = catalogue.queries()["hybrid_fallback_g1"](spark, SF).first()
    assert fall.n_fallback > 0 and fall.n_approx > 0
    heavy = catalogue.queries()["hybrid_x_light_heavy_g1"](spark, SF).first()
    assert heavy.light > 0 and heavy.heavy > 0


@pytest.mark.parametrize("name", ["read_edges_text", "read_edges_gzip"])
def test_no_edge_text_is_left(spark, name):
    folder = shared_dir(spark).removeprefix("file://")
    texts = lambda: {x for x in os.listdir(folder) if x.startswith("edges-")}
    before = texts()
    assert catalogue.queries()[name](spark, SF).count() == 8899
    assert texts() == before
