"""Triangle counts that route each edge to the exact intersection or to sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from .blocks import Setting, totals
from .graph import adjacency, edge_costs, forward_degrees
from .sketches import Profile, S, dense, guard, intersections


def edge_details(fwd: DataFrame, gamma: int, p: int = 8, profile: Profile = S, theta: int | None = None, seed: int = 0, most_gb: float | None = None) -> DataFrame:
    """(src, dst, deg_u, deg_v, proxy, method, s_hat, s_clamped, wanted) for every edge.

    ``wanted``: the cost asks for sketches; without sketches of both ends (nodes below ``theta`` have none) the edge is
    exact after all; more than ``most_gb`` of sketches are refused. Each branch reads only its own edges, so arrays are shipped for cheap edges and registers for dear ones.
    """
    theta = gamma if theta is None and profile is S else theta or 0
    adj = adjacency(fwd)
    costs = edge_costs(fwd, adj.select("node", F.col("d_out").cast("bigint")))
    wanted = F.col("proxy") > gamma if profile.strict else F.col("proxy") >= gamma
    routed = costs.withColumn("wanted", wanted).withColumn("hll", F.col("wanted") & (F.col("proxy") >= theta))
    cheap = routed.where("not hll").join(adj.select(F.col("node").alias("dst"), F.col("nbrs").alias("nv")), "dst").join(adj.select(F.col("node").alias("src"), F.col("nbrs").alias("nu")), "src")
    s = F.size(F.array_intersect("nu", "nv")).cast("double")
    exact = cheap.select("src", "dst", "deg_u", "deg_v", "proxy", F.lit("exact").alias("method"), s.alias("s_hat"), s.alias("s_clamped"), "wanted")
    sketches = dense(adj, p, profile, theta, seed, most_gb)
    dear = routed.where("hll").join(sketches.toDF("dst", "rv"), "dst").join(sketches.toDF("src", "ru"), "src")
    hat = dear.select("src", "dst", "deg_u", "deg_v", "proxy", "wanted", intersections(p, profile)("ru", "rv", "deg_u", "deg_v").alias("s_hat"))
    upper = F.least("s_hat", F.col("proxy").cast("double")) if profile.upper else F.col("s_hat")
    hll = hat.select("src", "dst", "deg_u", "deg_v", "proxy", F.lit("hll").alias("method"), "s_hat", F.greatest(F.lit(0.0), upper).alias("s_clamped"), "wanted")
    return exact.unionByName(hll)


def summary(details: DataFrame) -> DataFrame:
    """Total and statistics of ``edge_details``, one row; ratios are 0 where their base is."""
    hll = F.col("method") == "hll"
    base = details.agg(
        F.coalesce(F.sum("s_clamped"), F.lit(0.0)).alias("total"),
        F.count("*").alias("n_edges"),
        F.count_if(hll).alias("n_approx"),
        F.count_if(~hll).alias("n_exact"),
        F.count_if(F.col("wanted") & ~hll).alias("n_fallback"),
        F.count_if(hll & (F.col("s_hat") != F.col("s_clamped"))).alias("n_clamped"),
        F.coalesce(F.sum(F.when(~hll, F.col("s_clamped"))), F.lit(0.0)).alias("exact_sum"),
        F.coalesce(F.sum(F.when(hll, F.col("s_clamped"))), F.lit(0.0)).alias("hll_sum"),
    )
    n, a, f = F.col("n_edges"), F.col("n_approx"), F.col("n_fallback")
    return base.select("*", ratio(a, n).alias("approx_coverage"), ratio(f, a + f).alias("fallback_ratio"), ratio(F.col("n_clamped"), a).alias("clamp_ratio"))


def routed(fwd: DataFrame, settings: list[Setting], exact: bool = False) -> DataFrame:
    """What ``summary`` gives of ``edge_details``, for each setting, in one pass over cells; and ``triangles`` with ``exact``."""
    t = totals(fwd, settings, exact).withColumn("n_exact", F.col("n_edges") - F.col("n_approx")).withColumn("total", F.col("exact_sum") + F.col("hll_sum"))
    n, a, f = F.col("n_edges"), F.col("n_approx"), F.col("n_fallback")
    ratios = ratio(a, n).alias("approx_coverage"), ratio(f, a + f).alias("fallback_ratio"), ratio(F.col("n_clamped"), a).alias("clamp_ratio")
    return t.select("setting", "triangles", "total", "n_edges", "n_approx", "n_exact", "n_fallback", "n_clamped", "exact_sum", "hll_sum", *ratios)


def hybrid(fwd: DataFrame, gamma: int, p: int = 8, profile: Profile = S, theta: int | None = None, seed: int = 0, most_gb: float | None = None) -> DataFrame:
    """One row: total and statistics."""
    setting = Setting(gamma, p, profile, theta, seed)
    if most_gb is not None:
        guard(forward_degrees(fwd).where(F.col("d_out") >= setting.least).count(), p, most_gb)
    return routed(fwd, [setting]).drop("setting", "triangles")


def pure(fwd: DataFrame, p: int = 8, profile: Profile = S, seed: int = 0, most_gb: float | None = None) -> DataFrame:
    """Every edge by sketches: (total, n_edges, n_clamped)."""
    return hybrid(fwd, -1, p, profile, 0, seed, most_gb).select("total", "n_edges", "n_clamped")


def sweep(fwd: DataFrame, grid: list[tuple[int, int]], profile: Profile = S) -> DataFrame:
    """(p, gamma, total, n_approx, n_clamped) for each setting of the grid; the graph is oriented, packed and shipped once for all."""
    pair = lambda k: F.element_at(F.array(*(F.lit(x[k]) for x in grid)), F.col("setting") + 1)
    found = routed(fwd, [Setting(gamma, p, profile) for p, gamma in grid])
    return found.select(pair(0).alias("p"), pair(1).alias("gamma"), "total", "n_approx", "n_clamped")
