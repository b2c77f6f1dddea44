"""Degrees, orientation, adjacency, and degree statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import proxy_label, ratio


def nodes(edges: DataFrame) -> DataFrame:
    """Distinct endpoints."""
    return edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, deg): incident edges of each node; a multigraph's repeated edges count."""
    return edges.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("deg"))


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of every edge."""
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def orient(edges: DataFrame, deg: DataFrame | None = None) -> DataFrame:
    """(src, dst): every edge from the smaller to the larger end by (degree, id); out-degrees then stay below sqrt(2 m)."""
    deg = deg if deg is not None else degrees(edges)
    both = edges.join(deg.toDF("u", "du"), "u").join(deg.toDF("v", "dv"), "v")
    up = (F.col("du") < F.col("dv")) | ((F.col("du") == F.col("dv")) & (F.col("u") < F.col("v")))
    return both.select(F.when(up, F.col("u")).otherwise(F.col("v")).alias("src"), F.when(up, F.col("v")).otherwise(F.col("u")).alias("dst"))


def adjacency(fwd: DataFrame, sinks: bool = True) -> DataFrame:
    """(node, nbrs, d_out): sorted out-neighbours; with ``sinks`` nodes without any have an empty array."""
    adj = fwd.groupBy(F.col("src").alias("node")).agg(F.sort_array(F.collect_list("dst")).alias("nbrs")).withColumn("d_out", F.size("nbrs"))
    if not sinks:
        return adj
    everyone = fwd.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return everyone.join(adj, "node", "left").select("node", F.coalesce("nbrs", F.array().cast("array<bigint>")).alias("nbrs"), F.coalesce("d_out", F.lit(0)).alias("d_out"))


def symmetric_adjacency(edges: DataFrame) -> DataFrame:
    """(node, nbrs, d_out) over both directions."""
    return adjacency(symmetric(edges).toDF("src", "dst"), sinks=False)


def forward_degrees(fwd: DataFrame) -> DataFrame:
    """(node, d_out) of every node, 0 for sinks."""
    each = fwd.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("k")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("k")))).alias("x")).select("x.*")
    return each.groupBy("node").agg(F.sum("k").cast("bigint").alias("d_out"))


def edge_costs(fwd: DataFrame, d_out: DataFrame | None = None) -> DataFrame:
    """(src, dst, deg_u, deg_v, proxy): out-degrees of both ends and the smaller one, which routes."""
    d = d_out if d_out is not None else forward_degrees(fwd)
    both = fwd.join(d.toDF("src", "deg_u"), "src").join(d.toDF("dst", "deg_v"), "dst")
    return both.select("src", "dst", "deg_u", "deg_v", F.least("deg_u", "deg_v").alias("proxy"))


def classify(costs: DataFrame, gamma: int) -> DataFrame:
    """light: the cost is gamma or less."""
    return costs.withColumn("light", F.col("proxy") <= gamma)


def proxy_buckets(costs: DataFrame) -> DataFrame:
    """(bucket, edges) over the labelled cost buckets."""
    return costs.groupBy(proxy_label(F.col("proxy")).alias("bucket")).agg(F.count("*").alias("edges"))


def by_cost(costs: DataFrame, partitions: int) -> DataFrame:
    """Edges dealt out and sorted by cost: a layout experiment, without effect on results."""
    return costs.repartitionByRange(partitions, "proxy").sortWithinPartitions("proxy")


def max_cost(costs: DataFrame) -> DataFrame:
    """The largest routing cost, 0 without edges."""
    return costs.agg(F.coalesce(F.max("proxy"), F.lit(0)).cast("bigint").alias("max_cost"))


def forward_summary(d_out: DataFrame) -> DataFrame:
    """max_d_out and mean_d_out over all nodes."""
    return d_out.agg(F.max("d_out").cast("bigint").alias("max_d_out"), F.avg("d_out").alias("mean_d_out"))


def degree_summary(deg: DataFrame) -> DataFrame:
    """Nodes, degree sum, mean, spread, extremes, density and nodes of degree 1 in one pass."""
    d = F.col("deg").cast("double")
    base = deg.agg(F.count("*").alias("active_nodes"), F.sum("deg").alias("degree_sum"), F.sum(d * d).alias("sq"), F.min("deg").alias("min_degree"), F.max("deg").alias("max_degree"), F.count_if(F.col("deg") == 1).alias("degree_1_nodes"), F.max("node").alias("max_node_id"))
    n, s = F.col("active_nodes"), F.col("degree_sum")
    mean = ratio(s, n)
    spread = F.sqrt(F.greatest(F.lit(0.0), ratio(F.col("sq"), n) - mean * mean))
    density = F.when(n > 1, s.cast("double") / (n.cast("double") * (n.cast("double") - 1))).otherwise(F.lit(0.0))
    return base.select("active_nodes", F.coalesce(s, F.lit(0)).alias("degree_sum"), mean.alias("avg_degree"), "min_degree", "max_degree", spread.alias("std_degree"), density.alias("density_active_nodes"), "degree_1_nodes", "max_node_id")


def degree_histogram(deg: DataFrame) -> DataFrame:
    """(degree, node_count, fraction) of the degrees that occur."""
    bins = deg.groupBy(F.col("deg").alias("degree")).agg(F.count("*").alias("node_count"))
    total = bins.agg(F.sum("node_count").alias("t"))
    return bins.crossJoin(F.broadcast(total)).select("degree", "node_count", ratio(F.col("node_count"), F.col("t")).alias("fraction"))


def degree_log2_buckets(deg: DataFrame) -> DataFrame:
    """(bucket, degree_low, degree_high, node_count, fraction) over powers of two; the bit length gives the exponent exactly."""
    bins = deg.where("deg > 0").groupBy((F.length(F.bin("deg")) - 1).alias("k")).agg(F.count("*").alias("node_count"))
    total = bins.agg(F.sum("node_count").alias("t"))
    low, high = F.expr("shiftleft(1L, k)"), F.expr("shiftleft(1L, k + 1) - 1")
    out = bins.crossJoin(F.broadcast(total)).select(low.alias("degree_low"), high.alias("degree_high"), "node_count", ratio(F.col("node_count"), F.col("t")).alias("fraction"))
    return out.select(F.concat(F.lit("["), F.col("degree_low").cast("string"), F.lit(","), F.col("degree_high").cast("string"), F.lit("]")).alias("bucket"), "degree_low", "degree_high", "node_count", "fraction")


def top_degrees(deg: DataFrame, k: int) -> DataFrame:
    """The k nodes of highest degree, smaller ids first on ties; none if k is 0 or less."""
    return deg.orderBy(F.desc("deg"), "node").limit(max(k, 0)).select("node", F.col("deg").alias("degree"))


def statistics_document(deg: DataFrame, raw_edges: DataFrame, dedup: bool, k: int = 10) -> DataFrame:
    """One row with a JSON document: counts, degree summary and the top nodes (k of them, so the list is bounded)."""
    used = raw_edges.dropDuplicates(["u", "v"]) if dedup else raw_edges
    top = top_degrees(deg, k).agg(F.sort_array(F.collect_list(F.struct((-F.col("degree")).alias("o"), "node", "degree"))).alias("t")).select(F.transform("t", lambda x: F.struct(x["node"].alias("node"), x["degree"].alias("degree"))).alias("top_degrees"))
    parts = raw_edges.agg(F.count("*").alias("raw_edges")).crossJoin(used.agg(F.count("*").alias("used_edges"))).crossJoin(degree_summary(deg)).crossJoin(top)  # one row each
    return parts.select(F.to_json(F.struct("*")).alias("document"))
