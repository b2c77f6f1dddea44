"""Graphs derived from the relational tables, as DataFrames and as SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.edges import canonical, read_edges
from ..sources.shared import remove, shared_dir

SPAN = 4  # the tripartite graph interleaves its three id ranges
SHARES, SHARE_ROWS = 4, 2_000_000  # shares in which an edge-list text is written at most, and lines of orders from which it is cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def together(df: DataFrame, group: str, node: str, distinct: bool = True) -> DataFrame:
    """Pairs of nodes that share a group. A group's pairs are its own definition of the graph; orders have few lines.

    Rows are dealt once by group and pairs once by u, where both repeats go and degrees are looked up; unless ``distinct``,
    pairs stay where they are and come once for each group.
    """
    rows = df.select(F.col(group).alias("g"), F.col(node).cast("bigint").alias("x")).where("g IS NOT NULL AND x IS NOT NULL")
    sets = rows.groupBy("g").agg(F.sort_array(F.collect_set("x")).alias("xs"))
    first = sets.select("xs", F.posexplode("xs").alias("i", "u")).where(F.col("i") + 1 < F.size("xs"))
    pairs = first.select("u", F.explode(F.slice("xs", F.col("i") + 2, F.size("xs"))).alias("v"))
    return pairs.repartition("u").distinct() if distinct else pairs


def part_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """g1: parts of one order."""
    return together(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


def supplier_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """g2: suppliers of one order."""
    return together(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey")


def tripartite_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """g3: customer, part and supplier of each line."""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    c, p, s = F.col("o_custkey") * SPAN, F.col("l_partkey") * SPAN + 1, F.col("l_suppkey") * SPAN + 2
    sides = F.array(*(F.struct(a.alias("u"), b.alias("v")) for a, b in ((c, p), (p, s), (c, s))))
    return canonical(li.select(F.explode(sides).alias("e")).select("e.*"))


def returned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """g4: g1 over returned lines only, which is sparse."""
    return together(table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'"), "l_orderkey", "l_partkey")


def together_sql(node: str, where: str = "TRUE") -> str:
    return f"SELECT DISTINCT a.x AS u, b.x AS v FROM (SELECT DISTINCT l_orderkey AS g, CAST({node} AS BIGINT) AS x FROM lineitem WHERE {where}) a JOIN (SELECT DISTINCT l_orderkey AS g, CAST({node} AS BIGINT) AS x FROM lineitem WHERE {where}) b ON a.g = b.g AND a.x < b.x"


GRAPHS = {"g1": part_graph, "g2": supplier_graph, "g3": tripartite_graph, "g4": returned_graph}
EDGE_SQL = {
    "g1": together_sql("l_partkey"),
    "g2": together_sql("l_suppkey"),
    "g3": f"SELECT DISTINCT least(x, y) AS u, greatest(x, y) AS v FROM (SELECT unnest([c, p, c]) AS x, unnest([p, s, s]) AS y FROM (SELECT o_custkey * {SPAN} AS c, l_partkey * {SPAN} + 1 AS p, l_suppkey * {SPAN} + 2 AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey)) WHERE x <> y",
    "g4": together_sql("l_partkey", "l_returnflag = 'R'"),
}


def edge_file(spark: SparkSession, sf_dir: str, codec: str = "none", share: int = 0, shares: int = 1) -> str:
    """Path of g1 as an edge-list text, one file for each partition: every edge both ways, comments, blanks and loops.

    An edge of several orders stands there for each of them. With ``shares`` it holds the orders of one share alone.
    """
    path = f"{shared_dir(spark)}/edges-{uuid.uuid4().hex}"
    u, v = F.col("u").cast("string"), F.col("v").cast("string")
    lines = F.array(F.concat_ws("\t", u, v), F.concat_ws("  ", v, u, F.lit("0.5")), F.concat_ws(" ", F.lit("#"), u, v), F.lit("  "), F.concat_ws(" ", u, u))
    rows = table(spark, sf_dir, "lineitem").where(F.pmod(F.xxhash64("l_orderkey"), F.lit(shares)) == share)
    together(rows, "l_orderkey", "l_partkey", distinct=False).select(F.explode(lines)).write.option("zlib.compress.level", "BEST_SPEED").text(path, compression=codec)
    return path


def edges_read_back(spark: SparkSession, sf_dir: str, codec: str = "none", shares: int | None = None) -> DataFrame:
    """g1 from its edge-list text. The text is several times as large as the tables, so large ones are written, read and removed share by share."""
    shares = shares or min(SHARES, 1 + table(spark, sf_dir, "lineitem").count() // SHARE_ROWS)
    path, clean = f"{shared_dir(spark)}/pairs-{uuid.uuid4().hex}", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean, None)
    spark.conf.set(clean, "true")  # once a share's text stands, nothing needs the shuffle that led to it
    try:
        for share in range(shares):
            text = edge_file(spark, sf_dir, codec, share, shares)
            read_edges(spark, text, dedup=False).write.mode("append").parquet(path, compression="zstd")
            remove(spark, text)
    finally:
        spark.conf.unset(clean) if before is None else spark.conf.set(clean, before)
    return canonical(spark.read.schema("u bigint, v bigint").parquet(path))


def edge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line, value): an edge-list text made from nations, with comments, blanks, loops, reversed repeats, third columns and short lines."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"), F.col("n_regionkey").cast("bigint").alias("r"))
    k, far = F.col("k").cast("string"), ((F.col("k") * 7 + F.col("r")) % 25).cast("string")
    lines = [F.concat_ws("\t", k, far), F.concat_ws("  ", far, k, F.lit("0.5")), F.concat(F.lit(" \t# "), k, F.lit(" "), far), F.lit("   "), F.concat_ws(" ", k, k), k, F.concat(F.lit("% "), k), F.concat(F.lit("  +"), k, F.lit(" "), ((F.col("k") + 1) % 25).cast("string"), F.lit("\t9\t9 "))]
    return n.select("k", F.posexplode(F.array(*lines)).alias("i", "value")).select((F.col("k") * 8 + F.col("i")).alias("line"), "value")


EDGE_LINES_SQL = r"""SELECT k * 8 + i AS line, value FROM (SELECT k, unnest(range(8)) AS i, unnest([k || chr(9) || far, far || '  ' || k || '  0.5', ' ' || chr(9) || '# ' || k || ' ' || far, '   ', k || ' ' || k, CAST(k AS VARCHAR), '% ' || k, '  +' || k || ' ' || ((k + 1) % 25) || chr(9) || '9' || chr(9) || '9 ']) AS value
FROM (SELECT CAST(n_nationkey AS BIGINT) AS k, (CAST(n_nationkey AS BIGINT) * 7 + CAST(n_regionkey AS BIGINT)) % 25 AS far FROM nation))"""


def delimited_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line, value): suppliers and nations as labels with a two-character delimiter, with an empty field and a loop."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").cast("bigint").alias("n"))
    a, b = F.concat(F.lit("S"), F.col("k").cast("string")), F.concat(F.lit("N"), F.col("n").cast("string"))
    lines = [F.concat_ws("||", a, b, F.lit("1")), F.concat_ws("||", b, a), F.concat(F.lit("; "), a), F.concat_ws("||", F.concat(F.lit("loop"), (F.col("k") % 3).cast("string")), F.concat(F.lit("loop"), (F.col("k") % 3).cast("string"))), F.concat(F.lit("||"), b)]
    return s.select("k", F.posexplode(F.array(*lines)).alias("i", "value")).select((F.col("k") * 5 + F.col("i")).alias("line"), "value")


DELIMITED_SQL = """SELECT k * 5 + i AS line, value FROM (SELECT k, unnest(range(5)) AS i, unnest([a || '||' || b || '||1', b || '||' || a, '; ' || a, 'loop' || (k % 3) || '||' || 'loop' || (k % 3), '||' || b]) AS value
FROM (SELECT s_suppkey AS k, 'S' || s_suppkey AS a, 'N' || s_nationkey AS b FROM supplier))"""
