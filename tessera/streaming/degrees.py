"""Degree counts over a growing edge list; an extension, as the batch engine has no stream of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.edges import canonical, integer_pairs, parse


def edge_stream(spark: SparkSession, folder: str, comments: str = "#%") -> DataFrame:
    """Canonical edges of text files as they arrive in ``folder``; repeated edges stay, as a multigraph's do."""
    lines = spark.readStream.text(folder).withColumn("line", F.lit(0).cast("bigint"))
    return canonical(integer_pairs(parse(lines, None, comments)), dedup=False)


def degree_stream(edges: DataFrame) -> DataFrame:
    """(node, deg) so far; the state is one counter a node."""
    return edges.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("deg"))
