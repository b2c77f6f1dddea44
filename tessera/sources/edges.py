"""Edge lists: text and gzip files, tables, literals; and the sinks for results."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPACE, TOKEN = r"[\s\x1c-\x1f\x85\xa0]", r"[^\s\x1c-\x1f\x85\xa0]+"


def read_lines(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """(line, value) of a text file, gzip by suffix; ``line`` grows within a file.

    Between the files of a folder it follows Spark's packing of splits, so labels are interned in the order of one file only.
    A gzip file is one split, so ``partitions`` deals its lines out again before anything else is done with them.
    """
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    return (lines.repartition(partitions) if partitions else lines).select("line", "value")


def once(df: DataFrame, value: Column, name: str, *keep: str) -> DataFrame:
    """``keep`` and ``value`` as ``name``, computed once a row.

    What reads a projected column gets its whole expression instead, once for each mention; behind a generator it does not.
    """
    return df.select(*keep, F.explode(F.array(value)).alias(name))


def parse(lines: DataFrame, delimiter: str | None = None, comments: str = "#%") -> DataFrame:
    """(line, a, b): the first two fields of each line.

    Blank lines, lines whose first character (after stripping) is in ``comments`` and lines of one field are skipped; a
    given delimiter keeps empty fields, white space does not.
    """
    lead = "".join(c for c in comments if not re.fullmatch(SPACE, c))  # no line begins with white space once stripped
    begins = lambda name: F.instr(F.lit(lead), F.substring(name, 1, 1)) > 0
    if delimiter is None:
        rows = once(lines, F.ltrim(F.replace("value", F.lit("\t"), F.lit(" "))), "v", "line", "value").where("v <> ''")
        rows = rows.where(~begins("v")) if lead else rows
        a = F.substring_index("v", " ", 1)
        b = F.substring_index(F.ltrim(F.substr("v", F.length(a) + 1)), " ", 1)
        rows = once(rows, F.struct(a.alias("a"), b.alias("b")), "x", "line", "value").select("line", "value", "x.a", "x.b")
        # two plain numbers between blanks and tabs hold no other white space, so they are the first two fields; all other lines take the slow way
        plain = [F.col(x).try_cast("bigint").cast("string") == F.col(x) for x in ("a", "b")]
        fields = F.when(plain[0] & plain[1], F.array("a", "b")).otherwise(F.regexp_extract_all("value", F.lit(TOKEN), F.lit(0)))
        rows = once(rows, fields, "f", "line").where(F.size("f") >= 2).select("line", F.col("f")[0].alias("a"), F.col("f")[1].alias("b"))
        return rows.where(~begins("a")) if lead else rows
    rows = once(lines, F.regexp_replace("value", rf"^{SPACE}+|{SPACE}+$", ""), "value", "line").where("value <> ''")
    rows = rows.where(~begins("value")) if lead else rows
    return once(rows, F.split("value", re.escape(delimiter)), "f", "line").where(F.size("f") >= 2).select("line", F.col("f")[0].alias("a"), F.col("f")[1].alias("b"))


def integer_pairs(pairs: DataFrame, one_indexed: bool = False, negative: bool = True) -> DataFrame:
    """(line, u, v) from fields that must be integers: others raise, and so do negative ids unless ``negative``."""
    def number(name: str):
        digits = F.regexp_replace(name, r"(?<=\d)_(?=\d)", "")
        x = F.when(F.regexp_like(digits, F.lit(r"^[+-]?\d+$")), digits.try_cast("bigint"))
        plain = F.col(name).try_cast("bigint")  # nearly all ids: no sign, zeros or marks that a cast might take otherwise
        return F.when(plain.cast("string") == F.col(name), plain).otherwise(x)

    def checked(name: str):
        x = F.when(F.col(name).isNull(), F.raise_error(F.format_string("line %s: expected integer node ids", "line")).cast("bigint")).otherwise(F.col(name))
        x = x - 1 if one_indexed else x
        return x if negative else F.when(x < 0, F.raise_error(F.format_string("line %s: negative node id after parsing", "line")).cast("bigint")).otherwise(x)

    read = once(pairs, F.struct(number("a").alias("u"), number("b").alias("v")), "x", "line").select("line", "x.u", "x.v")
    return once(read, F.struct(checked("u").alias("u"), checked("v").alias("v")), "x", "line").select("line", "x.u", "x.v")


def canonical(pairs: DataFrame, dedup: bool = True) -> DataFrame:
    """Edges (u, v) with u < v: self-loops go, and repeated edges unless ``dedup`` is off (a multigraph, or a list known to be simple)."""
    e = pairs.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return e.dropDuplicates(["u", "v"]) if dedup else e


def dense(keys: DataFrame, key: str, buckets: int = 1024) -> DataFrame:
    """``keys`` (distinct numbers in ``key``) with dense ids from 0 in the order of ``key``.

    Ranges between approximate quantiles are numbered apart, each from the count of the ranges before, so no task has to see
    all keys, however unevenly they lie. Any ends of the ranges give the same ids; the quantiles only make them even.
    """
    ends = keys.approxQuantile(key, [k / buckets for k in range(1, buckets)], 1 / (4 * buckets)) if buckets > 1 else []
    splits = [float("-inf"), *sorted(set(ends)), float("inf")]
    at = keys.withColumn("__x", F.col(key).cast("double"))  # rounding keeps the order, and equal doubles share a range
    parted = Bucketizer(splits=splits, inputCol="__x", outputCol="__part").transform(at).drop("__x") if ends else at.drop("__x").withColumn("__part", F.lit(0.0))
    sizes = parted.groupBy("__part").agg(F.count("*").alias("__n"))  # at most ``buckets`` rows
    before = sizes.withColumn("__base", F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__part")) - F.col("__n")).select("__part", "__base")
    order = Window.partitionBy("__part").orderBy(key)
    return parted.withColumn("__rank", F.row_number().over(order)).join(F.broadcast(before), "__part").withColumn("id", (F.col("__base") + F.col("__rank") - 1).cast("bigint")).drop("__part", "__rank", "__base")


def intern_labels(pairs: DataFrame) -> DataFrame:
    """(label, id): dense ids in the order of first appearance, also of labels that stand on self-loops only."""
    seen = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("label"), (F.col("line") * 2).alias("at")), F.struct(F.col("b").alias("label"), (F.col("line") * 2 + 1).alias("at")))).alias("x")).select("x.*")
    first = seen.groupBy("label").agg(F.min("at").alias("at"))
    return dense(first, "at").select("label", "id")


def labelled_pairs(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(line, u, v) with labels replaced by their ids."""
    a, b = labels.toDF("a", "u"), labels.toDF("b", "v")
    return pairs.join(a, "a").join(b, "b").select("line", "u", "v")


def remap(edges: DataFrame) -> DataFrame:
    """Edges over dense ids in the order of the nodes' ids, so that ties break as before."""
    ids = dense(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "node")
    return edges.join(ids.toDF("u", "x"), "u").join(ids.toDF("v", "y"), "v").select(F.col("x").alias("u"), F.col("y").alias("v"))


def read_edges(spark: SparkSession, path: str, delimiter: str | None = None, comments: str = "#%", remapped: bool = False, one_indexed: bool = False, dedup: bool = True, partitions: int | None = None) -> DataFrame:
    """Canonical edges of a file; with ``remapped`` any labels are taken and interned, else ids must be integers from 0 on."""
    pairs = parse(read_lines(spark, path, partitions), delimiter, comments)
    if remapped:
        return canonical(labelled_pairs(pairs, intern_labels(pairs)), dedup)
    return canonical(integer_pairs(pairs, one_indexed, negative=False), dedup)


def from_pairs(df: DataFrame, u: str, v: str, dedup: bool = True) -> DataFrame:
    """Canonical edges of any table with two node columns."""
    return canonical(df.select(F.col(u).cast("bigint").alias("u"), F.col(v).cast("bigint").alias("v")).dropna(), dedup)


def from_triangles(spark: SparkSession, triangles: Iterable[tuple[int, int, int]]) -> DataFrame:
    """The edges of literal triangles."""
    t = spark.createDataFrame(list(triangles), "a bigint, b bigint, c bigint")
    sides = F.array(*(F.struct(F.col(x).alias("u"), F.col(y).alias("v")) for x, y in (("a", "b"), ("b", "c"), ("a", "c"))))
    return canonical(t.select(F.explode(sides).alias("e")).select("e.*"))


def self_test_graph(spark: SparkSession) -> DataFrame:
    """Four nodes all joined, and a tail of two edges."""
    return canonical(spark.createDataFrame([(a, b) for a in range(4) for b in range(a + 1, 4)] + [(3, 4), (4, 5)], "u bigint, v bigint"))


def write_csv(df: DataFrame, path: str) -> None:
    """A report as CSV with a header, in the order of ``df``; reports are small by nature, so one file."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    """A report as JSON lines, in one file."""
    df.coalesce(1).write.mode("overwrite").json(path)
