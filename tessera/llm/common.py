"""Shared plumbing: Arrow buffers as numpy, vectorised word and window hashes, checkpoints, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Odd multipliers of the splitmix64 finaliser (public domain constants).
MIX1, MIX2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch: texts vary too much in length for a bound by rows alone.
BATCH_BYTES = 4 << 20


def through(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` over batches of bounded bytes (a longer row comes alone)."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def beside(df: DataFrame, column: str, run: Callable[[pa.Array], pa.RecordBatch], kinds: str) -> Column:
    """A struct column of what ``run`` finds for each value of ``column``: only that column goes to Python, and only the struct comes back.

    It counts as not deterministic, so that no filter on it is evaluated apart.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def each(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in arrays:
            found = run(x)
            yield pa.StructArray.from_arrays(found.columns, found.schema.names)

    each.__annotations__ = {"arrays": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(each, f"struct<{kinds}>").asNondeterministic()(F.col(column))


def pieces(values: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of values with about ``most`` bytes; a longer value stands alone."""
    _, at = utf8(values)
    row, n = 0, len(values)
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        yield row, end
        row = end


def least_hashed(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The ``rows`` rows of ``df`` with the least hash of ``key``, and all that tie with the last of them; rows without a key are left out.

    Only hashes and keys are sorted, never what else a row holds, and of those only what lies below a cut: rows are counted by
    the leading 14 bits of their hash first (16,384 counts on the driver), or else every partition would send ``rows`` of them to one task.
    """
    df = df.where(F.col(key).isNotNull())
    h = F.xxhash64(key)
    top, held = None, 0
    for top, n in sorted(df.groupBy(F.shiftright(h, 50).alias("b")).count().collect()):
        held += n
        if held >= rows:
            break
    if top is None:
        return df.limit(0)
    below = df.select(h.alias("h"), F.col(key).alias("i")).where(F.shiftright("h", 50) <= top)
    last = below.orderBy("h", "i").limit(rows).agg(F.max(F.struct("h", "i")).alias("m")).first().m
    return df.limit(0) if last is None else df.where((h < last.h) | ((h == last.h) & (F.col(key) <= F.lit(last.i))))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir`` or the context. Only a session within one
    process (tests), where all folders are shared, gets one of its own where that is unset; on a cluster it must be set."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, what: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: the lineage ends there, and lost executors cost only their own tasks.

    The table stays until its folder is cleared or it is given to ``discard``, as what is derived from it may be read at any time.
    """
    spark, clean = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = scratch(spark, "table"), spark.conf.get(clean, None)
    spark.conf.set(clean, "true")  # once the table stands, nothing needs the shuffles that led to it
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(clean) if before is None else spark.conf.set(clean, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``cut`` from which all that is read later has been written, and let the driver drop shuffles that nothing refers to any more."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        release(tables[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Let the driver's cleaner see which shuffles nothing refers to: their files go once their plans are collected."""
    spark.sparkContext._jvm.System.gc()


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser, vectorised; wraps modulo 2**64."""
    x = x ^ (x >> U64(30))
    x = x * MIX1
    x ^= x >> U64(27)
    x *= MIX2
    x ^= x >> U64(31)
    return x


def byte_weights(seed: int) -> np.ndarray:
    """256 random 64-bit values, one for each byte."""
    return mix64(np.arange(1, 257, dtype=U64) + U64(seed) * U64(0x9E3779B97F4A7C15 & 0xFFFFFFFF))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def grown(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, U64), np.full(n - 1, b, U64)])) for b in (self.base, self.inverse))
        return self.up, self.down


class SpanHash:
    """Polynomial hashes of any spans of a byte buffer from one pass of prefix sums."""

    def __init__(self, base: int, seed: int) -> None:
        self.powers, self.weights = Powers(base), byte_weights(seed)

    def load(self, data: np.ndarray) -> None:
        up, self.down = self.powers.grown(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum(self.weights[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hash of each span [start, end); equal bytes give equal values wherever they stand."""
        return mix64((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U64))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of whole rows with about ``most`` bytes of text: rows, bytes, offsets. A longer row stands alone."""
    data, at = utf8(batch.column(batch.schema.get_field_index(column)))
    row, n = 0, batch.num_rows
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        yield batch.slice(row, end - row), data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def spans_of(is_word: np.ndarray, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of word bytes that do not cross rows: starts, ends, and the first word of each row (with the total behind)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(at), np.int64)
    inside = is_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, at)


def forest(edges: DataFrame, tasks: int) -> DataFrame:
    """(a, b): each task's own components of its edges, every node linked to the smallest one of its component there.

    Rows are dealt to ``tasks`` by no key, so a task holds the same share whatever a hub's degree is.
    """
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        a, b = (np.concatenate([np.asarray(x.column(c)) for x in held]) for c in ("a", "b"))
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = at[: len(a)], at[len(a) :]
        root = np.arange(len(ids))
        while True:  # hook the larger root to the smaller, then point every node at its root
            u, v = root[x], root[y]
            if (u == v).all():
                break
            np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
            while (root[root] != root).any():
                root = root[root]
        own = np.flatnonzero(root != np.arange(len(ids)))
        for k in range(0, len(own), 100_000):
            part = own[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(ids[part]), pa.array(ids[root[part]])], ["a", "b"])

    return edges.select("a", "b").coalesce(tasks).mapInArrow(run, f"a {kind}, b {kind}")


def components(edges: DataFrame, rounds: int = 60, share: int = 1_000_000) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows (id, component), the smallest id reachable.

    Tasks first reduce about ``share`` edges each to a forest. If that took one task, it is the result; else large-star and
    small-star alternate until nothing changes. A hub's edges are only ever combined through partial minima, so that no
    task holds all its neighbours.
    """
    now = cut(edges.where("a <> b").select("a", "b"))
    n = now.count()
    tasks = max(1, -(-n // share))
    now = cut(forest(now, tasks))
    if tasks == 1:
        minima = now.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("component")), F.struct(F.col("b").alias("id"), F.col("b").alias("component")))).alias("x")).select("x.*")
        return minima.distinct()
    known = None
    for _ in range(rounds):
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(least, both.a == least.k).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        small = large.join(down, large.a == down.k).select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        now = cut(small)
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
        if (state.n, state.s) == known:
            break
        known = (state.n, state.s)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    links = now.groupBy("a").agg(F.min("b").alias("component"))
    return links.select(F.col("a").alias("id"), "component").unionByName(links.select(F.col("component").alias("id"), "component").distinct())
