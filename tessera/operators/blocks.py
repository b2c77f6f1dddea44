"""Sums over all edges that need both ends' out-neighbours, computed in cells of two blocks of nodes.

A join that ships one array for each edge writes the sum of squared degrees to disk. Here nodes are dealt to R blocks by a
hash, and each block's packed lists go to the R cells that pair it with another block (or itself): every edge has its ends
in just one cell, and R copies of the graph are shipped, at about two bytes an edge.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_dir
from .sketches import Profile, S, check, np_estimate, np_hash, np_register

#: Blocks are unions of buckets. Neighbours and bytes of sketches that a cell holds at most; cells that keep a cluster busy have so many edges.
BUCKETS, CELL_IDS, CELL_BYTES, SMALL = 1024, 16_000_000, 192 << 20, 500_000
FLUSH, WEDGES, MARKS = 4_000_000, 1 << 19, 1 << 25
SUMS = ("n_edges", "triangles", "n_approx", "n_fallback", "n_clamped", "exact_sum", "hll_sum")


@dataclass(frozen=True)
class Setting:
    """A way to route edges; see ``hybrid.edge_details``."""

    gamma: int
    p: int = 8
    profile: Profile = S
    theta: int | None = None
    seed: int = 0

    @property
    def least(self) -> int:
        return self.gamma if self.theta is None and self.profile is S else self.theta or 0


def bucket(ids: np.ndarray) -> np.ndarray:
    return (np_hash(ids, S, 0) % np.uint64(BUCKETS)).astype(np.int64)


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices of all runs, one run after the other."""
    end = np.cumsum(size)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - size), size)


def encode(src: np.ndarray, size: np.ndarray, dst: np.ndarray) -> bytes:
    """Sorted lists as varints: the first neighbour's zigzag distance from its node, then the gaps."""
    gap = np.empty(len(dst), np.int64)
    gap[1:] = dst[1:] - dst[:-1]
    first = np.cumsum(size) - size
    far = dst[first] - src
    gap[first] = (far << 1) ^ (far >> 63)
    v = gap.view(np.uint64)
    n = np.ones(len(v), np.int64)
    for k in range(1, 10):
        n += v >= np.uint64(1 << 7 * k)
    at = np.cumsum(n) - n
    out = np.empty(int(n.sum()), np.uint8)
    for k in range(int(n.max(initial=0))):
        on = np.flatnonzero(n > k)
        out[at[on] + k] = ((v[on] >> np.uint64(7 * k)) & np.uint64(127)) | ((n[on] > k + 1).astype(np.uint64) << np.uint64(7))
    return out.tobytes()


def decode(src: np.ndarray, size: np.ndarray, data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    end = np.flatnonzero(b < 128)
    start = np.concatenate([[0], end[:-1] + 1])
    n = end - start + 1
    v = (b[start] & 127).astype(np.uint64)
    for k in range(1, int(n.max(initial=0))):
        on = np.flatnonzero(n > k)
        v[on] |= (b[start[on] + k] & 127).astype(np.uint64) << np.uint64(7 * k)
    first = np.cumsum(size) - size
    far = v[first]
    far = (far >> np.uint64(1)).view(np.int64) ^ -(far & np.uint64(1)).view(np.int64)
    s = np.cumsum(v.view(np.int64))
    return s - np.repeat(s[first] - (src + far), size)


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges sorted by (src, dst) become bundles of lists, one for each bucket of a few million edges."""

    def bundles(src: np.ndarray, dst: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.concatenate([[True], src[1:] != src[:-1]]))
        size, node = np.diff(np.append(first, len(src))), src[first]
        kind = bucket(node)
        order = np.argsort(kind, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(kind[order])) + 1):
            data = encode(node[part], size[part], dst[spans(first[part], size[part])])
            row = [[int(kind[part[0]])], [len(part)], [int(size[part].sum())], [node[part].tobytes()], [size[part].astype(np.int32).tobytes()], [data]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["bucket", "nodes", "edges", "ids", "sizes", "data"])

    held, rows = [], 0
    for x in batches:
        if x.num_rows:
            held.append([c.to_numpy() for c in x.columns])
            rows += x.num_rows
        if rows >= FLUSH:
            src, dst = map(np.concatenate, zip(*held, strict=True))
            keep = int(np.searchsorted(src, src[-1]))  # the last node may go on
            if keep:
                yield from bundles(src[:keep], dst[:keep])
            held, rows = [[src[keep:].copy(), dst[keep:].copy()]], len(src) - keep
    if rows:
        yield from bundles(*map(np.concatenate, zip(*held, strict=True)))


def supports(a: np.ndarray, b: np.ndarray, off: np.ndarray, size: np.ndarray, near: np.ndarray, n: int) -> np.ndarray:
    """Common neighbours of a[k] and b[k], a in order: the wedges a, b, c are closed by a look-up of (a, c) among marks."""
    out = np.zeros(len(a), np.int64)
    done = np.cumsum(size[b])
    marks, place = np.zeros(MARKS, np.uint8), np.zeros(n, np.int32)
    p = 0
    while p < len(a):
        q = max(p + 1, int(np.searchsorted(done, (done[p - 1] if p else 0) + WEDGES, "right")))
        while True:
            row = np.concatenate([[0], np.cumsum(a[p + 1 : q] != a[p : q - 1])])
            top = a[p:q][np.concatenate([[True], row[1:] != row[:-1]])]
            k = int(size[top].sum())
            wide = min(n, k + 1)
            if len(top) * wide <= MARKS or q == p + 1:
                break
            q = p + max(1, (q - p) // 2)
        if len(top) * wide > len(marks):
            marks = np.zeros(len(top) * wide, np.uint8)
        mine = near[spans(off[top], size[top])]
        if wide < n:  # only what the marked lists hold gets a column; the rest has column 0
            place[mine] = np.arange(1, k + 1, dtype=np.int32)
        column = lambda c: place[c] if wide < n else c  # noqa: B023, E731
        on = np.repeat(np.arange(len(top)) * wide, size[top]) + column(mine)
        marks[on] = 1
        many = size[b[p:q]]
        hit = marks[np.repeat(row * wide, many) + column(near[spans(off[b[p:q]], many)])]
        out[p:q] = np.add.reduceat(hit, np.cumsum(many) - many, dtype=np.int64)
        marks[on] = 0
        if wide < n:
            place[mine] = 0
        p = q
    return out


def estimates(a: np.ndarray, b: np.ndarray, off: np.ndarray, size: np.ndarray, ids: np.ndarray, p: int, profile: Profile, seed: int) -> np.ndarray:
    """Unclamped estimates of the common neighbours by sketches; b is -1 for nodes without neighbours."""
    used = np.unique(np.concatenate([a, b]))
    regs = np.zeros((len(used), 1 << p), np.uint8)
    real = np.flatnonzero(used >= 0)
    for part in np.array_split(real, max(1, int(size[used[real]].sum()) // 1_000_000)):
        j, rho = np_register(ids[spans(off[used[part]], size[used[part]])], p, profile, seed)
        np.maximum.at(regs, (np.repeat(part, size[used[part]]), j), rho.astype(np.uint8))
    du, dv = size[a], np.where(b >= 0, size[b], 0)
    a, b = np.searchsorted(used, a), np.searchsorted(used, b)
    own = None if profile.exact_degrees else np.concatenate([np_estimate(regs[k : k + 4096], p, profile) for k in range(0, len(used), 4096)])
    out = np.empty(len(a))
    for k in range(0, len(a), 4096):
        x, y = a[k : k + 4096], b[k : k + 4096]
        both = du[k : k + 4096] + dv[k : k + 4096].astype(float) if own is None else own[x] + own[y]
        out[k : k + 4096] = both - np_estimate(np.maximum(regs[x], regs[y]), p, profile)
    return out


def cell(i: int, j: int, blocks: int, lists: list[tuple[np.ndarray, np.ndarray, np.ndarray]], settings: list[Setting], exact: bool) -> list[tuple]:
    """(setting, *SUMS) over the edges between blocks i and j; without settings, their triangles alone."""
    node, size = (np.concatenate([x[k] for x in lists]) for k in (0, 1))
    ids = np.concatenate([x[2] for x in lists])
    lists.clear()
    off = np.cumsum(size) - size
    order = np.argsort(node, kind="stable")
    other = i + j - bucket(node) % blocks
    ends: list[tuple[np.ndarray, np.ndarray]] = []
    for part in np.array_split(np.arange(len(node)), max(1, len(ids) // 1_000_000)):
        if not len(part):
            continue
        v = ids[off[part[0]] : off[part[-1]] + size[part[-1]]]
        mine = bucket(v) % blocks == np.repeat(other[part], size[part])
        v = v[mine]
        at = np.minimum(np.searchsorted(node, v, sorter=order), len(node) - 1)
        ends.append((np.repeat(part, size[part])[mine], np.where(node[order[at]] == v, order[at], -1)))
    a, b = (np.concatenate([x[k] for x in ends]) for k in (0, 1))
    cost = np.minimum(size[a], np.where(b >= 0, size[b], 0))
    wanted = [cost > s.gamma if s.profile.strict else cost >= s.gamma for s in settings]
    dear = [w & (cost >= s.least) for w, s in zip(wanted, settings, strict=True)]
    need = np.ones(len(a), bool) if exact or not settings else ~np.logical_and.reduce(dear)
    need &= b >= 0
    support = np.zeros(len(a), np.int64)
    if need.any():
        low, high = int(ids.min()), int(ids.max())
        if high - low < 4 * len(ids) + 1_000_000:
            near, n = (ids - low).astype(np.int32), high - low + 1
        else:
            found, near = np.unique(ids, return_inverse=True)
            near, n = near.astype(np.int32), len(found)
        support[need] = supports(a[need], b[need], off, size, near, n)
        del near
    total = int(support.sum())
    if not settings:
        return [(0, len(a), total, 0, 0, 0, float(total), 0.0)]
    out: list[tuple] = []
    for kind in dict.fromkeys((s.p, s.profile, s.seed) for s in settings):
        mine = [k for k, s in enumerate(settings) if (s.p, s.profile, s.seed) == kind]
        some = np.logical_or.reduce([dear[k] for k in mine])
        hat = np.zeros(len(a))
        if some.any():
            hat[some] = estimates(a[some], b[some], off, size, ids, kind[0], kind[1], kind[2])
        clamped = np.maximum(0.0, np.minimum(hat, cost) if kind[1].upper else hat)
        for k in mine:
            hll = dear[k]
            out.append((k, len(a), total, int(hll.sum()), int((wanted[k] & ~hll).sum()), int((hll & (hat != clamped)).sum()), float(support[~hll].sum()), float(clamped[hll].sum())))
    return out


def packed(fwd: DataFrame) -> DataFrame:
    """(bucket, nodes, edges, ids, sizes, data): the lists of all nodes that have out-neighbours, written to the shared folder; the shuffles behind them are removed."""
    spark, clean = fwd.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = f"{shared_dir(spark)}/lists-{uuid.uuid4().hex}", spark.conf.get(clean, None)
    rows = fwd.select("src", "dst").repartition("src").sortWithinPartitions("src", "dst")
    out = rows.mapInArrow(pack, "bucket int, nodes long, edges long, ids binary, sizes binary, data binary")
    spark.conf.set(clean, "true")
    try:
        out.write.option("compression", "none").parquet(path)
    finally:
        spark.conf.unset(clean) if before is None else spark.conf.set(clean, before)
    return spark.read.schema(out.schema).parquet(path)


def totals(fwd: DataFrame, settings: list[Setting] = (), exact: bool = True) -> DataFrame:
    """(setting, n_edges, triangles, n_approx, n_fallback, n_clamped, exact_sum, hll_sum) for each setting, by its place in the list.

    ``triangles`` is the sum of all supports; without ``exact`` only of those that a setting asks for. Without settings there
    is one row. Edges must be distinct. The graph is packed at once, the sums are computed when they are read.
    """
    settings = list(settings)
    for s in settings:
        check(s.p)
    table = packed(fwd)
    size = table.agg(F.coalesce(F.sum("nodes"), F.lit(0)).alias("n"), F.coalesce(F.sum("edges"), F.lit(0)).alias("m")).first()
    large = max((2 * size.n << s.p for s in settings), default=0)
    blocks = min(BUCKETS, max(1, min(8, size.m // SMALL), -(-2 * size.m // CELL_IDS), -(-large // CELL_BYTES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for x in batches:
            for r in x.to_pylist():
                node, n = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["sizes"], np.int32).astype(np.int64)
                held.setdefault((r["i"], r["j"]), []).append((node, n, decode(node, n, r["data"])))
        for i, j in sorted(held):
            found = list(zip(*cell(i, j, blocks, held.pop((i, j)), settings, exact), strict=True))
            kinds = (pa.int32(), *[pa.int64()] * 5, pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, kinds, strict=True)], ["setting", *SUMS])

    own, far = F.col("bucket") % blocks, F.col("far").cast("int")
    rows = table.select("ids", "sizes", "data", own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("far"))
    rows = rows.select(F.least("own", far).alias("i"), F.greatest("own", far).alias("j"), "ids", "sizes", "data")
    number = (F.col("j") * (F.col("j") + 1) / 2).cast("int") + F.col("i")
    rows = rows.repartitionById(blocks * (blocks + 1) // 2, number)
    sums = rows.mapInArrow(run, "setting int, " + ", ".join(f"{x} {'double' if x.endswith('sum') else 'long'}" for x in SUMS))
    zero = lambda x: F.lit(0.0) if x.endswith("sum") else F.lit(0).cast("bigint")
    each = [F.struct(F.lit(k).alias("setting"), *(F.coalesce(F.sum(F.when(F.col("setting") == k, F.col(x))), zero(x)).alias(x) for x in SUMS)) for k in range(max(1, len(settings)))]
    return sums.agg(F.array(*each).alias("x")).select(F.inline("x"))
