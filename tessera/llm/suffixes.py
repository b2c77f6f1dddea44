"""Suffix-array dedup by external induced sorting.

A substring of ``length`` bytes that starts twice must be found wherever its two starts lie, so suffixes are first dealt
out by content. The least of the hashed ``gram``-byte strings inside a window of ``probe`` bytes (its anchor) depends on the
window alone: equal windows have equal anchors at equal places. Each window start of a document belongs to the stretch of
starts that share an anchor place, and only anchors that occur twice go on. Two suffixes that share ``length`` bytes share the
first ``probe`` of them, so one sort serves both: common prefixes of ``length`` bytes are removed, and those of ``probe`` bytes
that lie in different rows make the passages that are reported.

A shard holds stretches of text aligned at their anchors. Their suffixes are sorted by induction, as in induced suffix
sorting with common prefixes: the order of the suffixes that begin one symbol earlier follows from the order of those
behind by a stable sort on the symbol in front, and a common prefix grows by the symbol, or is the least between the two in
the order before. The recursion has two levels, 8-byte names from the far end up to the anchor and then single bytes, and
every suffix that shares ``length`` bytes with a neighbour is a repeat. Suffix tuples wait in a disk-backed priority queue
(``RunQueue``), which spills sorted runs and hands out whole anchor groups in order, so that a shard may be far larger than
memory.
"""

from __future__ import annotations

import hashlib
import shutil
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, SpanHash, cut, discard, mix64, slices, spans_of, through


@dataclass(frozen=True)
class Settings:
    length: int = 400
    #: Bytes from which on a repeat in another row is reported; a repeat of fewer bytes is not looked for.
    probe: int = 200
    gram: int = 48
    #: A passage has more words than this.
    words: int = 50
    #: Bytes of suffix tuples that a task holds before it spills a sorted run, and that it sorts at once.
    memory: int = 96 << 20
    #: An anchor with more distinct stretches is settled by counting its single windows, which no one task has to hold.
    hot: int = 20_000

    @property
    def least(self) -> int:
        return min(self.probe, self.length)

    @property
    def reach(self) -> int:
        """Places an anchor may have in a window."""
        return self.least - self.gram + 1


#: Bytes of words: all but white space.
IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
CHUNK = 1 << 20  # positions of a buffer fit 20 bits


def sliding_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """Place of the least value (its upper 44 bits; leftmost on ties) of each w neighbouring ones."""
    n = len(h)
    packed = (h & ~U64(CHUNK - 1)) | np.arange(n, dtype=U64)
    size = -(-n // w) * w
    blocks = np.full(size, U64(0xFFFFFFFFFFFFFFFF))
    blocks[:n] = packed
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - w + 1
    return (np.minimum(behind[:m], ahead[w - 1 : w - 1 + m]) & U64(CHUNK - 1)).astype(np.int64)


class Stretches:
    """Cuts a buffer of rows into stretches of window starts that share an anchor."""

    def __init__(self, s: Settings) -> None:
        self.s, self.grams, self.whole = s, SpanHash(0x9E3779B97F4A7C15, 3), SpanHash(0xD1342543DE82EF95, 5)

    def of(self, data: np.ndarray, at: np.ndarray, most: int | None = None) -> tuple[np.ndarray, ...]:
        """row, anchor hash, hash of all bytes, first start, anchor place, last start, last start of a window of ``length`` bytes
        (places within the row; before the first start where none fits). ``most`` bounds the starts of each row."""
        s, n = self.s, len(data)
        if n < s.least:
            return (np.zeros(0, np.int64),) * 7
        self.grams.load(data)
        k = np.arange(n - s.gram + 1)
        h = self.grams.of(k, k + s.gram)
        owner = sliding_argmin(h, s.reach)
        mark = np.zeros(n + 1, np.int32)
        fit = np.flatnonzero(np.diff(at) >= s.least)
        last_of = at[fit + 1] - s.least + 1
        np.add.at(mark, at[fit], 1)
        np.add.at(mark, last_of if most is None else np.minimum(last_of, at[fit] + most), -1)
        starts = np.flatnonzero(np.cumsum(mark)[: len(owner)] > 0)
        own = owner[starts]
        first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)])) if len(own) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(own)) - 1
        a, e, p = starts[first], starts[last] if len(first) else first, own[first]
        self.whole.load(data)
        row = np.searchsorted(at, a, "right") - 1
        ends = at[row + 1]
        whole = self.whole.of(a, np.minimum(e + s.length, ends))
        f = np.minimum(e, ends - s.length)
        return row, h[p].view(np.int64), mix64(whole + (e - a).astype(U64)).view(np.int64), a - at[row], p - at[row], e - at[row], f - at[row]

    def of_row(self, data: np.ndarray) -> tuple[np.ndarray, ...]:
        """As ``of`` for one long row, a piece after the other; pieces overlap by what a stretch may hold behind its last start."""
        step, parts = CHUNK - 2 * self.s.length, []
        for b in range(0, max(1, len(data) - self.s.least + 1), step):
            piece = data[b : b + step + self.s.length]
            got = self.of(piece, np.array([0, len(piece)]), step)
            parts.append((*got[:3], *(x + b for x in got[3:])))
        return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def keyed(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(id, k, __text): rows with what tells them apart: the id and a hash of the text. Rows equal in both have equal results."""
    return docs.select(F.col(doc).alias("id"), F.xxhash64(text).alias("k"), F.col(text).alias("__text"))


def on_row(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on (id, k), where a null id is an id like any other; ``right`` loses both."""
    r = right.withColumnsRenamed({"id": "__id", "k": "__k"})
    return left.join(r, left.id.eqNullSafe(F.col("__id")) & (left.k == F.col("__k")), how).drop("__id", "__k")


def anchors(rows: DataFrame, s: Settings) -> DataFrame:
    """(id, k, a, g, s, p, e, f): every stretch of every row of ``keyed``."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretches = Stretches(s)
        for batch in batches:
            for part, data, at in slices(batch, "__text", CHUNK // 2):
                row, a, g, *places = stretches.of(data, at) if len(data) < CHUNK else stretches.of_row(data)
                own = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column("id").take(own), part.column("k").take(own), pa.array(a, pa.int64()), pa.array(g, pa.int64()), *(pa.array(x.astype(np.int32)) for x in places)], ["id", "k", "a", "g", "s", "p", "e", "f"])

    return through(rows, run, f"id {kind}, k long, a long, g long, s int, p int, e int, f int")


#: What a set of equal stretches carries besides the bytes: anchor, rows, whether they lie in different rows, and places.
CARRIED = {"a": "long", "n": "long", "multi": "boolean", "s": "int", "p": "int", "e": "int", "f": "int"}


def texts_of(rows: DataFrame, wanted: DataFrame, s: Settings) -> DataFrame:
    """``wanted`` (id, k and what is ``CARRIED``) with the bytes of each stretch: one row for each, read from the whole texts."""
    per = wanted.groupBy("id", "k").agg(F.collect_list(F.struct(*CARRIED)).alias("w"))
    rows = on_row(rows, per)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in slices(batch, "__text", 1 << 20):
                lists = part.column("w")
                flat = lists.flatten()
                row = np.repeat(np.arange(part.num_rows), np.asarray(lists.value_lengths()))
                begin, end = (at[row] + np.asarray(flat.field(c)).astype(np.int64) for c in ("s", "e"))
                end = np.minimum(end + s.length, at[row + 1])
                found = [data[b:c].tobytes() for b, c in zip(begin.tolist(), end.tolist(), strict=True)]
                own = [part.column(c).take(pa.array(row)) for c in ("id", "k")]
                for j in range(0, len(found), 4096):
                    yield pa.RecordBatch.from_arrays([*(x[j : j + 4096] for x in own), *(flat.field(c)[j : j + 4096] for c in CARRIED), pa.array(found[j : j + 4096], pa.binary())], ["id", "k", *CARRIED, "b"])

    return through(rows, run, f"id {kind}, k long, " + ", ".join(f"{c} {t}" for c, t in CARRIED.items()) + ", b binary")


class RunQueue:
    """A priority queue of fixed-width tuples on disk: sorted runs are spilled, and whole groups of equal ``a`` come out in order."""

    def __init__(self, dtype: np.dtype, memory: int) -> None:
        self.dtype, self.memory, self.held, self.size = dtype, memory, [], 0
        self.folder, self.runs = None, []

    def push(self, tuples: np.ndarray) -> None:
        self.held.append(tuples)
        self.size += tuples.nbytes
        if self.size > self.memory:
            self.spill()

    def ordered(self) -> np.ndarray:
        held = np.concatenate(self.held) if self.held else np.zeros(0, self.dtype)
        self.held, self.size = [], 0
        return held[np.argsort(held["a"], kind="stable")]

    def spill(self) -> None:
        self.folder = self.folder or tempfile.mkdtemp(prefix="runs-")
        path = f"{self.folder}/{len(self.runs)}"
        self.ordered().tofile(path)
        self.runs.append(path)

    def groups(self) -> Iterator[np.ndarray]:
        """Batches of about ``memory`` bytes that hold whole groups; a larger group comes alone."""
        try:
            if self.runs and self.held:
                self.spill()
            runs = [np.memmap(p, self.dtype, "r") for p in self.runs] if self.runs else [self.ordered()]
            at, step = [0] * len(runs), max(1, self.memory // (2 * self.dtype.itemsize * len(runs)))
            while live := [k for k, r in enumerate(runs) if at[k] < len(r)]:
                bound = min(runs[k]["a"][min(at[k] + step, len(runs[k])) - 1] for k in live)
                parts = []
                for k in live:
                    end = int(np.searchsorted(runs[k]["a"], bound, "right"))
                    parts.append(np.array(runs[k][at[k] : end]))
                    at[k] = end
                batch = np.concatenate(parts)
                yield batch[np.argsort(batch["a"], kind="stable")]
        finally:
            if self.folder:
                shutil.rmtree(self.folder, ignore_errors=True)


class Induction:
    """Suffixes of aligned stretches in order within their groups, with the prefix each shares with the one before."""

    def __init__(self, group: np.ndarray) -> None:
        self.order = np.arange(len(group))
        self.start = np.concatenate([[True], group[1:] != group[:-1]])
        self.lcp = np.zeros(len(group), np.int32)

    def prepend(self, symbols: np.ndarray, width: int, split: bool) -> None:
        """Go on to the suffixes that begin with ``symbols`` (of ``width`` bytes). With ``split``, those that differ now part for good."""
        c = symbols[self.order]
        differ = np.zeros(len(c), bool)
        differ[1:] = (c[1:] != c[:-1]) & ~self.start[1:]
        grown = np.where(self.start, 0, self.lcp + width)
        if differ.any():
            g = np.cumsum(self.start) - 1
            mixed = np.zeros(g[-1] + 1, bool)
            mixed[g[differ]] = True
            pos = np.flatnonzero(mixed[g])
            sub = np.lexsort((c[pos], g[pos]))
            old = pos[sub]
            same = np.zeros(len(pos), bool)
            same[1:] = (c[old[1:]] == c[old[:-1]]) & (g[old[1:]] == g[old[:-1]])
            new = np.zeros(len(pos), np.int32)
            k = np.flatnonzero(same)
            if len(k):
                pairs = np.stack([old[k - 1] + 1, old[k] + 1], 1).ravel()
                new[k] = np.minimum.reduceat(np.append(self.lcp, 0), pairs)[::2] + width
            inner = np.flatnonzero(~same & ~self.start[pos])
            inner = inner[inner > 0]
            if width > 1 and len(inner):
                x = c[old[inner]] ^ c[old[inner - 1]]
                lead = np.zeros(len(x), np.int32)
                for shift in range(8, 8 * width, 8):
                    lead += (x >> U64(8 * width - shift)) == 0
                new[inner] = lead
            self.order[pos] = self.order[old]
            grown[pos] = new
            if split:
                self.start[pos] |= ~same
        self.lcp = grown.astype(np.int32)

    def clusters(self, alive: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Members (of those alive) whose suffix shares ``length`` bytes with another's, and a number for each set that shares them."""
        idx = np.flatnonzero(alive[self.order])
        if len(idx) < 2:
            return idx[:0], idx[:0]
        low = np.minimum.reduceat(np.append(self.lcp, 0), idx + 1)[:-1] >= length
        hit = np.zeros(len(idx), bool)
        hit[1:] = low
        hit[:-1] |= low
        number = np.cumsum(np.concatenate([[True], ~low]))
        return self.order[idx[hit]], number[hit]

    def shrink(self, keep: np.ndarray) -> None:
        """Leave out members; what two that become neighbours share is the least between them."""
        idx = np.flatnonzero(keep[self.order])
        if len(idx) == len(self.order):
            return
        if not len(idx):
            self.order, self.start, self.lcp = self.order[:0], self.start[:0], self.lcp[:0]
            return
        low = np.append(0, np.minimum.reduceat(np.append(self.lcp, 0), idx + 1)[:-1])
        g = (np.cumsum(self.start) - 1)[idx]
        self.order, self.lcp = self.order[idx], low.astype(np.int32)
        self.start = np.concatenate([[True], g[1:] != g[:-1]])
        self.lcp[self.start] = 0


def tuples(s: Settings) -> np.dtype:
    """A suffix tuple: anchor, row number, hash of its row, times it occurs and whether in different rows, first and last starts
    before the anchor (of either window), and the aligned bytes around it."""
    return np.dtype([("a", np.int64), ("row", np.int64), ("own", np.int64), ("n", np.int64), ("uid", np.int64), ("multi", bool), ("p", np.int32), ("lo", np.int32), ("long", np.int32), ("hi", np.int32), ("left", np.uint8, s.reach - 1), ("right", np.uint8, s.length)])


def runs(hits: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last place of each run of true values."""
    at = np.flatnonzero(hits)
    cuts = np.flatnonzero(np.diff(at) > 1)
    yield from zip(np.append(at[:1], at[cuts + 1]).tolist(), np.append(at[cuts], at[-1:]).tolist(), strict=True)


def repeated(batch: np.ndarray, s: Settings) -> Iterator[tuple[int, int, int, bool]]:
    """(row, first byte, end, False) of the repeated windows of each stretch that occurs once, and with True of the shorter ones
    that repeat in another row; ``batch`` has whole groups in order."""
    _, once = np.unique(np.stack([batch["a"], batch["uid"]], 1), axis=0, return_index=True)
    batch = batch[np.sort(once)]
    ind = Induction(batch["a"])
    right = np.ascontiguousarray(batch["right"]).view(">u8").astype(U64)
    for j in range(right.shape[1] - 1, -1, -1):
        ind.prepend(np.ascontiguousarray(right[:, j]), 8, False)
    del right
    left = np.ascontiguousarray(batch["left"].T)
    lo, long, hi, own, multi = (np.ascontiguousarray(batch[c]) for c in ("lo", "long", "hi", "own", "multi"))
    hits, across = np.zeros((len(batch), s.reach), bool), np.zeros((len(batch), s.reach), bool)
    for a in range(s.reach):
        if a:
            ind.prepend(left[s.reach - 1 - a], 1, True)
        if a % 16 == 0:
            lone = ind.start & np.append(ind.start[1:], True)
            keep = np.zeros(len(batch), bool)
            keep[ind.order[~lone]] = True
            ind.shrink(keep & (hi >= a))
        if not len(ind.order):
            break
        hits[ind.clusters((long <= a) & (a <= hi), s.length)[0], a] = True
        found, number = ind.clusters((lo <= a) & (a <= hi), s.least)
        if len(found):
            first = np.flatnonzero(np.diff(number, prepend=-1))
            size = np.diff(first, append=len(number))
            apart = np.minimum.reduceat(own[found], first) < np.maximum.reduceat(own[found], first)
            across[found[np.repeat(apart | np.logical_or.reduceat(multi[found], first), size)], a] = True
    hits[batch["n"] > 1] = False
    across[multi] = False  # equal stretches in different rows are known without a sort
    for table, length, flag in ((hits, s.length, False), (across, s.least, True)):
        for k in np.flatnonzero(table.any(1)).tolist():
            for x, y in runs(table[k]):
                yield int(batch["row"][k]), int(batch["p"][k]) - y, int(batch["p"][k]) - x + length, flag


def induced(stretches: DataFrame, s: Settings) -> DataFrame:
    """(id, k, s, t, across): bytes of rows covered by repeated windows, from shards dealt out by anchor."""
    kind = stretches.schema["id"].dataType.simpleString()
    rows = stretches.select("id", "k", *CARRIED, "b", F.xxhash64("id", "k", "s").alias("uid"), F.xxhash64("id", "k").alias("own")).repartition("a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind_of, queue, ids, n_rows = tuples(s), RunQueue(tuples(s), s.memory), [], 0
        for batch in batches:
            t = np.zeros(batch.num_rows, kind_of)
            for c in ("a", "n", "uid", "own", "p"):
                t[c] = np.asarray(batch.column(c))
            t["multi"] = batch.column("multi").to_numpy(zero_copy_only=False)
            first, last, fits = (np.asarray(batch.column(c)) for c in ("s", "e", "f"))
            t["row"] = n_rows + np.arange(batch.num_rows)
            t["lo"], t["long"], t["hi"] = t["p"] - last, t["p"] - fits, t["p"] - first
            for k, b in enumerate(batch.column("b")):
                v, cut_at = np.frombuffer(b.as_buffer(), np.uint8), int(t["hi"][k])
                t["left"][k, s.reach - 1 - cut_at :] = v[:cut_at]
                t["right"][k, : min(len(v) - cut_at, s.length)] = v[cut_at : cut_at + s.length]
            ids.append(batch.select(["id", "k"]))
            n_rows += batch.num_rows
            queue.push(t)
        if not n_rows:
            return
        ids = pa.Table.from_batches(ids)
        for group in queue.groups():
            if found := list(repeated(group, s)):
                row, a, b, across = (np.array(c) for c in zip(*found, strict=True))
                for one in ids.take(pa.array(row)).combine_chunks().to_batches():
                    yield pa.RecordBatch.from_arrays([*one.columns, pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(across)], ["id", "k", "s", "t", "across"])

    return through(rows, run, f"id {kind}, k long, s int, t int, across boolean")


def counted(stretches: DataFrame, s: Settings) -> DataFrame:
    """(id, k, s, t, across) for the stretches of hot anchors: their single windows, counted by a 128-bit hash with partial sums."""
    kind = stretches.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = SpanHash(0x9E3779B97F4A7C15, 21), SpanHash(0xD1342543DE82EF95, 23)
        for batch in batches:
            for j in range(batch.num_rows):
                v = np.frombuffer(batch.column("b")[j].as_buffer(), np.uint8)
                x.load(v), y.load(v)
                s0, last, fits = (batch.column(c)[j].as_py() for c in ("s", "e", "f"))
                for length, ends in ((s.length, fits), (s.least, last)):
                    at = np.arange(max(0, ends - s0 + 1))
                    same = batch.slice(j, 1).select(["id", "k", "n", "multi"]).take(pa.array(np.zeros(len(at), np.int64)))
                    yield pa.RecordBatch.from_arrays([*same.columns, pa.array((at + s0).astype(np.int32)), pa.array(np.full(len(at), length, np.int32)), pa.array(x.of(at, at + length).view(np.int64)), pa.array(y.of(at, at + length).view(np.int64))], ["id", "k", "n", "multi", "s", "len", "x", "y"])

    wins = cut(through(stretches.select("id", "k", "n", "multi", "s", "e", "f", "b"), run, f"id {kind}, k long, n long, multi boolean, s int, len int, x long, y long").distinct())
    own = F.xxhash64("id", "k")
    twice = wins.groupBy("len", "x", "y").agg(F.sum("n").alias("m"), (F.max("multi") | (F.min(own) < F.max(own))).alias("apart")).where("m > 1")
    met = wins.join(cut(twice), ["len", "x", "y"])
    removed = met.where((F.col("len") == s.length) & (F.col("n") == 1)).select("id", "k", "s", (F.col("s") + s.length).alias("t"), F.lit(False).alias("across"))
    return removed.unionByName(met.where((F.col("len") == s.least) & F.col("apart") & ~F.col("multi")).select("id", "k", "s", (F.col("s") + s.least).alias("t"), F.lit(True).alias("across")))


def repeated_spans(rows: DataFrame, s: Settings) -> DataFrame:
    """(id, k, s, t, across): bytes covered by windows of ``length`` bytes that start twice, and (``across``) by those of ``probe``
    bytes that start in another row too; the spans of a row may overlap."""
    found = cut(anchors(rows, s))
    # written, so that the join deals an anchor that very many rows share to several tasks
    twice = cut(found.groupBy("a").agg(F.count("*").alias("m"), F.min("g").alias("g0"), F.max("g").alias("g1")).where("m > 1").select("a", (F.col("g0") < F.col("g1")).alias("mixed")))
    live = cut(found.join(twice, "a"))
    discard(found, twice)
    own = F.xxhash64("id", "k")
    sets = cut(live.groupBy("a", "g", "mixed").agg(F.count("*").alias("n"), (F.min(own) < F.max(own)).alias("multi"), F.min(F.struct("id", "k", "s", "p", "e", "f")).alias("r")))
    same = cut(live.select("id", "k", "a", "g", "s", "e", "f").join(sets.where("n > 1").select("a", "g", "multi"), ["a", "g"]))
    discard(live)
    equal = same.where("f >= s").select("id", "k", "s", (F.col("f") + s.length).alias("t"), F.lit(False).alias("across"))
    equal = equal.unionByName(same.where("multi").select("id", "k", "s", (F.col("e") + s.least).alias("t"), F.lit(True).alias("across")))
    kinds = cut(sets.where("mixed").groupBy("a").agg(F.count("*").alias("kinds")))
    wanted = sets.where("mixed").join(kinds, "a").select("a", "n", "multi", "kinds", "r.*")
    texts = cut(texts_of(rows, wanted.where(F.col("kinds") <= s.hot), s))
    parts = equal.unionByName(induced(texts, s))
    if not kinds.where(F.col("kinds") > s.hot).isEmpty():
        parts = parts.unionByName(counted(texts_of(rows, wanted.where(F.col("kinds") > s.hot), s), s))
    spans = cut(parts.groupBy("id", "k", "across", "s").agg(F.max("t").alias("t")))
    discard(texts, sets, same, kinds)
    return spans


def covered(n: int, spans: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n bytes lie in a span."""
    cover = np.zeros(n + 1, np.int32)
    np.add.at(cover, spans, 1)
    np.add.at(cover, ends, -1)
    return np.cumsum(cover)[:-1] > 0


def passage(raw: np.ndarray) -> int:
    """Words that a run has, counting those cut off at its ends."""
    _, ends, _ = spans_of(IS_WORD, raw, np.array([0, len(raw)]))
    return len(ends)


def remove_repeats(docs: DataFrame, s: Settings = Settings(), doc: str = "doc_id", text: str = "text", kept: bool = False) -> DataFrame:
    """doc, n_bytes, n_removed, n_spans, kept_sha256, longest_repeat, repeat_words and has_passage for each row of ``docs``; with ``kept`` also kept_bytes.

    A byte goes if a window of ``length`` bytes that covers it also starts anywhere else, in this document or another.
    longest_repeat: bytes of the longest run covered by strings of ``probe`` bytes or more that another row holds too (another
    row is one with another id or text), repeat_words: the most words that such a run has (0 without one), has_passage:
    whether those are more than ``words``. Null and empty texts have 0. Rows are told apart by id and text, null ids included;
    rows equal in both repeat each other, and all of them lose what repeats.
    """
    rows = keyed(docs, doc, text)
    per = repeated_spans(rows, s).groupBy("id", "k").agg(F.collect_list(F.struct("s", "t", "across")).alias("w"))
    rows = on_row(rows, per, "left")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in slices(batch, "__text", 4 << 20):
                lists = part.column("w")
                n, gone, spans, sha, longest, most, rest = [], [], [], [], [], [], []
                for k in range(part.num_rows):
                    raw, w = data[at[k] : at[k + 1]], lists[k]
                    out, shared = np.zeros(len(raw), bool), []
                    if w.is_valid and len(w.values):
                        a, b = (np.asarray(w.values.field(c)) for c in ("s", "t"))
                        across = w.values.field("across").to_numpy(zero_copy_only=False)
                        out = covered(len(raw), a[~across], b[~across])
                        shared = [(x, y + 1) for x, y in runs(covered(len(raw), a[across], b[across]))] if across.any() else []
                    left = raw[~out].tobytes()
                    n.append(len(raw))
                    gone.append(int(out.sum()))
                    spans.append(int((out[1:] & ~out[:-1]).sum() + (len(out) > 0 and out[0])))
                    sha.append(hashlib.sha256(left).hexdigest())
                    longest.append(max((y - x for x, y in shared), default=0))
                    most.append(max((passage(raw[x:y]) for x, y in shared), default=0))
                    rest.append(left)
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(c, pa.int64()) for c in (n, gone, spans)), pa.array(sha, pa.string()), pa.array(longest, pa.int64()), pa.array(most, pa.int64()), pa.array([x > s.words for x in most], pa.bool_()), *([pa.array(rest, pa.binary())] if kept else [])], [doc, "n_bytes", "n_removed", "n_spans", "kept_sha256", "longest_repeat", "repeat_words", "has_passage", *(["kept_bytes"] if kept else [])])

    return through(rows.select("id", "__text", "w"), run, f"`{doc}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, longest_repeat long, repeat_words long, has_passage boolean" + ", kept_bytes binary" * kept)


def query(spark, sf_dir: str) -> DataFrame:
    """op1: repeats of 400 bytes in documents."""
    from .common import table

    return remove_repeats(table(spark, sf_dir, "documents"))
