"""MinHash near-dedup: fast similarity sketches, banding, exact verification, components.

Sketch: in each of up to t rounds every shingle is hashed to one of t places with a value, and a place keeps the least
(round, value); t further rounds send all shingles to one place each, so every coordinate fills, and the places behave as
t independent min-hashes with concentration bounds while large sets need one or two rounds (Dahlgaard, Knudsen, Thorup 2017).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, SpanHash, components, cut, discard, mix64, slices, spans_of, through
from .decontaminate import LOWER as SMALL
from .decontaminate import UPPER

#: Bytes of words: all but blank, tab, line feed, vertical tab, form feed and carriage return.
IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
TOP = U64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class Settings:
    """``bands`` x ``rows`` coordinates: at similarity 0.8, 32 bands of 4 miss a pair with probability (1 - 0.8**4)**32, under 1e-7."""

    shingle: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 4
    #: Members of a bucket that are verified against one copy of its leader's set.
    share: int = 10_000

    @property
    def size(self) -> int:
        return self.bands * self.rows


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int, hasher: SpanHash) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingles of each row of a buffer: k neighbouring words, or all words of a row that has fewer."""
    low = LOWER[data]
    starts, ends, first = spans_of(IS_WORD, low, at)
    hasher.load(low)
    h = hasher.of(starts, ends)
    odd = mix64(np.arange(1, k + 1, dtype=U64)) | U64(1)
    n = len(h)
    total = np.zeros(max(n - k + 1, 0), U64)
    for j in range(k):
        total += h[j : n - k + 1 + j] * odd[j]
    total = mix64(total)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(total[a : b - k + 1])
        elif b > a:
            yield mix64(np.array([(h[a:b] * odd[: b - a]).sum(dtype=U64) + U64(b - a)], U64))
        else:
            yield total[:0]


class Sketcher:
    """Signatures of t coordinates (a power of two)."""

    def __init__(self, t: int) -> None:
        self.t, self.shift = t, U64(64 - (t.bit_length() - 1))
        self.seeds = mix64(np.arange(1, 2 * t + 1, dtype=U64) * U64(0x632BE59BD9B4E019))

    def of(self, shingles: np.ndarray) -> np.ndarray:
        t, seeds = self.t, self.seeds
        out = np.full(t, TOP, U64)
        if len(shingles) < 48:  # all rounds at once
            h = mix64(shingles[None, :] ^ seeds[:t, None])
            seen = np.full((t, t), TOP, U64)
            np.minimum.at(seen, (np.repeat(np.arange(t), len(shingles)), (h >> self.shift).ravel().astype(np.int64)), h.ravel())
            filled = seen < TOP
            when = filled.argmax(0)
            any_ = filled.any(0)
            out[any_] = mix64(seen[when, np.arange(t)] + seeds[when])[any_]
            left = np.flatnonzero(~any_)
        else:
            for i in range(t):
                h = mix64(shingles ^ seeds[i])
                seen = np.full(t, TOP, U64)
                np.minimum.at(seen, (h >> self.shift).astype(np.int64), h)
                new = (out == TOP) & (seen < TOP)
                out[new] = mix64(seen[new] + seeds[i])
                left = np.flatnonzero(out == TOP)
                if not len(left):
                    break
        if len(left):
            out[left] = mix64(mix64(shingles[None, :] ^ seeds[t + left][:, None]).min(1) + seeds[t + left])
        return out


def fingerprint(shingles: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """128 bits of a set."""
    return shingles.sum(dtype=U64), mix64(shingles ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64)


def sketches(docs: DataFrame, s: Settings, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n, f1, f2, keys): size and 128-bit fingerprint of each row's shingle set, and a key for each band (none for an empty set)."""
    rows = docs.select(F.col(doc).alias("id"), F.col(text).alias("__text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, sketcher = SpanHash(0x2545F4914F6CDD1D, 11), Sketcher(s.size)
        odd = mix64(np.arange(1, s.rows + 1, dtype=U64)) | U64(1)
        salt = mix64(np.arange(1, s.bands + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
        for batch in batches:
            for part, data, at in slices(batch, "__text", 1 << 19):
                n, f1, f2, keys = [], [], [], []
                for found in shingle_sets(data, at, s.shingle, hasher):
                    n.append(len(found))
                    x, y = fingerprint(found)
                    f1.append(x)
                    f2.append(y)
                    keys.append((mix64((sketcher.of(found).reshape(s.bands, s.rows) * odd).sum(1, dtype=U64) + salt)).view(np.int64) if len(found) else None)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64()), pa.array(np.array(f1, U64).view(np.int64)), pa.array(np.array(f2, U64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))], ["id", "n", "f1", "f2", "keys"])

    return through(rows, run, f"id {kind}, n long, f1 long, f2 long, keys array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, s: Settings, doc: str, text: str) -> DataFrame:
    """(id, s): the full shingle sets, as sorted 64-bit numbers, of the classes in ``wanted`` (id, rep, f1, f2), read from the texts of their representatives."""
    rows = docs.select(F.col(doc).alias("rep"), F.col(text).alias("__text")).join(wanted.hint("merge"), "rep").select("id", "f1", "f2", "__text")  # ids grow with the input: never broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHash(0x2545F4914F6CDD1D, 11)
        for batch in batches:
            for part, data, at in slices(batch, "__text", 1 << 19):
                held = list(shingle_sets(data, at, s.shingle, hasher))
                marks = np.array([fingerprint(x) for x in held], U64).view(np.int64)
                own = pa.array((marks[:, 0] == np.asarray(part.column("f1"))) & (marks[:, 1] == np.asarray(part.column("f2"))))  # another text under the same id is another class's
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([x.tobytes() for x in held], pa.binary())], ["id", "s"]).filter(own)

    return through(rows, run, "id long, s binary").dropDuplicates(["id"])


def with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b, k, ...) with both full sets as sa and sb. The set of each a is laid out k times, so that its pairs, however many, are dealt to k tasks."""
    right = pairs.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("k")))
    many = pairs.groupBy("a").agg(F.max("k").alias("k"))
    left = many.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").select("a", "sa", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("salt"))
    return right.join(left, ["a", "salt"])


def verified(pairs: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), U64) for v in (x, y))
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= s.percent * (len(both) - common))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return through(with_sets(pairs, sets).select("a", "b", "sa", "sb"), run, f"a {kind}, b {kind}").distinct()


def deltas(members: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """``members`` (a, b, k, comp, minor) with d, what b's set lacks and has beyond a's, the weight w of that, and the slack t of a's set.

    With c = percent / (100 + percent), b's weight is (1 - c) for each shingle it lacks and c for each that it adds, and a's
    slack is (1 - 2c) of its size, here all times (100 + percent). b is linked with a if w <= t. Two such sets x and y are
    linked if their deltas share (w_x + w_y - t) / (100 + percent) shingles or more, as what both have of a's set is that
    set without both deltas.
    """
    kind = members.schema["a"].dataType.simpleString()
    other = members.schema["comp"].dataType.simpleString()
    lacking = U64(0x6A09E667F3BCC909)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, w, t = [], [], []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), U64) for v in (x, y))
                less, more = np.setdiff1d(x, y, True), np.setdiff1d(y, x, True)
                d.append(np.concatenate([mix64(less ^ lacking), more]).view(np.int64))
                w.append(100 * len(less) + s.percent * len(more))
                t.append((100 - s.percent) * len(x))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "comp", "minor")), pa.array(w, pa.int64()), pa.array(t, pa.int64()), pa.array(d, pa.list_(pa.int64()))], ["a", "b", "comp", "minor", "w", "t", "d"])

    return through(with_sets(members, sets).select("a", "b", "comp", "minor", "sa", "sb"), run, f"a {kind}, b {kind}, comp {other}, minor boolean, w long, t long, d array<long>")


def left_over(members: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """(a, b): the pairs of each leader's group that are yet in different components and may be linked, by a prefix-filtered join of their deltas.

    At least one of such a pair is not linked with the leader (``minor``), so its weight is above the slack, and the other
    has to share more than its own weight: a copy whose own changes nobody else has is ruled out alone. What is left joins
    on the rarest of its shared delta shingles, as many as it may miss and one more.
    """
    unit = 100 + s.percent
    found = cut(deltas(members, sets, s))
    least = cut(found.groupBy("a").agg(F.min("w").alias("m0"), F.min(F.when(F.col("minor"), F.col("w"))).alias("m1")))
    asked = F.col("w") - F.col("t") + F.when(F.col("minor"), F.col("m0")).otherwise(F.col("m1"))
    rows = found.join(least, "a").withColumn("need", F.greatest(F.lit(1), F.ceil(asked / unit)).cast("long")).where(F.size("d") >= F.col("need"))
    rows = cut(rows.select("a", "b", "comp", "minor", "w", "t", "need", F.explode("d").alias("h")))
    keys = ["a", "b", "comp", "minor", "w", "t", "need"]
    for last in (False, True):  # what the first pass rules out shares with nobody in the second
        common = cut(rows.groupBy("a", "h").agg(F.count("*").alias("f"), F.max("minor").alias("any")).where("f > 1 and any").drop("any"))
        held = rows.join(common, ["a", "h"]).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("f", "h"))).alias("x")).where(F.size("x") >= F.col("need"))
        held = cut(held)
        rows = held.select(*keys, F.explode("x.h").alias("h"))
    prefix = cut(held.select("a", "b", "comp", "minor", "w", "t", F.size("x").cast("long").alias("n"), F.explode(F.slice("x.h", F.lit(1), (F.size("x") - F.col("need") + 1).cast("int"))).alias("h")))
    mine = prefix.where("minor").select("a", "h", "t", F.col("b").alias("x"), F.col("comp").alias("cx"), F.col("w").alias("wx"), F.col("n").alias("nx"))
    theirs = prefix.select("a", "h", F.col("b").alias("y"), F.col("comp").alias("cy"), F.col("w").alias("wy"), F.col("n").alias("ny"), F.col("minor").alias("too"))
    met = mine.join(theirs, ["a", "h"]).where((F.col("cx") != F.col("cy")) & (~F.col("too") | (F.col("x") < F.col("y"))) & (unit * F.least("nx", "ny") >= F.col("wx") + F.col("wy") - F.col("t")))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def possible(n: str, c: str, na: str, ca: str, s: Settings):
    """Whether two sets of n and na shingles, c and ca of them not theirs alone, can reach the similarity: what they share is no more than the least of c and ca."""
    return (100 + s.percent) * F.least(c, ca) >= s.percent * (F.col(n) + F.col(na))


def exploded(sets: DataFrame) -> DataFrame:
    """(id, h): a row for each shingle."""
    kind = sets.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.array([len(x.as_buffer()) // 8 for x in batch.column("s")], np.int64)
            at = np.concatenate([[0], np.cumsum(size)])
            flat = np.frombuffer(b"".join(x.as_buffer() for x in batch.column("s")), np.int64)
            row = 0
            while row < len(size):  # about a million rows at a time
                end = max(row + 1, int(np.searchsorted(at, at[row] + 1_000_000, "right")) - 1)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(np.repeat(np.arange(row, end), size[row:end]))), pa.array(flat[at[row] : at[end]])], ["id", "h"])
                row = end

    return through(sets.select("id", "s"), run, f"id {kind}, h long")


def lone_shingles(sets: DataFrame) -> DataFrame:
    """(id, lone): how many shingles of each set none of the others has; a set without any is left out."""
    lone = exploded(sets).groupBy("h").agg(F.count("*").alias("k"), F.min("id").alias("id")).where("k = 1")
    return lone.groupBy("id").agg(F.count("*").alias("lone"))


def near_duplicates(docs: DataFrame, s: Settings = Settings(), doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n_shingles, component_id, kept) for each row of ``docs``.

    Rows with equal sets form a class, and only one row of a class goes on. Shingles that only one of the documents in
    shared buckets has are in no intersection; their number bounds what any pair shares, and rules out most that share a
    passage alone. In each bucket all members are verified against a leader, the one that shares most buckets (fewest lone
    shingles on ties). Pairs that share a leader and are still apart go through a prefix-filtered join of what sets them off
    from it (``left_over``) and are verified too. So every pair that shares a bucket is either connected or refuted, without
    all pairs of a group.
    Null and empty texts are linked with nothing. Rows are judged by their own texts, also where they share an id; rows
    without an id are not compared and get a null component.
    """
    sk = cut(sketches(docs, s, doc, text))
    classes = sk.where("n > 0 and id is not null").groupBy("n", "f1", "f2").agg(F.min("id").alias("rep"), F.first("keys").alias("keys"))
    classes = cut(classes.select(F.monotonically_increasing_id().alias("id"), "*"))
    places = classes.select("id", "n", F.explode("keys").alias("key"))
    crowded = places.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    shared = cut(places.join(crowded, "key"))
    wanted = shared.select("id").distinct().join(classes.select("id", "rep", "f1", "f2"), "id")
    sets = cut(sets_of(docs, wanted, s, doc, text))
    lone = cut(lone_shingles(sets))
    alive = cut(shared.join(lone, "id", "left").withColumn("c", F.col("n") - F.coalesce("lone", F.lit(0))).drop("lone").where(100 * F.col("c") >= s.percent * F.col("n")))
    size = cut(alive.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"))
    crowd = cut(alive.join(size, "key"))
    discard(shared, lone, alive, size)
    score = crowd.groupBy("id").agg(F.sum("m").alias("score"))
    rated = cut(crowd.drop("m").join(score, "id"))
    lead = rated.groupBy("key").agg(F.max(F.struct("score", (F.col("c") - F.col("n")).alias("own"), "id", "n", "c")).alias("l"), F.count("*").alias("m")).select("key", F.col("l.id").alias("a"), F.col("l.n").alias("na"), F.col("l.c").alias("ca"), "m")
    wide = lead.groupBy("a").agg((1 + F.floor(F.max("m") / s.share)).cast("long").alias("k"))
    lead = cut(lead.join(wide, "a"))
    star = cut(rated.join(lead, "key").where((F.col("id") != F.col("a")) & possible("n", "c", "na", "ca", s)).select("a", F.col("id").alias("b"), "k").distinct())
    links = cut(verified(star, sets, s))
    comp = cut(components(links))
    now = cut(rated.select("id", "key").join(comp, "id", "left").select("id", "key", F.coalesce("component", "id").alias("comp")))
    groups = cut(now.join(lead.select("key", "a", "k"), "key").select("a", "k", F.col("id").alias("b"), "comp").distinct())
    main = cut(groups.where("a = b").select("a", F.col("comp").alias("main")))
    groups = cut(groups.where("a <> b").join(main, "a").withColumn("minor", F.col("comp") != F.col("main")).drop("main"))
    open_ = cut(groups.where("minor").select("a").distinct())
    rest = cut(left_over(groups.join(open_, "a"), sets, s))
    if not rest.isEmpty():
        comp = cut(components(links.unionByName(verified(rest.withColumn("k", F.lit(1).cast("long")), sets, s))))
    whole = cut(classes.select("id", "n", "f1", "f2", "rep").join(comp, "id", "left").withColumn("component", F.coalesce("component", "id")))
    names = cut(whole.groupBy("component").agg(F.min("rep").alias("component_id")))
    whole = whole.join(names, "component").select("n", "f1", "f2", "component_id")
    out = sk.select("id", "n", "f1", "f2").join(whole, ["n", "f1", "f2"], "left")
    cid = F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.col("component_id"))).otherwise(F.col("id"))
    return out.select(F.col("id").alias(doc), F.col("n").alias("n_shingles"), cid.alias("component_id"), F.coalesce(F.col("id") == cid, F.lit(True)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    """op2: near-duplicate components of documents on 4-word shingles."""
    from .common import table

    return near_duplicates(table(spark, sf_dir, "documents"), Settings(shingle=4))


#: Counts every pair of documents that share a shingle; ids are taken as unique and not null.
SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{SMALL}'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[g:g + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS g FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
k AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
l AS MATERIALIZED (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id WHERE r.c < l.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id) m USING (doc_id)
"""
