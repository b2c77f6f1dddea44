"""LM scoring by masked pseudo-likelihood: a bidirectional window network predicts every token from both sides.

A token is a word. Every distinct word of the corpus has its own leaf in a tree that follows the counts: classes of about
equal mass, each split in ``BRANCH`` parts of about equal mass, and so on down to single words, so depth grows with the
vocabulary. p(word | both sides) is the product of the choices on its path; each choice is a softmax of the network's hidden
layer, which sees the whole path of every neighbour and the path so far, on top of the logarithm of the counts below the node.
The network (an embedding of classes for each neighbour place, the codes of paths, one hidden layer, a softmax for each
level) is trained in numpy on every document: in each of
``rounds`` rounds shares of the documents are gone through from the same weights, and the weights they end with
are averaged, each weighing as many windows as it saw. Shares and their order follow hashes of the rows and the corpus's
number of words, so neither the weights nor the scores depend on how the rows are partitioned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, SpanHash, mix64, slices, spans_of

IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Parts of a node below the classes.
BRANCH = 16


@dataclass(frozen=True)
class Settings:
    """``buckets``: None for a leaf for each distinct word; a number for a bounded lexicon of so many hashed words, whose choice
    within a class follows the counts alone."""

    buckets: int | None = None
    classes: int = 64
    hidden: int = 16
    sides: int = 2
    rounds: int = 2
    batch: int = 2048
    rate: float = 0.5
    smoothing: float = 0.5
    seed: int = 17
    share: int = 1_000_000  # words of a share of the documents, more where that would make over ``most`` shares a round
    most: int = 20_000

    @property
    def offsets(self) -> tuple[int, ...]:
        return tuple(k for k in range(-self.sides, self.sides + 1) if k)


@dataclass(frozen=True)
class Tree:
    """Words by hash and their paths below the classes. The last word stands for all that the corpus does not hold."""

    keys: np.ndarray  # sorted hashes, with a sentinel behind
    start: np.ndarray  # first key of each value of the leading bits
    shift: int
    node: np.ndarray  # node above each word, -1 where the class is the word
    digit: np.ndarray  # place of each word below its node
    up: np.ndarray  # node above each node, -1 at the class
    up_digit: np.ndarray
    depth: np.ndarray
    log_count: np.ndarray  # of each node's places, -inf where there is none
    levels: int

    def find(self, hashes: np.ndarray) -> np.ndarray:
        at = self.start[(hashes >> U64(self.shift)).astype(np.int64)].astype(np.int64)
        low = np.flatnonzero(self.keys[at] < hashes)
        while len(low):
            at[low] += 1
            low = low[self.keys[at[low]] < hashes[low]]
        return np.where(self.keys[at] == hashes, at, len(self.keys) - 1)

    def paths(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and node of each word by level, ``BRANCH`` and -1 below its leaf."""
        digits, nodes = np.full((self.levels, len(ids)), BRANCH, np.uint8), np.full((self.levels, len(ids)), -1, np.int32)
        node, digit = self.node[ids], self.digit[ids]
        at = np.flatnonzero(node >= 0)
        node, digit = node[at], digit[at]
        while len(at):
            level = self.depth[node]
            digits[level, at], nodes[level, at] = digit, node
            node, digit = self.up[node], self.up_digit[node]
            on = node >= 0
            at, node, digit = at[on], node[on], digit[on]
        return digits, nodes


def planted(keys: np.ndarray, counts: np.ndarray, s: Settings) -> tuple[np.ndarray, Tree]:
    """Class of each word and the tree, from sorted hashes and their counts."""
    v = len(keys) + 1
    kind = np.int32 if v < 1 << 27 else np.int64
    mass = np.append(counts, 0) + s.smoothing
    order = np.argsort(-mass, kind="stable").astype(kind)
    mass = mass[order]
    before = np.cumsum(mass)
    before -= mass
    group = np.minimum((before / mass.sum() * s.classes).astype(kind), s.classes - 1)
    of = np.empty(v, np.int32)
    of[order] = group
    node, digit = np.full(v, -1, np.int32), np.zeros(v, np.uint8)
    ups, up_digits, depths, logs, level, made = [], [], [], [], 0, 0
    at = np.arange(v, dtype=kind)  # words in order whose group may hold others
    above, place = np.full(v, -1, np.int32), np.zeros(v, np.uint8)
    while True:
        first = np.flatnonzero(np.diff(group, prepend=-1))
        size = np.diff(first, append=len(group))
        on = np.repeat(size > 1, size)
        at, above, place = at[on], above[on], place[on]
        if not len(at):
            break
        size = size[size > 1]
        first = np.cumsum(size) - size
        own = np.repeat(np.arange(len(size), dtype=kind), size)
        d = np.empty(len(at), np.uint8)
        held = mass[at]
        sums, low = np.add.reduceat(held, first), before[at[first]]
        for k in range(0, len(at), 1 << 18):  # piece by piece: the driver holds few arrays of the vocabulary's length at once
            here = slice(k, k + (1 << 18))
            o = own[here]
            share = ((before[at[here]] - low[o]) / sums[o] * BRANCH).astype(np.int64)
            d[here] = np.where(size[o] <= BRANCH, np.arange(k, k + len(o)) - first[o], np.minimum(share, BRANCH - 1))
        group = own * BRANCH + d
        held = np.bincount(group, held, len(size) * BRANCH).reshape(-1, BRANCH)
        with np.errstate(divide="ignore"):
            logs.append(np.log(held / held.sum(1, keepdims=True)).astype(np.float32))
        ups.append(above[first])
        up_digits.append(place[first])
        depths.append(np.full(len(size), level, np.uint8))
        above, place = (own + made).astype(np.int32), d
        node[order[at]], digit[order[at]] = above, place
        made, level = made + len(size), level + 1
    shift = 64 - max(1, len(keys).bit_length())
    start = np.searchsorted(keys, np.arange(1 << (64 - shift), dtype=U64) << U64(shift)).astype(np.int32 if v < 1 << 31 else np.int64)
    joined = [np.concatenate(x) if x else np.zeros(0, t) for x, t in ((ups, np.int32), (up_digits, np.uint8), (depths, np.uint8))]
    log_count = np.concatenate(logs) if logs else np.zeros((0, BRANCH), np.float32)
    return of, Tree(np.append(keys, U64(2**64 - 1)), start, shift, node, digit, *joined, log_count, level)


@dataclass(frozen=True)
class Lexicon:
    """Class of each word, and its place below the class: a path in the tree, or in buckets the log-probability within the class."""

    of: np.ndarray
    log_inner: np.ndarray | None
    tree: Tree | None = None
    words: int = 0

    @property
    def levels(self) -> int:
        return self.tree.levels if self.tree else 0


@dataclass(frozen=True)
class Below:
    """Paths of a run of words and of ``sides`` more on both ends."""

    digits: np.ndarray
    nodes: np.ndarray
    log_count: np.ndarray

    def part(self, a: int, b: int, sides: int) -> Below:
        return Below(self.digits[:, a : b + 2 * sides], self.nodes[:, a : b + 2 * sides], self.log_count)


def pour(weights: np.ndarray, index: np.ndarray, change: np.ndarray) -> None:
    """Take each row of ``change`` from the row of ``weights`` that it names."""
    one = np.zeros((len(index), len(weights)), np.float32)
    one[np.arange(len(index)), index] = 1
    weights -= one.T @ change


def raised(z: np.ndarray, w: np.ndarray, c: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """exp(z) and its sum by row. The largest of a row is taken off first, unless ``w`` and ``c`` bound z as small."""
    if np.abs(w).sum(0).max() + (0 if c is None else np.abs(c).max()) > 60:
        z -= z.max(1, keepdims=True)
    e = np.exp(z)
    return e, e @ np.ones(z.shape[1], np.float32)


class Net:
    """Weights: embeddings (place, class or border, hidden), hidden bias, output matrix, output bias; with levels below the
    classes also the codes of a neighbour's path, a matrix for each place, what the path so far adds (class, then places), and
    the output matrix of each level, which starts at zero: at the counts."""

    def __init__(self, s: Settings, flat: np.ndarray | None = None, levels: int = 0) -> None:
        self.s, self.levels = s, levels
        shapes = [(2 * s.sides, s.classes + 1, s.hidden), (s.hidden,), (s.hidden, s.classes), (s.classes,)]
        if levels:
            shapes += [(levels, BRANCH, s.hidden), (2 * s.sides, s.hidden, s.hidden), (s.classes, s.hidden), (levels, BRANCH, s.hidden), (levels, s.hidden, BRANCH)]
        if flat is None:
            r = np.random.default_rng(s.seed)
            flat = np.concatenate([(r.normal(0, 0.3, np.prod(x)) if len(x) > 1 and k < 8 else np.zeros(np.prod(x))) for k, x in enumerate(shapes)])
        self.flat, self.parts, at = np.array(flat, np.float32), [], 0
        for x in shapes:
            n = int(np.prod(x))
            self.parts.append(self.flat[at : at + n].reshape(x))
            at += n

    def sums(self, context: np.ndarray, below: Below | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """What enters the hidden layer, and the codes of all words of the run."""
        e, b = self.parts[:2]
        h = e[0].take(context[0], 0)
        for k in range(1, len(context)):
            h += e[k].take(context[k], 0)
        h += b
        if not self.levels:
            return h, None
        f, m = self.parts[4:6]
        coded = np.concatenate([f, np.zeros((self.levels, 1, self.s.hidden), np.float32)], 1)  # nothing below a leaf
        code = coded[0].take(below.digits[0], 0)
        for level in range(1, self.levels):
            code += coded[level].take(below.digits[level], 0)
        for k, o in enumerate(self.s.offsets):
            x = code[self.s.sides + o : self.s.sides + o + len(h)] @ m[k]
            x[context[k] == self.s.classes] = 0
            h += x
        return h, code

    def forward(self, context: np.ndarray, below: Below | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hidden layer and log-probabilities of all classes; context has a row for each place."""
        h = np.tanh(self.sums(context, below)[0])
        z = h @ self.parts[2] + self.parts[3]
        _, total = raised(z, *self.parts[2:4])
        return h, z - np.log(total)[:, None]

    def descend(self, sums: np.ndarray, target: np.ndarray, below: Below) -> Iterator[tuple[np.ndarray, ...]]:
        """From the class down, by level: rows whose path goes on, their hidden layer, logits, exponentials with their sums, and places."""
        q0, q, u = self.parts[6:]
        own = slice(self.s.sides, self.s.sides + len(target))
        digits, nodes = below.digits[:, own], below.nodes[:, own]
        sums, on = sums + q0.take(target, 0), np.arange(len(target))
        for level in range(self.levels):
            kept = np.flatnonzero(nodes[level].take(on) >= 0)
            if len(kept) < len(on):
                sums, on = sums.take(kept, 0), on.take(kept)
            if level:
                sums += q[level - 1].take(digits[level - 1].take(on), 0)
            g = np.tanh(sums)
            z = g @ u[level]
            z += below.log_count.take(nodes[level].take(on), 0)
            yield on, g, z, *raised(z, u[level]), digits[level].take(on)

    def log_prob(self, context: np.ndarray, target: np.ndarray, below: Below | None = None) -> np.ndarray:
        """Log-probability of each class, and of the path below it where there are levels."""
        sums, _ = self.sums(context, below)
        z = np.tanh(sums) @ self.parts[2] + self.parts[3]
        _, total = raised(z, *self.parts[2:4])
        out = z[np.arange(len(target)), target] - np.log(total)
        for t, _, z, _, total, d in self.descend(sums, target, below) if self.levels else ():
            out[t] += z[np.arange(len(t)), d] - np.log(total)
        return out

    def step(self, context: np.ndarray, target: np.ndarray, rate: float, below: Below | None = None) -> None:
        e, b, w, c = self.parts[:4]
        n = len(target)
        sums, code = self.sums(context, below)
        h = np.tanh(sums)
        d, total = raised(h @ w + c, w, c)
        d /= total[:, None]
        d[np.arange(n), target] -= 1
        d *= rate / n
        dh = (d @ w.T) * (1 - h * h)
        if self.levels:
            dh += self.step_below(sums, target, rate, below)
            self.step_codes(dh, context, code, below)
        w -= h.T @ d
        c -= d.sum(0)
        b -= dh.sum(0)
        for k in range(len(context)):
            pour(e[k], context[k], dh)

    def step_below(self, sums: np.ndarray, target: np.ndarray, rate: float, below: Below) -> np.ndarray:
        """Change the weights of the levels; returns the change of what enters the hidden layer."""
        q0, q, u = self.parts[6:]
        back = np.zeros_like(sums)
        digits = below.digits[:, self.s.sides : self.s.sides + len(target)]
        for level, (t, g, _, d, total, own) in reversed(list(enumerate(self.descend(sums, target, below)))):
            d /= total[:, None]
            d[np.arange(len(t)), own] -= 1
            d *= rate / len(target)
            back[t] += (d @ u[level].T) * (1 - g * g)
            u[level] -= g.T @ d
            if level:
                pour(q[level - 1], digits[level - 1, t], back[t])
        pour(q0, target, back)
        return back

    def step_codes(self, dh: np.ndarray, context: np.ndarray, code: np.ndarray, below: Below) -> None:
        f, m = self.parts[4:6]
        dcode = np.zeros_like(code)
        for k, o in enumerate(self.s.offsets):
            here = slice(self.s.sides + o, self.s.sides + o + len(dh))
            d, beyond = dh, np.flatnonzero(context[k] == self.s.classes)
            if len(beyond):
                d = dh.copy()
                d[beyond] = 0
            dcode[here] += d @ m[k].T
            m[k] -= code[here].T @ d
        for level in range(self.levels):
            t = np.flatnonzero(below.nodes[level] >= 0)
            pour(f[level], below.digits[level].take(t), dcode.take(t, 0))


def tokens(data: np.ndarray, at: np.ndarray, hasher: SpanHash, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, or its bucket where the settings have buckets, and the first word of each row."""
    low = LOWER[data]
    starts, ends, first = spans_of(IS_WORD, low, at)
    hasher.load(low)
    hashes = mix64(hasher.of(starts, ends))
    return (hashes if s.buckets is None else (hashes & U64(s.buckets - 1)).astype(np.int64)), first


def read(data: np.ndarray, at: np.ndarray, hasher: SpanHash, lex: Lexicon, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, Below | None, np.ndarray]:
    """Of the words of some rows: ids in the lexicon, classes, neighbours' classes, paths; and the first word of each row."""
    ids, first = tokens(data, at, hasher, s)
    below = None
    if lex.tree:
        ids = lex.tree.find(ids)
        digits, nodes = lex.tree.paths(ids)
        ends = ((0, 0), (s.sides, s.sides))
        below = Below(np.pad(digits, ends, constant_values=BRANCH), np.pad(nodes, ends, constant_values=-1), lex.tree.log_count)
    cls = lex.of[ids].astype(np.int64)
    return ids, cls, contexts(cls, first, s), below, first


def contexts(classes: np.ndarray, first: np.ndarray, s: Settings) -> np.ndarray:
    """Classes of the neighbours of each word, ``s.classes`` beyond the row's ends."""
    n = len(classes)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out = np.full((2 * s.sides, n), s.classes, np.int64)
    for k, o in enumerate(s.offsets):
        if abs(o) < n:
            here = slice(max(0, -o), n - max(0, o))
            there = slice(max(0, o), n - max(0, -o))
            out[k, here] = np.where(row[here] == row[there], classes[there], s.classes)
    return out


def hasher() -> SpanHash:
    return SpanHash(0x2545F4914F6CDD1D, 41)


def lexicon(docs: DataFrame, s: Settings = Settings(), text: str = "text") -> Lexicon:
    """Count the words of all documents and form classes; the driver gets a hash and a count for each distinct word."""
    if s.buckets is not None:
        return bucket_lexicon(docs, s, text)

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        h = np.concatenate([p[0] for p in parts])
        n = np.concatenate([p[1] for p in parts])
        order = np.argsort(h)
        h = h[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        return h[first], np.add.reduceat(n[order], first)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, hash_ = [], 0, hasher()

        def out() -> Iterator[pa.RecordBatch]:
            h, n = merged(parts)
            for k in range(0, len(h), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(h[k : k + (1 << 16)].view(np.int64)), pa.array(n[k : k + (1 << 16)])], ["h", "n"])

        for batch in batches:
            for _, data, at in slices(batch, "t", 1 << 19):
                h, n = np.unique(tokens(data, at, hash_, s)[0], return_counts=True)
                if len(h):
                    parts.append((h, n))
                    held += len(h)
                if held > 1 << 21:
                    parts = [merged(parts)]
                    held = len(parts[0][0])
                    if held > 1 << 20:
                        yield from out()
                        parts, held = [], 0
        if parts:
            yield from out()

    sums = docs.select(F.col(text).alias("t")).mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).toArrow()
    keys, counts = sums["h"].to_numpy().view(U64), sums["n"].to_numpy()
    del sums
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    del order
    of, tree = planted(keys, counts, s)
    return Lexicon(of, None, tree, int(counts.sum()))


def bucket_lexicon(docs: DataFrame, s: Settings, text: str) -> Lexicon:
    """Count the words of all documents in ``s.buckets`` buckets (the driver gets one number for each) and form classes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, hash_ = np.zeros(s.buckets, np.int64), hasher()
        for batch in batches:
            for _, data, at in slices(batch, "t", 1 << 19):
                total += np.bincount(tokens(data, at, hash_, s)[0], minlength=s.buckets)
        seen = np.flatnonzero(total)
        for k in range(0, len(seen), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(seen[k : k + (1 << 16)]), pa.array(total[seen[k : k + (1 << 16)]])], ["b", "n"])

    sums = docs.select(F.col(text).alias("t")).mapInArrow(count, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(s.buckets, np.int64)
    counts[sums["b"].to_numpy(np.int64)] = sums["n"].to_numpy(np.int64)
    order = np.argsort(-counts, kind="stable")
    mass = counts[order] + s.smoothing
    before = np.cumsum(mass) - mass
    of = np.empty(s.buckets, np.int64)
    of[order] = np.minimum((before / mass.sum() * s.classes).astype(np.int64), s.classes - 1)
    held = np.bincount(of, counts + s.smoothing, s.classes)
    return Lexicon(of, np.log((counts + s.smoothing) / held[of]), None, int(counts.sum()))


def train(docs: DataFrame, lex: Lexicon, s: Settings = Settings(), doc: str = "doc_id", text: str = "text") -> Net:
    """The averaged network; every document is in one share of one round.

    Each share is a partition, sorted by the hash of id and text; rows equal in both stand side by side in the same share.
    """
    net = Net(s, levels=lex.levels)
    sc = docs.sparkSession.sparkContext
    words = sc.broadcast(lex)
    shares = min(s.most, 1 + lex.words // (s.rounds * s.share))
    key = F.xxhash64(F.col(doc), F.col(text))
    rows = docs.where(F.length(text) > 0).select(F.pmod(key, F.lit(s.rounds)).alias("r"), F.xxhash64(key).alias("key"), F.col(text).alias("t"))
    for r in range(s.rounds):
        start = net.flat.copy()

        def learn(batches: Iterator[pa.RecordBatch], start: np.ndarray = start, r: int = r) -> Iterator[pa.RecordBatch]:
            lexi = words.value
            own, hash_, seen = Net(s, start, lexi.levels), hasher(), 0
            for batch in batches:
                for _, data, at in slices(batch, "t", 1 << 19):
                    _, cls, ctx, below, _ = read(data, at, hash_, lexi, s)
                    for k in range(0, len(cls), s.batch):
                        own.step(ctx[:, k : k + s.batch], cls[k : k + s.batch], s.rate / (1 + r + seen / 2_000_000) * min(1.0, len(cls[k : k + s.batch]) / s.batch), below and below.part(k, min(k + s.batch, len(cls)), s.sides))
                        seen += len(cls[k : k + s.batch])
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(own.flat))), pa.array(own.flat.astype(np.float64) * seen), pa.array(np.full(len(own.flat), float(seen)))], ["k", "v", "n"])

        dealt = rows.where(F.col("r") == r).select("key", "t").repartitionById(shares, F.pmod("key", F.lit(shares)).cast("int")).sortWithinPartitions("key").select("t")
        parts = dealt.mapInArrow(learn, "k long, v double, n double")
        mean = parts.groupBy("k").agg((F.sum("v") / F.sum("n")).alias("v")).toPandas()
        if len(mean):
            flat = net.flat.copy()
            flat[mean["k"].to_numpy(np.int64)] = mean["v"].to_numpy()
            net = Net(s, flat, lex.levels)
    words.destroy()  # the rounds are over; scoring sends its own
    return net


def score(docs: DataFrame, lex: Lexicon, net: Net, s: Settings = Settings(), text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, n_tokens, log_prob (the sum over all words of the log-probability given both sides) and mean_log_prob for every row.

    Null and empty texts have no tokens and 0 for both. Repeated rows score the same; extra columns are not read.
    """
    sc = docs.sparkSession.sparkContext
    words, weights = sc.broadcast(lex), sc.broadcast(net.flat)
    rows = docs.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[: len(keep)]) + ", n_tokens long, log_prob double, mean_log_prob double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexi = words.value
        net, hash_ = Net(s, weights.value, lexi.levels), hasher()
        for batch in batches:
            for part, data, at in slices(batch, "__text", 1 << 19):
                ids, cls, ctx, below, first = read(data, at, hash_, lexi, s)
                each = np.zeros(len(cls)) if lexi.tree else lexi.log_inner[ids]
                for k in range(0, len(cls), s.batch):
                    t = cls[k : k + s.batch]
                    each[k : k + s.batch] += net.log_prob(ctx[:, k : k + s.batch], t, below and below.part(k, k + len(t), s.sides))
                total = np.array([each[a:b].sum() for a, b in zip(first[:-1], first[1:], strict=True)])
                n = np.diff(first)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(n, pa.int64()), pa.array(total, pa.float64()), pa.array(total / np.maximum(n, 1), pa.float64())], [*keep, "n_tokens", "log_prob", "mean_log_prob"])

    return rows.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op10: pseudo-likelihood of every document under a model of all of them."""
    from .common import table

    docs, s = table(spark, sf_dir, "documents"), Settings()
    lex = lexicon(docs, s)
    return score(docs, lex, train(docs, lex, s), s)
