"""Quality classifier: a sparse rule ensemble.

Statistics of each text are read off its bytes; boosted trees over a bounded sample of labelled rows give paths, which are
conjunctive rules over the statistics; a logistic model with an l1 penalty over all rules and the statistics themselves
keeps few of them; what it keeps is compiled into one Spark column expression.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, SpanHash, mix64, slices, spans_of

CLASSES = ("lower", "upper", "digit", "blank", "newline", "stop", "mark", "bang", "bar", "high")
KIND = np.full(256, 6, np.uint8)
KIND[97:123], KIND[65:91], KIND[48:58], KIND[[32, 9, 11, 12]], KIND[[10, 13]], KIND[[44, 46, 58, 59]], KIND[[33, 63]], KIND[124], KIND[128:] = 0, 1, 2, 3, 4, 5, 7, 8, 9
IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
STATS = (*(f"share_{c}" for c in CLASSES), "log_bytes", "log_words", "word_bytes", "distinct_words", "top_word", "long_words", "line_bytes", "repeated_lines", "repeated_runs", "stops_per_word", "short_words", "capital_words")


def statistics(data: np.ndarray, at: np.ndarray, hasher: SpanHash) -> np.ndarray:
    """The statistics of each row of a buffer; an empty row has zeros."""
    rows = len(at) - 1
    out = np.zeros((rows, len(STATS)))
    size = np.diff(at)
    kind = KIND[data]
    row = np.repeat(np.arange(rows), size)
    per = np.bincount(row * len(CLASSES) + kind, minlength=rows * len(CLASSES)).reshape(rows, -1)
    n = np.maximum(size, 1)
    out[:, : len(CLASSES)] = per / n[:, None]
    starts, ends, first = spans_of(IS_WORD, data, at)
    hasher.load(data)
    h, length = hasher.of(starts, ends), ends - starts
    words = np.diff(first)
    w = np.maximum(words, 1)
    total = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[first])
    c = len(CLASSES)
    out[:, c], out[:, c + 1] = np.log1p(size), np.log1p(words)
    out[:, c + 2], out[:, c + 5], out[:, c + 10] = total(length) / w, total(length > 14) / w, total(length < 4) / w
    out[:, c + 9] = per[:, 5] / w
    out[:, c + 11] = total(KIND[data[starts]] == 1) / w if len(starts) else 0
    lines_s, lines_e, lines = spans_of(~np.isin(np.arange(256), [10, 13]), data, at)
    lh, n_lines = hasher.of(lines_s, lines_e), np.diff(lines)
    out[:, c + 6] = size / np.maximum(n_lines, 1)
    runs = mix64(h[:-4] + h[1:-3] * U64(3) + h[2:-2] * U64(9) + h[3:-1] * U64(27) + h[4:] * U64(81)) if len(h) > 4 else h[:0]
    for k in np.flatnonzero(words).tolist():
        a, b = int(first[k]), int(first[k + 1])
        v = np.sort(h[a:b])
        cuts = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1], [True]]))
        out[k, c + 3], out[k, c + 4] = (len(cuts) - 1) / (b - a), np.diff(cuts).max() / (b - a)
        if n_lines[k] > 1:
            out[k, c + 7] = 1 - len(np.unique(lh[lines[k] : lines[k + 1]])) / n_lines[k]
        if b - a > 5:
            out[k, c + 8] = 1 - len(np.unique(runs[a : b - 4])) / (b - a - 4)
    return out


def with_statistics(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the statistics, each a double, of every row; null is empty."""
    rows = df.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[: len(keep)]) + "".join(f", {x} double" for x in STATS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHash(0x2545F4914F6CDD1D, 31)
        for batch in batches:
            for part, data, at in slices(batch, "__text", 1 << 19):
                got = statistics(data, at, hasher)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(np.ascontiguousarray(x)) for x in got.T)], [*keep, *STATS])

    return rows.mapInArrow(run, schema)


@dataclass(frozen=True)
class Settings:
    """``train_rows`` bounds the labelled sample: the rows with the smallest hash of doc_id among those that may be learnt from."""

    train_rows: int = 6_000
    folds: int = 3
    held_fold: int = 1
    trees: int = 40
    depth: int = 3
    cuts: int = 24
    rate: float = 0.3
    least: int = 12  # rows of a leaf
    penalty: float = 0.002
    steps: int = 400


#: A rule is a conjunction of (statistic, whether above, threshold).
Rule = tuple[tuple[int, bool, float], ...]


@dataclass(frozen=True)
class Model:
    bias: float
    rules: tuple[tuple[Rule, float], ...] = ()
    #: statistic, weight, and the bounds to which it is clipped
    linear: tuple[tuple[int, float, float, float], ...] = field(default=())

    def logit(self) -> Column:
        """The model as one column expression over the statistics."""
        parts = [F.lit(float(self.bias))]
        for rule, w in self.rules:
            on = functools.reduce(operator.and_, ((F.col(STATS[k]) > t) if above else (F.col(STATS[k]) <= t) for k, above, t in rule))
            parts.append(F.when(on, F.lit(float(w))).otherwise(F.lit(0.0)))
        for k, w, low, high in self.linear:
            parts.append(F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), F.col(STATS[k]))) * F.lit(float(w)))
        return functools.reduce(operator.add, parts)

    def numpy_logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for rule, w in self.rules:
            out += w * holds(rule, x)
        for k, w, low, high in self.linear:
            out += w * np.clip(x[:, k], low, high)
        return out


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    on = np.ones(len(x), bool)
    for k, above, t in rule:
        on &= (x[:, k] > t) == above
    return on


def grow(x: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, s: Settings, path: Rule, out: list[tuple[Rule, np.ndarray, float]]) -> None:
    """Second-order regression tree by greedy splits; appends every node but the root as a rule, with its rows and step for leaves."""
    best = (1e-6, -1, 0.0)
    total_g, total_h = g[rows].sum(), h[rows].sum()
    if depth and len(rows) >= 2 * s.least:
        for k in range(x.shape[1]):
            if not len(cuts[k]):
                continue
            b = np.searchsorted(cuts[k], x[rows, k])  # x <= cuts[b]
            m = len(cuts[k]) + 1
            gl, hl, nl = (np.cumsum(np.bincount(b, v, m))[:-1] for v in (g[rows], h[rows], np.ones(len(rows))))
            gain = gl**2 / (hl + 1) + (total_g - gl) ** 2 / (total_h - hl + 1) - total_g**2 / (total_h + 1)
            gain[(nl < s.least) | (len(rows) - nl < s.least)] = -1
            j = int(gain.argmax())
            if gain[j] > best[0]:
                best = (float(gain[j]), k, float(cuts[k][j]))
    _, k, t = best
    if k < 0:
        out.append((path, rows, -total_g / (total_h + 1)))
        return
    if path:
        out.append((path, rows, 0.0))
    for above in (False, True):
        grow(x, cuts, g, h, rows[(x[rows, k] > t) == above], depth - 1, s, (*path, (k, above, t)), out)


def fit(x: np.ndarray, y: np.ndarray, s: Settings = Settings()) -> Model:
    """Rules by boosting, weights by an accelerated proximal gradient on the l1-penalised logistic loss."""
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return Model(float(np.log(p / (1 - p))))
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0.02, 0.98, s.cuts), method="lower")) for k in range(x.shape[1])]
    cuts = [c[c < x[:, k].max()] for k, c in enumerate(cuts)]
    z = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    rules: dict[Rule, None] = {}
    for _ in range(s.trees):
        p = 1 / (1 + np.exp(-z))
        nodes: list[tuple[Rule, np.ndarray, float]] = []
        grow(x, cuts, p - y, p * (1 - p), np.arange(len(y)), s.depth, s, (), nodes)
        for path, rows, step in nodes:
            z[rows] += s.rate * step
            if path:
                rules[path] = None
    rules_ = list(rules)
    low, high = np.quantile(x, 0.025, axis=0), np.quantile(x, 0.975, axis=0)
    clipped = np.clip(x, low, high)
    spread = clipped.std(0)
    usable = np.flatnonzero(spread > 1e-9)
    a = np.column_stack([*(holds(r, x).astype(float) for r in rules_), *(0.4 * (clipped[:, k] - clipped[:, k].mean()) / spread[k] for k in usable)])
    mean = a.mean(0)
    a -= mean
    scale = 4 * len(y) / max(np.linalg.norm(a, 2) ** 2, 1e-9)
    w, v, bias, t = np.zeros(a.shape[1]), np.zeros(a.shape[1]), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), 1.0
    for _ in range(s.steps):
        r = 1 / (1 + np.exp(-(a @ v + bias))) - y
        new = v - scale * (a.T @ r) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - scale * s.penalty, 0)
        bias -= 2 * float(r.mean())
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        w, v, t = new, new + (t - 1) / t2 * (new - w), t2
    bias -= float(mean @ w)
    kept = [(r, float(c)) for r, c in zip(rules_, w, strict=False) if c]
    linear = []
    for k, c in zip(usable, w[len(rules_) :], strict=True):
        if c:
            b = 0.4 * c / spread[k]
            bias -= b * clipped[:, k].mean()
            linear.append((int(k), float(b), float(low[k]), float(high[k])))
    return Model(bias, tuple(kept), tuple(linear))


def held_out(doc_id: str, s: Settings) -> Column:
    """True where crc32(doc_id as text) leaves the held-out remainder."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(s.folds)) == s.held_fold


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), doc: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Learn from a bounded sample of labelled rows outside the held-out fold; without labels of both kinds the model is their smoothed share."""
    marked = labels.where(F.col(label).isNotNull() & F.col(doc).isNotNull()).select(F.col(doc).alias("i"), F.col(label).cast("int").alias("y")).where(~held_out("i", s))
    marked = marked.groupBy("i").agg(F.max("y").alias("y")).orderBy(F.xxhash64("i"), "i").limit(s.train_rows)
    rows = docs.select(F.col(doc).alias("i"), F.col(text).alias("t")).join(F.broadcast(marked), "i")
    got = with_statistics(rows, "t", ("i", "y")).toPandas().sort_values(["i", *STATS])
    return fit(got[list(STATS)].to_numpy(float), (got["y"].to_numpy() > 0).astype(float), s)


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, score (0 to 1, higher: label 1 likelier) and predicted for every row; null and empty texts have zeros for statistics."""
    p = 1 / (1 + F.exp(-model.logit()))
    return with_statistics(docs, text, keep).select(*keep, p.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def query(spark, sf_dir: str) -> DataFrame:
    """op8: quality of every document."""
    from .common import table

    docs, s = table(spark, sf_dir, "documents"), Settings()
    out = score(docs, train(docs, table(spark, sf_dir, "labels"), s))
    return out.select("doc_id", held_out("doc_id", s).alias("held_out"), "score", "predicted")
