"""Language identification: multinomial naive Bayes over hashed character n-grams.

The log-probability matrix (buckets x languages) is small and of fixed size, so it is broadcast; scoring gathers its
rows for the n-grams of a whole batch of texts and sums them per text (sparse batch scoring in numpy).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, beside, least_hashed, mix64, pieces, through

UNDETERMINED = "und"


@dataclass(frozen=True)
class Settings:
    """``train_rows`` bounds the labelled sample: the rows with the smallest hash of doc_id among those that may be learnt from (all rows of the last id count)."""

    orders: tuple[int, ...] = (1, 2, 3)
    buckets: int = 1 << 15
    smoothing: float = 0.5
    train_rows: int = 12_000
    folds: int = 4
    held_fold: int = 2
    #: For ``score`` alone, log-odds are scaled by (n-grams of the text) ** -cooling, as neighbouring n-grams are not independent.
    cooling: float = 0.5


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    log_prior: np.ndarray
    log_prob: np.ndarray  # buckets x languages, float32


def held_out(doc_id: str, settings: Settings) -> F.Column:
    """True where crc32(doc_id as text) leaves the held-out remainder."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(settings.folds)) == settings.held_fold


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts, each with a blank before and behind, and the offsets."""
    padded = [f" {x.lower()} " for x in texts]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.concatenate([[0], np.cumsum([len(x) for x in padded])]).astype(np.int64)


def grams(points: np.ndarray, order: int, buckets: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each position (the last order - 1 positions have none)."""
    if len(points) < order:
        return np.zeros(0, np.int32)
    h = np.full(len(points) - order + 1, order, U64)
    for k in range(order):
        h = h * U64(0x9E3779B97F4A7C15) + points[k : len(points) - order + 1 + k]
    return (mix64(h) & U64(buckets - 1)).astype(np.int32)


def in_text(sizes: np.ndarray, order: int) -> np.ndarray:
    return np.maximum(sizes - order + 1, 0)


def train(df: DataFrame, settings: Settings = Settings(), text: str = "text", label: str = "lang", doc_id: str = "doc_id") -> Model:
    """Learn from a bounded sample of labelled rows outside the held-out fold.

    Rows without id, text or label teach nothing. Counts are made and summed on the executors; the driver gets ``buckets``
    counts at most for each language that the sample has, and an empty sample gives a model without languages.
    """
    rows = df.select(F.col(doc_id).alias("i"), F.col(text).alias("t"), F.col(label).alias("l"))
    sample = least_hashed(rows.where(F.col("t").isNotNull() & F.col("l").isNotNull() & ~held_out("i", settings)), "i", settings.train_rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                points, _ = code_points([t])
                total = seen.setdefault(lang, np.zeros(settings.buckets + 1, np.int64))
                total[-1] += 1  # behind the buckets: rows
                for order in settings.orders:
                    total[:-1] += np.bincount(grams(points, order, settings.buckets), minlength=settings.buckets)
        for lang, total in seen.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(total[at])], ["l", "b", "n"])

    sums = through(sample.select("t", "l"), count, "l string, b long, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).toArrow()
    languages = tuple(sorted(set(sums["l"].to_pylist())))
    counts = np.zeros((settings.buckets + 1, len(languages)))
    place = {x: k for k, x in enumerate(languages)}
    counts[sums["b"].to_numpy(), [place[x] for x in sums["l"].to_pylist()]] = sums["n"].to_numpy()
    if not languages:
        return Model((), np.zeros(0), np.zeros((settings.buckets, 0), np.float32))
    matrix, prior = counts[:-1] + settings.smoothing, counts[-1]
    return Model(languages, np.log(prior / prior.sum()), np.log(matrix / matrix.sum(0)).astype(np.float32))


def score_texts(texts: list[str], model: Model, settings: Settings) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language (the largest sum of log-prior and log-likelihood), cooled posterior and evidence of each text: the nats an
    n-gram by which that language explains the text better than n-grams drawn alike."""
    points, at = code_points(texts)
    sizes = np.diff(at)
    total = np.zeros((len(texts), len(model.languages)))
    n = np.zeros(len(texts))
    for order in settings.orders:
        g = grams(points, order, settings.buckets)
        count = in_text(sizes, order)
        n += count
        # positions whose n-gram would cross into the next text weigh nothing
        for k in range(len(model.languages)):
            sums = np.concatenate([[0.0], np.cumsum(model.log_prob[:, k][g], dtype=np.float64)])
            total[:, k] += sums[np.minimum(at[:-1] + count, len(g))] - sums[np.minimum(at[:-1], len(g))]
    row = np.arange(len(texts))
    best = (total + model.log_prior).argmax(1)
    evidence = total[row, best] / np.maximum(n, 1) + np.log(settings.buckets)
    cooled = total / np.maximum(n, 1)[:, None] ** settings.cooling + model.log_prior
    post = np.exp(cooled - cooled.max(1, keepdims=True))
    return [model.languages[b] for b in best], post[row, best] / post.sum(1), evidence


def identify(df: DataFrame, model: Model, settings: Settings = Settings(), text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` plus lang_pred, score (cooled posterior, 0 to 1) and evidence (nats an n-gram over n-grams drawn alike) for every row.

    Null texts, texts without a letter and any text when nothing could be learnt are ``und`` with score and evidence 0.
    Repeated rows give equal results, ties go to the language first in order, and other columns of ``df`` are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def found(values: pa.Array) -> pa.RecordBatch:
        m = shared.value
        langs, scores, evidence = [UNDETERMINED] * len(values), np.zeros(len(values)), np.zeros(len(values))
        for a, b in pieces(values, 1 << 19):
            texts = values.slice(a, b - a).to_pylist()
            if at := [k for k, x in enumerate(texts) if m.languages and x is not None and has_letter(x)]:
                got, post, more = score_texts([texts[k] for k in at], m, settings)
                scores[a + np.array(at)], evidence[a + np.array(at)] = post, more
                for k, lang in zip(at, got, strict=True):
                    langs[a + k] = lang
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(scores), pa.array(evidence)], ["lang_pred", "score", "evidence"])

    rows = df.select(*keep, beside(df, text, found, "lang_pred string, score double, evidence double").alias("__found"))
    return rows.select(*keep, "__found.*")


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def query(spark, sf_dir: str) -> DataFrame:
    """op3: language of every document; learns only outside the held-out fold."""
    from .common import table

    docs, settings = table(spark, sf_dir, "documents"), Settings()
    out = identify(docs, train(docs, settings), settings)
    return out.select("doc_id", held_out("doc_id", settings).alias("held_out"), "lang_pred", "score")


def fold_of(doc_id: int, settings: Settings = Settings()) -> bool:
    """The same fold in Python, for tests."""
    return zlib.crc32(str(doc_id).encode()) % settings.folds == settings.held_fold
