"""Secret scans: base patterns, and character Markov models of random strings and of ordinary identifiers compared by log-likelihood ratio."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, least_hashed, pieces, through

KINDS = ("assign", "access", "hex", "markov")
KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: What the models judge: runs that may hold a key; every hex run of the base patterns lies in one.
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CODE = np.full(256, len(LETTERS), np.int64)
CODE[np.frombuffer(LETTERS.encode(), np.uint8)] = np.arange(len(LETTERS))


@dataclass(frozen=True)
class Settings:
    """``train_rows`` bounds the sample of texts that labelled strings are taken from: the rows with the smallest hash of doc_id (all rows of the last id count)."""

    train_rows: int = 3_000
    smoothing: float = 0.2
    #: A letter counts for a secret by what its log-likelihood ratio exceeds this many nats.
    nats: float = 1.5
    #: A stretch is a secret if its letters exceed that by so many nats together, it is long enough, and holds digits and letters.
    total: float = 18.0
    least: int = 16


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratio (random against ordinary) of each letter after each letter."""

    ratio: np.ndarray

    def ratios(self, text: str) -> np.ndarray:
        """Ratio of each letter of a run but the first."""
        c = CODE[np.frombuffer(text.encode(), np.uint8)]
        return self.ratio[c[:-1], c[1:]]

    def score(self, text: str) -> float:
        """Mean ratio a letter of a run."""
        return float(self.ratios(text).mean())

    def stretches(self, run: str, settings: Settings) -> Iterator[tuple[int, int]]:
        """Stretches of a run that are likelier random, best first: each the segment with the largest excess in what is left of the run."""
        over = self.ratios(run) - settings.nats
        todo = [(0, len(run))]
        while todo:
            a, b = todo.pop()
            if b - a < settings.least:
                continue
            sums = np.concatenate([[0.0], np.cumsum(over[a : b - 1])])
            low = np.minimum.accumulate(sums)
            end = int((sums - low).argmax())
            if sums[end] - low[end] < settings.total:
                continue
            begin = int(sums[: end + 1].argmin())
            x, y = a + begin, a + end + 1
            part = run[x:y]
            if y - x >= settings.least and any(map(str.isalpha, part)) and any(map(str.isdigit, part)):
                yield x, y
            todo += [(a, x), (y, b)]


def transitions(samples: list[str], smoothing: float) -> np.ndarray:
    n = len(LETTERS) + 1
    total = np.full((n, n), smoothing)
    for s in samples:
        c = CODE[np.frombuffer(s.encode("latin-1", "replace"), np.uint8)]
        np.add.at(total, (c[:-1], c[1:]), 1)
    return np.log(total / total.sum(1, keepdims=True))


def fit(secret: list[str], ordinary: list[str], settings: Settings = Settings()) -> Model:
    """Both chains from labelled samples."""
    return Model(transitions(secret, settings.smoothing) - transitions(ordinary, settings.smoothing))


def drawn(n: int = 400, seed: int = 7) -> list[str]:
    """Labelled random strings that no corpus need hold: base 64, alphanumeric and hexadecimal."""
    rng = random.Random(seed)
    kinds = (LETTERS[:64], LETTERS[:62], LETTERS[26:62], "0123456789abcdef")
    return ["".join(rng.choice(kinds[k % 4]) for _ in range(20 + k % 21)) for k in range(n)]


#: Words that identifiers are commonly made of.
IDENTIFIER_WORDS = (
    "access account action address archive array async attribute background batch build cache callback channel character check client cluster code column "
    "command commit common component connection content context convert count create current database date default delete description device directory "
    "document download element enable encoding entry environment error event example exception execute export extension factory field file filter format "
    "function generate global group hash header height history host image import index information initialize input instance integer interface internal "
    "iterator language length level library line link load local location log manager map memory message method model module monitor name network node "
    "object offset operation option order output package parameter parent parse path pattern performance permission pixel platform pointer policy port "
    "position prefix previous process profile project property protocol provider queue random range record reference region register remote remove report "
    "request reset resource response result return root route sample schedule schema scope script search segment select sequence server service session "
    "size source stack standard start state static status storage stream string structure style submit summary support switch symbol system table target "
    "task template text thread time title transaction transform type unique update upload user utility validate value variable vector version view window"
).split()


def identifiers(n: int = 4000, seed: int = 13) -> list[str]:
    """Labelled ordinary identifiers: two to six words in the usual cases, some with a number behind."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        words = rng.choices(IDENTIFIER_WORDS, k=2 + k % 5)
        cased = ("_".join(words), "-".join(words), "/".join(words), words[0] + "".join(w.capitalize() for w in words[1:]), "".join(w.capitalize() for w in words), "_".join(words).upper())
        out.append(cased[k // 5 % 6] + (str(rng.randrange(1000)) if k % 3 == 0 else ""))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns in code points: leftmost matches that do not overlap within a kind, failing ones dropped."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    for r in RUN.finditer(text):
        if len(r[0]) >= 24:
            out += [(r.start() + m.start(), 2, r.start() + m.end()) for m in HEX.finditer(r[0]) if m.end() - m.start() >= 24]
    return sorted(out)


def model_spans(text: str, base: list[tuple[int, int, int]], model: Model, settings: Settings) -> list[tuple[int, int, int]]:
    """What the models take for random in the runs, with the base spans cut out of them."""
    out = []
    for r in RUN.finditer(text):
        if r[0].isalpha():
            continue
        last = r.start()
        parts = []
        for a, _, b in base:
            if a < r.end() and r.start() < b:
                parts.append((last, a))
                last = max(last, b)
        for a, b in [*parts, (last, r.end())]:
            if b - a >= settings.least:
                out += [(a + x, 3, a + y) for x, y in model.stretches(text[a:b], settings)]
    return out


def labelled(text: str) -> tuple[list[str], list[str]]:
    """Strings of a text by the base patterns: their values are random, other runs and words ordinary."""
    base = base_spans(text)
    last, rest = 0, []
    for a, _, b in base:
        rest.append(text[last:a])
        last = max(last, b)
    secret = [text[a:b] if k != 0 else ASSIGN.match(text, a)[2] for a, k, b in base]
    return secret, re.findall(r"[A-Za-z0-9+/_=-]{4,}", " ".join([*rest, text[last:]]))


def train(df: DataFrame, settings: Settings = Settings(), text: str = "text", doc_id: str = "doc_id") -> Model:
    """Label strings of a bounded sample of texts; drawn random strings and identifiers are added. Rows without id or text teach nothing.

    Executors count transitions and sum them; the driver gets one table of letter pairs.
    """
    rows = least_hashed(df.select(F.col(doc_id).alias("i"), F.col(text).alias("t")), "i", settings.train_rows).select("t")
    size = len(LETTERS) + 1

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, size, size), np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                for k, strings in enumerate(labelled(t) if t else ()):
                    c = CODE[np.frombuffer("\n".join(strings).encode("latin-1", "replace"), np.uint8)]
                    np.add.at(n[k], (c[:-1], c[1:]), 1)
        flat = n.ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], ["k", "n"])

    total = np.full(2 * size * size, settings.smoothing)
    sums = through(rows, label, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    total[sums["k"].to_numpy()] += sums["n"].to_numpy()
    total = total.reshape(2, size, size)
    for k, strings in enumerate((drawn(), identifiers())):
        c = CODE[np.frombuffer("\n".join(strings).encode(), np.uint8)]
        np.add.at(total[k], (c[:-1], c[1:]), 1)
    log = np.log(total / total.sum(2, keepdims=True))
    return Model(log[0] - log[1])


def named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(df: DataFrame, model: Model, settings: Settings = Settings(), text: str = "text", keep: tuple[str, ...] = ("doc_id",), mask: str | None = None) -> DataFrame:
    """``keep``, the counts of base spans, base_sha256, spans (kind:start:end, code points, end exclusive) and n_markov; with ``mask`` also
    ``masked``: the text with each stretch of spans replaced by it (null stays null).

    Null and empty texts have no spans. Spans of different kinds may overlap; those of the models never overlap base ones,
    hold 16 letters or more of which some are letters and some digits, and runs of letters alone have none. Rows are
    independent: repeated rows give equal results, an empty table gives none, and other columns are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def found(values: pa.Array) -> pa.RecordBatch:
        counts: list[list[int]] = [[], [], [], []]
        sha, spans, masked = [], [], []
        for a, b in pieces(values):
            for t in values.slice(a, b - a).to_pylist():
                base = base_spans(t) if t else []
                more = model_spans(t, base, shared.value, settings) if t else []
                for k in range(4):
                    counts[k].append(sum(x[1] == k for x in (more if k == 3 else base)))
                sha.append(hashlib.sha256(named(base).encode()).hexdigest())
                spans.append(named(base + more))
                masked.append(masked_text(t, base + more, mask) if mask is not None and base + more else None)
        cols = [*(pa.array(c, pa.int64()) for c in counts[:3]), pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array(counts[3], pa.int64()), *([pa.array(masked, pa.string())] if mask is not None else [])]
        return pa.RecordBatch.from_arrays(cols, ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov", *(["masked"] if mask is not None else [])])

    kinds = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long" + ", masked string" * (mask is not None)
    names = [x.split()[0] for x in kinds.split(", ")]
    rows = df.select(*keep, F.col(text).alias("__text"), beside(df, text, found, kinds).alias("__found"))
    whole = [F.coalesce("__found.masked", "__text").alias("masked")] if mask is not None else []  # only changed texts come back
    return rows.select(*keep, *(f"__found.{x}" for x in names if x != "masked"), *whole)


def masked_text(text: str, spans: list[tuple[int, int, int]], mask: str) -> str:
    out, last = [], 0
    for a, _, b in sorted(spans):
        if a >= last:
            out += [text[last:a], mask]
        last = max(last, b)
    return "".join([*out, text[last:]])


def query(spark, sf_dir: str) -> DataFrame:
    """op7: secrets of every whole text of documents."""
    from .common import table

    docs, settings = table(spark, sf_dir, "documents"), Settings()
    return scan(docs, train(docs, settings), settings)
