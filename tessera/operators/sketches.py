"""HyperLogLog sketches of out-neighbourhoods, in three profiles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as H


@dataclass(frozen=True)
class Profile:
    """How sketches are made and used; see ``S``, ``C`` and ``X``."""

    hash: str  # plain, seeded or murmur
    index: str  # high or low bits give the register
    strict: bool  # routed to sketches above the threshold only, or from it on
    exact_degrees: bool  # inclusion-exclusion from exact degrees, or from three estimates
    upper: bool  # estimates are clamped to the smaller degree too
    domain: int  # bits of the large-range correction, 0 for none


S = Profile("plain", "high", False, True, True, 64)
C = Profile("seeded", "low", True, True, True, 32)
X = Profile("murmur", "high", True, False, False, 0)


def check(p: int) -> None:
    if not 4 <= p <= 16:
        raise ValueError(f"p must be in [4, 16], not {p}")


def memory_bytes(p: int) -> int:
    """Bytes of one sketch."""
    check(p)
    return 1 << p


def guard(n: int, p: int, most_gb: float) -> None:
    """Refuse sketches of more than ``most_gb`` in all."""
    if n * memory_bytes(p) > most_gb * 2**30:
        raise MemoryError(f"{n} sketches of {1 << p} bytes exceed {most_gb} GB")


def alpha(m: int) -> float:
    """Bias constant of m registers (fixed values)."""
    return {16: 0.673, 32: 0.697, 64: 0.709}.get(m, 0.7213 / (1 + 1.079 / m))


def with_register(df: DataFrame, x: Column, p: int, profile: Profile = S, seed: int = 0) -> DataFrame:
    """``df`` with j and rho of an id: its register, and the place of the first one bit behind."""
    check(p)
    h = F.col("__h")
    if profile.hash == "murmur":
        df = df.withColumn("__h", H.murmur32(x))
        df = df.withColumn("__w", H.low32(F.shiftleft(h, p)).bitwiseOR(F.lit(1).cast("bigint")).bitwiseAND(F.lit((1 << (32 - p)) - 1).cast("bigint")))
        j, top = H.shr(h, 32 - p), 33 - p
    else:
        df = H.with_hash64(df, x, "__h", None if profile.hash == "plain" else seed)
        bits = 64 - p
        high = profile.index == "high"
        df = df.withColumn("__w", h.bitwiseAND(F.lit((1 << bits) - 1).cast("bigint")) if high else H.shr(h, p))
        j, top = (H.shr(h, bits) if high else h.bitwiseAND(F.lit((1 << p) - 1).cast("bigint"))), bits + 1
    return df.withColumn("j", j.cast("int")).withColumn("rho", (F.lit(top) - H.bit_length(F.col("__w"))).cast("int")).drop("__h", "__w")


def registers(fwd: DataFrame, p: int, profile: Profile = S, theta: int = 0, seed: int = 0) -> DataFrame:
    """(node, j, rho): the non-zero registers of every node with ``theta`` out-neighbours or more."""
    if theta > 0:
        many = fwd.groupBy("src").agg(F.count("*").alias("d")).where(F.col("d") >= theta).select("src")
        fwd = fwd.join(many, "src", "left_semi")
    return with_register(fwd.select(F.col("src").alias("node"), "dst"), F.col("dst"), p, profile, seed).groupBy("node", "j").agg(F.max("rho").alias("rho"))


def estimate(z: Column, zeros: Column, p: int, profile: Profile = S) -> Column:
    """Cardinality from the sum of 2**-rho over all registers and the number of empty ones."""
    m = float(1 << p)
    raw = F.lit(alpha(1 << p) * m * m) / z
    out = F.when((raw <= 2.5 * m) & (zeros > 0), F.lit(m) * F.ln(F.lit(m) / zeros))
    if profile.domain:
        top = 2.0**profile.domain
        out = out.when(raw > top / 30, -top * F.ln(1 - raw / top))
    return out.otherwise(raw)


def cardinalities(regs: DataFrame, p: int, profile: Profile = S) -> DataFrame:
    """(node, estimate) from sparse registers."""
    m = 1 << p
    per = regs.groupBy("node").agg(F.sum(F.pow(F.lit(2.0), -F.col("rho"))).alias("s"), F.count("*").alias("k"))
    return per.select("node", estimate(F.col("s") + (m - F.col("k")), (m - F.col("k")).cast("double"), p, profile).alias("estimate"))


# Dense sketches: the form that many unions are made from.


def np_hash(x: np.ndarray, profile: Profile, seed: int) -> np.ndarray:
    if profile.hash == "murmur":
        h = (x.astype(np.uint64) & np.uint64(H.M32)).astype(np.uint32) ^ np.uint32(H.MURMUR_SEED)
        for _ in range(2):
            h = (h ^ h >> np.uint32(16)) * np.uint32(H.MURMUR_MULTIPLIER)
        return h ^ h >> np.uint32(16)
    z = x.astype(np.int64).view(np.uint64).copy()
    if profile.hash == "seeded":
        z += np.uint64((H.GAMMA + seed) & ((1 << 64) - 1))
    z = (z ^ z >> np.uint64(30)) * np.uint64(H.MULTIPLIER_1)
    z = (z ^ z >> np.uint64(27)) * np.uint64(H.MULTIPLIER_2)
    return z ^ z >> np.uint64(31)


def np_bit_length(w: np.ndarray) -> np.ndarray:
    """Exact bit lengths of unsigned integers: halves of 32 bits convert to doubles without rounding."""
    w = w.astype(np.uint64)
    high = (w >> np.uint64(32)).astype(np.float64)
    low = (w & np.uint64(H.M32)).astype(np.float64)
    return np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1])


def np_register(x: np.ndarray, p: int, profile: Profile, seed: int) -> tuple[np.ndarray, np.ndarray]:
    h = np_hash(x, profile, seed)
    if profile.hash == "murmur":
        rest = ((h << np.uint32(p)) | np.uint32(1)) & np.uint32((1 << (32 - p)) - 1)
        return (h >> np.uint32(32 - p)).astype(np.int64), 33 - p - np_bit_length(rest)
    if profile.index == "high":
        j, w = h >> np.uint64(64 - p), h & np.uint64((1 << (64 - p)) - 1)
    else:
        j, w = h & np.uint64((1 << p) - 1), h >> np.uint64(p)
    return j.astype(np.int64), 64 - p + 1 - np_bit_length(w)


def dense(adj: DataFrame, p: int, profile: Profile = S, theta: int = 0, seed: int = 0, most_gb: float | None = None) -> DataFrame:
    """(node, regs): 2**p bytes for each node with ``theta`` out-neighbours or more, straight from its array; theta 0 also gives sinks a sketch of zeros.

    With ``most_gb`` the nodes are counted first, and more than that many GB of sketches are refused before any is built.
    """
    check(p)
    m = 1 << p
    kept = adj.where(F.col("d_out") >= theta)
    if most_gb is not None:
        guard(kept.count(), p, most_gb)

    @F.pandas_udf("binary")
    def build(nbrs: pd.Series) -> pd.Series:
        size = nbrs.map(len).to_numpy(np.int64)
        out = np.zeros((len(size), m), np.uint8)
        if size.sum():
            j, rho = np_register(np.concatenate(nbrs.to_list()), p, profile, seed)
            np.maximum.at(out, (np.repeat(np.arange(len(size)), size), j), rho.astype(np.uint8))
        return pd.Series([r.tobytes() for r in out])

    return kept.select("node", build("nbrs").alias("regs"))


def np_estimate(regs: np.ndarray, p: int, profile: Profile) -> np.ndarray:
    m = float(1 << p)
    zeros = (regs == 0).sum(1)
    raw = alpha(1 << p) * m * m / np.exp2(-np.arange(256.0))[regs].sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = raw.copy()
        if profile.domain:
            top = 2.0**profile.domain
            out = np.where(raw > top / 30, -top * np.log1p(-raw / top), out)
        return np.where((raw <= 2.5 * m) & (zeros > 0), m * np.log(m / np.maximum(zeros, 1)), out)


def union_estimates(pairs: DataFrame, sketches: DataFrame, p: int, profile: Profile = S) -> DataFrame:
    """(src, dst, union_estimate) of pairs whose ends both have a dense sketch; a pair ships two sketches, whatever their fill."""
    m = 1 << p

    @F.pandas_udf("double")
    def union(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for ru, rv in batches:
            out = np.zeros(len(ru))
            for k in range(0, len(ru), 4096):
                a, b = (np.frombuffer(b"".join(r.iloc[k : k + 4096]), np.uint8).reshape(-1, m) for r in (ru, rv))
                out[k : k + 4096] = np_estimate(np.maximum(a, b), p, profile)
            yield pd.Series(out)

    both = pairs.join(sketches.toDF("dst", "rv"), "dst").join(sketches.toDF("src", "ru"), "src")
    return both.select("src", "dst", union("ru", "rv").alias("union_estimate"))


def intersections(p: int, profile: Profile):
    """A vectorised function of (regs of u, regs of v, deg_u, deg_v): the unclamped intersection estimate."""
    m = 1 << p

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for ru, rv, du, dv in batches:
            out = np.zeros(len(ru))
            for k in range(0, len(ru), 4096):
                a, b = (np.frombuffer(b"".join(r.iloc[k : k + 4096]), np.uint8).reshape(-1, m) for r in (ru, rv))
                union = np_estimate(np.maximum(a, b), p, profile)
                if profile.exact_degrees:
                    out[k : k + 4096] = du.iloc[k : k + 4096].to_numpy(float) + dv.iloc[k : k + 4096].to_numpy(float) - union
                else:
                    out[k : k + 4096] = np_estimate(a, p, profile) + np_estimate(b, p, profile) - union
            yield pd.Series(out)

    return run


def native_hll(fwd: DataFrame, lg_k: int = 10) -> DataFrame:
    """(node, d_out, estimate) by Spark's own sketch, whose hash and registers are others."""
    return fwd.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("d_out"), F.hll_sketch_estimate(F.hll_sketch_agg("dst", lg_k)).alias("estimate"))


def native_theta(fwd: DataFrame, pairs: DataFrame, lg_k: int = 12) -> DataFrame:
    """(src, dst, estimate) of common out-neighbours by Spark's theta sketches, without inclusion-exclusion."""
    sk = fwd.groupBy(F.col("src").alias("node")).agg(F.expr(f"theta_sketch_agg(dst, {lg_k})").alias("t"))
    both = pairs.join(sk.toDF("src", "tu"), "src").join(sk.toDF("dst", "tv"), "dst")
    return both.select("src", "dst", F.expr("theta_sketch_estimate(theta_intersection(tu, tv))").alias("estimate"))
