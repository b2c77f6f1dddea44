"""Edge sampling: triangles of a sample, scaled."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import MURMUR_MULTIPLIER, MURMUR_SEED, low32, shr
from .triangles import count, triangles

#: Odd multipliers of the pair hash that decides about an edge (our own choice).
PAIR_A, PAIR_B, PAIR_SEED = 0x1E3779B1, 0x25EBCA77, 0x42B2AE3D
UNIT = 1 << 32


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once, however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def mixed(x: Column) -> Column:
    """``murmur32`` with each step bound, so that the expression grows with the steps and not with two to their power."""
    x = low32(x).bitwiseXOR(F.lit(MURMUR_SEED).cast("bigint"))
    for _ in range(2):
        x = bound(x, lambda h: low32(h.bitwiseXOR(shr(h, 16)) * F.lit(MURMUR_MULTIPLIER).cast("bigint")))
    return bound(x, lambda h: h.bitwiseXOR(shr(h, 16)))


def coin(u: Column, v: Column, seed: Column) -> Column:
    """A number in [0, 2**32) from an edge and a seed; equal on every engine."""
    parts = [low32(low32(x.cast("bigint")) * F.lit(k).cast("bigint")) for x, k in ((u, PAIR_A), (v, PAIR_B), (seed, PAIR_SEED))]
    return mixed(parts[0].bitwiseXOR(mixed(parts[1].bitwiseXOR(parts[2]))))


def doulion(edges: DataFrame, q: float, seed: int = 42) -> DataFrame:
    """estimate: triangles of a hashed sample of the edges, oriented anew, over q**3; an empty sample gives 0."""
    kept = edges.where(coin(F.col("u"), F.col("v"), F.lit(seed)) < int(q * UNIT))
    return triangles(kept).select((F.col("triangles") / F.lit(q**3)).alias("estimate"))


def doulion_rand(edges: DataFrame, q: float, seed: int = 42) -> DataFrame:
    """As ``doulion`` with Spark's generator: only its distribution is fixed."""
    return triangles(edges.sample(q, seed)).select((F.col("triangles") / F.lit(q**3)).alias("estimate"))


def doulion_forward(fwd: DataFrame, q: float, seed: int = 42) -> DataFrame:
    """As ``doulion`` on edges that keep the orientation of the whole graph, which saves the degrees of the sample."""
    kept = fwd.where(coin(F.least("src", "dst"), F.greatest("src", "dst"), F.lit(seed)) < int(q * UNIT))
    return count(kept).select((F.col("triangles") / F.lit(q**3)).alias("estimate"))


def doulion_seeds(fwd: DataFrame, q: float, n_seeds: int = 10, base_seed: int = 42) -> DataFrame:
    """(seed, estimate) for all seeds in one plan: nodes carry their seed, so that the samples never meet."""
    seeds = F.sequence(F.lit(base_seed), F.lit(base_seed + n_seeds - 1))
    each = fwd.select("src", "dst", F.explode(seeds).alias("seed")).where(coin(F.least("src", "dst"), F.greatest("src", "dst"), F.col("seed")) < int(q * UNIT))
    adj = each.groupBy("seed", "src").agg(F.collect_list("dst").alias("n"))
    # an edge takes its own end's list along, so that the sample is drawn once and both sides share one exchange
    far = adj.select("seed", F.col("n").alias("nu"), F.explode("n").alias("dst")).join(adj.select("seed", F.col("src").alias("dst"), F.col("n").alias("nv")), ["seed", "dst"])
    found = far.groupBy("seed").agg(F.sum(F.size(F.array_intersect("nu", "nv"))).alias("t"))
    every = fwd.sparkSession.range(base_seed, base_seed + n_seeds).select(F.col("id").cast("int").alias("seed"))
    return every.join(found, "seed", "left").select("seed", (F.coalesce("t", F.lit(0)) / F.lit(q**3)).alias("estimate"))


def doulion_repeated(fwd: DataFrame, q: float, n_seeds: int = 10, base_seed: int = 42) -> DataFrame:
    """(q, n_seeds, mean_estimate, std_estimate) with the spread of the population."""
    return doulion_seeds(fwd, q, n_seeds, base_seed).agg(F.lit(q).alias("q"), F.count("*").alias("n_seeds"), F.avg("estimate").alias("mean_estimate"), F.stddev_pop("estimate").alias("std_estimate"))
