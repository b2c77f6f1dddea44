"""Hashes as column expressions that neither overflow under ANSI mode nor leave the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of splitmix64 and of the 32-bit mix.
GAMMA = 0x9E3779B97F4A7C15
MULTIPLIER_1 = 0xBF58476D1CE4E5B9
MULTIPLIER_2 = 0x94D049BB133111EB
MURMUR_SEED = 0x9747B28C
MURMUR_MULTIPLIER = 0x45D9F3B
M32 = 0xFFFFFFFF


def signed(x: int) -> int:
    """The 64-bit pattern as a BIGINT literal."""
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def low32(c: Column) -> Column:
    return c.bitwiseAND(F.lit(M32))


def shr(c: Column, n: int) -> Column:
    return F.shiftrightunsigned(c, n)


def mul64(x: Column, k: int) -> Column:
    """x * k modulo 2**64 from 16-bit limbs, whose products and sums stay far below 2**63."""
    a = [shr(x, 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    b = [k >> (16 * i) & 0xFFFF for i in range(4)]
    carry, out = None, None
    for n in range(4):
        terms = [a[i] * F.lit(b[n - i]).cast("bigint") for i in range(n + 1)]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        total = total if carry is None else total + carry
        limb = F.shiftleft(total.bitwiseAND(F.lit(0xFFFF)), 16 * n)
        out = limb if out is None else out.bitwiseOR(limb)
        carry = shr(total, 16)
    return out


def add64(x: Column, k: int) -> Column:
    """x + k modulo 2**64."""
    low = low32(x) + F.lit(k & M32)
    high = shr(x, 32) + F.lit(k >> 32 & M32) + shr(low, 32)
    return F.shiftleft(low32(high), 32).bitwiseOR(low32(low))


def with_hash64(df: DataFrame, x: Column, out: str, seed: int | None = None) -> DataFrame:
    """``df`` with the 64-bit hash of x: the splitmix64 finaliser alone (0 stays 0), or with its increment and ``seed``.

    Every step is a projection of its own: the next one refers to it many times, and one nested expression would grow by
    powers.
    """
    z = x.cast("bigint")
    df = df.withColumn(out, z if seed is None else add64(z, (GAMMA + seed) & ((1 << 64) - 1)))
    for shift, multiplier in ((30, MULTIPLIER_1), (27, MULTIPLIER_2), (31, None)):
        df = df.withColumn(out, F.col(out).bitwiseXOR(shr(F.col(out), shift)))
        if multiplier:
            df = df.withColumn(out, mul64(F.col(out), multiplier))
    return df


def murmur32(x: Column) -> Column:
    """32-bit mix of the low 32 bits of x, as a BIGINT in [0, 2**32)."""
    h = low32(x.cast("bigint")).bitwiseXOR(F.lit(MURMUR_SEED).cast("bigint"))
    for _ in range(2):
        h = low32(h.bitwiseXOR(shr(h, 16)) * F.lit(MURMUR_MULTIPLIER).cast("bigint"))
    return h.bitwiseXOR(shr(h, 16))


def bit_length(w: Column) -> Column:
    """Bits of a non-negative BIGINT; 0 has none."""
    return F.when(w == 0, F.lit(0)).otherwise(F.length(F.bin(w)))
