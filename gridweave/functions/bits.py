"""Unsigned 64-bit arithmetic on signed BIGINT columns that ANSI overflow checks let pass."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed constants of the mixer and the two sketch seeds.
GAMMA = 0x9E3779B97F4A7C15
MUL1 = 0xBF58476D1CE4E5B9
MUL2 = 0x94D049BB133111EB
SEED_1 = 0x243F6A8885A308D3
SEED_2 = 0x13198A2E03707344
FLIP = -(1 << 63)


def signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def _lit(x: int) -> Column:
    return F.lit(signed(x)).cast("long")


def _and(a: Column, mask: int) -> Column:
    return a.bitwiseAND(F.lit(mask).cast("long"))


def add64(a: Column, c: int) -> Column:
    """a + c modulo 2**64, in 32-bit halves."""
    low = _and(a, 0xFFFFFFFF) + F.lit(c & 0xFFFFFFFF)
    high = F.shiftrightunsigned(a, 32) + F.lit(c >> 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(_and(high, 0xFFFFFFFF), 32).bitwiseOR(_and(low, 0xFFFFFFFF))


def mul64(a: Column, c: int) -> Column:
    """a * c modulo 2**64, in 16-bit limbs."""
    x = [_and(F.shiftrightunsigned(a, 16 * i), 0xFFFF) for i in range(4)]
    y = [(c >> (16 * i)) & 0xFFFF for i in range(4)]
    out, carry = [], F.lit(0).cast("long")
    for k in range(4):
        t = carry
        for i in range(k + 1):
            t = t + x[i] * F.lit(y[k - i]).cast("long")
        out.append(_and(t, 0xFFFF))
        carry = F.shiftrightunsigned(t, 16)
    return out[0].bitwiseOR(F.shiftleft(out[1], 16)).bitwiseOR(F.shiftleft(out[2], 32)).bitwiseOR(F.shiftleft(out[3], 48))


def xor_shift(a: Column, n: int) -> Column:
    return a.bitwiseXOR(F.shiftrightunsigned(a, n))


def splitmix64(df, source: str, target: str, seed: int = 0):
    """df with column target: the mixed 64-bit hash of BIGINT column source XOR seed.

    Stages are columns of their own, so each limb is computed once.
    """
    tmp = "__mix"
    df = df.withColumn(tmp, add64(F.col(source).bitwiseXOR(_lit(seed)), GAMMA))
    df = df.withColumn(tmp, xor_shift(F.col(tmp), 30)).withColumn(tmp, mul64(F.col(tmp), MUL1))
    df = df.withColumn(tmp, xor_shift(F.col(tmp), 27)).withColumn(tmp, mul64(F.col(tmp), MUL2))
    return df.withColumn(target, xor_shift(F.col(tmp), 31)).drop(tmp)


def flipped(c: Column) -> Column:
    """Signed order of the result is the unsigned order of c."""
    return c.bitwiseXOR(F.lit(FLIP).cast("long"))


def xxhash64_int(h: np.ndarray, value: int) -> np.ndarray:
    """Spark's xxhash64(.., value) for an int, where h is the xxhash64 of what comes before it."""
    p1, p2, p3, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    x = h.astype(np.int64).view(np.uint64) + (p5 + np.uint64(4))
    x ^= np.uint64((value & 0xFFFFFFFF) * int(p1) & (1 << 64) - 1)
    x = ((x << np.uint64(23)) | (x >> np.uint64(41))) * p2 + p3
    x ^= x >> np.uint64(33)
    x *= p2
    x ^= x >> np.uint64(29)
    x *= p3
    x ^= x >> np.uint64(32)
    return x.view(np.int64)
