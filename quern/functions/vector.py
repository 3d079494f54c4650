"""Vector functions as Column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null for a zero vector, which means not embedded."""
    a, b = doubles(a), doubles(b)
    return F.lit(1.0) - dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def normalized(a: Column) -> Column:
    a = doubles(a)
    n = F.nullif(norm(a), F.lit(0.0))
    return F.when(n.isNull(), a).otherwise(F.transform(a, lambda x: x / n))


def unembedded(a: Column) -> Column:
    return a.isNull() | F.forall(a, lambda x: x == 0)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def fnv_dimension(token: Column, dims: int = 64) -> Column:
    """The dimension that a token counts in: its FNV-1a hash as signed 32 bits, absolute value, modulo dims."""

    def step(h: Column, ch: Column) -> Column:
        return (h.bitwiseXOR(F.ascii(ch).cast("long")) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF))

    h = F.aggregate(F.split(token, ""), F.lit(2166136261).cast("long"), step)
    return (F.abs(F.when(h >= 2**31, h - 2**32).otherwise(h)) % dims).cast("int")
