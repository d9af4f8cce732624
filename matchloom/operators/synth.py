"""Corpora made for measuring: replicas, injected matches, and layouts of dense blocks."""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def replicate(df: DataFrame, key: str, copies: int = 8) -> DataFrame:
    """df, copies times one after the other: copy comes before key in the order."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).select("copy", *df.columns)


def inject(data: bytes, patterns: list[bytes], n: int, seed: int = 42) -> bytes:
    """data with n prefixes of random patterns, of 80 % of their length at least, written over random places."""
    out, rng = bytearray(data), random.Random(seed + n)
    for _ in range(n):
        p = rng.choice(patterns)
        k = rng.randint(-(-8 * len(p) // 10), len(p))
        if len(out) > k:
            at = rng.randrange(len(out) - k)
            out[at : at + k] = p[:k]
    return bytes(out)


def tune(density: Callable[[int], float], target: float, start: int = 1000, tolerance: float = 0.01, steps: int = 20) -> int:
    """The number of injections whose density is within tolerance of target: the bound is doubled, then halved in."""
    low, high = 0, start
    while density(high) < target:
        low, high = high, high * 2
    for _ in range(steps):
        middle = (low + high) // 2
        d = density(middle)
        if abs(d - target) <= tolerance * target:
            return middle
        low, high = (middle, high) if d < target else (low, middle)
    return high


def layout(spark: SparkSession, total: int, hot: int, skew: float = 1.0) -> DataFrame:
    """block, is_hot for total blocks of which hot are dense: spread evenly (skew 1), or packed into the first part."""
    i = F.col("id")
    if skew >= 1:
        rows = spark.range(total).select(i.alias("block"), (F.floor((i + 1) * hot / total) > F.floor(i * hot / total)).alias("is_hot"))
        return rows
    region = max(hot, int(total * skew))
    return spark.range(total).select(i.alias("block"), ((i < region) & (F.floor((i + 1) * hot / region) > F.floor(i * hot / region))).alias("is_hot"))


def parity(a: tuple[int, int], b: tuple[int, int]) -> None:
    """ValueError unless two corpora have equal bytes and equal matches."""
    if a != b:
        raise ValueError(f"bytes and matches differ: {a} and {b}")
