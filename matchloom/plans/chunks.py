"""Plans: how a text of n bytes, or a dictionary, is divided. All are arithmetic and give the same matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST = 64  # bytes a task should have


def long(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("long")


def equal_chunks(df: DataFrame, n_bytes: str, parts: int, halo: int) -> DataFrame:
    """df with a row for each chunk: chunk, core_start, core_end, scan_start.

    Cores are ceil(n/parts) bytes; a chunk that would begin at the end of the text is left out. scan_start is halo
    bytes before the core, where there are as many.
    """
    n = long(F.col(n_bytes))
    size = F.greatest(long(1), F.expr(f"({n_bytes} + {parts - 1}) div {parts}"))
    used = F.ceil(n / size)
    df = df.withColumn("size_", size).withColumn("chunk", F.explode(F.when(used > 0, F.sequence(long(0), long(used) - 1)).otherwise(F.array().cast("array<bigint>"))))
    df = df.withColumn("core_start", F.col("chunk") * F.col("size_")).withColumn("core_end", F.least(n, (F.col("chunk") + 1) * F.col("size_")))
    return df.withColumn("scan_start", F.greatest(long(0), F.col("core_start") - halo)).drop("size_")


def task_count(n_bytes: int, workers: int, per_worker: int = 4) -> int:
    """workers * per_worker tasks, but no more than one for each 64 bytes, and no fewer than workers."""
    tasks = workers * per_worker
    if tasks > n_bytes // LEAST:
        tasks = max(n_bytes // LEAST, workers)
    return tasks


def weighted_ranges(n_bytes: int, weights: list[float]) -> list[tuple[int, int]]:
    """[start, end) for each worker in proportion to its weight, in steps of 64 bytes; the last takes what is left."""
    total, at, out = sum(weights), 0, []
    for k, w in enumerate(weights):
        size = max(LEAST, -(-int(n_bytes * w / total) // LEAST) * LEAST)
        end = n_bytes if k == len(weights) - 1 else min(n_bytes, at + size)
        if at < end:
            out.append((at, end))
        at = end
    return out


def two_d(threads: int, n_patterns: int, shards: int = 2) -> tuple[int, int]:
    """(shards, chunks): shards that divide threads and are no more than threads or patterns, else one shard."""
    if shards < 1 or shards > threads or shards > n_patterns or threads % shards:
        shards = 1
    return shards, threads // shards


def falls_back(n_bytes: int, workers: int, halo: int) -> bool:
    """Whether a text is too small to be divided: one scan gives the same result."""
    return workers <= 1 or n_bytes <= 2 * halo or n_bytes < LEAST * workers


def balanced_slices(n: int, parts: int) -> list[tuple[int, int]]:
    return [(k * n // parts, (k + 1) * n // parts) for k in range(parts)]


def cpu_order(topology: DataFrame) -> DataFrame:
    """topology(cpu, is_leader, max_khz) in the order in which cores are used: leaders, then fast ones, then low numbers."""
    return topology.orderBy(F.col("is_leader").desc(), F.col("max_khz").desc(), F.col("cpu"))


def plan_table(spark: SparkSession, ranges: list[tuple[int, int]], halo: int) -> DataFrame:
    rows = [(k, a, b, max(0, a - halo)) for k, (a, b) in enumerate(ranges)]
    return spark.createDataFrame(rows, "chunk long, core_start long, core_end long, scan_start long")
