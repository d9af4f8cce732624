"""Exact top-k inner products by vector-approximation files.

Every vector becomes an approximation: one byte a dimension, on a grid of the vector's own scale, and how far the vector
is from its grid point. Only these are dealt into blocks and scanned; with a query they give a lower and an upper bound
of the score (Cauchy-Schwarz on what the grid leaves out). A block keeps, for each query, the rows whose upper bound
reaches the k-th best lower bound. Then exact vectors are read in the order of their bounds: first the k most promising
rows of each query over all blocks, whose exact scores set a limit, and after them just the rows whose upper bound
reaches that limit; with those the k best are certain.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SCALE = 1024
STEPS = 127  # of the grid on either side of zero
CANDIDATES, QUERIES = 131072, 65536  # rows of a block: some 10 MB of approximations, and of queries
AT_ONCE = 2_000_000  # scores of a block that are held at once
ROUNDING = 2.0**-40  # more than a sum of some thousand doubles can be off, in parts of the product of lengths
_FILE = "vec_id long, rid long, dim int, cells binary, scale double, off double"
_BOUNDS = "query_id long, vec_id long, rid long, high double"


def _lists(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of floor(1024 * x)) for each length of the vectors in a column of lists.

    The numbers are whole and exact: doubles above 2^53 are whole numbers, and times 1024 stay exact.
    """
    offsets = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(offsets)
    with np.errstate(over="ignore"):
        flat = np.floor(flat * SCALE)
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        yield rows, flat[offsets[rows][:, None] + np.arange(n)]


def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The approximation of each vector: scale * cells is at most off away from it."""
    for batch in batches:
        for rows, v in _lists(batch.column("e_")):
            with np.errstate(all="ignore"):
                most = np.abs(v).max(1)
                scale = np.where((most > 0) & np.isfinite(most), most / STEPS, 1.0)
                cells = np.clip(np.nan_to_num(np.rint(v / scale[:, None])), -STEPS, STEPS)
                left = np.sqrt(np.square(v - cells * scale[:, None]).sum(1))
                off = left * (1 + 2.0**-20) + ROUNDING * np.sqrt(np.square(v).sum(1))
            off[~np.isfinite(off)] = np.inf
            at = pa.array(rows)
            cells = [x.tobytes() for x in cells.astype(np.int8)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(at), batch.column("rid").take(at), pa.array(np.full(len(rows), v.shape[1], np.int32)), pa.array(cells, pa.binary()), pa.array(scale), pa.array(off)], ["vec_id", "rid", "dim", "cells", "scale", "off"])


def _first_copies(ids: np.ndarray, rid: np.ndarray, cells: np.ndarray, k: int) -> np.ndarray:
    """Rows that are among the k + 1 smallest ids of equal vectors; a query is one of them at most, the others' scores tie."""
    order = np.lexsort([ids, rid])
    new = np.ones(len(order), bool)
    new[1:] = (rid[order][1:] != rid[order][:-1]) | (cells[order][1:] != cells[order][:-1]).any(1)
    begin = np.flatnonzero(new)
    place = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
    return np.sort(order[place <= k])


def scan_block(candidates: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """Bounds of the candidates of a block that may be among the k best of a query."""
    queries, candidates = queries.combine_chunks(), candidates.combine_chunks()
    ids, rid, scale, off = (candidates.column(c).to_numpy() for c in ("vec_id", "rid", "scale", "off"))
    cells = np.frombuffer(b"".join(candidates.column("cells").to_pylist()), np.int8).reshape(len(ids), -1)
    own = _first_copies(ids, rid, cells, k)
    ids, rid, scale, cells = ids[own], rid[own], scale[own], cells[own].astype(np.float32)
    # Queries are scanned with length 1 and in single precision, so bounds allow for its rounding too.
    off = off[own] + len(cells[0]) * 2.0**-23 * scale * np.sqrt(np.square(cells, dtype=np.float64).sum(1))
    cells = cells.T
    rows, q = next(_lists(queries.column("e_").chunk(0)))
    asked = queries.column("vec_id").to_numpy()[rows]
    out: list[tuple[np.ndarray, ...]] = []
    step = max(1, AT_ONCE // max(1, len(ids)))
    for begin in range(0, len(q), step):
        part = q[begin : begin + step]
        with np.errstate(all="ignore"):
            length = np.sqrt(np.square(part).sum(1))[:, None]
            middle = ((part / np.maximum(length, 1)).astype(np.float32) @ cells) * scale * length
            slack = np.nan_to_num(length * off, nan=np.inf, posinf=np.inf)
        for i, query in enumerate(asked[begin : begin + step]):
            high, low = middle[i] + slack[i], middle[i] - slack[i]
            high[np.isnan(high)], low[np.isnan(low)] = np.inf, -np.inf
            other = ids != query
            may = other
            if other.sum() > k:
                own = low[other]
                may = other & (high >= np.partition(own, len(own) - k)[len(own) - k])
            at = np.flatnonzero(may)
            out.append((np.full(len(at), query), ids[at], rid[at], high[at]))
    return pa.table({name: np.concatenate(c) for name, c in zip(("query_id", "vec_id", "rid", "high"), zip(*out))})


def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scores of pairs of vectors q_, e_ of one length, exactly: score, near (as a double) and beyond (-1, 0, 1: outside of a long)."""
    for batch in batches:
        n = batch.num_rows
        score, near, beyond = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, np.int8)
        for (rows, q), (_, v) in zip(_lists(batch.column("q_")), _lists(batch.column("e_"))):
            with np.errstate(all="ignore"):
                most = np.abs(q).max(1) * np.abs(v).max(1) * q.shape[1]
                fits = (most < 2.0**62) & (np.abs(q).max(1) < 2.0**53) & (np.abs(v).max(1) < 2.0**53)
            at = rows[fits]
            score[at] = (q[fits].astype(np.int64) * v[fits].astype(np.int64)).sum(1)
            near[at] = score[at]
            for i in np.flatnonzero(~fits).tolist():  # whole numbers of any size
                a, b = (_whole(batch.column(c)[int(rows[i])].as_py()) for c in ("q_", "e_"))
                whole = sum(x * y for x, y in zip(a, b))
                if -(2**63) <= whole < 2**63:
                    score[rows[i]] = whole
                else:
                    beyond[rows[i]] = 1 if whole > 0 else -1
                try:
                    near[rows[i]] = float(whole)
                except OverflowError:
                    near[rows[i]] = math.inf if whole > 0 else -math.inf
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("query_id", "vec_id")), pa.array(score), pa.array(near), pa.array(beyond)], ["query_id", "vec_id", "score", "near", "beyond"])


def _whole(v: list[float]) -> list[int]:
    """floor(1024 * x) of each component as a whole number."""
    return [int(x) * SCALE if abs(x) >= 2.0**53 else math.floor(x * SCALE) for x in v]


def search(vectors: DataFrame, every: int = 100, k: int = 10, candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """The k best rows for each query among vectors(vec_id, embedding, ...): query_id, rank, vec_id, score.

    Components become floor(1024 * x); queries are the rows whose vec_id is divisible by every; score is the inner
    product, ties go to the smaller vec_id. Vectors that are null or empty, or hold null or non-finite components, or have
    no vec_id take no part; all others do, however large. A vector is compared with those of its own length; of rows that share a
    query's vec_id the smallest vector asks and none is a candidate; other repeated rows are candidates each; an empty
    table gives an empty result. Scores are exact whole numbers of any size; if one of the k best does not fit a long, the
    query fails with an error that says so.
    """
    spark = vectors.sparkSession
    finite = F.forall("e_", lambda c: c.isNotNull() & (F.abs(c) < float("inf")))  # NaN is above all numbers
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("e_")).filter(F.col("vec_id").isNotNull() & F.col("e_").isNotNull() & finite & (F.size("e_") > 0))
    rows = rows.withColumn("rid", F.xxhash64("e_"))
    asked = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min_by("e_", F.struct(F.size("e_"), F.col("e_"))).alias("e_"))
    n, m = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    blocks = max(-(-n // candidates), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // 1024)), 1)
    groups = max(-(-m // queries), 1)
    block = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    key = ["dim", "block", "part"]
    file = rows.select("vec_id", "rid", "e_").mapInArrow(approximate, _FILE)
    left = file.withColumn("block", block(blocks, 1)).withColumn("part", each(groups)).select(*key, "vec_id", "rid", "cells", "scale", "off")
    right = asked.withColumn("dim", F.size("e_")).withColumn("part", block(groups, 2)).withColumn("block", each(blocks)).select(*key, "vec_id", "e_")

    def scan(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        if not candidates.num_rows or not queries.num_rows:
            return pa.table({c: pa.array([], pa.float64() if c == "high" else pa.int64()) for c in ("query_id", "vec_id", "rid", "high")})
        return scan_block(candidates, queries, k)

    may = left.groupBy(*key).cogroup(right.groupBy(*[F.col(c).alias(c) for c in key])).applyInArrow(scan, _BOUNDS)
    order = Window.partitionBy("query_id").orderBy(F.col("high").desc(), "vec_id", "rid")
    may = cut(may.withColumn("place", F.row_number().over(order)))
    # Only the vectors that some block kept are read again.
    whole = cut(rows.join(may.select("vec_id", "rid").distinct(), ["vec_id", "rid"], "left_semi").groupBy("vec_id", "rid").agg(F.first("e_").alias("e_")))

    def scored(pairs: DataFrame) -> DataFrame:
        with_vectors = pairs.join(whole, ["vec_id", "rid"]).join(asked.select(F.col("vec_id").alias("query_id"), F.col("e_").alias("q_")), "query_id")
        return cut(with_vectors.select("query_id", "vec_id", "q_", "e_").mapInArrow(exact, "query_id long, vec_id long, score long, near double, beyond byte"))

    first = scored(may.filter(F.col("place") <= k))
    limit = first.groupBy("query_id").agg((F.min("near") - F.abs(F.min("near")) * ROUNDING).alias("limit_"))
    rest = scored(may.filter(F.col("place") > k).join(limit, "query_id").filter(F.col("high") >= F.col("limit_")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("beyond").desc(), F.col("score").desc(), F.col("vec_id")))
    found = first.unionByName(rest).withColumn("rank", rank).filter(F.col("rank") <= k)
    score = F.when(F.col("beyond") == 0, F.col("score")).otherwise(F.raise_error(F.lit("a score does not fit a long")).cast("long"))
    return found.select("query_id", "rank", "vec_id", score.alias("score"))
