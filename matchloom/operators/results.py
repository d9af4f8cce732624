"""Operations on match lists: order, equality, digests, labels, rendering."""

from __future__ import annotations

import hashlib
import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge(*parts: DataFrame) -> DataFrame:
    """All rows of all parts; nothing is made distinct."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def canonical(matches: DataFrame, keys: list[str] = []) -> DataFrame:
    return matches.orderBy(*keys, "end_pos", "pattern_id")


def emission(matches: DataFrame, patterns: DataFrame, keys: list[str] = []) -> DataFrame:
    """Matches in the order a scan emits them: by end, longest pattern first, equal patterns in descending id."""
    sized = matches.join(patterns.select("pattern_id", F.octet_length("pattern").alias("length")), "pattern_id")
    return sized.orderBy(*keys, "end_pos", F.col("length").desc(), F.col("pattern_id").desc())


def equal(a: DataFrame, b: DataFrame) -> bool:
    """Whether two match lists are the same multiset."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def digest(ordered: DataFrame) -> str:
    """MD5 over 12-byte records (end_pos as int64, pattern_id as int32, little-endian) of an ordered list, read as a stream."""
    h = hashlib.md5()
    for row in ordered.select("end_pos", "pattern_id").toLocalIterator(prefetchPartitions=True):
        h.update(struct.pack("<qi", row[0], row[1]))
    return h.hexdigest()


def digest_by(matches: DataFrame, keys: list[str], raw: DataFrame | None = None) -> DataFrame:
    """keys, n, digest: MD5 of "end:id" joined by commas, per key, in canonical order, or with raw (the patterns) as emitted."""
    if raw is None:
        item = F.struct("end_pos", F.col("pattern_id").alias("a"), F.col("pattern_id").alias("b"))
    else:
        matches = matches.join(raw.select("pattern_id", (-F.octet_length("pattern")).alias("length")), "pattern_id")
        item = F.struct("end_pos", F.col("length").alias("a"), (-F.col("pattern_id")).alias("b"), "pattern_id")
    pid = "b" if raw is None else "pattern_id"
    text = F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: F.concat_ws(":", x["end_pos"].cast("string"), x[pid].cast("string"))), ",")
    return matches.groupBy(*keys).agg(F.count("*").alias("n"), F.md5(text).alias("digest"))


def located(matches: DataFrame, patterns: DataFrame) -> DataFrame:
    """matches with start_pos, length and the pattern."""
    own = patterns.select("pattern_id", "pattern", F.octet_length("pattern").alias("length"))
    return matches.join(own, "pattern_id").withColumn("start_pos", F.col("end_pos") - F.col("length") + 1)


def printable(pattern: Column) -> Column:
    r"""Bytes as text; those that are not printable ASCII as \xNN."""
    pairs = F.regexp_extract_all(F.hex(pattern), F.lit("(..)"), F.lit(1))
    one = lambda h: F.when((h >= "20") & (h <= "7E"), F.decode(F.unhex(h), "US-ASCII")).otherwise(F.concat(F.lit("\\x"), F.lower(h)))
    return F.array_join(F.transform(pairs, one), "")


def rendered(matches: DataFrame, patterns: DataFrame, keys: list[str] = []) -> DataFrame:
    """keys and a line for each match: pattern, start, end, length and text."""
    rows = located(matches, patterns)
    line = F.format_string("pat=%d start=%d end=%d len=%d text=%s", "pattern_id", "start_pos", "end_pos", "length", printable(F.col("pattern")))
    return rows.select(*keys, "end_pos", "pattern_id", line.alias("line"))
