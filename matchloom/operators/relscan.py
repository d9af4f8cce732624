"""Matching without Python: anchors joined to the dictionary, for small inputs and as a cross-check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def match_relational(df: DataFrame, patterns: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, end_pos, pattern_id: windows of each pattern length, joined by their bytes.

    A window must lie within the text; substring() alone would cut it short at the end and match a shorter pattern.
    """
    body = df.select(*keys, F.hex(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("h_"))
    sizes = patterns.select(F.octet_length("pattern").cast("long").alias("len_")).distinct()  # no more rows than the longest pattern has bytes
    at = F.explode(F.expr("sequence(0L, length(h_) div 2 - len_)"))
    windows = body.join(F.broadcast(sizes)).filter(F.length("h_") >= 2 * F.col("len_")).withColumn("at_", at)
    windows = windows.select(*keys, "at_", "len_", F.expr("substring(h_, cast(2 * at_ + 1 as int), cast(2 * len_ as int))").alias("w_"))
    return windows.join(patterns.select("pattern_id", F.hex("pattern").alias("w_")), "w_").select(*keys, (F.col("at_") + F.col("len_") - 1).cast("long").alias("end_pos"), "pattern_id")
