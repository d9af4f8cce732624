"""Scanning a stream of documents; each row is a text of its own, so every micro-batch is scanned like a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scan import ScanConfig, bodies, dictionary, scan_rows, shared


def match_stream(stream: DataFrame, patterns: DataFrame, keys: list[str], text: str = "text", config: ScanConfig = ScanConfig()) -> DataFrame:
    """Matches of a streaming DataFrame as a streaming DataFrame; stateless, so any output mode and sink do."""
    rows = dictionary(patterns, config.nocase)
    df = bodies(stream, keys, text).withColumns({"at": F.lit(0).cast("long"), "core": F.lit(0).cast("long"), "shard": F.lit(0)})
    return scan_rows(df, keys, {0: shared(stream.sparkSession, rows)}, config.nocase)


