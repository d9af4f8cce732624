"""Corpora: files as texts, byte ranges of large files, wiki dumps, capped and joined files."""

from __future__ import annotations

import re

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def read_files(spark: SparkSession, path: str, cap: int | None = None) -> DataFrame:
    """path, body: each file under path as one text; cap keeps that many leading bytes."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("content").alias("body"))
    return rows if cap is None else rows.withColumn("body", F.expr(f"substring(body, 1, {int(cap)})"))


class _Range(InputPartition):
    def __init__(self, part: int, start: int, end: int):
        self.part, self.start, self.end = part, start, end


class _RangeReader(DataSourceReader):
    def __init__(self, path: str, record: int):
        self.path, self.record = path, record

    def _open(self):
        files, path = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        return files, path

    def partitions(self):
        files, path = self._open()
        size = files.get_file_info(path).size or 0
        return [_Range(k, a, min(size, a + self.record)) for k, a in enumerate(range(0, size, self.record))] or [_Range(0, 0, 0)]

    def read(self, partition):
        if partition.end > partition.start:
            files, path = self._open()
            with files.open_input_file(path) as f:
                yield partition.part, f.read_at(partition.end - partition.start, partition.start)


class ByteRanges(DataSource):
    """part, body: byte ranges of one file, each a partition."""

    @classmethod
    def name(cls):
        return "byte_ranges"

    def schema(self):
        return "part long, body binary"

    def reader(self, schema):
        return _RangeReader(self.options["path"], int(self.options.get("record", 1 << 20)))


def read_ranges(spark: SparkSession, path: str, record: int = 1 << 20) -> DataFrame:
    """part, body: a large file cut in records of so many bytes, for corpus mode with key part; each is read by a task.

    path is on a file system that executors share, or a URI that Arrow's file systems open.
    """
    spark.dataSource.register(ByteRanges)
    return spark.read.format("byte_ranges").option("record", record).load(path)


def join_files(files: DataFrame) -> DataFrame:
    """files(path, body) with part, their order: by path."""
    from pyspark.sql import Window

    return files.withColumn("part", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("path")) - 1).select("part", "body")


_TEXT = re.compile("<text[^>]*>(.*)", re.S)


def text_blocks(dump: str) -> list[str]:
    """What stands in <text> elements of a dump, read line by line, the lines of a block joined by a space.

    A line with an opening tag begins a block, or goes on with one that is open; only a line without one can end it, at its
    last closing tag. So an element on one line goes on to the next line that ends one.
    """
    blocks, own, inside = [], [], False
    for line in re.split("\r\n|\r|\n", dump):
        if "<text " in line or line.strip() == "<text>":
            inside = True
            own += _TEXT.findall(line)[:1]
        elif "</text>" in line:
            blocks.append(" ".join([*own, line.rpartition("</text>")[0]]))
            own, inside = [], False
        elif inside:
            own.append(line.rstrip())
    return blocks


def clean(block: str) -> str:
    """A block without tags and references, which become spaces; three line feeds or more become two."""
    block = re.sub("<[^>]+>", " ", block)
    block = re.sub("&[a-zA-Z]+;|&#[0-9]+;", " ", block)
    return re.sub("\n{3,}", "\n\n", block).strip()


def read_wiki(spark: SparkSession, path: str) -> DataFrame:
    """path, value: a dump of any size, cut after each </page>, so that tasks share it; wiki_text() takes the parts."""
    return spark.read.option("lineSep", "</page>").text(path).select(F.col("_metadata.file_path").alias("path"), "value")


def wiki_text(pages: DataFrame, least: int = 20) -> DataFrame:
    """path, block_no, text of pages(path, value): the text blocks of each value, cleaned; those of least characters or fewer go."""

    def run(batches):
        for batch in batches:
            for path, value in zip(batch.column("path").to_pylist(), batch.column("value").to_pylist()):
                own = [clean(x) for x in text_blocks(value or "")]
                keep = [k for k, x in enumerate(own) if len(x) > least]
                yield pa.RecordBatch.from_pydict({"path": pa.array([path] * len(keep), pa.string()), "block_no": pa.array(keep, pa.int32()), "text": pa.array([own[k] for k in keep], pa.string())})

    return pages.select("path", "value").mapInArrow(run, "path string, block_no int, text string")
