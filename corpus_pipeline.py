"""A corpus pipeline of five stages, each by one operator of matchloom.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import jaccard, mixing, quality, secrets, sentencepiece
from matchloom.llm.common import shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; rows are judged one by one, whatever their doc_id, and move nowhere."""
    rows = docs.select(F.struct(*docs.columns).alias("doc_id"), "text", "lang")
    return quality.judge(rows).filter("kept").select("doc_id.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays."""
    return jaccard.keep_first(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, each whole; the columns stay."""
    return mixing.repeat_rows(docs, uncut=True)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids of their pieces."""
    return sentencepiece.encode(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("secret_scans", secret_scan),
    ("source_mixing", source_mix),
    ("sentencepiece", encoded),
]

#: The near-duplicate classes and the pieces are out of SQL's reach; tests hold run() against a brute-force version.
ORACLE_SQL = None


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written as Parquet to the shared folder and read again.

    What a stage has read is deleted when its own rows are written; those of the last stage stay for the caller.
    """
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        folder = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before:
            _delete(spark, before)
        before = folder
    return docs
