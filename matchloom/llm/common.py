"""What the operators of this package share."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words; a word is a run of any other characters.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text in order; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; a temporary one where it is unset on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="checkpoint-")


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared checkpoint folder, so that a lost executor costs no recomputation.

    spark.cleaner.referenceTracking.cleanCheckpoints lets Spark delete what is no longer referenced.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files, and the checkpoints if it may, that nothing refers to any more.

    It does so when the driver's garbage is collected, which a driver with little to do puts off while disks fill up.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def parts_for(spark: SparkSession, n_bytes: int, target: int) -> int:
    """A number of hash buckets so that none holds much more than target bytes of an input of n_bytes."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(n_bytes) // target))
