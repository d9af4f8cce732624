"""Run logs as typed tables: labels, header lines, result rows found by column name, and worker lines."""

from __future__ import annotations

import os
import uuid
import warnings
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of runs by type (fixed values: the tables' format).
TEXTS = ("phase", "patterns", "corpus", "searcher", "threads_label", "tag", "log_file")
INTS = ("automaton_states", "bytes", "iters", "matches", "pattern_count", "thr", "warmup", "wrk")
REALS = ("automaton_kib", "build_ms", "cv_pct", "gbps", "max_ms", "mbps", "mean_ms", "median_ms", "min_ms")
#: Column of a log's table -> name here (fixed values: the logs' format).
COLUMNS = {"thr": "thr", "bytes": "bytes", "min(ms)": "min_ms", "mean(ms)": "mean_ms", "max(ms)": "max_ms", "mb/s": "mbps", "matches": "matches", "median(ms)": "median_ms", "cv%": "cv_pct", "gbps": "gbps", "wrk": "wrk"}
#: Names that may stand in a result row (fixed values: the strategies).
SEARCHERS = (
    "sequential", "sequential_flat", "pthread_chunked", "pthread_chunked_v2", "pthread_chunked_v3", "pthread_chunked_v3_flat", "pthread_chunked_flat",
    "pthread_dynamic", "pthread_dynamic_flat", "pthread_prefetch", "pattern_sharded_prefix", "pthread_2d_sharded_chunked",
)
#: A worker's line (fixed values: the logs' format).
WORKER = r"^\s*\[t(\d+)\]\s+([\d.]+) ms\s+(\d+) bytes\s+(\d+) matches\s+([\d.]+) MB/s(?:\s+cpu=(-?\d+))?\s*$"


def read_logs(spark: SparkSession, run_dir: str, failed: bool = False) -> DataFrame:
    """phase, log_file, value: every log of a run directory's phases but env; with failed, also *.log.FAIL."""
    rows = spark.read.text(f"{run_dir}/*/*.log" + ("*" if failed else ""), wholetext=True).select(F.col("_metadata.file_path").alias("log_file"), "value")
    parts = F.split("log_file", "/")
    return rows.select(F.element_at(parts, -2).alias("phase"), "log_file", "value").filter("phase <> 'env'")


def to_int(c: Column) -> Column:
    """A whole number from text; decimals are cut off, anything else is null."""
    return F.nullif(c, F.lit("")).try_cast("double").try_cast("bigint")


def to_real(c: Column) -> Column:
    return F.nullif(c, F.lit("")).try_cast("double")


def parse_label(file_name: Column) -> dict[str, Column]:
    """patterns, corpus, searcher, threads_label and tag of a log's name; null if it has fewer than four parts."""
    label = F.regexp_replace(F.element_at(F.split(file_name, "/"), -1), r"\.log(\.FAIL)?$", "")
    parts = F.split(label, "__")
    part = lambda k: F.get(parts, k)
    ok, fits = F.size(parts) >= 4, part(3).rlike(r"^T\d+(_.+)?$")
    pick = lambda c: F.when(ok, c)
    return {
        "patterns": pick(part(0)), "corpus": pick(part(1)), "label_searcher": pick(part(2)),
        "threads_label": pick(F.when(fits, F.regexp_extract(part(3), r"^T(\d+)", 1)).otherwise(part(3))),
        "tag": pick(F.when(fits, F.regexp_extract(part(3), r"^T\d+_(.+)$", 1)).otherwise("")),
    }


def _last(text: Column, pattern: str, group: int = 1) -> Column:
    """The group in the last line that the pattern fits, or ''."""
    return F.coalesce(F.try_element_at(F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x: x.isNotNull()), F.lit(-1)), F.lit(""))


def parse_runs(logs: DataFrame, known_only: bool = True) -> DataFrame:
    """Result rows of logs(phase, log_file, value), typed; a log may have several, and 8 or 12 columns.

    Sizes of the automaton are read in KiB and MiB only, as the logs' readers always did; others are null. Text that is
    empty is null, and so are numbers that are none.
    """
    text = F.col("value")
    df = logs.select("phase", "log_file", text.alias("value"), *[c.alias(k) for k, c in parse_label(F.col("log_file")).items()])
    size = to_real(_last(text, r"(?m)^\s*# automaton:.*?\d+\s*states,\s*([\d.]+)\s*[KM]iB", 1)) * F.when(_last(text, r"(?m)^\s*# automaton:.*?\d+\s*states,\s*[\d.]+\s*([KM])iB", 1) == "M", 1024.0).otherwise(1.0)
    df = df.withColumns({
        "pattern_count": to_int(_last(text, r"(?m)^\s*# patterns:\s*(\d+)")),
        "automaton_states": to_int(_last(text, r"(?m)^\s*# automaton:.*?(\d+)\s*states,\s*[\d.]+\s*[KM]iB")),
        "automaton_kib": F.round(size, 2),
        "build_ms": to_real(_last(text, r"(?m)^\s*# build time:.*?([\d.]+)\s*ms")),
        "warmup": to_int(_last(text, r"(?m)^\s*# warmup=(\d+)\s+iters=\d+")),
        "iters": to_int(_last(text, r"(?m)^\s*# warmup=\d+\s+iters=(\d+)")),
        "lines_": F.transform(F.split(text, "\n"), lambda x: F.trim(x)),
    })
    is_head = lambda x: F.startswith(x, F.lit("searcher")) & F.contains(x, F.lit("bytes")) & F.contains(x, F.lit("matches"))
    heads = F.filter(F.transform("lines_", lambda x, i: F.when(is_head(x), i)), lambda i: i.isNotNull())
    df = df.withColumn("head_", F.try_element_at(heads, F.lit(-1))).filter("head_ is not null")
    df = df.withColumn("names_", F.transform(F.split(F.get("lines_", F.col("head_")), r"\s+"), lambda x: F.lower(x)))
    df = df.select("*", F.posexplode("lines_").alias("at_", "line_")).filter("at_ > head_ and line_ <> '' and line_ not like '#%'")
    df = df.withColumn("cells_", F.split("line_", r"\s+")).withColumn("searcher", F.get("cells_", F.lit(0))).filter(F.col("searcher").rlike("^[a-z][a-z0-9_]*$"))
    if known_only:
        df = df.filter(F.col("searcher").isin(*SEARCHERS))
    cells = {}
    for name, key in COLUMNS.items():
        at = F.array_position("names_", name).cast("int")
        cells[key] = F.when(at > 0, F.get("cells_", at - 1)).otherwise("")
    empty = lambda c: F.nullif(F.col(c), F.lit(""))
    out = [empty(c).alias(c) for c in TEXTS]
    out += [(to_int(cells[c]) if c in cells else F.col(c)).alias(c) for c in INTS]
    out += [(to_real(cells[c]) if c in cells else F.col(c)).alias(c) for c in REALS]
    return df.select(*out, build_threads(F.col("tag")).alias("build_threads"))


def build_threads(tag: Column) -> Column:
    own = to_int(F.regexp_extract(F.coalesce(tag, F.lit("")), r"buildpar_T(\d+)", 1))
    return F.coalesce(own, F.when(tag == "buildseq", F.lit(1).cast("bigint")))


def parse_workers(runs: DataFrame, logs: DataFrame) -> DataFrame:
    """Worker lines of the runs' logs, one row each; tag is '' where a run has none (runs has null there)."""
    lines = logs.select(F.col("log_file").alias("file_"), F.explode(F.split("value", "\n")).alias("line_")).filter(F.col("line_").rlike(WORKER))
    rows = runs.join(lines, F.col("log_file") == F.col("file_"))
    part = lambda k: F.regexp_extract("line_", WORKER, k)
    return rows.select(
        "phase", "patterns", "corpus", "searcher", "threads_label", F.coalesce("tag", F.lit("")).alias("tag"), "thr", "log_file", to_int(part(1)).alias("worker_id"),
        (to_real(part(2)) / 1000).alias("seconds"), to_real(part(2)).alias("milliseconds"), to_int(part(3)).alias("bytes_scanned"), to_int(part(4)).alias("matches_found"),
        to_real(part(5)).alias("mbps"), to_int(part(6)).alias("cpu"),
    )


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Runs from CSV with a header, read as text by name and typed here."""
    raw = spark.read.csv(path, header=True)
    have = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string")
    out = [F.nullif(have(c), F.lit("")).alias(c) for c in TEXTS] + [to_int(have(c)).alias(c) for c in INTS] + [to_real(have(c)).alias(c) for c in REALS]
    return raw.select(*out, build_threads(have("tag")).alias("build_threads"))


def write_csv(runs: DataFrame, path: str) -> None:
    runs.drop("build_threads").coalesce(1).write.mode("overwrite").csv(path, header=True)


def save(runs: DataFrame, workers: DataFrame, path: str) -> None:
    """Both tables under path. They are written beside it first and take its place together when both are whole."""
    spark = runs.sparkSession
    new = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    runs.write.parquet(f"{new}/runs")
    workers.write.parquet(f"{new}/worker_metrics")
    made, place = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (new, path))
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(place, True)
    if not files.rename(made, place):
        raise OSError(f"{new} cannot be renamed to {path}")


def load_table(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """A saved table; where there is none a warning and an empty one of the given schema."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(f"{path}/{name}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        warnings.warn(f"there is no table {name} in {path}", stacklevel=2)
        return spark.createDataFrame([], schema)


def resolve_log(csv_path: str, log_file: str | None) -> str | None:
    """The log that a CSV row names: as it is, with ~ read, or else beside the CSV; None if it is in neither place."""
    if not log_file:
        return None
    own = os.path.expanduser(log_file)
    return next((p for p in (own, os.path.join(os.path.dirname(csv_path), log_file)) if os.path.exists(p)), None)


def discover(root: str, name: str = "runs", labels: dict[str, str] | None = None) -> list[tuple[str, str, str]]:
    """(run_id, path, label) of the saved runs root/*/name: those with a given label first, in that order, then by run_id.

    The others' label is their run_id with spaces for underscores.
    """
    labels = labels or {}
    order = {run: k for k, run in enumerate(labels)}
    found = [(p.parent.name, str(p)) for p in Path(root).glob(f"*/{name}")]
    return [(run, path, labels.get(run, run.replace("_", " "))) for run, path in sorted(found, key=lambda x: (order.get(x[0], len(order)), x[0]))]
