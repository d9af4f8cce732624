"""Measuring scans: warm-up and iterations, statistics of samples, worker metrics, and their output."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kernel import scan_texts
from ..plans.chunks import equal_chunks
from .analytics import div
from .scan import _schema, _shards, bodies, dealt, shared

MIB = 1 << 20
PART = MIB  # bytes of a chunk that are scanned at once, as a scan takes many times its text


def run(scan: Callable[[], DataFrame], warmup: int = 1, iters: int = 5) -> list[float]:
    """Seconds of each iteration after the warm-ups; each writes to nowhere."""
    seconds = []
    for k in range(warmup + iters):
        begin = time.monotonic()
        scan().write.format("noop").mode("overwrite").save()
        if k >= warmup:
            seconds.append(time.monotonic() - begin)
    return seconds


def samples(spark: SparkSession, searcher: str, threads: int, n_bytes: int, matches: int, workers: int, seconds: list[float]) -> DataFrame:
    rows = [(searcher, threads, n_bytes, matches, workers, k, s) for k, s in enumerate(seconds)]
    return spark.createDataFrame(rows, "searcher string, threads_req int, bytes long, matches long, effective_workers int, iter int, seconds double")


def statistics(rows: DataFrame) -> DataFrame:
    """One row per searcher and configuration of samples: times in milliseconds and rates."""
    ms = F.col("seconds") * 1000
    out = rows.groupBy("searcher", "threads_req", "effective_workers", "bytes", "matches").agg(
        F.min(ms).alias("min_ms"), F.avg(ms).alias("mean_ms"), F.median(ms).alias("median_ms"), F.max(ms).alias("max_ms"), F.coalesce(F.stddev_samp(ms), F.lit(0.0)).alias("stdev_ms"),
        F.count("*").alias("iters"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("iter", ms.alias("ms")))), lambda x: F.format_string("%.3f", x["ms"])), ";").alias("iter_ms"),
    )
    rate = lambda t: div(F.col("bytes") * 1000.0, F.col(t) * MIB)
    return (
        out.withColumn("cv_pct", F.coalesce(div(F.col("stdev_ms") * 100, "mean_ms"), F.lit(0.0)))
        .withColumn("mbps_mean", rate("mean_ms")).withColumn("mbps_median", rate("median_ms"))
        .withColumn("gbps_mean", div(F.col("bytes") * 8.0, F.col("mean_ms") * 1e6)).withColumn("ns_per_byte", div(F.col("mean_ms") * 1e6, "bytes"))
    )


def scaling(stats: DataFrame) -> DataFrame:
    """stats with speedup over one thread and efficiency per thread."""
    one = stats.filter("threads_req = 1").select(F.col("searcher").alias("s_"), F.col("bytes").alias("b_"), F.col("mean_ms").alias("one_"))
    rows = stats.join(one, (F.col("searcher") == F.col("s_")) & (F.col("bytes") == F.col("b_"))).drop("s_", "b_")
    return rows.withColumn("speedup", div("one_", "mean_ms")).withColumn("efficiency", div("speedup", "threads_req")).drop("one_")


def count_chunks(texts: DataFrame, keys: list[str], automaton: Broadcast, parts: int, nocase: bool = False) -> DataFrame:
    """keys, chunk, scanned, n of texts(keys, body, size): bytes and matches of the first parts chunks of size bytes.

    Matches are counted where they are found, so a chunk is one row however many it has.
    """
    halo = automaton.value.halo
    df = texts.withColumn("n_", F.octet_length("body").cast("long")).filter("n_ > 0")
    df = df.withColumn("chunk", F.explode(F.expr(f"sequence(0L, least({parts - 1}L, (n_ - 1) div size))"))).withColumn("core_", F.expr("chunk * size"))
    df = df.withColumn("at_", F.greatest(F.lit(0).cast("long"), F.col("core_") - halo)).withColumn("scanned", F.expr("least(core_ + size, n_) - at_"))
    piece = F.expr("substring(body, cast(at_ + 1 as int), cast(scanned as int))")
    df = df.select(*keys, "chunk", "scanned", piece.alias("body"), F.expr("core_ - at_").alias("skip"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, skip, sizes = batch.column("body"), batch.column("skip").to_numpy(), batch.column("scanned").to_numpy()
            n = np.zeros(batch.num_rows, np.int64)
            short = np.flatnonzero(sizes <= PART)
            for row, end, _ in scan_texts(automaton.value, body.take(pa.array(short)), nocase):
                own = short[row]
                n += np.bincount(own[end >= skip[own]], minlength=len(n))
            for k in np.flatnonzero(sizes > PART).tolist():
                for core in range(int(skip[k]), int(sizes[k]), PART):
                    at = max(0, core - halo)
                    part = pc.binary_slice(body.slice(k, 1), at, core + PART)
                    n[k] += sum(int((end >= core - at).sum()) for _, end, _ in scan_texts(automaton.value, part, nocase))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*keys, "chunk", "scanned")), pa.array(n)], [*keys, "chunk", "scanned", "n"])

    return df.mapInArrow(run, f"{_schema(df, [*keys, 'chunk', 'scanned'])}, n long")


def worker_metrics(texts: DataFrame, rows: list[tuple[int, bytes]], parts: int, key: str = "doc_id", text: str = "text", kind: str = "chunked", nocase: bool = False, most_broadcast: int = 200_000) -> DataFrame:
    """key, worker_id, bytes_scanned, matches_found of a plan over texts(key, text), for the dictionary rows.

    A chunk scans its core and the halo before it; kind "sharded" means that every worker reads the whole text. Texts of one
    key count each other's matches, as a join on the key has it, so their matches are counted by the chunks of each size; a null
    key counts none. Where no key is shared, which is measured first, counts stay where they are made.
    """
    automaton = shared(texts.sparkSession, rows)
    n_bytes = F.octet_length(text).cast("long")
    size = F.greatest(F.lit(1).cast("long"), F.expr(f"(n_bytes + {parts - 1}) div {parts}"))
    sized = texts.select(key, n_bytes.alias("n_bytes")).withColumn("size", size)
    whole = bodies(texts.withColumn("n_bytes", n_bytes).withColumn("size", size), [key, "n_bytes", "size"], text)
    known = sized.filter(F.col(key).isNotNull())
    by_key = known.groupBy(key).agg(F.count("*").alias("n_"), (F.min("size") < F.max("size")).alias("mixed_")).filter("n_ > 1")
    several, mixed = by_key.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("mixed_"), F.col("n_"))), F.lit(0))).first()
    scanned = lambda own: F.col("n_bytes") if kind == "sharded" else own
    if not several:
        found = count_chunks(dealt(whole), [key, "n_bytes"], automaton, parts, nocase)
        return found.select(key, F.col("chunk").alias("worker_id"), scanned(F.col("scanned")).alias("bytes_scanned"), F.when(F.col(key).isNotNull(), F.col("n")).otherwise(F.lit(0)).cast("long").alias("matches_found"))
    sizes = known.groupBy(key, "size").agg(F.count("*").alias("times_"))
    whole = whole.filter(F.col(key).isNotNull())
    if mixed:
        every = sizes.groupBy(key).agg(F.collect_list("size").alias("every_")).filter(F.size("every_") > 1)
        whole = whole.join(F.broadcast(every) if mixed <= most_broadcast else every, key, "left")
        whole = whole.select(key, "body", F.explode(F.coalesce("every_", F.array("size"))).alias("size"))
    found = count_chunks(dealt(whole), [key, "size"], automaton, parts, nocase).groupBy(key, "size", "chunk").agg(F.sum("n").alias("n"))
    own = found.join(sizes, [key, "size"]).groupBy(F.col(key).alias("k_"), F.col("chunk").alias("c_")).agg(F.sum(F.col("n") * F.col("times_")).alias("m_"))
    plan = equal_chunks(sized.drop("size"), "n_bytes", parts, automaton.value.halo)
    return plan.join(own, (F.col(key) == F.col("k_")) & (F.col("chunk") == F.col("c_")), "left").select(key, F.col("chunk").alias("worker_id"), scanned(F.col("core_end") - F.col("scan_start")).alias("bytes_scanned"), F.coalesce("m_", F.lit(0)).cast("long").alias("matches_found"))


def _cpu() -> int:
    """The core that runs this process, or -1 where the system does not say."""
    try:
        with open("/proc/self/stat") as f:
            return int(f.read().rpartition(")")[2].split()[36])
    except (OSError, ValueError, IndexError):
        return -1


def worker_run(texts: DataFrame, rows: list[tuple[int, bytes]], threads: int, kind: str = "chunked", tasks_per_thread: int = 4, nocase: bool = False) -> DataFrame:
    """worker_id, seconds, milliseconds, bytes_scanned, matches_found, mbps, cpu of a scan of texts(body), measured in its tasks.

    chunked: a chunk is a worker, and its halo counts as scanned. dynamic: a partition is a worker, and counts the size
    of a task for each it took. sharded: a shard of the dictionary is a worker, and scans the whole text. cpu is the core
    at the end, -1 if unknown.
    """
    spark = texts.sparkSession
    parts = threads * tasks_per_thread if kind == "dynamic" else threads
    own = _shards(rows, max(1, min(threads, len(rows)))) if kind == "sharded" else {0: rows}
    automata = {k: shared(spark, r) for k, r in own.items()}
    halo = max(a.value.halo for a in automata.values())
    sized = texts.select("body", F.octet_length("body").cast("long").alias("n_bytes"))
    if kind == "sharded":
        pieces = sized.withColumn("chunk", F.explode(F.lit(sorted(own)).cast("array<bigint>"))).select("chunk", "body", F.lit(0).cast("long").alias("skip"), F.col("n_bytes").alias("size"))
    else:
        plan = equal_chunks(sized, "n_bytes", parts, halo)
        piece = F.expr("substring(body, cast(scan_start + 1 as int), cast(core_end - scan_start as int))")
        pieces = plan.select("chunk", piece.alias("body"), (F.col("core_start") - F.col("scan_start")).alias("skip"), F.expr(f"(n_bytes + {parts - 1}) div {parts}").alias("size"))

    def run(batches):
        number = TaskContext.get().partitionId()
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                chunk, skip = batch.column("chunk")[k].as_py(), batch.column("skip")[k].as_py()
                begin, n = time.monotonic(), 0
                for _, end, _ in scan_texts(automata[chunk if kind == "sharded" else 0].value, batch.column("body").slice(k, 1), nocase):
                    n += int((end >= skip).sum())
                seconds = time.monotonic() - begin
                scanned = batch.column("size")[k].as_py() if kind == "dynamic" else len(batch.column("body")[k].as_py())
                out.append((number if kind == "dynamic" else chunk, seconds, scanned, n, _cpu()))
            cols = list(zip(*out)) or [[]] * 5
            kinds = (("worker_id", pa.int64()), ("seconds", pa.float64()), ("bytes_scanned", pa.int64()), ("matches_found", pa.int64()), ("cpu", pa.int64()))
            yield pa.RecordBatch.from_pydict({c: pa.array(x, t) for (c, t), x in zip(kinds, cols)})

    ran = pieces.repartition(threads).mapInArrow(run, "worker_id long, seconds double, bytes_scanned long, matches_found long, cpu long")
    done = ran.groupBy("worker_id").agg(F.sum("seconds").alias("seconds"), F.sum("bytes_scanned").alias("bytes_scanned"), F.sum("matches_found").alias("matches_found"), F.max("cpu").alias("cpu"))
    return done.select("worker_id", "seconds", (F.col("seconds") * 1000).alias("milliseconds"), "bytes_scanned", "matches_found", div(F.col("bytes_scanned").cast("double"), F.col("seconds") * MIB).alias("mbps"), "cpu")


#: Lines of results and their heads (fixed values: the logs' format).
HEAD = "%-22s %4s %12s %14s %14s %14s %12s %10s %14s %8s %10s %6s" % ("searcher", "thr", "bytes", "min(ms)", "mean(ms)", "max(ms)", "MB/s", "matches", "median(ms)", "cv%", "Gbps", "wrk")
LINE = "%-22s %4d %12d %14.3f %14.3f %14.3f %12.2f %10d %14.3f %8.2f %10.4f %6d"
CSV_HEAD = "git_hash,searcher,threads_req,effective_workers,bytes,matches,min_ms,mean_ms,median_ms,max_ms,stdev_ms,cv_pct,mbps_mean,mbps_median,gbps_mean,ns_per_byte,iters,iter_ms"
CSV_LINE = "%s,%s,%d,%d,%d,%d,%.6f,%.6f,%.6f,%.6f,%.6f,%.4f,%.4f,%.4f,%.6f,%.6f,%d,%s"
WORKER_LINE = "    [t%02d] %.3f ms  %d bytes  %d matches  %.2f MB/s  cpu=%d"


def text_lines(stats: DataFrame) -> DataFrame:
    """A result line for each row of stats, with the frozen first eight columns and the four later ones, and two more lines behind it."""
    first = F.format_string(LINE, "searcher", "threads_req", "bytes", "min_ms", "mean_ms", "max_ms", "mbps_mean", "matches", "median_ms", "cv_pct", "gbps_mean", "effective_workers")
    times = F.concat(F.lit("#   iter_ms: "), F.translate("iter_ms", ";", " "))
    more = F.format_string("#   workers=%d  median_MB/s=%.2f  ns/byte=%.4f  stdev_ms=%.3f", "effective_workers", "mbps_median", "ns_per_byte", "stdev_ms")
    return stats.select(F.concat_ws("\n", first, times, more).alias("line"))


def csv_lines(stats: DataFrame, git_hash: str = "unknown") -> DataFrame:
    """A line of eighteen columns for each row of stats, under CSV_HEAD."""
    return stats.select(F.format_string(CSV_LINE, F.lit(git_hash), *CSV_HEAD.split(",")[1:]).alias("line"))


def worker_lines(workers: DataFrame) -> DataFrame:
    """[tNN] lines of worker_id, milliseconds, bytes_scanned, matches_found, mbps, cpu."""
    return workers.select(F.format_string(WORKER_LINE, "worker_id", "milliseconds", "bytes_scanned", "matches_found", "mbps", F.coalesce("cpu", F.lit(-1))).alias("line"))


def write_csv(stats: DataFrame, path: str, git_hash: str = "unknown") -> None:
    """The eighteen columns of the CSV form, in their order."""
    stats.withColumn("git_hash", F.lit(git_hash)).select(*CSV_HEAD.split(",")).coalesce(1).write.mode("overwrite").csv(path, header=True)


def grid(spark: SparkSession, axes: dict[str, list]) -> DataFrame:
    """The cross product of an experiment's parameters, one row per cell; axes are lists given by hand."""
    out = None
    for name, values in axes.items():
        own = spark.createDataFrame([(v,) for v in values], [name])
        out = own if out is None else out.crossJoin(own)
    return out
