"""Command line: scan a text with a pattern file by one or all strategies, and print results as text or CSV."""

from __future__ import annotations

import argparse
import os
import subprocess
import sys
import time

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.automaton import compile_patterns, human_bytes
from .operators import measure, results, scan
from .sources import corpus, patterns

WHOLE, RANGE = 1 << 30, 4 << 20  # bytes of a file that is one row at most, and of a range of a larger one


def git_hash() -> str:
    """The commit of this code, or unknown."""
    own = subprocess.run(["git", "-C", os.path.dirname(__file__), "rev-parse", "--short", "HEAD"], capture_output=True, text=True, check=False)
    return own.stdout.strip() or "unknown"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="matchloom", description=__doc__)
    p.add_argument("--patterns", help="file with a pattern per line")
    p.add_argument("--input", help="file that is scanned as one text")
    p.add_argument("--searcher", help="a strategy; all of them if left out")
    p.add_argument("--threads", type=int, default=0)
    p.add_argument("--tasks-per-thread", type=int, default=0)
    p.add_argument("--chunk", type=int, default=0, help="read the input in ranges of so many bytes, as files beyond 1 GiB are")
    p.add_argument("--warmup", type=int, default=1)
    p.add_argument("--iters", type=int, default=5)
    p.add_argument("--format", default="text", choices=("text", "csv"))
    p.add_argument("--nocase", action="store_true")
    p.add_argument("--print-matches", action="store_true")
    p.add_argument("--per-thread", action="store_true")
    p.add_argument("--list", action="store_true", help="name the strategies and stop")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 if it went well, 1 for an unknown strategy, a missing file or an empty dictionary, 2 for missing arguments."""
    args = parser().parse_args(argv)
    if args.list:
        print("\n".join(scan.strategies()))
        return 0
    if not args.patterns or not args.input:
        print("--patterns and --input are needed", file=sys.stderr)
        return 2
    if args.searcher and args.searcher not in scan.strategies():
        print(f"unknown strategy {args.searcher}", file=sys.stderr)
        return 1
    spark = spark or SparkSession.builder.appName("matchloom").getOrCreate()
    try:
        n_bytes = spark.read.format("binaryFile").load(args.input).select("length").first()[0]
        words = patterns.load(patterns.read_lines(spark, args.patterns)).cache()
        rows = scan.dictionary(words, args.nocase)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        print(e.desc if hasattr(e, "desc") else e, file=sys.stderr)
        return 1
    if not rows:
        print("the dictionary is empty", file=sys.stderr)
        return 1
    begin = time.monotonic()
    a = compile_patterns([p for _, p in rows])
    build_ms = (time.monotonic() - begin) * 1000
    config = scan.ScanConfig(threads=args.threads, tasks_per_thread=args.tasks_per_thread, nocase=args.nocase, spread=True)
    threads = args.threads or spark.sparkContext.defaultParallelism
    ranges = args.chunk or (RANGE if n_bytes > WHOLE else 0)  # a value of one row holds 2 GB at most
    if ranges:
        parts = corpus.read_ranges(spark, args.input, ranges)
    else:
        text = spark.read.format("binaryFile").load(args.input).select(F.lit(0).cast("long").alias("doc_id"), F.col("content").alias("body")).cache()
    # The form of these lines is fixed: logs are read by it.
    print(f"# matchloom\n# git:        {git_hash()}\n# patterns:   {len(rows)} (max len {a.max_length}, min len {a.min_length}){' [nocase]' * args.nocase}\n# automaton:  {a.states} states, {human_bytes(a.footprint())}")
    print(f"# input:      {n_bytes} bytes ({n_bytes / measure.MIB:.2f} MiB) via {'byte ranges' if ranges else 'read'}\n# build time: {build_ms:.3f} ms\n# warmup={args.warmup} iters={args.iters} threads={threads} tasks_per_thread={args.tasks_per_thread or 4}")
    print(measure.CSV_HEAD if args.format == "csv" else "\n" + measure.HEAD)
    for name in [args.searcher] if args.searcher else scan.strategies():
        if ranges:
            once = lambda: scan.match_corpus(parts, words, "part", "body", ranges, args.nocase)
        else:
            once = lambda name=name: scan.strategy(name)(text, ["doc_id"], rows, config)
        seconds = measure.run(once, args.warmup, args.iters)
        found = once()
        stats = measure.statistics(measure.samples(spark, name, threads, n_bytes, found.count(), threads, seconds))
        print((measure.csv_lines(stats, git_hash()) if args.format == "csv" else measure.text_lines(stats)).first()[0])
        if args.per_thread and args.format != "csv" and not ranges:
            kind = "dynamic" if name.startswith("pthread_dynamic") else "sharded" if name == "pattern_sharded_prefix" else "chunked"
            workers = measure.worker_run(text, rows, 1 if name.startswith("sequential") else threads, kind, args.tasks_per_thread or 4, args.nocase)
            for row in measure.worker_lines(workers.orderBy("worker_id")).collect():
                print(row[0])
        if args.print_matches:
            for row in results.rendered(found, words).orderBy("end_pos", "pattern_id").toLocalIterator():
                print(row["line"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
