"""Views over runs and worker metrics, and the frames behind the pages of a dashboard."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEQUENTIAL = ("sequential", "sequential_flat")
CORNERS = ["patterns", "corpus"]


def div(a, b) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.try_divide(a, b)


def _curves(runs: DataFrame) -> DataFrame:
    return runs.filter("phase = 'A_speedup_curves'")


def v_speedup(runs: DataFrame) -> DataFrame:
    """Throughput of phase A against its sequential runs; several baselines give several rows."""
    a = _curves(runs)
    base = a.filter("searcher = 'sequential'").select(*CORNERS, F.col("mbps").alias("seq_"))
    rows = a.filter(~F.col("searcher").isin(*SEQUENTIAL)).join(base, CORNERS)
    return rows.select(*CORNERS, "searcher", "thr", F.round("mbps", 2).alias("mbps"), F.round("seq_", 2).alias("seq_mbps"), F.round(div("mbps", "seq_"), 3).alias("speedup_vs_seq"))


def v_self_speedup(runs: DataFrame) -> DataFrame:
    a = _curves(runs)
    base = a.filter("thr = 1").select(*CORNERS, "searcher", F.col("mbps").alias("one_"))
    rows = a.filter(~F.col("searcher").isin(*SEQUENTIAL)).join(base, [*CORNERS, "searcher"])
    return rows.select(*CORNERS, "searcher", "thr", F.round("mbps", 2).alias("mbps"), F.round(div("mbps", "one_"), 3).alias("speedup_vs_t1"))


def v_footprint(runs: DataFrame) -> DataFrame:
    return runs.filter("phase = 'B_footprint'").select("patterns", "searcher", "thr", "automaton_states", F.round(F.col("automaton_kib") / 1024.0, 2).alias("automaton_mib"), F.round("mbps", 2).alias("mbps"))


def v_build(runs: DataFrame) -> DataFrame:
    """Build times of phase E against the sequential build, which is a row itself."""
    e = runs.filter("phase = 'E_build_par'")
    base = e.filter("tag = 'buildseq'").select("patterns", F.col("build_ms").alias("seq_"))
    return e.join(base, "patterns").select("patterns", F.coalesce("build_threads", F.lit(1).cast("bigint")).alias("build_threads"), F.round("build_ms", 2).alias("build_ms"), F.round("seq_", 2).alias("seq_build_ms"), F.round(div("seq_", "build_ms"), 3).alias("build_speedup"))


def v_correctness(runs: DataFrame) -> DataFrame:
    return _curves(runs).groupBy(*CORNERS).agg(F.count_distinct("matches").alias("distinct_match_counts"), F.min("matches").alias("matches"))


def divergences(runs: DataFrame) -> DataFrame:
    return v_correctness(runs).filter("distinct_match_counts <> 1")


def v_best(runs: DataFrame) -> DataFrame:
    """The fastest runs of phase A for each dictionary, corpus and thread count; ties give several rows."""
    rows = _curves(runs).filter(~F.col("searcher").isin(*SEQUENTIAL))
    top = F.max("mbps").over(Window.partitionBy(*CORNERS, "thr"))
    return rows.withColumn("top_", top).filter("mbps = top_").select(*CORNERS, "thr", "searcher", F.round("mbps", 2).alias("mbps"))


def v_worker_balance(workers: DataFrame) -> DataFrame:
    ms = F.col("milliseconds")
    rows = workers.groupBy("phase", *CORNERS, "searcher", "thr", "tag", "log_file").agg(
        F.count("*").alias("workers"), F.min(ms).alias("a_"), F.avg(ms).alias("b_"), F.max(ms).alias("c_"), F.min("mbps").alias("d_"), F.avg("mbps").alias("e_"), F.max("mbps").alias("f_"),
        F.sum("bytes_scanned").alias("total_worker_bytes"), F.sum("matches_found").alias("total_worker_matches"),
    )
    return rows.select(
        "phase", *CORNERS, "searcher", "thr", "tag", "log_file", "workers", F.round("a_", 3).alias("min_worker_ms"), F.round("b_", 3).alias("avg_worker_ms"), F.round("c_", 3).alias("max_worker_ms"),
        F.round(div(F.col("c_") - F.col("a_"), "b_") * 100, 3).alias("spread_pct"), F.round(div("c_", "a_"), 4).alias("imbalance_ratio"),
        F.round("d_", 2).alias("min_worker_mbps"), F.round("e_", 2).alias("avg_worker_mbps"), F.round("f_", 2).alias("max_worker_mbps"), "total_worker_bytes", "total_worker_matches",
    )


def v_skew(runs: DataFrame) -> DataFrame:
    return runs.groupBy(*CORNERS, "searcher", "thr").agg(F.median("mbps").alias("median_mbps"))


def register_views(runs: DataFrame, workers: DataFrame) -> None:
    """runs, worker_metrics and the views as temporary views, for SQL over them."""
    runs.createOrReplaceTempView("runs")
    workers.createOrReplaceTempView("worker_metrics")
    for f in (v_speedup, v_self_speedup, v_footprint, v_build, v_correctness, v_best):
        f(runs).createOrReplaceTempView(f.__name__)
    v_worker_balance(workers).createOrReplaceTempView("v_worker_balance")


#: Questions that runs are asked as a rule, over the views' names (fixed values: names, filters and columns).
CANONICAL = {
    "canonical_correctness": "SELECT * FROM v_correctness",
    "canonical_curve": "SELECT thr, speedup_vs_seq, mbps FROM v_speedup WHERE patterns = '{patterns}' AND corpus = '{corpus}' AND searcher = '{searcher}' ORDER BY thr",
    "canonical_best": "SELECT * FROM v_best WHERE patterns = '{patterns}' AND corpus = '{corpus}' ORDER BY thr",
    "canonical_footprint": "SELECT patterns, searcher, thr, automaton_mib, mbps FROM v_footprint ORDER BY automaton_mib, searcher, thr",
    "canonical_build": "SELECT patterns, build_threads, build_ms, seq_build_ms, build_speedup FROM v_build ORDER BY patterns, build_threads",
    "canonical_balance": "SELECT phase, searcher, thr, tag, workers, min_worker_ms, max_worker_ms, spread_pct, imbalance_ratio FROM v_worker_balance ORDER BY phase, searcher, tag",
    "canonical_workers": "SELECT worker_id, milliseconds, bytes_scanned, matches_found, mbps FROM worker_metrics WHERE phase = 'D_per_thread' AND searcher = '{searcher}' ORDER BY worker_id",
}


def canonical(runs: DataFrame, workers: DataFrame, name: str, **names: str) -> DataFrame:
    """One of the canonical questions over runs and worker_metrics, whose views are registered; names fill in its filters."""
    register_views(runs, workers)
    return runs.sparkSession.sql(CANONICAL[name].format(**names))


def verdict(parity_ok: bool, divergent: int, worst_cv: float, most_cv: float = 0.05) -> str:
    """What a comparison of runs is worth: "invalid" if corpora or matches differ, "noisy" if workers spread too much, else "valid"."""
    return "invalid" if not parity_ok or divergent else "noisy" if worst_cv > most_cv else "valid"


def concat_runs(frames: dict[str, DataFrame]) -> DataFrame | None:
    """All runs under each other with run_id; columns that some lack are null there, empty frames are left out."""
    rows = [df.withColumn("run_id", F.lit(k)) for k, df in frames.items() if not df.isEmpty()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows) if rows else None


def options(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def filtered(df: DataFrame, wanted: dict[str, list], exclude: tuple[str, ...] = (), hide_sequential: bool = False) -> DataFrame:
    """Rows with one of the wanted values in every column; an empty list, a missing or an excluded column sets no limit."""
    for c, values in wanted.items():
        if values and c in df.columns and c not in exclude:
            df = df.filter(F.col(c).isin(*values))
    if hide_sequential and "searcher" in df.columns:
        df = df.filter(F.col("searcher").isNull() | ~F.col("searcher").isin(*SEQUENTIAL))
    return df


def derived(df: DataFrame) -> DataFrame:
    """df with efficiency, automaton_mib, tasks_per_thread, replicate and core_class, where their inputs are there."""
    if {"speedup_vs_seq", "thr", "searcher"} <= {*df.columns}:
        own = F.when(F.col("thr") > 0, F.col("speedup_vs_seq") / F.col("thr")).when(F.col("searcher") == "sequential", 1.0).otherwise(0.0)
        df = df.withColumn("efficiency", own)
    if "automaton_kib" in df.columns:
        df = df.withColumn("automaton_mib", F.col("automaton_kib") / 1024.0)
    if "tag" in df.columns:
        num = lambda p: F.nullif(F.regexp_extract(F.coalesce("tag", F.lit("")), p, 1), F.lit("")).try_cast("int")
        df = df.withColumn("tasks_per_thread", num(r"tpt(\d+)")).withColumn("replicate", num(r"rep(\d+)"))
    if "cpu" in df.columns:
        df = df.withColumn("core_class", F.when(F.col("cpu").isNotNull(), F.when(F.col("cpu").between(0, 3), "P").otherwise("E")))
    return df


def replicate_summary(df: DataFrame, by: list[str], value: str, prefix: str = "") -> DataFrame:
    """reps, median, quartiles, extremes and spreads of a value in each group; groups with null keys stay."""
    v = F.col(value)
    n = lambda x: f"{prefix}{x}"
    rows = df.groupBy(*by).agg(F.count(v).alias("reps"), F.percentile(v, F.lit(0.5)).alias(n("median")), F.percentile(v, F.lit(0.25)).alias(n("q1")), F.percentile(v, F.lit(0.75)).alias(n("q3")), F.min(v).alias(n("min")), F.max(v).alias(n("max")), *([F.percentile("cv_pct", F.lit(0.5)).alias("median_cv_pct"), F.max("cv_pct").alias("max_cv_pct")] if "cv_pct" in df.columns else []))
    rows = rows.withColumn(n("iqr"), F.col(n("q3")) - F.col(n("q1")))
    return rows.withColumn(n("iqr_pct"), div(n("iqr"), n("median")) * 100).withColumn(n("range_pct"), div(F.col(n("max")) - F.col(n("min")), n("median")) * 100)


def speedup_from_median(summary: DataFrame, prefix: str = "", baseline: DataFrame | None = None) -> DataFrame:
    """A replicate summary with speed-ups over the sequential rows at one thread, per run, dictionary and corpus.

    These are rows of baseline, another summary, where it is given. Without any the summary stays as it is.
    """
    keys = [c for c in ("run_id", *CORNERS) if c in summary.columns]
    base = (summary if baseline is None else baseline).filter("searcher = 'sequential' and thr = 1").select(*[F.col(k).alias(f"{k}_b") for k in keys], F.col(f"{prefix}median").alias("base_"))
    if base.isEmpty():
        return summary
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_b")) for k in keys])
    rows = summary.join(base, on, "left").drop(*[f"{k}_b" for k in keys])
    for c in ("median", "q1", "q3"):
        rows = rows.withColumn(f"speedup_{c}", div(f"{prefix}{c}", "base_"))
    return rows.withColumnRenamed("base_", "seq_median")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.col("count").desc(), column)


def n_unique(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_distinct(column).alias("n"))


def overview(df: DataFrame) -> DataFrame:
    return df.groupBy("run_id", "phase").agg(F.count("*").alias("rows"))


def ranking(df: DataFrame) -> DataFrame:
    return df.withColumn("place", F.rank().over(Window.partitionBy(*CORNERS, "thr").orderBy(F.col("mbps").desc()))).orderBy(*CORNERS, "thr", F.col("mbps").desc())


def pivot_mean(df: DataFrame, by: list[str], across: str, value: str = "mbps", values: list | None = None) -> DataFrame:
    """Mean of value by group, one column for each value of across; rows with a null key go."""
    df = df.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*by, across)]))
    return df.groupBy(*by).pivot(across, values).avg(value)


def cross_corpus(runs: DataFrame, values: list | None = None) -> DataFrame:
    rows = runs.filter(F.col("phase").startswith("A_") | (F.col("phase") == "C_cross_corpus"))
    return pivot_mean(rows, ["patterns", "searcher", "thr"], "corpus", values=values)


def run_comparison(runs: DataFrame, values: list | None = None) -> DataFrame:
    return pivot_mean(runs, [*CORNERS, "searcher", "thr"], "run_id", values=values)


def skew_delta(runs: DataFrame) -> DataFrame:
    """Median throughput on uniform and clustered corpora (by corpus name) and the change in percent."""
    kind = F.when(F.col("corpus").contains("clustered"), "clustered").when(F.col("corpus").contains("uniform"), "uniform")
    rows = runs.withColumn("kind_", kind).filter("kind_ is not null").groupBy("patterns", "searcher", "thr").pivot("kind_", ["uniform", "clustered"]).agg(F.median("mbps"))
    return rows.withColumn("delta_pct", div(F.col("clustered") - F.col("uniform"), "uniform") * 100)


def barrier_idle(workers: DataFrame, by: list[str]) -> DataFrame:
    """How much of the slowest worker's time the others wait: per log (max - mean) / max in percent, then summarised."""
    per = workers.groupBy(*by, "log_file").agg(F.max("milliseconds").alias("top_"), F.avg("milliseconds").alias("mean_"))
    return replicate_summary(per.withColumn("idle_pct", div(F.col("top_") - F.col("mean_"), "top_") * 100), by, "idle_pct", "idle_")


def cpu_classes(workers: DataFrame) -> DataFrame:
    return derived(workers).filter("core_class is not null").groupBy("core_class").agg(F.count("*").alias("workers"), F.median("milliseconds").alias("median_ms"), F.median("mbps").alias("median_mbps"), F.median("bytes_scanned").alias("median_bytes"))


def stragglers(workers: DataFrame) -> DataFrame:
    """Each log's slowest worker, the first on a tie."""
    keys = [c for c in ("run_id", "log_file") if c in workers.columns]
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("milliseconds").desc(), "worker_id"))
    return derived(workers.withColumn("first_", first).filter("first_ = 1").drop("first_"))


def straggler_classes(workers: DataFrame) -> DataFrame:
    return value_counts(stragglers(workers), "core_class")


def with_imbalance(summary: DataFrame, balance: DataFrame, by: list[str]) -> DataFrame:
    return summary.join(balance.groupBy(*by).agg(F.median("imbalance_ratio").alias("median_imbalance")), by, "left")


def granularity(runs: DataFrame) -> DataFrame:
    return derived(runs.filter("phase = 'G_granularity'")).filter("tasks_per_thread is not null").orderBy("searcher", "tasks_per_thread")


def footprint_or_runs(runs: DataFrame) -> DataFrame:
    """The footprint view; if that phase was not run, the same columns from all runs."""
    view = v_footprint(runs)
    return view if not view.isEmpty() else v_footprint(runs.withColumn("phase", F.lit("B_footprint")))


def scenarios(df: DataFrame) -> DataFrame:
    return df.withColumn("scenario", F.concat("patterns", F.lit(" / "), "corpus"))


def error_bars(summary: DataFrame, prefix: str = "") -> DataFrame:
    return summary.withColumn("error_up", F.col(f"{prefix}q3") - F.col(f"{prefix}median")).withColumn("error_down", F.col(f"{prefix}median") - F.col(f"{prefix}q1"))


def near_ties(runs: DataFrame, tolerance_pct: float = 1.0) -> DataFrame:
    """Runs with their distance from the best of their group in percent, and whether that is within tolerance."""
    top = F.max("mbps").over(Window.partitionBy(*CORNERS, "thr"))
    rows = _curves(runs).withColumn("delta_mbps_pct", div(F.col("mbps") - top, top) * 100)
    return rows.withColumn("near_tie", F.abs("delta_mbps_pct") <= tolerance_pct)


def efficiency_vs_t1(runs: DataFrame) -> DataFrame:
    return v_self_speedup(runs).withColumn("efficiency_vs_t1", div("speedup_vs_t1", "thr"))


def coverage(runs: DataFrame, values: list | None = None) -> DataFrame:
    return runs.groupBy("phase").pivot("run_id", values).count().na.fill(0)


def top_n(runs: DataFrame, n: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*CORNERS).orderBy(F.col("mbps").desc(), "searcher", "thr"))
    return runs.withColumn("place", place).filter(F.col("place") <= n)


def worker_cv(workers: DataFrame) -> DataFrame:
    return workers.groupBy("log_file").agg(F.coalesce(div(F.stddev_samp("milliseconds"), F.avg("milliseconds")), F.lit(0.0)).alias("cv"))
