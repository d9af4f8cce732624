"""Match operators: every overlapping occurrence of every pattern, by interchangeable strategies with one result.

Document mode scans each row as a text of its own; corpus mode takes the rows, in order of their key, as one text.
The strategies differ in how text and dictionary are divided; where the original differs in hardware hints only, the
names share one plan.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.automaton import Automaton, compile_patterns, content_key, fold
from ..functions.kernel import scan_texts
from ..plans import chunks

#: Environment variables that set a plan where the configuration does not (fixed values: their names).
TASKS_ENV, SHARDS_ENV = "AC_DYN_TASKS_PER_THREAD", "AC_2D_K"
MAX_STRATEGIES = 32
#: A Parquet row group is read by one task and has this size by default, so a smaller input may be in fewer than cores.
GROUP_BYTES = 128 << 20
MAX_CACHED = 8


@dataclass(frozen=True)
class ScanConfig:
    """threads and tasks_per_thread size the plans (0: chosen here); shards is K of the two-dimensional plan.

    spread deals the pieces of texts over that many partitions; it is for a few large texts, as a table of many texts is
    in enough partitions already and need not be shuffled.
    """

    threads: int = 0
    tasks_per_thread: int = 0
    shards: int = 0
    weights: tuple[float, ...] = ()
    nocase: bool = False
    spread: bool = False


_cached: dict[tuple[str, str], Broadcast] = {}


def dictionary(patterns: DataFrame, nocase: bool = False) -> list[tuple[int, bytes]]:
    """(pattern_id, pattern) of a dictionary, which is compiled on the driver and has to fit there."""
    rows = sorted(patterns.select("pattern_id", "pattern").collect())
    return [(r[0], fold(bytes(r[1])) if nocase else bytes(r[1])) for r in rows]


def shared(spark: SparkSession, rows: list[tuple[int, bytes]]) -> Broadcast:
    """The compiled dictionary as a broadcast, kept by content."""
    key = (spark.sparkContext.applicationId, content_key([p for _, p in rows], [i for i, _ in rows]))
    if key not in _cached:
        while len(_cached) >= MAX_CACHED:
            _cached.pop(next(iter(_cached))).unpersist()
        _cached[key] = spark.sparkContext.broadcast(compile_patterns([p for _, p in rows], [i for i, _ in rows]))
    return _cached[key]


def _schema(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)


def scan_rows(df: DataFrame, keys: list[str], automata: dict[int, Broadcast], nocase: bool = False) -> DataFrame:
    """Matches in df(keys..., body, at, core, shard): keys, end_pos, pattern_id; at is added to ends, matches ending before core go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for shard in np.unique(whole.column("shard").to_numpy()).tolist():
                batch = whole.filter(pa.array(whole.column("shard").to_numpy() == shard))
                at, core = batch.column("at").to_numpy(), batch.column("core").to_numpy()
                for row, end, pid in scan_texts(automata[shard].value, batch.column("body"), nocase):
                    end = end + at[row]
                    keep = end >= core[row]
                    row = pa.array(row[keep])
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(row) for c in keys), pa.array(end[keep], pa.int64()), pa.array(pid[keep], pa.int32())], [*keys, "end_pos", "pattern_id"])

    return df.select(*keys, "body", "at", "core", "shard").mapInArrow(run, f"{_schema(df, keys)}, end_pos long, pattern_id int")


def count_rows(df: DataFrame, keys: list[str], automaton: Broadcast, nocase: bool = False) -> DataFrame:
    """keys, pattern_id, n: matches counted inside the scan, for dense dictionaries whose positions nobody needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = max(1, len(automaton.value.lengths))
            counts: dict[int, int] = {}
            for row, _, pid in scan_texts(automaton.value, batch.column("body"), nocase):
                key, n = np.unique(row * width + pid, return_counts=True)
                for k, m in zip(key.tolist(), n.tolist()):
                    counts[k] = counts.get(k, 0) + m
            codes = np.array(list(counts), np.int64)
            row = pa.array(codes // width)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(row) for c in keys), pa.array((codes % width).astype(np.int32)), pa.array(list(counts.values()), pa.int64())], [*keys, "pattern_id", "n"])

    return dealt(df.select(*keys, "body")).mapInArrow(run, f"{_schema(df, keys)}, pattern_id int, n long")


def bodies(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """df as keys and body, the bytes of its text column; a null text is an empty one."""
    body = F.col(text).cast("binary")
    return df.select(*keys, F.coalesce(body, F.lit(b"")).alias("body"))


def dealt(df: DataFrame) -> DataFrame:
    """df, dealt over all cores if the planner's estimate says that its row groups may be fewer; larger inputs are not shuffled."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    estimate = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if estimate < cores * GROUP_BYTES else df


Strategy = Callable[[DataFrame, list[str], list[tuple[int, bytes]], ScanConfig], DataFrame]
_strategies: dict[str, Strategy] = {}


def register(name: str) -> Callable[[Strategy], Strategy]:
    """Adds a strategy; a name is taken once, and there are 32 at most."""

    def add(f: Strategy) -> Strategy:
        if name in _strategies:
            raise ValueError(f"strategy {name} is registered already")
        if len(_strategies) >= MAX_STRATEGIES:
            raise ValueError("too many strategies")
        _strategies[name] = f
        return f

    return add


def strategies() -> list[str]:
    return list(_strategies)


def strategy(name: str | int) -> Strategy:
    """By name or place; KeyError if there is none."""
    if isinstance(name, int):
        if not 0 <= name < len(_strategies):
            raise KeyError(name)
        name = list(_strategies)[name]
    return _strategies[name]


def match(df: DataFrame, patterns: DataFrame, keys: list[str], text: str = "text", name: str | int = "pthread_dynamic_flat", config: ScanConfig = ScanConfig()) -> DataFrame:
    """Matches in document mode: keys, end_pos (of the last byte, from 0), pattern_id."""
    found = strategy(name)
    return found(bodies(df, keys, text), keys, dictionary(patterns, config.nocase), config)


def _threads(df: DataFrame, config: ScanConfig) -> int:
    return config.threads or df.sparkSession.sparkContext.defaultParallelism


def _whole(df: DataFrame, keys: list[str], rows: list[tuple[int, bytes]], config: ScanConfig) -> DataFrame:
    df = df.withColumns({"at": F.lit(0).cast("long"), "core": F.lit(0).cast("long"), "shard": F.lit(0)})
    return scan_rows(df, keys, {0: shared(df.sparkSession, rows)}, config.nocase)


@register("sequential")
def sequential(df, keys, rows, config):
    """Each text in one piece, one task after the other."""
    return _whole(df.coalesce(1), keys, rows, config)


def _shards(rows: list[tuple[int, bytes]], k: int) -> dict[int, list[tuple[int, bytes]]]:
    """The dictionary by first byte modulo k; ids stay those of the whole dictionary."""
    out: dict[int, list[tuple[int, bytes]]] = {}
    for i, p in rows:
        out.setdefault(p[0] % k, []).append((i, p))
    return out


def _divided(df: DataFrame, keys: list[str], rows: list[tuple[int, bytes]], config: ScanConfig, parts: int, shards: int = 1) -> DataFrame:
    """Each text in chunks with a halo, each chunk against each shard; texts too small for that stay whole.

    The input is read once.
    """
    spark = df.sparkSession
    own = _shards(rows, shards) if shards > 1 else {0: rows} if rows else {}
    automata = {k: shared(spark, r) for k, r in own.items()}
    halo = max((a.value.halo for a in automata.values()), default=0)
    df = df.withColumn("n_", F.octet_length("body").cast("long")).filter("n_ > 0")
    small = (F.col("n_") <= 2 * halo) | (F.col("n_") < chunks.LEAST * parts)
    size = F.when(small, F.col("n_")).otherwise(F.expr(f"(n_ + {parts - 1}) div {parts}"))
    df = df.withColumn("size_", size).withColumn("core", F.explode(F.expr("sequence(0L, n_ - 1, size_)")))
    df = df.withColumn("at", F.greatest(F.lit(0).cast("long"), F.col("core") - halo))
    piece = F.expr("substring(body, cast(at + 1 as int), cast(least(core + size_, n_) - at as int))")
    df = df.select(*keys, piece.alias("body"), "at", "core")
    df = df.repartition(parts) if config.spread else df
    if shards > 1 or not automata:
        df = df.withColumn("shard", F.explode(F.lit(sorted(automata)).cast("array<int>")))
    else:
        df = df.withColumn("shard", F.lit(next(iter(automata))))
    return scan_rows(df, keys, automata, config.nocase)


def _chunked(df, keys, rows, config):
    return _divided(dealt(df), keys, rows, config, _threads(df, config))


def _dynamic(df, keys, rows, config):
    per = config.tasks_per_thread or int(os.environ.get(TASKS_ENV, 0)) or 4
    return _divided(dealt(df), keys, rows, config, _threads(df, config) * per)


def _sharded(df, keys, rows, config):
    return _divided(dealt(df), keys, rows, config, 1, max(1, min(_threads(df, config), len(rows))))


def _two_d(df, keys, rows, config):
    k, n = chunks.two_d(_threads(df, config), len(rows), config.shards or int(os.environ.get(SHARDS_ENV, 2)))
    return _divided(dealt(df), keys, rows, config, n, k)


def _weighted(df, keys, rows, config):
    """Chunks in proportion to weights, in steps of 64 bytes; the last takes the rest."""
    weights = list(config.weights) or [1.0] * _threads(df, config)
    automaton = shared(df.sparkSession, rows)
    halo, total = automaton.value.halo, sum(weights)
    df = dealt(df).withColumn("n_", F.octet_length("body").cast("long"))
    # Range ends follow one another, so they are columns built by a loop over the weights, of which there are few.
    ends, at = [], F.lit(0).cast("long")
    for k, w in enumerate(weights):
        size = F.greatest(F.lit(64), F.ceil(F.floor(F.col("n_") * F.lit(w / total)) / 64) * 64)
        end = F.col("n_") if k == len(weights) - 1 else F.least(F.col("n_"), at + size)
        ends.append(F.struct(at.cast("long").alias("a"), end.cast("long").alias("b")))
        at = end
    df = df.withColumn("r_", F.explode(F.array(*ends))).filter("r_.a < r_.b")
    df = df.withColumn("s_", F.greatest(F.lit(0).cast("long"), F.col("r_.a") - halo))
    piece = F.expr("substring(body, cast(s_ + 1 as int), cast(r_.b - s_ as int))")
    df = df.select(*keys, piece.alias("body"), F.col("s_").alias("at"), F.col("r_.a").alias("core"), F.lit(0).alias("shard"))
    return scan_rows(df, keys, {0: automaton}, config.nocase)


register("sequential_flat")(lambda df, keys, rows, config: _whole(df.coalesce(1), keys, rows, config))
for _name in ("pthread_chunked", "pthread_chunked_v2", "pthread_chunked_flat", "pthread_prefetch"):
    register(_name)(_chunked)
for _name in ("pthread_chunked_v3", "pthread_chunked_v3_flat"):
    register(_name)(_weighted)
for _name in ("pthread_dynamic", "pthread_dynamic_flat"):
    register(_name)(_dynamic)
register("pattern_sharded_prefix")(_sharded)
register("pthread_2d_sharded_chunked")(_two_d)


def corpus_offsets(df: DataFrame, key: str) -> DataFrame:
    """df(key, body) with base, the number of bytes before the row in order of key.

    Rows are dealt by ranges of the key; sums of the ranges are added up, one row per range, and then inside each.
    """
    from pyspark.sql import Window

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sized = df.select(key, F.octet_length("body").cast("long").alias("n_")).repartitionByRange(n, key).withColumn("part_", F.spark_partition_id())
    sums = sized.groupBy("part_").agg(F.sum("n_").alias("all_"))
    before = F.coalesce(F.sum("all_").over(Window.partitionBy(F.lit(0)).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("n_").over(Window.partitionBy("part_").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sized.withColumn("inside_", inside).join(sums.withColumn("before_", before).drop("all_"), "part_")
    return df.join(placed.select(F.col(key), (F.col("before_") + F.col("inside_")).alias("base")), key)


def match_corpus(df: DataFrame, patterns: DataFrame, key: str, text: str = "text", chunk_bytes: int = 4 << 20, nocase: bool = False) -> DataFrame:
    """Matches with all rows, in order of a unique key, as one text: end_pos in that text, pattern_id.

    Rows are cut at chunk borders and sent to every chunk whose bytes or halo they hold; each chunk is put together and
    scanned in one task, so its size is bounded whatever the rows' sizes.
    """
    rows = dictionary(patterns, nocase)
    automaton = shared(df.sparkSession, rows)
    halo = automaton.value.halo
    df = corpus_offsets(bodies(df, [key], text), key).withColumn("end_", F.col("base") + F.octet_length("body")).filter("end_ > base")
    first, last = F.expr(f"base div {chunk_bytes}"), F.expr(f"(end_ - 1 + {halo}) div {chunk_bytes}")
    df = df.withColumn("chunk", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("base"), F.col("chunk") * chunk_bytes - halo)
    high = F.least(F.col("end_"), (F.col("chunk") + 1) * chunk_bytes)
    df = df.withColumn("low_", low).withColumn("high_", high).filter("low_ < high_")
    df = df.select("chunk", F.col("low_").alias("at"), F.expr("substring(body, cast(low_ - base + 1 as int), cast(high_ - low_ as int))").alias("body"))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("at")
        text = b"".join(group.column("body").to_pylist())
        core = group.column("chunk")[0].as_py() * chunk_bytes
        begin = group.column("at")[0].as_py()
        parts = [(end + begin, pid) for _, end, pid in scan_texts(automaton.value, pa.array([text], pa.large_binary()), nocase)]
        ends = np.concatenate([np.zeros(0, np.int64), *(e for e, _ in parts)])
        pids = np.concatenate([np.zeros(0, np.int32), *(p for _, p in parts)])
        keep = ends >= core
        return pa.table({"end_pos": ends[keep], "pattern_id": pa.array(pids[keep], pa.int32())})

    return df.groupBy("chunk").applyInArrow(run, "end_pos long, pattern_id int")
