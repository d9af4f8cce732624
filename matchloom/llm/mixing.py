"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

A source's target is min(cap, level * weight); the level follows from the sources sorted by cap/weight. A source's
documents are laid out in a seeded order; the mix takes every document floor(target / size) times whole, and once more
the first so many words of the layout as the target still lacks, so it meets the target to a word. The running sum
behind that is taken over hash buckets first and inside each bucket next, so that a source with a third of all rows is
spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, words

BUCKET_HEX = 3  # 4096 buckets a source


def water_fill(sources: DataFrame, total: Column, max_epochs: float) -> DataFrame:
    """sources(source, source_size, weight) with target: total shared by weight, none above max_epochs * source_size.

    If total is more than all caps together, every source gets its cap. Runs over one row per source.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    every = Window.partitionBy(F.lit(0))
    order = every.orderBy("ratio_", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    df = sources.withColumn("cap_", cap).withColumn("total_", total).withColumn("ratio_", F.col("cap_") / F.col("weight"))
    df = df.withColumn("level_", (F.col("total_") - F.coalesce(F.sum("cap_").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # The level is the one of the first source, in this order, that it does not lift above its cap.
    df = df.withColumn("found_", F.min(F.when(F.col("level_") <= F.col("ratio_"), F.struct("ratio_", F.col("source").isNull(), "source", "level_"))).over(every)["level_"])
    return df.withColumn("target", F.when(F.col("found_").isNull(), F.col("cap_")).otherwise(F.least("cap_", F.col("found_") * F.col("weight")))).select("source", "source_size", "target")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, max_epochs: float = 2.0, seed: int = 7) -> DataFrame:
    """How many words of every row of docs(doc_id, text, source, ...) a mix takes.

    Sources in order of code points, null last, have the given weights, over and over. Returns doc_id, source, size,
    source_size, target, whole (times the document is taken whole), rest (words of one more repetition, below size) and
    taken = whole * size + rest. A null text has size 0 and is taken with 0 words; a null source is a source like any
    other; rows repeated in full are taken one by one; an empty table gives an empty result.
    """
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(str(seed))))
    df = docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), key.alias("key_"))
    df = df.withColumn("bucket_", F.substring("key_", 1, BUCKET_HEX)).select("*", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("s_"))
    df = cut(df)  # narrow rows: texts are read and cut into words once
    buckets = df.groupBy("s_", "bucket_").agg(F.sum("size").alias("bucket_size"), F.first("source").alias("source"))
    buckets = buckets.withColumn("start_", F.coalesce(F.sum("bucket_size").over(Window.partitionBy("s_").orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sources = buckets.groupBy("s_").agg(F.sum("bucket_size").alias("source_size"), F.first("source").alias("source"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    sources = sources.select("source", "source_size", weight.alias("weight"))
    every = Window.partitionBy(F.lit(0))
    filled = water_fill(sources.withColumn("all_", F.sum("source_size").over(every)), F.col("all_") * F.lit(float(share)), max_epochs)
    filled = filled.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("s_"), "source_size", "target")
    starts = buckets.join(filled, "s_").select("s_", "bucket_", "start_", "source_size", "target")
    inside = Window.partitionBy("s_", "bucket_").orderBy("key_", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("inside_", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, ["s_", "bucket_"])
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    df = df.withColumn("whole", whole).withColumn("more_", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    rest = F.greatest(F.lit(0).cast("long"), F.least("size", F.col("more_") - F.col("start_") - F.col("inside_")))
    df = df.withColumn("rest", rest)
    return df.select("doc_id", "source", "size", "source_size", "target", "whole", "rest", (F.col("whole") * F.col("size") + F.col("rest")).alias("taken"))


def repeat_rows(docs: DataFrame, uncut: bool = False, **how) -> DataFrame:
    """The rows of docs as mix(docs, **how) takes them: whole repetitions, and of a rest below the size its first words.

    With uncut such a document is taken whole once more if the rest is half of it or more, else not: no text is cut, and
    a source misses its target by at most half a document.
    Columns and their order stay; n_chars, if there, follows the text. Rows repeated in full are taken as often as mix()
    takes all of them together.
    """
    columns = [c for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()]
    key = F.struct("doc_id", F.xxhash64(*columns))
    mixed = mix(docs.select(key.alias("doc_id"), "text", "source"), **how).filter("taken > 0")
    counts = mixed.groupBy(F.col("doc_id").alias("key_")).agg(F.max("size").alias("size_"), F.sum("whole").alias("whole_"), F.sum("rest").alias("rest_"))
    counts = counts.withColumn("whole_", F.col("whole_") + F.expr("rest_ div size_")).withColumn("rest_", F.col("rest_") % F.col("size_"))
    if uncut:
        counts = counts.withColumn("rest_", F.when(2 * F.col("rest_") >= F.col("size_"), F.col("size_")).otherwise(F.lit(0).cast("long")))
    rows = docs.select(F.struct(*docs.columns).alias("row_"), key.alias("key_")).groupBy("key_").agg(F.first("row_").alias("row_"))  # equal rows are one before they are shuffled
    df = rows.join(counts, "key_")
    times = F.concat(F.array_repeat("size_", F.col("whole_").cast("int")), F.when(F.col("rest_") > 0, F.array("rest_")).otherwise(F.array().cast("array<bigint>")))
    df = df.select("row_", "size_", F.explode(times).alias("take_"))
    less = F.col("take_") < F.col("size_")
    text = F.when(less, F.array_join(F.slice(words(F.col("row_")["text"]), 1, F.col("take_").cast("int")), " ")).otherwise(F.col("row_")["text"])
    own = {"text": text}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(less, F.length(text)).otherwise(F.col("row_")["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return df.select(*[own.get(c, F.col("row_")[c]).alias(c) for c in docs.columns])
