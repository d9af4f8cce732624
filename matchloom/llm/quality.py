"""Quality rules: divergence of a document's character classes and common words from its language's reference.

Everything is built from DataFrame functions. One pass over the texts makes a narrow row of counts per document; the
references are sums of those rows over all documents of a language, so the texts are read once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, words

#: Frequent words of four languages, each in lower case; the last bin of the histogram is every other word.
COMMON_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "it", "for", "was",
    "le", "la", "les", "de", "des", "et", "un", "une", "du", "que",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "ist", "ein",
    "el", "los", "las", "y", "por", "con", "para", "se", "su", "al",
)
#: Classes of non-space characters, taken off one after the other; what is left is the last class.
CLASSES = (("lower", "[a-z]+"), ("upper", "[A-Z]+"), ("digit", "[0-9]+"), ("point", r"[.,;:'\"?()-]+"), ("letter", r"\p{L}+"))
MOST_BROADCAST = 4096  # languages with a reference, of under 1 kB each, that are broadcast; more are joined with salt
SALT = 64
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class QualityConfig:
    """Limits of the verdict. A divergence counts only where the document has enough characters or words for it.

    max_class and max_words bound the Jensen-Shannon distances (0 to 1) of the two histograms; a document beyond
    max_words goes only if its share of common words, of whatever language, is beyond max_share too, so that text of
    several languages stays; min_chars and min_words
    are the guards below which a histogram says nothing. min_reference is the number of words a language's reference
    needs; a document of a language without one is compared with the reference over all languages.
    """

    min_chars: int = 200
    min_words: int = 120
    max_class: float = 0.3
    max_words: float = 0.2
    max_share: float = 0.15
    min_reference: int = 2000


def features(docs: DataFrame) -> DataFrame:
    """Counts per row of docs(doc_id, text, lang): the base features and the two histograms."""
    text = F.coalesce("text", F.lit(""))
    df = docs.select("doc_id", F.col("lang").alias("lang_"), words(F.col("text")).alias("w_"), F.split(text, "\n").alias("l_"), (F.length(text) - F.length(F.regexp_replace(text, rf"[{SYMBOLS}]+", ""))).alias("n_symbols"))
    n = F.size("w_")
    at = lambda i: F.get("w_", i)
    df = df.select(
        "doc_id", "lang_", "n_symbols", n.cast("long").alias("n_words"), F.array_join("w_", "").alias("r0_"),
        F.filter("l_", lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("l_"),
        F.filter("w_", lambda x: x.isin(*COMMON_WORDS)).alias("f_"),
        F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)))).otherwise(F.array().cast("array<long>")).alias("h_"),
    )
    for k, (_, pattern) in enumerate(CLASSES):
        df = df.withColumn(f"r{k + 1}_", F.regexp_replace(f"r{k}_", pattern, ""))
    left = [F.length(f"r{k}_") for k in range(len(CLASSES) + 1)]
    df = df.select(
        "doc_id", "lang_", "n_words", left[0].cast("long").alias("word_chars"), F.col("n_symbols").cast("long"),
        (F.size("l_") - F.size(F.array_distinct("l_"))).cast("long").alias("n_dup_lines"),
        F.array(*[(a - b).cast("double") for a, b in zip(left, left[1:])], left[-1].cast("double")).alias("class_hist"),
        F.array(*[(F.size("f_") - F.size(F.array_remove("f_", w))).cast("double") for w in COMMON_WORDS], (F.col("n_words") - F.size("f_")).cast("double")).alias("word_hist"),
        F.when(F.size(F.array_distinct("h_")) < F.size("h_"), F.sort_array(F.transform("h_", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).otherwise(F.array().cast("array<struct<x:bigint,i:int>>")).alias("s_"),
    )
    m = F.size("s_")
    hash_at = lambda j: F.get("s_", j)["x"]
    twice = F.when(m > 0, F.filter(F.transform("s_", lambda s, j: F.when((hash_at(j - 1) == s["x"]) | (hash_at(j + 1) == s["x"]), s["i"])), lambda x: x.isNotNull())).otherwise(F.array().cast("array<int>"))
    covered = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda i: F.array(i, i + 1, i + 2)))))
    return df.select("doc_id", "lang_", "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.cast("long").alias("n_repeat_words"), "class_hist", "word_hist")


def js_distance(p: Column, q: Column, p_sum: Column | None = None, q_sum: Column | None = None) -> Column:
    """Jensen-Shannon distance, base 2, of two count arrays of equal length; null where one has no counts.

    The sums of the counts should be given as columns where they are known: here they would be added up for each bin.
    """
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    tp, tq = total(p) if p_sum is None else p_sum, total(q) if q_sum is None else q_sum
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    part = lambda a, b: term(a, (a + b) / 2) + term(b, (a + b) / 2)
    parts = F.zip_with(p, q, lambda a, b: part(a / tp, b / tq))
    return F.when((tp > 0) & (tq > 0), F.sqrt(F.greatest(F.lit(0.0), total(parts) / 2)))


def references(rows: DataFrame, config: QualityConfig) -> tuple[DataFrame, DataFrame]:
    """Summed histograms over all rows that pass the base rules: one row of all languages, and one per language.

    A language with fewer words than config.min_reference has no row of its own.
    """
    sums = lambda name, size: [F.sum(F.col(name)[i]).alias(f"{name}{i}") for i in range(size)]
    sizes = {"class_hist": len(CLASSES) + 1, "word_hist": len(COMMON_WORDS) + 1}
    by = rows.filter(~F.col("base_failed")).groupBy("lang_").agg(F.sum("n_words").alias("n_"), *[c for name, size in sizes.items() for c in sums(name, size)])
    by = by.select("lang_", "n_", *[F.array(*[f"{name}{i}" for i in range(size)]).alias(name) for name, size in sizes.items()])
    whole = by.agg(*[F.array(*[F.sum(F.col(name)[i]) for i in range(size)]).alias(name) for name, size in sizes.items()])
    total = lambda name: F.aggregate(name, F.lit(0.0), lambda s, x: s + x)
    named = lambda of: [c for name in sizes for c in (F.col(name).alias(f"{of}_{name}"), total(name).alias(f"{of}_{name}_sum"))]
    return whole.select(*named("all")), by.filter((F.col("n_") >= config.min_reference) & F.col("lang_").isNotNull()).select("lang_", *named("ref"))


def judge(docs: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """Quality verdict of every row of docs(doc_id, text, lang, ...).

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, kept (boolean),
    class_distance, word_distance, share_distance (double; null where the guard holds it back or there is no reference). A null text is
    an empty one and fails the base rules; repeated rows are judged one by one; an empty table gives an empty result;
    a document is compared with its language's reference and with that over all languages, of which the nearer one
    counts (text of several languages is near the second); a null or rare lang has the second only. Other columns of docs
    are not read.
    """
    rows = features(docs.select("doc_id", "text", "lang"))
    rows = rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    rows = cut(rows)
    whole, by_lang = references(rows, config)
    by_lang = cut(by_lang)
    if by_lang.count() <= MOST_BROADCAST:
        rows = rows.join(F.broadcast(by_lang), "lang_", "left")
    else:
        salted = by_lang.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        rows = rows.withColumn("salt_", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int")).join(salted, ["lang_", "salt_"], "left")
    rows = rows.join(F.broadcast(whole))  # a single row
    for name, n, least in (("class", F.col("word_chars"), config.min_chars), ("word", F.col("n_words"), config.min_words)):
        distances = [js_distance(F.col(f"{name}_hist"), F.col(f"{of}_{name}_hist"), n, F.col(f"{of}_{name}_hist_sum")) for of in ("ref", "all")]
        rows = rows.withColumn(f"{name}_distance", F.when(n >= least, F.least(*distances)))  # nulls do not count
    common = lambda c: F.array(F.aggregate(F.slice(c, 1, len(COMMON_WORDS)), F.lit(0.0), lambda s, x: s + x), F.element_at(c, -1))
    own, ref = common(F.col("word_hist")), common(F.coalesce("ref_word_hist", "all_word_hist"))
    rows = rows.withColumn("share_distance", F.when(F.col("n_words") >= config.min_words, js_distance(own, ref, F.col("n_words"), F.coalesce("ref_word_hist_sum", "all_word_hist_sum"))))
    kept = ~F.col("base_failed") & (F.coalesce("class_distance", F.lit(0.0)) <= config.max_class) & ((F.coalesce("word_distance", F.lit(0.0)) <= config.max_words) | (F.coalesce("share_distance", F.lit(0.0)) <= config.max_share))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "class_distance", "word_distance", "share_distance")
