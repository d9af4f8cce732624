"""Secret scans by a trigram inverted index, with DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived: a conjunction of clauses, each a choice of
trigram lists of which a match must hold one. The index is a table of postings (trigram, document) over the trigrams that
the queries name. Queries are joined to it by trigram, and a document's postings are intersected: a list counts if all its
trigrams are there, a clause if one of its lists does, a rule if all its clauses do. Documents come back as candidates
with their rules, and the expressions verify just those. A rule without mandatory trigrams is scanned in full.

Postings are partitioned by document, so that a trigram of a third of all documents is no hot key.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

MOST = 64  # strings a clause may have before it is dropped as too wide to narrow anything
MOST_BROADCAST = 500_000  # candidates, of some 50 bytes each, that are broadcast; more are joined by shuffle


@dataclass(frozen=True)
class Rule:
    """A kind of secret: pattern is read by Java's and Python's engines alike; group (0: the match) needs least characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (Rule("assign", ASSIGN, 2, 8), Rule("access", "AKIA[A-Z0-9]+", 0, 16), Rule("hex", "[0-9a-f]+", 0, 32))
#: What the method adds: public formats of tokens that the base kinds do not know. A scheme is looked for at the start of
#: a run of letters only, where its leftmost match begins anyway, and a web token at the start of a run of its characters;
#: from every letter a long run would take quadratic time.
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 24),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("url_password", r"(?<![a-z])[a-z]+://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/@]+@"),
)
RULES = BASE + ADDED


def _strings(tree, ignore: bool):
    """(exact, clauses) of a parsed expression: exact is the set of all strings it matches, lower case, or None."""
    clauses: list[frozenset[str]] = []
    exact: set[str] | None = {""}

    def close():
        nonlocal exact
        if exact:
            clauses.append(frozenset(exact))
        exact = {""}

    whole = True
    for op, arg in tree:
        if op is sre.LITERAL:
            own, more = {chr(arg).lower()}, []
        elif op is sre.IN and not any(o is sre.NEGATE for o, _ in arg) and all(o in (sre.LITERAL, sre.RANGE) for o, _ in arg):
            own = {chr(c).lower() for o, a in arg for c in ([a] if o is sre.LITERAL else range(a[0], a[1] + 1))} if sum(1 if o is sre.LITERAL else a[1] - a[0] + 1 for o, a in arg) <= 8 else None
            more = []
        elif op is sre.SUBPATTERN:
            own, more = _strings(arg[3], ignore)
        elif op is sre.BRANCH:
            parts = [_strings(x, ignore) for x in arg[1]]
            if all(e is not None for e, _ in parts):
                own, more = set().union(*(e for e, _ in parts)), []
            else:  # each branch's best clause together make one
                own, best = None, [max(c, key=lambda s: min(map(len, s)), default=None) if e is None else frozenset(e) for e, c in parts]
                more = [frozenset().union(*best)] if all(best) else []
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, inner = arg
            e, more = _strings(inner, ignore)
            if (low, high) == (0, 1) and e is not None:
                own, more = e | {""}, []
            else:
                own = e if (low, high) == (1, 1) else None
                more = [] if low == 0 else (more if e is None else [frozenset(e)])
        elif op is sre.AT:
            own, more = {""}, []
        else:
            own, more = None, []
        if own is not None and len(exact) * len(own) <= MOST:
            exact = {a + b for a in exact for b in own}
        else:
            close()
            whole = False
            clauses += more
            if own is not None:
                exact = set(own)
    if whole:
        return exact, []
    close()
    return None, clauses


def trigram_query(pattern: str) -> list[list[list[str]]]:
    """Conjunction of disjunctions of trigram lists: a text that matches holds, for each clause, all trigrams of one list.

    Trigrams are of the text with A-Z in lower case. An empty query means that the expression has no mandatory trigram.
    """
    tree = sre_parse.parse(pattern)
    exact, clauses = _strings(tree, False)
    if exact is not None:
        clauses = [frozenset(exact)]
    found = []
    for clause in clauses:
        if clause and all(len(s) >= 3 and s.isascii() for s in clause):
            lists = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in clause}
            found.append(sorted(sorted(x) for x in lists if not any(y < x for y in lists)))
    return found


def running(values: str, zero: Column, add) -> Column:
    """For each value of an array column what add makes of zero and those before it.

    The array is cut in about as many blocks as a block has values, so that no array grows by one n times. It has to be a
    column: an expression would be computed again for each block.
    """
    size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(values)))).cast("int")
    starts = F.when(F.size(values) > 0, F.sequence(F.lit(1), F.size(values), size)).otherwise(F.array().cast("array<int>"))
    step = lambda s, x: F.struct(add(s["sum"], x).alias("sum"), F.concat(s["out"], F.array(s["sum"])).alias("out"))
    begin = F.struct(zero.alias("sum"), F.slice(F.array(zero), 1, 0).alias("out"))
    blocks = F.transform(starts, lambda i: F.aggregate(F.slice(values, i, size), begin, step))
    before = F.aggregate(blocks, begin, lambda s, x: step(s, x["sum"]))["out"]
    return F.flatten(F.zip_with(blocks, before, lambda x, b: F.transform(x["out"], lambda v: add(b, v))))


def _spans(rows: DataFrame, text: Column, rules: dict[int, Rule]) -> DataFrame:
    """rows with s{k}_, array<struct<start, end>>, for each rule k: its matches where m{k}_ holds.

    Matches are the leftmost non-overlapping ones that are long enough, in code points.
    """
    sizes = lambda c: F.transform(c, lambda x: F.length(x))
    # split() and regexp_extract_all() find the same matches: what lies between them and the matches take turns.
    def cols(name, make):
        return {f"{name}{k}_": F.when(F.col(f"m{k}_"), make(k, rule)) for k, rule in rules.items()}

    rows = rows.withColumns(cols("g", lambda k, r: sizes(F.split(text, r.pattern, -1))) | cols("l", lambda k, r: sizes(F.regexp_extract_all(text, F.lit(r.pattern), F.lit(0)))) | {f"o{k}_": F.when(F.col(f"m{k}_"), sizes(F.regexp_extract_all(text, F.lit(r.pattern), F.lit(r.group)))) for k, r in rules.items() if r.group})
    rows = rows.withColumns(cols("v", lambda k, r: F.zip_with(F.slice(f"g{k}_", 1, F.size(f"l{k}_")), f"l{k}_", lambda a, b: a + b)))
    rows = rows.withColumns(cols("e", lambda k, r: running(f"v{k}_", F.lit(0), lambda a, b: a + b)))
    span = lambda x: F.struct((x["at"] + x["gap"]).alias("start"), (x["at"] + x["gap"] + x["len"]).alias("end"))

    def spans(k, r):
        steps = F.arrays_zip(F.slice(f"g{k}_", 1, F.size(f"l{k}_")).alias("gap"), F.col(f"l{k}_").alias("len"), F.col(f"o{k}_" if r.group else f"l{k}_").alias("own"), F.col(f"e{k}_").alias("at"))
        return F.transform(F.filter(steps, lambda x: x["own"] >= r.least), span)

    rows = rows.withColumns({c: F.coalesce(x, F.array().cast("array<struct<start:int,end:int>>")) for c, x in cols("s", spans).items()})
    return rows.drop(*[f"{c}{k}_" for k in rules for c in "glove"])


def _scanned(rule: Rule) -> Rule:
    """The rule, if possible with its least length in the expression: X+ of a class has the same maximal runs as X{n,}."""
    if rule.group == 0 and re.fullmatch(r"\[[^\]^]+\]\+", rule.pattern):
        return Rule(rule.kind, f"{rule.pattern[:-1]}{{{rule.least},}}", 0, rule.least)
    return rule


def queries(spark: SparkSession, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """rank, clause, list, gram, grams (in the list), clauses (of the rule): the rules' trigram queries, a row per trigram."""
    rows = []
    for rank, rule in enumerate(rules):
        query = trigram_query(rule.pattern)
        rows += [(rank, c, k, gram, len(grams), len(query)) for c, clause in enumerate(query) for k, grams in enumerate(clause) for gram in grams]
    names = ("rank", "clause", "list", "gram", "grams", "clauses")
    row = [F.struct(*[F.lit(x).alias(n) for n, x in zip(names, r)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*row))) if row else spark.createDataFrame([], "rank int, clause int, list int, gram string, grams int, clauses int")


def postings(keyed: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """gram, key_ of keyed(key_, text_): the inverted index over the trigrams of the rules' queries (A-Z in lower case)."""
    vocabulary = sorted({t for r in rules for c in trigram_query(r.pattern) for s in c for t in s})
    low = keyed.select("key_", F.lower("text_").alias("low_"))
    grams = F.array(*[F.when(F.contains("low_", F.lit(t)), F.lit(t)) for t in vocabulary], F.lit(None).cast("string"))
    # Of explode() Spark would infer a filter that looks for every trigram, in the text lower-cased anew, once more.
    return low.select("key_", F.explode_outer(grams).alias("gram")).filter("gram is not null")


def candidates(index: DataFrame, asked: DataFrame) -> DataFrame:
    """key_, ranks of the documents whose postings in index(gram, key_) satisfy the query of a rule: its rank."""
    met = index.repartition("key_").join(F.broadcast(asked), "gram")  # asked has a row for each trigram of the rules
    lists = met.groupBy("key_", "rank", "clause", "list").agg(F.size(F.collect_set("gram")).alias("n_"), F.first("grams").alias("grams"), F.first("clauses").alias("clauses")).filter("n_ = grams")
    held = lists.groupBy("key_", "rank").agg(F.size(F.collect_set("clause")).alias("n_"), F.first("clauses").alias("clauses")).filter("n_ = clauses")
    return held.groupBy("key_").agg(F.collect_set("rank").alias("ranks_"))


def _tagged(rank: int, rule: Rule):
    return lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), x["end"].alias("end"))


def _found(docs: DataFrame, rules: tuple[Rule, ...], most_broadcast: int) -> DataFrame:
    """row_ (all columns of docs, which has a text) and found."""
    hashed = [c for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()]
    text = F.coalesce(F.col("row_")["text"], F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("row_"), F.xxhash64(*hashed).alias("key_"))  # equal keys of different rows only add candidates
    may = cut(candidates(postings(rows.select("key_", text.alias("text_")), rules), queries(docs.sparkSession, rules)))
    rows = rows.join(F.broadcast(may) if may.count() <= most_broadcast else may, "key_", "left")
    own = {k: _scanned(rule) for k, rule in enumerate(rules)}
    for k, rule in enumerate(rules):
        holds = text.rlike(own[k].pattern)
        rows = rows.withColumn(f"m{k}_", F.when(F.array_contains("ranks_", k), holds).otherwise(False) if trigram_query(rule.pattern) else holds)
    rows = _spans(rows, text, own)
    return rows.select("row_", F.sort_array(F.concat(*[F.transform(f"s{k}_", _tagged(k, rule)) for k, rule in enumerate(rules)])).alias("found"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Spans of secrets in every row of docs(doc_id, text, ...).

    Returns doc_id and found: array<struct<start, rank, kind, end>>, sorted; start and end are code points, end
    exclusive, rank is the rule's place in rules. A null text is empty and has no spans; rows repeated in full are
    scanned one by one; an empty table gives an empty result; spans of different rules may overlap, of one they do not.
    Texts are never lower-cased beyond A-Z for what is reported; the postings use the lower-cased text. Up to
    most_broadcast candidates are broadcast, more are joined by shuffle.
    """
    return _found(docs.select("doc_id", "text"), rules, most_broadcast).select(F.col("row_")["doc_id"].alias("doc_id"), "found")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


BLOCK = 4096  # characters


def _pieces(blocks: str, cuts: str) -> Column:
    """The parts of a text between cuts, a column of array<struct<a, b>> in order: each is put together from the text's blocks.

    substring() reads a text from its start; from blocks a part takes no longer than it has characters.
    """
    block = lambda i: F.coalesce(F.get(blocks, i), F.lit(""))

    def part(x):
        a, b = x["a"], x["b"]
        i, j = F.floor(a / BLOCK).cast("int"), F.floor(b / BLOCK).cast("int")
        head, tail = F.substr(block(i), a - i * BLOCK + 1), F.substr(block(j), F.lit(1), b - j * BLOCK)
        inner = F.array_join(F.slice(blocks, i + 2, F.greatest(F.lit(0), j - i - 1)), "")
        return F.when(i == j, F.substr(block(i), a - i * BLOCK + 1, b - a)).otherwise(F.concat(head, inner, tail))

    return F.transform(cuts, part)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """docs with every match of every rule, if long enough, replaced by mark; spans that overlap or touch become one mark.

    Columns and their order stay; n_chars, if there, follows the text.
    """
    text = F.col("row_")["text"]
    df = _found(docs, rules, most_broadcast)
    some = F.size("found") > 0
    df = df.withColumn("end_", F.when(some, F.transform("found", lambda x: x["end"]))).withColumn("far_", F.when(some, running("end_", F.lit(-1), lambda a, b: F.greatest(a, b))))
    # What lies between the farthest end so far and a later start is kept.
    gaps = F.filter(F.zip_with("found", "far_", lambda x, e: F.struct(e.alias("a"), x["start"].alias("b"))), lambda g: g["b"] > g["a"])
    gaps = F.concat(F.transform(gaps, lambda g: F.struct(F.greatest(F.lit(0), g["a"]).alias("a"), g["b"].alias("b"))), F.array(F.struct(F.array_max("end_").alias("a"), F.length(text).alias("b"))))
    df = df.withColumn("gaps_", F.when(some, gaps)).withColumn("blocks_", F.when(some, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))))
    df = df.withColumn("new_", F.when(some, F.array_join(_pieces("blocks_", "gaps_"), mark)).otherwise(text))
    own = {"text": F.col("new_")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(some, F.length("new_")).otherwise(F.col("row_")["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return df.select(*[own.get(c, F.col("row_")[c]).alias(c) for c in docs.columns])
