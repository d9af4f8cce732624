"""Dictionaries: pattern files, literals of rule files, cleaning, prefixes, shards, and writing them back."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _lines(batches):
    for batch in batches:
        paths, numbers, lines = [], [], []
        for path, body in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            for k, line in enumerate((body or b"").split(b"\n")):
                paths.append(path)
                numbers.append(k + 1)
                lines.append(line)
        yield pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string()), "line_no": pa.array(numbers, pa.int64()), "line": pa.array(lines, pa.binary())})


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no (from 1), line: the bytes of each line of files that fit a task, without their line feed."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_lines, "path string, line_no long, line binary")


def read_rules(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, line_no, line of rule files, one after the other in the order given; line_no goes on from file to file.

    Bytes that are not UTF-8 become U+FFFD; CR, LF and both end a line. Each file is read by one task.
    """
    known = F.create_map(*[F.lit(x) for k, p in enumerate(paths) for x in (p.rsplit("/", 1)[-1], k)])

    def run(batches):
        for batch in batches:
            for place, body in zip(batch.column("place").to_pylist(), batch.column("content").to_pylist()):
                own = re.split("\r\n|\r|\n", (body or b"").decode("utf-8", "replace"))
                own = own[:-1] if own[-1] == "" else own
                yield pa.RecordBatch.from_pydict({"place": pa.array([place] * len(own), pa.int32()), "line_no": pa.array(range(1, len(own) + 1), pa.int64()), "line": pa.array(own, pa.string())})

    files = spark.read.format("binaryFile").load(list(paths)).select(known[F.element_at(F.split("path", "/"), -1)].alias("place"), "content")
    lines = files.mapInArrow(run, "place int, line_no long, line string")
    return lines.select(F.get(F.array(*[F.lit(p) for p in paths]), F.col("place")).alias("file"), (F.col("place").cast("long") * (1 << 40) + F.col("line_no")).alias("line_no"), "line")


def head(lines: DataFrame, n: int) -> DataFrame:
    """The first n lines, comments and blank ones included."""
    return lines.filter(F.col("line_no") <= n)


def load(lines: DataFrame) -> DataFrame:
    """pattern_id, pattern, length of lines(line_no, line BINARY).

    CR and LF at the end go; empty lines and those whose first byte is # are left out; nothing else is trimmed and no
    escape is read. Ids are dense, in order of the lines.
    """
    text = F.rtrim(F.decode("line", "ISO-8859-1"), F.lit("\r\n"))  # one character for each byte
    kept = lines.select("line_no", F.encode(text, "ISO-8859-1").alias("pattern")).filter((F.octet_length("pattern") > 0) & (F.hex(F.substring("pattern", 1, 1)) != "23"))
    one = Window.partitionBy(F.lit(0)).orderBy("line_no")  # a dictionary is compiled in one place anyway
    return kept.select((F.row_number().over(one) - 1).cast("int").alias("pattern_id"), "pattern", F.octet_length("pattern").cast("int").alias("length"))


def dedupe(rows: DataFrame, by: str = "pattern", order: str = "seq") -> DataFrame:
    """The first row, in order, of each pattern."""
    return rows.withColumn("first_", F.row_number().over(Window.partitionBy(by).orderBy(order))).filter("first_ = 1").drop("first_")


def shard(patterns: DataFrame, k: int) -> DataFrame:
    """patterns with shard: the first byte modulo k."""
    return patterns.withColumn("shard", (F.conv(F.hex(F.substring("pattern", 1, 1)), 16, 10).cast("int") % k).cast("int"))


def stats(patterns: DataFrame) -> DataFrame:
    """One row: num_patterns, max_length, min_length (0 if there are none)."""
    n = F.octet_length("pattern")
    return patterns.agg(F.count("*").alias("num_patterns"), F.coalesce(F.max(n), F.lit(0)).cast("int").alias("max_length"), F.coalesce(F.min(n), F.lit(0)).cast("int").alias("min_length"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: A content option, in letters of either case; a backslash keeps the quote after it from ending the value (fixed values: the rules' format).
_CONTENT = re.compile(r"""content\s*:\s*(!?)\s*(?:"((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)')""", re.I)
_NOCASE = re.compile(r"\bnocase\b", re.I)
_HEX_PAIR = re.compile(r"[0-9A-Fa-f]{2}")


def literal(value: str) -> bytes:
    """The bytes of a rule's value: text between bars is hexadecimal; a bad one gives nothing; backslashes are not read."""
    out, parts = bytearray(), value.split("|")
    for k, part in enumerate(parts):
        if k % 2 and k < len(parts) - 1:
            digits = "".join(part.split())
            if len(digits) % 2 == 0 and all(_HEX_PAIR.fullmatch(digits[i : i + 2]) for i in range(0, len(digits), 2)):
                out += bytes.fromhex(digits)
        elif k % 2:  # a bar that is not closed: it and what follows stand for themselves
            out += ("|" + part).encode("latin-1", "replace")
        else:
            out += bytes(ord(c) & 0xFF for c in part)
    return bytes(out)


def literals_of(line: str, nocase: bool = False, least: int = 4, most: int = 0) -> list[tuple[bytes, bool, bool, bool]]:
    """(pattern, nocase, negated, short) of each content option of a rule line.

    The line ends at its first #, even inside quotes; options stand between the first ( and the last ). nocase holds if
    the word comes within 60 characters after the value. Short literals are marked before the others are cut to most.
    """
    line = line.split("#", 1)[0]
    begin, end = line.find("("), line.rfind(")")
    if begin < 0 or end <= begin:
        return []
    body, out = line[begin + 1 : end], []
    for m in _CONTENT.finditer(body):
        raw = literal(m[2] if m[2] is not None else m[3] or "")
        own = nocase or _NOCASE.search(body, m.end(), m.end() + 60) is not None
        short = len(raw) < least
        raw = raw[:most] if most else raw
        out.append((raw.lower() if own else raw, own, bool(m[1]), short))
    return out


def extract_rules(lines: DataFrame, nocase: bool = False, least: int = 4, most: int = 0) -> DataFrame:
    """seq, pattern, nocase, negated, short for every content option of lines(line_no, line STRING), in order."""

    def run(batches):
        for batch in batches:
            rows = [(no, k, *x) for no, line in zip(batch.column("line_no").to_pylist(), batch.column("line").to_pylist()) for k, x in enumerate(literals_of(line or "", nocase, least, most))]
            cols = list(zip(*rows)) or [[]] * 6
            kinds = (("line_no", pa.int64()), ("k", pa.int32()), ("pattern", pa.binary()), ("nocase", pa.bool_()), ("negated", pa.bool_()), ("short", pa.bool_()))
            yield pa.RecordBatch.from_pydict({name: pa.array(c, kind) for (name, kind), c in zip(kinds, cols)})

    found = lines.select(F.col("line_no").cast("long").alias("line_no"), "line").mapInArrow(run, "line_no long, k int, pattern binary, nocase boolean, negated boolean, short boolean")
    seq = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("line_no", "k")) - 1
    return found.withColumn("seq", seq.cast("long")).select("seq", "pattern", "nocase", "negated", "short")


def rule_dictionary(found: DataFrame, drop_negated: bool = False, unique: bool = True) -> DataFrame:
    """pattern_id, pattern, length of extracted literals: short ones go, first occurrences stay."""
    rows = found.filter(~F.col("short") & (F.octet_length("pattern") > 0))
    rows = rows.filter(~F.col("negated")) if drop_negated else rows
    rows = dedupe(rows) if unique else rows
    return rows.select((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("seq")) - 1).cast("int").alias("pattern_id"), "pattern", F.octet_length("pattern").cast("int").alias("length"))


def rule_stats(lines: DataFrame, found: DataFrame, drop_negated: bool = False, unique: bool = True) -> DataFrame:
    """One row: rules, extracted, short, duplicates, dropped.

    rules are lines that are neither blank nor comments, indented or not; extracted are the patterns of the dictionary,
    duplicates those that it has already. dropped are literals that are too short; short counts those that are too short
    only after they are cut, which none is, so it is 0 as it always was.
    """
    rules = lines.filter(F.col("line").rlike(r"^\s*[^#\s]")).agg(F.count("*").alias("rules"))
    own = found.filter(~F.col("negated")) if drop_negated else found
    n, kinds = F.count_if(~F.col("short")), F.count_distinct(F.when(~F.col("short"), F.col("pattern")))
    kept = kinds if unique else n
    return rules.join(own.agg(kept.alias("extracted"), F.lit(0).cast("long").alias("short"), (n - kept).alias("duplicates"), F.count_if("short").alias("dropped")))


def to_lines(patterns: DataFrame) -> DataFrame:
    r"""pattern_id, line: ASCII patterns without control characters as they are, else such bytes as the four characters \xNN.

    load() does not read \xNN back; read_escapes() does.
    """
    h = F.hex("pattern")
    pairs = F.regexp_extract_all(h, F.lit("(..)"), F.lit(1))
    one = lambda x: F.when((x >= "20") & (x <= "7F"), F.decode(F.unhex(x), "US-ASCII")).otherwise(F.concat(F.lit("\\x"), F.lower(x)))
    return patterns.select("pattern_id", F.array_join(F.transform(pairs, one), "").alias("line"))


def read_escapes(patterns: DataFrame) -> DataFrame:
    r"""patterns with \xNN read as the byte; for dictionaries that to_lines() wrote."""

    def run(batches):
        for batch in batches:
            own = [re.sub(rb"\\x([0-9a-fA-F]{2})", lambda m: bytes([int(m[1], 16)]), p) for p in batch.column("pattern").to_pylist()]
            yield pa.RecordBatch.from_pydict({"pattern_id": batch.column("pattern_id"), "pattern": pa.array(own, pa.binary()), "length": pa.array([len(p) for p in own], pa.int32())})

    return patterns.select("pattern_id", "pattern").mapInArrow(run, "pattern_id int, pattern binary, length int")
