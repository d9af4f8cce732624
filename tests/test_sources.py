import pytest
from pyspark.sql import functions as F

from matchloom.operators import analytics, results, synth
from matchloom.plans import chunks
from matchloom.sources import corpus, patterns, runlog


def test_pattern_files(spark, tmp_path):
    (tmp_path / "p.txt").write_bytes(b"# c\nab\r\n\n\xff\x00z\n #k\nlast")
    rows = patterns.load(patterns.read_lines(spark, str(tmp_path / "p.txt"))).collect()
    assert [(r[0], bytes(r[1]), r[2]) for r in rows] == [(0, b"ab", 2), (1, b"\xff\x00z", 3), (2, b" #k", 3), (3, b"last", 4)]


def test_escapes_round_trip(spark):
    own = spark.createDataFrame([(0, bytearray(b"a\xff\x01b"))], "pattern_id int, pattern binary")
    line = patterns.to_lines(own)
    assert line.first()[1] == "a\\xff\\x01b"
    back = patterns.read_escapes(line.selectExpr("pattern_id", "cast(line as binary) pattern"))
    assert bytes(back.first()[1]) == b"a\xff\x01b"


def test_ranges(spark, tmp_path):
    (tmp_path / "c").write_bytes(bytes(range(250)))
    rows = corpus.read_ranges(spark, str(tmp_path / "c"), 100).orderBy("part").collect()
    assert b"".join(bytes(r[1]) for r in rows) == bytes(range(250)) and [r[0] for r in rows] == [0, 1, 2]
    assert len(corpus.read_files(spark, str(tmp_path / "c"), cap=10).first()[1]) == 10


def test_missing_table(spark, tmp_path):
    assert runlog.load_table(spark, str(tmp_path), "runs", "phase string").isEmpty()


def test_injection():
    data = synth.inject(b"." * 500, [b"needle", b"pin"], 9)
    assert len(data) == 500 and data == synth.inject(b"." * 500, [b"needle", b"pin"], 9) and data != b"." * 500
    assert 95 <= synth.tune(lambda n: n / 1000, 0.1) <= 105


def test_rule_files(spark, tmp_path):
    """Several files in the order given, bytes that are no UTF-8, line ends of every kind."""
    (tmp_path / "b.rules").write_bytes(b'alert (content:"caf\xff"; content:"abcd\\"efgh"; NOCASE;)\r\n\t# no\r\n')
    (tmp_path / "a.rules").write_bytes(b"drop (Content:!'later'; content:\"abcd\";)")
    lines = patterns.read_rules(spark, [str(tmp_path / "b.rules"), str(tmp_path / "a.rules")])
    assert [r["line"][:5] for r in lines.orderBy("line_no").collect()] == ["alert", "\t# no", "drop "] and lines.select("file").distinct().count() == 2
    found = patterns.extract_rules(lines)
    rows = [(bytes(r["pattern"]), r["nocase"], r["negated"]) for r in found.orderBy("seq").collect()]
    assert rows == [(b"caf\xfd", True, False), (b'abcd\\"efgh', True, False), (b"later", False, True), (b"abcd", False, False)]
    twice = lines.unionByName(lines.withColumn("line_no", F.col("line_no") + 10**15))
    assert tuple(patterns.rule_stats(twice, patterns.extract_rules(twice)).first()) == (4, 4, 0, 4, 0)
    assert patterns.rule_dictionary(patterns.extract_rules(twice, most=4)).count() == 3


def test_wiki_lines(spark, tmp_path):
    dump = "<page>\n<text xml:space='preserve'>One <b>short</b> story &amp; more\nin &#169; two lines\nends here</text>\n</page>\n<page><text a=1>all on one line of text</text>\n<x>goes on</x>\nto </text> here</page>"
    rows = corpus.wiki_text(spark.createDataFrame([("d", dump), ("n", None)], "path string, value string")).collect()
    assert [(r["block_no"], " ".join(r["text"].split())) for r in rows] == [(0, "One short story more in two lines ends here"), (1, "all on one line of text goes on to")]
    (tmp_path / "dump.xml").write_text("".join(f"<page>\n<text >Page number {k} with some words\n</text>\n</page>\n" for k in range(50)))
    parts = corpus.wiki_text(corpus.read_wiki(spark, str(tmp_path / "dump.xml")))
    assert sorted(r["text"] for r in parts.collect()) == sorted(f"Page number {k} with some words" for k in range(50))


def test_runs_on_disk(spark, tmp_path):
    """Tables are saved as one and replaced as one; CSV and logs are found again."""
    runs = spark.createDataFrame([("A", "p", "c", "sequential", "1", None, "/x.log", 5, 1.5)], "phase string, patterns string, corpus string, searcher string, threads_label string, tag string, log_file string, bytes long, mbps double")
    workers = spark.createDataFrame([(1,)], "worker_id long")
    place = str(tmp_path / "r1" / "tables")
    for _ in range(2):
        runlog.save(runs, workers, place)
    assert runlog.load_table(spark, place, "runs", "phase string").count() == 1 and not list((tmp_path / "r1").glob("*.new-*"))
    (tmp_path / "r_2" / "tables").mkdir(parents=True)
    assert runlog.discover(str(tmp_path), "tables", {"r_2": "Second"}) == [("r_2", str(tmp_path / "r_2" / "tables"), "Second"), ("r1", place, "r1")]
    full = runs.select("*", *[F.lit(None).cast("long").alias(c) for c in runlog.INTS if c != "bytes"], *[F.lit(None).cast("double").alias(c) for c in runlog.REALS if c != "mbps"], F.lit(None).cast("long").alias("build_threads"))
    runlog.write_csv(full, str(tmp_path / "csv"))
    back = runlog.read_csv(spark, str(tmp_path / "csv")).first()
    assert (back["bytes"], back["mbps"], back["tag"], back["build_threads"]) == (5, 1.5, None, None)
    (tmp_path / "a.log").write_text("x")
    assert runlog.resolve_log(str(tmp_path / "runs.csv"), "a.log") == str(tmp_path / "a.log") and runlog.resolve_log("x.csv", "none.log") is None and runlog.resolve_log("x.csv", None) is None


def test_baselines_and_verdicts(spark):
    rows = spark.createDataFrame([("r", "p", "c", "sequential", 1, 2.0), ("r", "p", "c", "pthread_chunked", 4, 6.0)], "run_id string, patterns string, corpus string, searcher string, thr int, mbps double")
    summary = analytics.replicate_summary(rows, ["run_id", "patterns", "corpus", "searcher", "thr"], "mbps")
    own = summary.filter("thr = 4")
    assert "seq_median" not in analytics.speedup_from_median(own).columns
    assert analytics.speedup_from_median(own, baseline=summary).first()["speedup_median"] == 3.0
    assert [analytics.verdict(*x) for x in ((False, 0, 0.0), (True, 1, 0.0), (True, 0, 0.2), (True, 0, 0.01))] == ["invalid", "invalid", "noisy", "valid"]


def test_plans_and_files(spark, tmp_path):
    assert chunks.balanced_slices(10, 3) == [(0, 3), (3, 6), (6, 10)]
    assert chunks.falls_back(100, 1, 2) and chunks.falls_back(10, 4, 5) and not chunks.falls_back(10_000, 4, 5)
    files = spark.createDataFrame([("b", bytearray(b"2")), ("a", bytearray(b"1"))], "path string, body binary")
    assert [(r["part"], bytes(r["body"])) for r in corpus.join_files(files).orderBy("part").collect()] == [(0, b"1"), (1, b"2")]
    assert results.merge(files, files).count() == 4
    synth.parity((1, 2), (1, 2))
    with pytest.raises(ValueError):
        synth.parity((1, 2), (1, 3))
