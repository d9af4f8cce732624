import pytest

from matchloom.operators import results, scan
from matchloom.streaming.scan import match_stream

WORDS = [b"he", b"she", b"his", b"hers", b"e", "é".encode(), b"\x00", b"he"]
TEXTS = [(0, "ushers and his héros " * 30), (1, ""), (2, None), (3, "he"), (4, "x\x00she"), (5, "hishers" * 200)]


def brute(key_text):
    return sorted((k, i + len(p) - 1, n) for k, t in key_text for b in [(t or "").encode()] for n, p in enumerate(WORDS) for i in range(len(b)) if b.startswith(p, i))


@pytest.fixture(scope="module")
def frames(spark):
    return spark.createDataFrame(TEXTS, "k int, text string"), spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(WORDS)], "pattern_id int, pattern binary")


@pytest.mark.parametrize("threads", [1, 2, 7])
@pytest.mark.parametrize("name", scan.strategies())
def test_strategies_agree(frames, name, threads):
    got = scan.match(*frames, ["k"], name=name, config=scan.ScanConfig(threads=threads)).collect()
    assert sorted(map(tuple, got)) == brute(TEXTS)


@pytest.mark.parametrize("size", [64, 1000])
def test_corpus_mode(frames, size):
    whole = "".join(t or "" for _, t in TEXTS)
    got = scan.match_corpus(*frames, "k", chunk_bytes=size).collect()
    assert sorted(map(tuple, got)) == [x[1:] for x in brute([(0, whole)])]


def test_registry():
    assert len(scan.strategies()) == 12 and scan.strategy(0) is scan.strategy("sequential")
    with pytest.raises(KeyError):
        scan.strategy("none")
    with pytest.raises(ValueError):
        scan.register("sequential")(None)


def test_digests(frames, spark):
    docs, words = frames
    a, b = (scan.match(docs.filter("k = 5"), words, ["k"], name=n).drop("k") for n in ("sequential", "pthread_dynamic"))
    assert results.equal(a, b) and not results.equal(a, b.union(b))
    assert results.digest(results.canonical(a)) == results.digest(results.canonical(b))
    assert results.digest(results.emission(a, words)) != results.digest(results.canonical(a))


def test_empty_dictionary(frames, spark):
    none = spark.createDataFrame([], "pattern_id int, pattern binary")
    for name in scan.strategies():
        assert scan.match(frames[0], none, ["k"], name=name, config=scan.ScanConfig(threads=2)).count() == 0


def test_stream(frames, spark, tmp_path):
    docs, words = frames
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    q = match_stream(stream, words, ["k"]).writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("found").collect())) == brute(TEXTS)
