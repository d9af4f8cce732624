"""worker_bytes_matches and worker_metrics against a plain version, on texts whose keys are their own, shared and null."""

import pytest

from matchloom import queries
from matchloom.operators import measure, scan

SCHEMA = "doc_id long, text string"
OWN = [(1, "the other thé them "), (2, ""), (3, None), (4, "a" * 3000), (5, "action and aa"), (None, "the heather"), (6, "h"), (7, "the" * 700 + "é" * 1_500)]
COPIES = OWN + [(4, "a" * 3000), (5, "action and aa"), (5, "action and aa"), (None, "and")]
MIXED = COPIES + [(1, "them and the" * 40), (1, "the other thé them "), (1, None), (2, "a"), (5, "")]
MANY = [(k, "the " * (k + c)) for k in range(20) for c in range(3)]


def brute(texts, parts=7, whole=False):
    words = [w.encode() for w in queries.DW]
    size = lambda t: max(1, (len((t or "").encode()) + parts - 1) // parts)
    ends = {}
    for k, t in texts:
        b = (t or "").encode()
        for w in words:
            at = b.find(w)
            while at >= 0:
                ends.setdefault(k, []).append(at + len(w) - 1)
                at = b.find(w, at + 1)
    counts = {}
    for k, t in texts:
        for e in ends.get(k, ()) if k is not None else ():
            c = (k, e // size(t))
            counts[c] = counts.get(c, 0) + 1
    out = []
    for k, t in texts:
        n, s = len((t or "").encode()), size(t)
        out += [(k, c // s, n if whole else min(n, c + s) - max(0, c - 3), counts.get((k, c // s), 0)) for c in range(0, n, s)]
    return sorted(out, key=repr)


def metrics(spark, texts, **how):
    df = measure.worker_metrics(spark.createDataFrame(texts, SCHEMA), scan.dictionary(queries.words(spark)), 7, **how)
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("texts", [OWN, COPIES, MIXED, MANY], ids=["own", "copies", "mixed", "many"])
def test_worker_metrics(spark, texts):
    expected = brute(texts)
    assert metrics(spark, texts) == expected
    assert metrics(spark, texts, most_broadcast=0) == expected


def test_sharded_workers_read_whole_texts(spark):
    for texts in (OWN, MIXED):
        assert metrics(spark, texts, kind="sharded") == brute(texts, whole=True)


def test_no_words(spark):
    df = measure.worker_metrics(spark.createDataFrame(OWN[:1], SCHEMA), [], 7)
    assert sorted(map(tuple, df.collect())) == [(1, k, 3, 0) for k in range(6)] + [(1, 6, 2, 0)]


def test_long_chunks_are_scanned_in_parts(spark, monkeypatch):
    monkeypatch.setattr(measure, "PART", 5)
    assert metrics(spark, MIXED) == brute(MIXED)


def shuffled_rows(sc, after=-1):
    """(rows written to shuffles by the stages behind after, the last stage)."""
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    none = sc._jvm.java.util.ArrayList()
    stages = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(sc._jvm.double, 0), none)
    stages = [stages.apply(k) for k in range(stages.size())]
    return sum(x.shuffleWriteRecords() for x in stages if x.stageId() > after), max((x.stageId() for x in stages), default=-1)


@pytest.fixture
def large(spark):
    """Tables count as too large to be broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name, column", [("worker_bytes_matches", "matches_found"), ("match_join_labels", "n")])
def test_matches_do_not_move(spark, large, tmp_path, name, column):
    """Rows shuffled are texts and their keys, however many matches they have."""
    spark.createDataFrame([(k, "a" * 2000) for k in range(14)] + [(14, "ab" * 14_000)], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, k % 2, 0) for k in range(15)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    _, last = shuffled_rows(spark.sparkContext)
    rows = queries.QUERIES[name](spark, str(tmp_path)).collect()
    assert sum(r[column] for r in rows) > 60_000
    assert 0 < shuffled_rows(spark.sparkContext, last)[0] < 1_000


def test_labels_of_texts(spark, tmp_path):
    """Shared keys meet every label of theirs, texts without matches and null keys make no group."""
    spark.createDataFrame(MIXED + [(8, "x"), (9, "")], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(1, 0, 0), (1, 1, 0), (5, 1, 0), (5, 1, 0), (8, 0, 1), (9, 1, 1), (None, 0, 1), (40, 0, 1), (4, None, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    expected = {}
    for key, *group in labels:
        n = sum(r[3] for k, t in MIXED if k == key is not None for r in brute([(k, t)], 1))
        if n:
            expected[tuple(group)] = expected.get(tuple(group), 0) + n
    assert {(r.quality, r.toxic): r.n for r in queries.QUERIES["match_join_labels"](spark, str(tmp_path)).collect()} == expected
