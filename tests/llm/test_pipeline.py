"""The pipeline against the operators' plain versions, stage by stage, and from end to end."""

import os
import random

import brute
import pytest

import corpus_pipeline
from matchloom.llm import common, jaccard, quality, sentencepiece
from matchloom.llm.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data is not here")


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    kept = {r["doc_id"] for r in quality.judge(docs).filter("kept").collect()}
    assert all(not brute.quality(rows[d]["text"])[-1] for d in kept)
    first = {d for d, n, c in brute.near_groups([(d, rows[d]["text"]) for d in kept]) if d == c or not n}
    out = corpus_pipeline.run(spark, SF).collect()
    seen = {}
    for r in out:
        seen.setdefault(r["doc_id"], []).append(r)
    assert {*seen} <= first
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=sentencepiece.MODEL)
    marked = {d: rows[d]["text"] for d in first if brute.secrets(rows[d]["text"])[:3] == (0, 0, 0)}
    size = lambda t: len(brute.WORD.findall(t))
    for d, own in seen.items():
        assert all(r["ids"] == library.encode(r["text"]) and r["round_trip"] for r in own)
        whole = [r for r in own if size(r["text"]) == size(max((x["text"] for x in own), key=size))]
        if d in marked and size(whole[0]["text"]) == size(marked[d]):
            assert all(r["text"] == marked[d] for r in whole)
        assert sum(size(r["text"]) for r in own) <= 2 * size(rows[d]["text"]) + 50
    for d in {*seen} - {*marked}:
        assert all(brute.secrets(r["text"])[:3] == (0, 0, 0) for r in seen[d])


def test_stages_keep_columns(spark):
    docs = spark.createDataFrame([(1, None, None, None, None, 5, "k"), (None, "a b", "en", "s", 3, 5, "k"), (2, "a b", "en", "s", 3, 5, "k")], "doc_id long, text string, lang string, source string, n_chars long, size int, key_ string")
    for df in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, SF)
            assert out.columns[: len(docs.columns)] == docs.columns, name
            out.collect()


def test_mix_cuts_no_text(spark):
    """Every text that leaves the mix is one that entered it, white space included; targets are met to half a document."""
    rows = [(k, " \n".join(f"w{k}x{i}" for i in range(5 + 37 * k % 90)) + "\n", f"s{k % 3}", 1) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")
    out = corpus_pipeline.source_mix(spark, docs, SF).collect()
    assert out and {(r["doc_id"], r["text"], r["source"], r["n_chars"]) for r in out} <= {*rows}
    for source, (_, target) in brute.mix([r[:3] for r in rows]).items():
        assert abs(sum(len(r["text"].split()) for r in out if r["source"] == source) - target) <= 48


def test_duplicates_by_text(spark):
    """Rows of one doc_id but different texts are documents of their own; which of equal rows stays is fixed."""
    a, b, c, e = (" ".join(f"{x}{i}" for i in range(30)) for x in "abce")
    rows = [(1, a, 1), (1, b, 1), (2, b, 1), (3, c, 1), (3, c, 2), (4, a, 1), (5, None, 1), (5, "", 1), (None, c, 1), (-6, e, 1), (7, e, 1)]
    outs = []
    for n in (1, 3):
        docs = spark.createDataFrame(rows, "doc_id long, text string, extra int").repartition(n)
        outs.append(sorted(map(tuple, corpus_pipeline.near_duplicates(spark, docs, SF).collect()), key=repr))
    assert outs[0] == outs[1]
    assert sorted((r[:2] for r in outs[0]), key=repr) == sorted([(1, a), (1, b), (3, c), (5, None), (5, ""), (None, c), (-6, e)], key=repr)


def test_duplicates_move_no_row_that_stays(spark):
    """Either way of leaving rows out gives the same rows; where few are left out the others' texts are not shuffled."""
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=6000)) for _ in range(6)) for _ in range(200)]
    rows = [(i, x, i % 3) for i, x in enumerate(texts)] + [(900 + i, texts[i], 1) for i in range(5)] + [(7, texts[7], 5), (901, texts[1], 4), (None, texts[3], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra int").repartition(3)
    docs = common.cut(docs)

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()

    outs, moved = [], []
    for few in (jaccard.FEW_MARKED, 0):
        before = written()
        outs.append(sorted(map(tuple, jaccard.keep_first(docs, few=few).collect()), key=repr))
        moved.append(written() - before)
    assert outs[0] == outs[1] and len(outs[0]) == 201
    size = sum(map(len, texts))
    assert moved[0] < 0.2 * size and moved[1] > 0.5 * size


def test_names():
    assert [f"op{n}" for n in range(1, 11)] == [k.split("_")[0] for k in QUERIES] and 4 <= len(corpus_pipeline.STAGES) <= 5
