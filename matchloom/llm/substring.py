"""Substring dedup by difference-cover anchors.

Hashes of 7 words are taken only at places whose number in the document is in a difference cover modulo 7. Of two equal
windows of 13 words, wherever they start, both have such an anchor at the same distance from their start. Anchors that
occur in one document only are dropped; around the others the windows of 13 words are hashed, and each window learns
the smallest document that has it. Windows are told apart by 96 bits of two hash functions: over the 1e13 windows of
100 TB the odds that any two different ones agree are below one in a thousand.

Documents are dealt into chunks by a hash of their id; the chunks' texts are shuffled once and that exchange is used
three times. A chunk sends each anchor once and each window once or twice, whatever the number of its documents that have it, so a passage
of a third of all documents makes no more rows than there are chunks. Shuffled rows are sorted and read as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts_for
from .hashing import by_bytes, found_in, found_pairs, hash_runs, hash_words, runs_equal

WINDOW, ANCHOR = 13, 7
PERIOD = WINDOW - ANCHOR + 1
COVER = (0, 1, 3)  # every difference modulo 7 is one of two of these
ANCHOR_BITS = 48  # an anchor's hash only finds candidates, so it may be short
LAST = 2**63 - 1  # stands for a null doc_id: after all others
CHUNK_BYTES, PACK_BYTES = 12_000_000, 32_000_000


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one chunk in a batch as one compressed row: texts are most of what is shuffled."""
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))
    for whole in batches:
        for batch in by_bytes(whole, "text", PACK_BYTES):
            chunk = batch.column("chunk").to_numpy()
            order = np.argsort(chunk, kind="stable")
            at = runs_equal(chunk[order])
            rows = batch.select(["doc_id", "text"]).take(pa.array(order))
            blobs = []
            for a, b in zip(at, np.append(at[1:], len(order))):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=options) as out:
                    out.write_batch(pa.concat_batches([rows.slice(a, b - a)]))
                blobs.append(sink.getvalue())
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(chunk[order][at], pa.int32()), "rows": pa.array([x.to_pybytes() for x in blobs], pa.binary())})


def _columns(group: pa.Table) -> tuple[np.ndarray, pa.Array]:
    """Documents and texts of a chunk, by document."""
    tables = [pa.ipc.open_stream(x.as_buffer()).read_all() for x in group.column("rows").combine_chunks().cast(pa.binary())]
    rows = pa.concat_tables(tables).combine_chunks()
    return rows.column("doc_id").to_numpy(), rows.column("text").chunk(0)


def _anchors(words) -> tuple[np.ndarray, np.ndarray]:
    at, h = hash_runs(words, ANCHOR)
    long_enough = np.diff(words.first) >= WINDOW
    own = np.isin(words.place[at] % PERIOD, COVER) & long_enough[words.row[at]]
    return at[own], (h[own] >> np.uint64(64 - ANCHOR_BITS)).astype(np.int64)


def _by_key(keys: np.ndarray, docs: np.ndarray, checks: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Each distinct key with its smallest and largest document; with checks, each key and check, these last.

    If a key has several checks, a pair may come more than once, each time with some of its documents.
    """
    order = np.argsort(keys, kind="stable")
    keys, docs = keys[order], docs[order]
    checks = np.zeros(len(keys), np.int32) if checks is None else checks[order]
    at = runs_equal(keys, checks)
    if not len(at):
        return keys, docs, docs, checks
    return keys[at], np.minimum.reduceat(docs, at), np.maximum.reduceat(docs, at), checks[at]


def _windows(texts: pa.Array, near: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, keys, checks) of the windows of texts; near: only those whose first word's number it marks."""
    start, key = hash_runs(hash_words(texts), WINDOW)
    check = (hash_runs(hash_words(texts, lane=1), WINDOW)[1] >> np.uint64(32)).astype(np.uint32).view(np.int32)
    own = slice(None) if near is None else near[start]
    return start[own], key[own].astype(np.int64), check[own]


def _send_anchors(group: pa.Table) -> pa.Table:
    docs, texts = _columns(group)
    words = hash_words(texts)
    at, keys = _anchors(words)
    keys, low, high, _ = _by_key(keys, docs[words.row[at]])
    return pa.table({"key": keys, "chunk": pa.array(np.full(len(keys), group.column("chunk")[0].as_py(), np.int32)), "multi": low != high})


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, those whose key comes twice or is marked multi; holds back one row at most."""
    known, waits = None, None  # the last key, if it is repeated; else its only row
    for batch in batches:
        key, chunk, multi = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "chunk", "multi"))
        if not len(key):
            continue
        if waits is not None:
            key, chunk, multi = np.append(waits[0], key), np.append(waits[1], chunk), np.append(False, multi)
        at = runs_equal(key)
        size = np.diff(np.append(at, len(key)))
        twice = (size > 1) | np.logical_or.reduceat(multi, at) | (key[at] == known if known is not None else False)
        known, waits = (key[-1], None) if twice[-1] else (None, (key[-1], chunk[-1]))
        rows = np.repeat(twice, size)
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(chunk[rows], pa.int32()), "key": pa.array(key[rows], pa.int64())})


def _send_windows(group: pa.Table, repeated: pa.Table) -> pa.Table:
    if not group.num_rows:
        return pa.table({c: pa.array([], pa.int64()) for c in ("key", "own", "doc")})
    docs, texts = _columns(group)
    words = hash_words(texts)
    at, keys = _anchors(words)
    at = at[found_in(np.sort(repeated.column("key").to_numpy()), keys) >= 0]
    near = np.zeros(len(words.row) + 1, np.int32)  # windows start up to PERIOD - 1 words before an anchor
    np.add.at(near, np.maximum(at - PERIOD + 1, 0), 1)
    np.add.at(near, at + 1, -1)
    start, keys, checks = _windows(texts, np.cumsum(near) > 0)
    keys, low, high, checks = _by_key(keys, docs[words.row[start]], checks)
    own = checks.astype(np.int64) << 32 | group.column("chunk")[0].as_py()
    more = low != high
    return pa.table({"key": np.append(keys, keys[more]), "own": np.append(own, own[more]), "doc": np.append(low, high[more])})


def _smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, check (the upper half of own) and doc, what a chunk has to know: its windows that lose words.

    known is twice the check, and one more if the smallest document is in another chunk, so that no document keeps the
    window here. A chunk may get the same row twice.
    """
    last, least, at_home = None, None, None
    for batch in batches:
        key, own, doc = (batch.column(c).to_numpy() for c in ("key", "own", "doc"))
        if not len(key):
            continue
        check, chunk = own >> 32, (own & 0xFFFFFFFF).astype(np.int32)
        at = runs_equal(key, check)
        first, home = doc[at].copy(), chunk[at].copy()
        if last == (key[0], check[0]):
            first[0], home[0] = least, at_home
        last, least, at_home = (key[-1], check[-1]), first[-1], home[-1]
        size = np.diff(np.append(at, len(key)))
        rows = doc > np.repeat(first, size)
        known = check * 2 + (chunk != np.repeat(home, size))
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(chunk[rows], pa.int32()), "key": pa.array(key[rows], pa.int64()), "known": pa.array(known[rows], pa.int64())})


def _cut(group: pa.Table, known: pa.Table, with_text: bool) -> pa.Table:
    names = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string()} | ({"kept": pa.string()} if with_text else {})
    if not group.num_rows:
        return pa.table({k: pa.array([], v) for k, v in names.items()})
    docs, texts = _columns(group)
    words = hash_words(texts)
    start, keys, checks = _windows(texts)
    key, own = (known.column(c).to_numpy() for c in ("key", "known"))
    order = np.argsort(key)
    key, own = key[order], own[order]
    at = found_pairs(key, (own >> 1).astype(np.int32), keys, checks)
    start, at = start[at >= 0], at[at >= 0]
    doc, least = docs[words.row[start]], np.full(len(key), LAST)
    np.minimum.at(least, at, doc)
    gone = start[(own[at] & 1 == 1) | (doc > least[at])]
    edge = np.zeros(len(words.row) + 1, np.int32)
    edge[gone] += 1
    np.add.at(edge, gone + WINDOW, -1)
    keep = np.cumsum(edge[:-1]) == 0
    n_words = np.diff(words.first)
    kept = np.add.reduceat(np.append(keep, False).astype(np.int64), words.first[:-1]) * (n_words > 0)
    digests, left = [], []
    for i, text in enumerate(texts.cast(pa.large_binary())):
        own = (text.as_py() or b"").split()  # bytes.split() cuts at just the six characters of white space
        if kept[i] < n_words[i]:
            own = compress(own, keep[words.first[i] : words.first[i + 1]])
        own = b" ".join(own)
        digests.append(hashlib.sha256(own).hexdigest())
        if with_text:
            left.append(own)
    ids = pa.array(docs, mask=docs == LAST)
    out = {"doc_id": ids, "n_words": n_words, "n_removed": n_words - kept, "kept_sha256": pa.array(digests, pa.string())}
    return pa.table(out | ({"kept": pa.array(left, pa.binary()).cast(pa.string())} if with_text else {}))


def dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Repeats of 13 words or more taken out of docs(doc_id, text, ...).

    A word goes if it is in a window of 13 words that also starts in a document with a smaller doc_id. Returns doc_id,
    n_words, n_removed, kept_sha256 and, with_text, kept: the words left, joined by one space. A null text has no words;
    a null doc_id comes after all others; rows with the same doc_id keep what only they share; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = parts_for(spark, n_bytes, CHUNK_BYTES)
    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    dealt = docs.select(F.pmod(F.xxhash64(ids), F.lit(chunks)).cast("int").alias("chunk"), ids.alias("doc_id"), "text").mapInArrow(_pack, "chunk int, rows binary")
    anchors = dealt.groupBy("chunk").applyInArrow(_send_anchors, "key long, chunk int, multi boolean")
    repeated = anchors.repartition("key").sortWithinPartitions("key").mapInArrow(_repeated, "chunk int, key long")
    windows = dealt.groupBy("chunk").cogroup(repeated.groupBy("chunk")).applyInArrow(_send_windows, "key long, own long, doc long")
    known = windows.repartition("key").sortWithinPartitions("key", F.shiftright("own", 32), "doc").mapInArrow(_smallest, "chunk int, key long, known long")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text

    def last(group: pa.Table, own: pa.Table) -> pa.Table:
        return _cut(group, own, with_text)

    return dealt.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(last, schema)
