"""Jaccard metric-space join of shingle sets: Voronoi regions, triangle-inequality windows, exact recursion.

Jaccard distance is a metric, but almost all documents are at distance 1 from any pivot document: their windows would
reach every region. So the outermost pivots are sets of one shingle. A document is placed under its rarest shingles, as
many as a partner within the radius must share some of (the window of that level); documents that meet under as many
pivots as partners of their sizes must are joined into regions, and a document that meets nobody has no partner. One
common shingle says nothing of long documents: the more of them there are, the more meet by chance. Inside a region the
pivots are documents: every document goes to the region of its nearest pivot and, if the triangle inequality lets a
partner be there, also to others; a region whose documents are all known to be connected is done; the rest recurses.

Shingles are compared by hashes: one function finds what may link, another, with nothing in common, measures it. A false
link would need both to collide.

A region within `local` shingles and a thousandth as many documents is solved in one task; a larger one is dealt out: each round measures the distances to
a few pivots in chunks, and regions that no longer shrink are joined block by block. Copies are one document throughout.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, parts_for, release
from .graph import components
from .hashing import by_bytes, found_in, hash_sets, hash_words, mix, runs_equal

SIZE = 5
NUM, DEN = 80, 100  # least similarity
RADIUS = 1 - NUM / DEN
SKETCH_BITS, SLICES = 22, 32
LEVEL_BITS = 12
SLICE_BYTES = 4_000_000
PIVOTS = 16  # of a round over a region that is dealt out
SALT = 16
LOCAL = 8_000_000  # shingles
FEW_MEMBERS = 200_000  # rows of 48 bytes that are broadcast
HOT = 2000  # documents with a shingle from which on its group is met in parts
PAIRED = 16  # documents with a shingle up to which each two of them are counted as meeting, beyond which all are joined
CHUNK_BYTES = 8_000_000
SLACK = 1e-9


def _sets(texts: pa.Array, lane: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle sets by one of two hash functions: lane 0 finds what may link, lane 1 measures it."""
    return hash_sets(hash_words(texts, fold=True, lane=lane), SIZE)


def _text(column) -> pa.Array:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)


def _fingerprint(elements: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit number for each set."""
    n = np.diff(first)
    out = np.zeros(len(n), np.uint64)
    if len(elements):
        own = np.flatnonzero(n)
        with np.errstate(over="ignore"):
            out[own] = np.add.reduceat(mix(elements), first[own])
    return out.astype(np.int64)


_SEEN = "doc_id long, n long, fp1 long, fp2 long, slice int, counts binary"


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's set size and fingerprint, and at the end the task's counts of shingles by hash, in slices."""
    counts = np.zeros(1 << SKETCH_BITS, np.uint32)
    null = lambda n, kind: pa.nulls(n, kind)
    for whole in batches:
        for batch in by_bytes(whole, "text", SLICE_BYTES):
            elements, first = _sets(_text(batch.column("text")), 0)
            counts += np.bincount((elements >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts)).astype(np.uint32)
            one, two = _fingerprint(elements, first), _fingerprint(*_sets(_text(batch.column("text")), 1))
            k = batch.num_rows
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n": pa.array(np.diff(first), pa.int64()), "fp1": pa.array(one), "fp2": pa.array(two), "slice": null(k, pa.int32()), "counts": null(k, pa.binary())})
    if counts.any():
        blobs = [zlib.compress(x.tobytes(), 1) for x in np.split(counts, SLICES)]
        yield pa.RecordBatch.from_pydict({c: null(SLICES, pa.int64()) for c in ("doc_id", "n", "fp1", "fp2")} | {"slice": pa.array(range(SLICES), pa.int32()), "counts": pa.array(blobs, pa.binary())})


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, blob in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist()):
            own = np.frombuffer(zlib.decompress(blob), np.uint32).astype(np.uint64)
            sums[k] = sums[k] + own if k in sums else own
    if sums:
        yield pa.RecordBatch.from_pydict({"slice": pa.array(list(sums), pa.int32()), "counts": pa.array([np.minimum(x, 2**32 - 1).astype(np.uint32).tobytes() for x in sums.values()], pa.binary())})


def _levels(counts: np.ndarray) -> np.ndarray:
    """How common the shingles of each slot are, in steps of half a percent."""
    return np.round(127 * np.log2(np.maximum(counts, 1))).astype(np.uint16)


def _parts(levels: np.ndarray, hot: int) -> np.ndarray:
    """By how common a shingle is, the parts in which its group is met: 1 up to hot documents, or 8 times what is usual."""
    count = 2.0 ** (np.arange(int(levels.max(initial=0)) + 1) / 127)
    return np.ceil(count / max(hot, 8 * float(count[levels].mean()))).astype(np.int64)


def least_shared(n: np.ndarray) -> np.ndarray:
    """How many shingles a set of n shares with a partner, itself not smaller, within the prefixes of both."""
    return np.where(n > 0, 1 + n // 100, 0)


def _prefixes(levels: np.ndarray, parts: np.ndarray):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # of copies within a task only the first is sent
        for whole in batches:
            for batch in by_bytes(whole, "text", SLICE_BYTES):
                elements, first = _sets(_text(batch.column("text")), 0)
                n = np.diff(first)
                new = np.zeros(len(n), bool)
                for i, fp in enumerate(zip(_fingerprint(elements, first).tolist(), n.tolist())):
                    if n[i] and fp not in seen:
                        seen.add(fp)
                        new[i] = True
                level = levels[(elements >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64)
                keys = (level << np.uint64(63 - LEVEL_BITS)) | (elements & np.uint64(2 ** (63 - LEVEL_BITS) - 1))
                for a, b in zip(first[:-1], first[1:]):
                    keys[a:b].sort()
                # After the k-th that is shared at most the rest of an overlap of NUM/DEN * n elements or more can follow.
                most = n - -(-NUM * n // DEN) + least_shared(n)
                size = np.where(new, np.minimum(most, n), 0)
                rows = np.repeat(np.arange(len(n)), size)
                at = np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[:-1], size)
                ids = batch.column("doc_id").to_numpy(zero_copy_only=False)[rows]
                with np.errstate(over="ignore"):
                    dealt = (mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(1)).astype(np.int64)
                many = parts[(keys[at] >> np.uint64(63 - LEVEL_BITS)).astype(np.int64)]
                part = np.where(many > 1, dealt % many, WHOLE).astype(np.int32)
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys[at].astype(np.int64)), "part": pa.array(part), "n": pa.array(n[rows].astype(np.int32)), "doc_id": pa.array(ids, pa.int64())})

    return emit


WHOLE, HEADS = -1, -2  # the part of a shingle that is met at once, and that of the rows by which parts meet
_MET = "a long, b long, need int, times long, key long, n int"


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """key, part, n and doc_id of rows sorted by key and part, in pieces that end where a group ends."""
    names, rest = ("key", "part", "n", "doc_id"), None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(c).to_numpy() for c in names]
        rows = rows if rest is None else [np.concatenate(x) for x in zip(rest, rows)]
        last = runs_equal(rows[0], rows[1])[-1]
        if last:
            yield tuple(x[:last] for x in rows)
        rest = [x[last:] for x in rows]
    if rest is not None:
        yield tuple(rest)


def _counted(pairs: list[np.ndarray], need: list[np.ndarray]) -> pa.RecordBatch:
    """Rows (a, b, need, times) of pairs that may repeat."""
    pairs, need = np.concatenate(pairs), np.concatenate(need)
    order = np.lexsort((need, pairs[:, 1], pairs[:, 0]))
    pairs, need = pairs[order], need[order]
    at = runs_equal(pairs[:, 0], pairs[:, 1])
    none = lambda kind: pa.nulls(len(at), kind)
    return pa.RecordBatch.from_pydict({"a": pa.array(pairs[at, 0], pa.int64()), "b": pa.array(pairs[at, 1], pa.int64()), "need": pa.array(need[at], pa.int32()), "times": pa.array(np.diff(np.append(at, len(need))), pa.int64()), "key": none(pa.int64()), "n": none(pa.int32())})


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, part and n: pairs (a, b) of documents that meet, how often, and how often partners would.

    Where the next size is too large for the one before, a new group begins. In a group of up to PAIRED every two
    documents are a pair; in a larger one or one of a part all are joined to the first, which needs no further meeting. A
    group of a part also gives a row (key, n, a) for each size that it has, by which the parts' groups meet.
    """
    for key, part, n, doc in _groups(batches):
        n = n.astype(np.int64)
        begin = np.zeros(len(key), bool)
        begin[runs_equal(key, part)] = True
        before = np.append(0, n[:-1])
        begin |= DEN * before < NUM * n
        sizes = (begin | (before != n)) & (part >= 0)
        at = np.flatnonzero(begin)
        many = np.diff(np.append(at, len(key)))
        heads, group = np.repeat(doc[at], many), np.repeat(np.arange(len(at)), many)
        joined = np.repeat(many, many) > PAIRED
        joined |= part != WHOLE
        apart = joined & (heads != doc)
        pairs, need = [np.stack([heads[apart], doc[apart]], 1)], [np.zeros(apart.sum(), np.int64)]
        for step in range(1, min(PAIRED, int(many.max()))):
            i = np.flatnonzero((group[:-step] == group[step:]) & ~joined[:-step])
            i = i[(DEN * n[i] >= NUM * n[i + step]) & (doc[i] != doc[i + step])]
            pairs.append(np.stack([doc[i], doc[i + step]], 1))
            need.append(least_shared(n[i]))
        yield _counted(pairs, need)
        if sizes.any():
            none = lambda kind: pa.nulls(int(sizes.sum()), kind)
            yield pa.RecordBatch.from_pydict({"a": pa.array(heads[sizes], pa.int64()), "b": none(pa.int64()), "need": none(pa.int32()), "times": none(pa.int64()), "key": pa.array(key[sizes], pa.int64()), "n": pa.array(n[sizes], pa.int32())})


def meetings(prefixes: DataFrame) -> DataFrame:
    """Edges (a, b) that connect documents which meet as often as partners must: prefixes(key, part, n, doc_id).

    The documents of a common shingle are dealt out; what comes of their parts is a row for each size, and those meet.
    """
    met = prefixes.repartition("key", "part").sortWithinPartitions("key", "part", "n", "doc_id").mapInArrow(_meet, _MET)
    met = met.groupBy("a", "b", "key", "n").agg(F.sum("times").alias("times"), F.min("need").alias("need"))
    met = cut(met.filter("key is not null or times >= need").select("a", "b", "key", "n"))
    release(met.sparkSession)
    heads = met.filter("key is not null").select("key", F.lit(HEADS).alias("part"), "n", F.col("a").alias("doc_id"))
    heads = heads.repartition("key").sortWithinPartitions("key", "n", "doc_id").mapInArrow(_meet, _MET)
    return met.filter("key is null").select("a", "b").unionByName(heads.select("a", "b")).distinct()


class _Region:
    """Documents of one task with their sets, and what is known of their connections."""

    def __init__(self, elements: np.ndarray, first: np.ndarray, rows: np.ndarray):
        self.n = np.diff(first)[rows]
        self.own = [elements[first[r] : first[r + 1]] for r in rows]
        self.up = list(range(len(rows)))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def labels(self, region: np.ndarray) -> np.ndarray:
        return np.array([self.root(i) for i in region.tolist()])

    def index(self, region: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The shingles of a region's documents in order, and the number in the region of the document each is of."""
        tokens = np.concatenate([self.own[i] for i in region])
        owner = np.repeat(np.arange(len(region)), self.n[region])
        order = np.argsort(tokens, kind="stable")
        return tokens[order], owner[order]

    def measure(self, p: int, region: np.ndarray, index: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Distances of a region's documents from p; those that link with p are joined to it."""
        tokens, owner = index
        low = np.searchsorted(tokens, self.own[p], "left")
        size = np.searchsorted(tokens, self.own[p], "right") - low
        hits = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
        shared = np.bincount(owner[hits], minlength=len(region))
        whole = self.n[region] + self.n[p] - shared
        for i in region[DEN * shared >= NUM * whole].tolist():
            a, b = self.root(i), self.root(p)
            self.up[max(a, b)] = min(a, b)
        return 1 - shared / whole

    def solve(self) -> None:
        todo = [np.arange(len(self.own))]
        while todo:
            region = todo.pop()
            if len(region) < 2 or len(set(self.labels(region).tolist())) == 1:
                continue
            index = self.index(region)
            far, pivots, distances = np.full(len(region), np.inf), [], []
            p = 0
            while len(pivots) < 8:  # each pivot is the document farthest from those before
                pivots.append(p)
                distances.append(self.measure(int(region[p]), region, index))
                far = np.minimum(far, distances[-1])
                p = int(far.argmax())
                if far[p] == 0:
                    break
            d = np.stack(distances)
            rest = np.ones(len(region), bool)
            rest[pivots] = False  # all links of a pivot are known
            near = d.min(0)
            for j in range(len(pivots)):
                cell = region[rest & (d[j] <= near + 2 * RADIUS + SLACK)]
                if not (rest & (d[j] <= near)).any() or len(cell) < 2:
                    continue
                if len(cell) > 0.8 * len(region):
                    self.one_by_one(cell)
                else:
                    todo.append(cell)

    def one_by_one(self, region: np.ndarray) -> None:
        """For a region that pivots do not divide: each document against those that are not yet connected to it."""
        labels = self.labels(region)
        kinds, sizes = np.unique(labels, return_counts=True)
        # The largest group need not be asked: all others' links are found from their side.
        index = self.index(region)
        for p in region[labels != kinds[sizes.argmax()]].tolist():
            self.measure(p, region, index)


def _solve(group: pa.Table) -> pa.Table:
    """Links that connect what is connected within each region of the group: (smallest document, document)."""
    elements, first = _sets(_text(group.column("text")), 1)
    docs, regions = group.column("doc_id").to_numpy(), group.column("region").to_numpy()
    order = np.lexsort([docs, regions])
    a, b = [], []
    at = runs_equal(regions[order])
    for begin, end in zip(at, np.append(at[1:], len(order))):
        rows = order[begin:end]
        region = _Region(elements, first, rows)
        region.solve()
        heads = docs[rows[region.labels(np.arange(len(rows)))]]
        a.append(heads)
        b.append(docs[rows])
    a, b = np.concatenate(a), np.concatenate(b)
    return pa.table({"a": a[a != b], "b": b[a != b]})


def _similar(group: pa.Table, pivots: pa.Table) -> pa.Table:
    """Distances of a chunk's documents from their region's pivots, by the pivots' numbers."""
    if not group.num_rows or not pivots.num_rows:
        return pa.table({"region": pa.array([], pa.int64()), "doc_id": pa.array([], pa.int64()), "pivot": pa.array([], pa.int64()), "distance": pa.array([], pa.float64()), "linked": pa.array([], pa.bool_())})
    elements, first = _sets(_text(group.column("text")), 1)
    own, begins = _sets(_text(pivots.column("text")), 1)
    docs, ids = group.column("doc_id").to_numpy(), pivots.column("doc_id").to_numpy()
    n, owner = np.diff(first), np.repeat(np.arange(len(docs)), np.diff(first))
    out = {"doc_id": [], "pivot": [], "distance": [], "linked": []}
    for k in range(len(ids)):
        p = own[begins[k] : begins[k + 1]]
        shared = np.bincount(owner[found_in(p, elements) >= 0], minlength=len(docs))
        whole = n + len(p) - shared
        for name, x in (("doc_id", docs), ("pivot", np.full(len(docs), ids[k])), ("distance", 1 - shared / whole), ("linked", DEN * shared >= NUM * whole)):
            out[name].append(x)
    out = {k: np.concatenate(v) for k, v in out.items()}
    return pa.table({"region": np.full(len(out["doc_id"]), group.column("region")[0].as_py())} | out)


def _block_links(group: pa.Table, other: pa.Table) -> pa.Table:
    """Links that connect what is connected between two blocks of a region."""
    if not group.num_rows or not other.num_rows:
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    both = pa.concat_tables([group.select(["region", "doc_id", "text"]), other.select(["region", "doc_id", "text"])])
    docs = both.column("doc_id").to_numpy()
    keep = np.sort(np.unique(docs, return_index=True)[1])
    return _solve(both.take(pa.array(keep)))


def _dealt_out(big: DataFrame, links: DataFrame, local: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round over regions too large for a task, big(region, doc_id, text, n, size): (links, regions, stuck regions)."""
    order = F.xxhash64("region", "doc_id", F.lit(1))
    chance = big.filter(F.pmod(order, F.col("docs")) < 4 * PIVOTS)
    pivots = chance.withColumn("place_", F.row_number().over(Window.partitionBy("region").orderBy(order))).filter(F.col("place_") <= PIVOTS).select("region", "doc_id", "text", "chunks")
    pivots = cut(pivots)
    chunk = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.col("chunks"))
    sent = pivots.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).select("region", "chunk", "doc_id", "text")
    left = big.withColumn("chunk", chunk).select("region", "chunk", "doc_id", "text")
    measured = cut(left.groupBy("region", "chunk").cogroup(sent.groupBy("region", "chunk")).applyInArrow(_similar, "region long, doc_id long, pivot long, distance double, linked boolean"))
    links = links.unionByName(measured.filter("linked and pivot <> doc_id").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")))
    links = cut(links)
    label = components(links)
    rest = measured.join(pivots.select("region", "doc_id"), ["region", "doc_id"], "left_anti")
    near = rest.groupBy("region", "doc_id").agg(F.min("distance").alias("near_"))
    cells = rest.join(near, ["region", "doc_id"]).filter(F.col("distance") <= F.col("near_") + 2 * RADIUS + SLACK)
    cells = cells.join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("region", "pivot", "doc_id", (F.col("distance") <= F.col("near_")).alias("home_"), F.coalesce("component", "doc_id").alias("label_"))
    cells = cut(cells)
    open_ = cells.groupBy("region", "pivot").agg(F.count("*").alias("now_"), F.max("home_").alias("home_"), F.min("label_").alias("low_"), F.max("label_").alias("high_")).filter("home_ and low_ <> high_")
    # A region whose cells together are much larger than itself is not divided by its pivots: it stays one.
    whole = open_.groupBy("region").agg(F.sum("now_").alias("all_"), F.max("now_").alias("most_")).join(big.select("region", "docs").distinct(), "region")
    whole = whole.select("region", ((F.col("most_") > 0.8 * F.col("docs")) | (F.col("all_") > 3 * F.col("docs"))).alias("stuck"))
    cells = cells.join(open_.select("region", "pivot"), ["region", "pivot"]).join(whole, "region")
    own = F.when(F.col("stuck"), F.col("region")).otherwise(F.xxhash64("region", "pivot"))
    cells = cells.select(F.col("region").alias("was_"), own.alias("region"), "doc_id", "stuck").distinct()
    rows = cells.join(big.select(F.col("region").alias("was_"), "doc_id", "text", "n"), ["was_", "doc_id"]).drop("was_")
    rows = cut(rows)
    return links, rows.filter("not stuck").drop("stuck"), rows.filter("stuck").drop("stuck")


def most_docs(local: int) -> int:
    """Documents of a region that one task solves: their pairs count, however short they are."""
    return max(8, local // 1000)


def _big(local: int) -> Column:
    return (F.col("size_") > local) | (F.col("docs") > most_docs(local))


def _sized(rows: DataFrame, local: int) -> DataFrame:
    """rows(region, doc_id, text, n) with docs and chunks, of its region."""
    chunks = F.ceil(F.greatest(F.sum("n") / F.lit(max(1, local // 4)), F.count("*") / F.lit(max(1, most_docs(local) // 4))))
    by = rows.groupBy("region").agg(F.count("*").alias("docs"), chunks.alias("chunks"), F.sum("n").alias("size_"))
    salted = by.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("salt_", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int")).join(salted, ["region", "salt_"]).drop("salt_")


def _blocks(stuck: DataFrame, local: int) -> DataFrame:
    """Links within regions that pivots do not divide: every block of a region against itself and every later one.

    A block is as large as a region of one task may be, as each is sent as often as there are blocks.
    """
    rows = stuck.withColumn("blocks_", F.ceil(F.greatest(F.col("size_") / local, F.col("docs") / most_docs(local))))
    rows = rows.withColumn("block_", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.col("blocks_")))
    first = rows.withColumn("other_", F.explode(F.sequence(F.col("block_"), F.col("blocks_") - 1)))
    second = rows.withColumnRenamed("block_", "other_").withColumn("block_", F.explode(F.sequence(F.lit(0).cast("long"), F.col("other_"))))
    key = ["region", "block_", "other_"]
    cols = [F.col(c).alias(c) for c in (*key, "doc_id", "text")]
    return first.select(*cols).groupBy(*key).cogroup(second.select(*cols).groupBy(*key)).applyInArrow(_block_links, "a long, b long")


def link_regions(members: DataFrame, texts: DataFrame, local: int = LOCAL) -> DataFrame:
    """Links (a, b) that connect just what links within each region connect: members(region, doc_id, n), texts(doc_id, text)."""
    spark = members.sparkSession
    links = spark.createDataFrame([], "a long, b long")
    sized = cut(_sized(members, local))
    rows = cut(texts.join(F.broadcast(sized) if members.count() <= FEW_MEMBERS else sized, "doc_id"))
    while not (big := rows.filter(_big(local))).isEmpty():
        links, smaller, stuck = _dealt_out(big, links, local)
        stuck = _sized(stuck, local)
        links = cut(links.unionByName(_blocks(stuck, local)))
        rows = cut(rows.filter(~_big(local)).unionByName(_sized(smaller, local)))
        del big, smaller, stuck
        release(spark)
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bucket = F.pmod(F.xxhash64("region"), F.lit(parts_for(spark, n_bytes, CHUNK_BYTES))).cast("int")
    own = rows.select(bucket.alias("bucket"), "region", "doc_id", "text").groupBy("bucket").applyInArrow(_solve, "a long, b long")
    return links.unionByName(own)


def join(docs: DataFrame, local: int = LOCAL, hot: int = HOT) -> DataFrame:
    """Near-duplicate classes of docs(doc_id, text, ...) by sets of 5-word shingles, A-Z in lower case.

    Two documents link when 100 * intersection >= 80 * union. Returns doc_id, n_shingles, component_id (the smallest
    doc_id that links reach). A null text and one without words have the empty set and link with nothing; fewer than
    five words are one shingle; rows repeated in full are copies; rows that share a doc_id are one node; a row without
    doc_id takes no part and has a null component_id; an empty table gives an empty result. local bounds the shingles of
    a region that one task solves, hot the documents of a shingle that meet in one task.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = cut(texts.mapInArrow(_survey, _SEEN))
    counts = np.zeros(1 << SKETCH_BITS, np.uint32)
    width = len(counts) // SLICES
    for row in seen.filter("slice is not null").select("slice", "counts").repartition(SLICES, "slice").mapInArrow(_add_up, "slice int, counts binary").collect():  # 16 MB, whatever the input
        counts[row["slice"] * width : (row["slice"] + 1) * width] = np.frombuffer(row["counts"], np.uint32)
    levels = _levels(counts)
    rows = seen.filter("slice is null").select("doc_id", "n", "fp1", "fp2")
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))
    copies = rows.filter("n > 0 and doc_id is not null").groupBy("n", "fp1", "fp2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("many_")).filter("many_ > 1").withColumn("salt_", salts).drop("many_")
    rows = rows.withColumn("salt_", salt).join(copies, ["n", "fp1", "fp2", "salt_"], "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"))
    rows = cut(rows)
    del seen, copies
    met = meetings(texts.filter("doc_id is not null").mapInArrow(_prefixes(levels, _parts(levels, hot)), "key long, part int, n int, doc_id long"))
    reps = rows.filter("doc_id is not null").select("doc_id", "rep").distinct()
    for side in ("a", "b"):
        met = met.join(reps, F.col(side) == F.col("doc_id")).withColumn(side, F.col("rep")).drop("doc_id", "rep")
    regions = components(met)
    members = cut(regions.select(F.col("node").alias("doc_id"), F.col("component").alias("region")).join(rows.filter("doc_id = rep").select("doc_id", "n").distinct(), "doc_id"))
    del met, regions
    release(spark)
    found = components(link_regions(members, texts, local)).withColumnRenamed("node", "rep").withColumn("salt_", salts)
    release(spark)
    rows = rows.withColumn("salt_", salt).join(found, ["rep", "salt_"], "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "rep")).otherwise(F.col("doc_id")).alias("component_id"))


FEW = 100_000  # ids, 16 bytes each, that are broadcast
FEW_MARKED = 1_000_000  # ids of rows that do not simply stay, which are broadcast so that no row moves that does


def keep_first(docs: DataFrame, local: int = LOCAL, few: int = FEW_MARKED) -> DataFrame:
    """The row of each near-duplicate class with the smallest doc_id; documents without words or doc_id all stay.

    Rows are told apart by doc_id and text: rows that share a doc_id are compared by their texts as any others are, and
    of equal doc_ids in a class the text with the smaller hash stays. Of rows with one doc_id and text one stays, by the
    hash of all columns. Columns and their order stay.
    """
    id_, text = F.col("doc_id").cast("long"), F.xxhash64("text")
    shared = docs.select(id_.alias("id_"), text.alias("text_")).filter("id_ is not null").groupBy("id_").agg(F.min("text_").alias("low_"), F.max("text_").alias("high_"))
    shared = cut(shared.filter("low_ <> high_").select("id_", F.lit(True).alias("shared_")))
    n = shared.count()  # no ids are shared as a rule; then, or if few are, no row moves for them
    rows = docs.select(F.struct(*docs.columns).alias("row_"), id_.alias("id_")).filter("id_ is not null")
    if n:
        rows = rows.join(F.broadcast(shared) if n <= FEW else shared, "id_", "left")
        rows = rows.select("row_", "id_", F.when(F.col("shared_"), F.xxhash64("id_", "row_.text")).otherwise(F.col("id_")).alias("node_"))
        names = rows.filter("node_ <> id_").select("node_", "id_").distinct()
        found = join(rows.select(F.col("node_").alias("doc_id"), "row_.text"), local).select(F.col("doc_id").alias("node_"), "component_id").distinct().join(names, "node_", "left")
        kept = found.groupBy("component_id").agg(F.min(F.struct(F.coalesce("id_", "node_").alias("id_"), "node_")).alias("x")).select("x.node_")
    else:
        rows = rows.select("row_", F.col("id_").alias("node_"))
        kept = join(docs, local).filter("doc_id = component_id").select(F.col("doc_id").alias("node_")).distinct()
    order = F.xxhash64(*[F.col("row_")[c] for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()])
    every = rows.groupBy("node_").agg(F.count("*").alias("rows_")).join(kept.withColumn("kept_", F.lit(True)), "node_", "left")
    marked = cut(every.filter("kept_ is null or rows_ > 1").select("node_", "kept_"))
    release(docs.sparkSession)
    stay, again = None, kept
    if marked.count() <= few:
        stay = rows.join(F.broadcast(marked), "node_", "left_anti").select("row_.*")
        again = F.broadcast(marked.filter("kept_").select("node_"))
    first = rows.join(again, "node_", "left_semi").groupBy("node_").agg(F.min_by("row_", order).alias("row_")).select("row_.*")
    first = first if stay is None else first.unionByName(stay)
    return first.unionByName(docs.filter(id_.isNull()))
