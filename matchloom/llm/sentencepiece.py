"""SentencePiece encoding and decoding by suffix-array matching.

The distinct words of a batch are put into one text and its suffixes are sorted. Every piece of the vocabulary is found
by binary search as a range of suffixes; its occurrences are edges from their start to their end. Sorted by the place in
their word, the edges are relaxed: at each place the edge is kept that ends the encoding of the word up to there.

For a model of merges (BPE) that edge is the one whose piece may stand after the piece kept at its start, that is, whose
joint text no earlier merge would have torn across their seam; there is exactly one. So the result is that of the greedy
merges, not that of the best sum of scores. Words with runs of spaces, whose merges tie, are merged one by one.
"""

from __future__ import annotations

import heapq
import itertools
import re
import struct
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .hashing import by_bytes, runs_equal

SPACE = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SLICE_BYTES = 2_000_000  # of text whose words are encoded together
INDEX_CHARS = 250_000  # of distinct words that are indexed at once; a longer word has an index of its own
CACHE_BITS = 20
NONE = -1


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a serialised protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


@dataclass
class Model:
    """A vocabulary of merges with byte fallback, as tables.

    rank orders merges (0 first); left and right are the two pieces of a piece's last merge, itself for single
    characters; pairs, sorted, are left * size + right of all pieces' cuts in two, joined the pieces they make. Pieces
    that merging never makes are not in usable.
    """

    pieces: list[str]
    byte_of: dict[int, int]
    rank: np.ndarray
    left: np.ndarray
    right: np.ndarray
    pairs: np.ndarray
    joined: np.ndarray
    usable: np.ndarray
    unknown: int
    dummy_prefix: bool

    def __post_init__(self):
        # Texts are cut only where no merge can cross: around \n, \t and \r if no longer piece holds them, and before
        # spaces if no piece has one after another character.
        joint = [p for i, p in enumerate(self.pieces) if self.rank[i] >= 0 and len(p) > 1]
        alone = "".join(c for c in "\n\t\r" if not any(c in p for p in joint))
        other = f"[^{alone}]" if alone else "[\\s\\S]"
        inner = any(SPACE in p.lstrip(SPACE) for p in joint)
        word = f"{other}+" if inner else f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+"
        self.words = re.compile(f"[{alone}]|{word}" if alone else word)
        self.ranks = self.rank.tolist()
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.rank[i] >= 0}
        self.byte_id = {b: i for i, b in self.byte_of.items()}
        self.known = frozenset(p for p in self.ids if len(p) == 1)
        self.raw = [bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(SPACE, " ").encode() if self.rank[i] >= 0 else b"" for i, p in enumerate(self.pieces)]
        self.size = np.array([len(p) for p in self.pieces], np.int32)
        # Code points of the usable pieces, 0 past their end.
        self.points = np.zeros((len(self.pieces), int(self.size[self.usable].max(initial=1))), np.uint32)
        for i in np.flatnonzero(self.usable).tolist():
            self.points[i, : self.size[i]] = [ord(c) for c in self.pieces[i]]
        self.cache = np.full(1 << CACHE_BITS, -2, np.int64)


def load_model(data: bytes) -> Model:
    """A Model from the bytes of a .model file; merges are simulated once for every piece."""
    pieces, scores, kinds, dummy = [], [], [], True
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            pieces.append(own[1].decode())
            scores.append(struct.unpack("<f", own.get(2, b"\0\0\0\0"))[0])
            kinds.append(own.get(3, 1))
        elif number == 3:
            dummy = bool(dict(_fields(value)).get(3, 1))
    n = len(pieces)
    order = sorted((i for i in range(n) if kinds[i] == 1), key=lambda i: (-scores[i], i))
    rank = np.full(n, NONE)
    rank[order] = np.arange(len(order))
    by_text = {pieces[i]: i for i in order}
    ranks = rank.tolist()
    left, right, usable = np.arange(n), np.arange(n), np.zeros(n, bool)
    pairs = {}
    for i in order:
        p = pieces[i]
        for k in range(1, len(p)):
            a, b = by_text.get(p[:k]), by_text.get(p[k:])
            if a is not None and b is not None:
                pairs[a * n + b] = i
        made, last = greedy(p, by_text, ranks)
        usable[i] = made == [i]
        if usable[i] and last:
            left[i], right[i] = last
    keys = np.array(sorted(pairs), np.int64)
    return Model(pieces, {i: int(pieces[i][3:5], 16) for i in range(n) if kinds[i] == 6}, rank, left, right, keys, np.array([pairs[k] for k in keys.tolist()], np.int64), usable, kinds.index(2), dummy)


def greedy(text: str, by_text: dict[str, int], ranks: list[int]) -> tuple[list[int | None], tuple[int, int] | None]:
    """The merges of a text, the best-ranked first and of equals the leftmost: ids (None: not a piece), and the last merge."""
    parts = list(text)
    after = list(range(1, len(parts) + 1))
    before = list(range(-1, len(parts) - 1))
    heap = []

    def offer(i: int) -> None:
        j = after[i]
        if j < len(parts) and (k := by_text.get(parts[i] + parts[j])) is not None:
            heapq.heappush(heap, (ranks[k], i, j, len(parts[i]) + len(parts[j])))

    for i in range(len(parts) - 1):
        offer(i)
    last = None
    while heap:
        _, i, j, size = heapq.heappop(heap)
        if not parts[i] or after[i] != j or len(parts[i]) + len(parts[j]) != size:
            continue
        last = by_text.get(parts[i]), by_text.get(parts[j])
        parts[i] += parts[j]
        parts[j] = ""
        after[i] = after[j]
        if after[i] < len(parts):
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [by_text.get(p) for p in parts if p], last


def seams(model: Model, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether merging leaves the pieces a and b, side by side, as they are: no earlier merge crosses their seam."""
    ok = np.ones(len(a), bool)
    live = np.arange(len(a))
    a, b = a.copy(), b.copy()
    limit = np.full(len(a), np.iinfo(np.int64).max)  # merges across the seam before this rank tear it
    n = len(model.pieces)
    base = lambda x: model.left[x] == x
    while len(live):
        code = a * n + b
        at = np.minimum(np.searchsorted(model.pairs, code), len(model.pairs) - 1)
        made = np.where(model.pairs[at] == code, model.rank[model.joined[at]], np.iinfo(np.int64).max)
        torn = made < limit
        ok[live[torn]] = False
        # Undo the later of the two pieces' own merges: what it joined lay open before.
        ra, rb = np.where(base(a), -1, model.rank[a]), np.where(base(b), -1, model.rank[b])
        done = torn | ((ra < 0) & (rb < 0))
        undo_a = ra > rb
        # While a's right part lies open, only merges before a's own count; on a tie in rank the left one came first.
        limit = np.where(undo_a, ra, rb + 1)
        a, b = np.where(undo_a, model.right[a], a), np.where(undo_a, b, model.left[b])
        keep = ~done
        live, a, b, limit = live[keep], a[keep], b[keep], limit[keep]
    return ok


def _may_follow(model: Model, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    code = a.astype(np.int64) * len(model.pieces) + b
    slot = ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
    seen = model.cache[slot]
    out = (seen & 1).astype(bool)
    new = np.flatnonzero(seen >> 1 != code)
    if len(new):
        codes, back = np.unique(code[new], return_inverse=True)
        ok = seams(model, codes // len(model.pieces), codes % len(model.pieces))
        out[new] = ok[back]
        model.cache[slot[new]] = code[new] * 2 + out[new]
    return out


def edges_of(model: Model, text: str) -> tuple[np.ndarray, np.ndarray]:
    """(starts, pieces): all occurrences of usable pieces in text, by its suffixes in order."""
    n, most = len(text), model.points.shape[1]
    alphabet, codes = np.unique(np.frombuffer(text.encode("utf-32-le"), np.uint32), return_inverse=True)
    bits = int(len(alphabet) + 1).bit_length()
    width = 64 // bits
    padded = np.zeros(n + max(width, most), np.uint32)
    np.add(codes, 1, out=padded[:n], casting="unsafe")
    del codes
    key = np.zeros(n, np.uint64)
    for k in range(width):  # the first characters of each suffix as one number
        key <<= np.uint64(bits)
        key |= padded[k : k + n]
    suffixes = np.argsort(key).astype(np.int32)
    key = key[suffixes]
    # The usable pieces in the same codes, 0 past their end; those with characters that the text has not are left out.
    ids = np.flatnonzero(model.usable)
    at = np.minimum(np.searchsorted(alphabet, model.points[ids]), len(alphabet) - 1)
    inside = np.arange(most) < model.size[ids][:, None]
    found = inside & (alphabet[at] == model.points[ids])
    whole = (found == inside).all(axis=1)
    ids, coded = ids[whole].astype(np.int32), np.where(found, at + 1, 0)[whole].astype(np.uint32)
    low = np.zeros(len(ids), np.uint64)
    for k in range(width):
        low <<= np.uint64(bits)
        if k < most:
            low |= coded[:, k]
    free = (bits * (width - np.minimum(width, model.size[ids]))).astype(np.uint64)
    begin = np.searchsorted(key, low, "left")
    size = np.searchsorted(key, low + (np.uint64(1) << free) - np.uint64(1), "right") - begin
    del key
    total = int(size.sum())
    places = np.repeat((begin - np.cumsum(size) + size).astype(kind := np.int32 if total < 2**31 else np.int64), size)
    places += np.arange(total, dtype=kind)
    start = suffixes[places]
    del places
    row = np.repeat(np.arange(len(ids), dtype=np.int32), size)
    # Of pieces longer than a key, what follows is compared key by key.
    long = np.flatnonzero(model.size[ids[row]] > width)
    if len(long):
        keep = np.ones(len(row), bool)
        for k in range(width, most):
            long = long[model.size[ids[row[long]]] > k]
            keep[long] &= padded[start[long] + k] == coded[row[long], k]
        start, row = start[keep], row[keep]
    return start, ids[row]


def encode_words(model: Model, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, first): the pieces of each word, one after the other. Words hold known characters only and no run of spaces."""
    if not words:
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    size = np.array([len(w) for w in words], np.int32)
    begin = np.cumsum(size, dtype=np.int32) - size
    start, piece = edges_of(model, "".join(words))
    word = np.repeat(np.arange(len(words), dtype=np.int32), size)[start]
    end = start + model.size[piece]
    inside = end <= begin[word] + size[word]
    start, piece, end, word = start[inside], piece[inside], end[inside], word[inside]
    depth = end - begin[word]
    # Counted in 16 bits the sort is linear; longer words take the general one.
    order = np.argsort(depth.astype(np.uint16) if size.max() < 2**16 else depth, kind="stable")
    start, piece, end, depth = start[order], piece[order], end[order], depth[order]
    first_place = start == begin[word[order]]
    last = np.full(int(size.sum()) + 1, NONE, np.int32)  # by end: the piece that ends the encoding up to there
    # last is indexed by the end within the joint text; an end that is another word's start is told apart by first_place.
    cuts = np.flatnonzero(np.append(True, depth[1:] != depth[:-1]))
    for a, b in zip(cuts, np.append(cuts[1:], len(depth))):
        ok = first_place[a:b].copy()
        rest = np.flatnonzero(~ok)
        ok[rest] = _may_follow(model, last[start[a:b][rest]], piece[a:b][rest])
        last[end[a:b][ok]] = piece[a:b][ok]
    at, live = begin + size, np.arange(len(words))
    own, places, pieces = [], [], []
    while len(live):
        p = last[at]
        own.append(live)
        places.append(at)
        pieces.append(p)
        at = at - model.size[p]
        more = at > begin[live]
        at, live = at[more], live[more]
    own, places, pieces = np.concatenate(own), np.concatenate(places), np.concatenate(pieces)
    order = np.argsort(places)
    return pieces[order], np.append(0, np.cumsum(np.bincount(own, minlength=len(words))))


def _plain(model: Model, word: str) -> list[int]:
    """The ids of any word by merging it directly."""
    out: list[int] = []
    ids, _ = greedy(word, model.ids, model.ranks)
    at = iter(word)
    for i in ids:
        if i is None:
            out += [model.byte_id.get(b, model.unknown) for b in next(at).encode()]
        else:
            out.append(i)
            for _ in range(len(model.pieces[i])):
                next(at)
    return out


def encode_batch(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, first) of texts; a null or empty text has no pieces."""
    # Counted apart: with its own __len__ as its factory the table would hold itself and stay until garbage is collected.
    number: defaultdict[str, int] = defaultdict(itertools.count().__next__)
    rows, counts = [], []
    for t in texts:
        found = model.words.findall((SPACE if model.dummy_prefix else "") + t.replace(" ", SPACE)) if t else []
        rows += [number[w] for w in found]
        counts.append(len(found))
    words = list(number)
    plain = [SPACE * 2 not in w and model.known.issuperset(w) for w in words]
    whole = [w for w, p in zip(words, plain) if p]
    group = np.cumsum([len(w) for w in whole]) // INDEX_CHARS
    cuts = [*runs_equal(group).tolist(), len(whole)]
    parts = [encode_words(model, whole[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
    ids = np.concatenate([np.zeros(0, np.int32), *(p for p, _ in parts)])
    size = np.zeros(len(words), np.int64)
    size[plain] = np.concatenate([np.zeros(0, np.int64), *(np.diff(f) for _, f in parts)])
    base = np.zeros(len(words), np.int64)
    base[plain] = np.cumsum(size[plain]) - size[plain]
    other = []
    for k, (w, p) in enumerate(zip(words, plain)):
        if not p:
            own = _plain(model, w)
            base[k], size[k] = len(ids) + len(other), len(own)
            other += own
    ids = np.append(ids, np.array(other, np.int32))
    rows = np.array(rows, np.int64)
    n = size[rows]
    flat = ids[np.repeat(base[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())]
    ends = np.append(0, np.cumsum(n))
    return flat, ends[np.append(0, np.cumsum(counts))]


def decode(model: Model, ids: list[int]) -> str:
    """The text of ids: pieces joined, byte pieces as bytes, the first space (the prefix) taken off."""
    data = b"".join([model.raw[i] for i in ids])
    if model.dummy_prefix and data[:1] == b" ":
        data = data[1:]
    return data.decode("utf-8", "replace")


def encode(docs: DataFrame, model_path: str = MODEL) -> DataFrame:
    """docs(doc_id, text, ...) with n_tokens, ids (array<int>) and round_trip.

    round_trip says whether decoding the ids gives the text back (with U+2581 read as a space, which is what the format
    makes of it). A null text has null ids; an empty one has none; rows repeated in full are encoded one by one; an
    empty table gives an empty result; all columns of docs stay but for those named n_tokens, ids or round_trip.
    """
    with open(model_path, "rb") as f:
        model = load_model(f.read())
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the vocabulary, a few MB whatever the input
    names = [c for c in docs.columns if c not in ("n_tokens", "ids", "round_trip")]
    docs = docs.select(*names)
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names), "n_tokens int, ids array<int>, round_trip boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "text", SLICE_BYTES):
                texts = batch.column("text").to_pylist()
                ids, first = encode_batch(shared.value, texts)
                none = pc.is_null(batch.column("text"))
                back = [None if t is None else decode(shared.value, ids[a:b].tolist()) == t.replace(SPACE, " ") for t, a, b in zip(texts, first[:-1].tolist(), first[1:].tolist())]
                offsets = pa.array(first.astype(np.int32), mask=np.append(none.to_numpy(zero_copy_only=False), False))
                own = pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32, copy=False)))
                n = pa.array(np.diff(first).astype(np.int32), mask=none.to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([*batch.columns, n, own, pa.array(back, pa.bool_())], [*names, "n_tokens", "ids", "round_trip"])

    return docs.mapInArrow(run, schema)
