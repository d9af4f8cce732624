"""Words of many texts at once and hashes of runs of words, in numpy.

There are two hash functions of 64 bits with keys of their own (lane 0 and 1). Where equality of words decides a result,
one finds candidates and the other confirms them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[ord("A") : ord("Z") + 1] += 32
#: Odd multipliers, one for each of the hash functions that are told apart by lane.
_STEPS = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15))
_KEYS = (np.uint64(0x2545F4914F6CDD1D), np.uint64(0x5851F42D4C957F2D))
#: The first k bytes of eight.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
SLICE = 2_000_000  # bytes of text that are worked on at once
LONG = 64  # bytes of a word from which on it is hashed by itself


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _pieces(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts of data into slices of about SLICE bytes, each beginning with white space."""
    begin = 0
    while begin < len(data):
        end = begin + SLICE
        while end < len(data) and not IS_SPACE[data[end]]:
            end += 1
        yield begin, min(end, len(data))
        begin = end


@dataclass
class Words:
    """Words of a batch of texts: their hashes, the text each belongs to, and the texts' first word (one more at the end)."""

    hashes: np.ndarray
    row: np.ndarray
    first: np.ndarray
    lane: int = 0

    @property
    def place(self) -> np.ndarray:
        """Each word's number in its text."""
        return np.arange(len(self.row)) - self.first[self.row]


def _hash_slices(part: np.ndarray, at: np.ndarray, size: np.ndarray, lane: int) -> np.ndarray:
    """64-bit hashes of the words part[at : at + size]: eight bytes at a time, each followed by a bijection that spreads them.

    So words of the same size of up to eight bytes never collide, others by chance only; words beyond LONG bytes go
    through BLAKE2.
    """
    padded = np.append(part, np.zeros(8, np.uint8))
    eight = np.ndarray(len(part) + 1, "<u8", padded, 0, (1,))
    with np.errstate(over="ignore"):
        h = mix((size.astype(np.uint64) + np.uint64(1)) * _KEYS[lane])
        own, done = np.flatnonzero(size <= LONG), 0
        while len(own):
            word = eight[at[own] + done] & _MASKS[np.minimum(size[own] - done, 8)]
            h[own] = mix(h[own] * _STEPS[lane] ^ word)
            done += 8
            own = own[size[own] > done]
    key = int(_KEYS[lane]).to_bytes(8, "little")
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(part[at[i] : at[i] + size[i]].data, digest_size=8, key=key).digest(), "little")
    return h


def hash_words(texts: pa.Array, fold: bool = False, lane: int = 0) -> Words:
    """The words of an array of strings; a null string has none. fold: A-Z count as a-z. lane: one of two hash functions."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if n and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0] if n else np.zeros(1, np.int64)
    hashes, places = [], []
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    for a, b in _pieces(data):
        part = _FOLDED[data[a:b]] if fold else data[a:b]
        word = ~IS_SPACE[part]
        start = word.copy()
        start[1:] &= ~word[:-1] | begins[a + 1 : b]
        end = word.copy()
        end[:-1] &= ~word[1:] | begins[a + 1 : b]
        at = np.flatnonzero(start)
        if not len(at):
            continue
        hashes.append(_hash_slices(part, at, np.flatnonzero(end) + 1 - at, lane))
        places.append(at + a)
    hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    places = np.concatenate(places) if places else np.zeros(0, np.int64)
    row = np.searchsorted(offsets, places, "right") - 1
    return Words(hashes, row, np.searchsorted(row, np.arange(n + 1)), lane)


def _joined(h: np.ndarray, more: np.ndarray, lane: int) -> np.ndarray:
    """The hash of a run that goes on by a word; the shift keeps it from being a polynomial."""
    return (h ^ (h >> np.uint64(29))) * _STEPS[lane] + more


def hash_runs(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes): the runs of size consecutive words of one text, by the number of their first word."""
    n = len(words.hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for k in range(size):
            h = _joined(h, words.hashes[k : k + n], words.lane)
        h = mix(h)
    own = np.flatnonzero(words.row[:n] == words.row[size - 1 :])
    return own, h[own]


def runs_equal(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys in a sorted array, or in several side by side."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def found_in(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each key its place in the sorted table, or -1."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def found_pairs(table: np.ndarray, checks: np.ndarray, keys: np.ndarray, own: np.ndarray) -> np.ndarray:
    """For each key with its own check number its place in the table, sorted by key, or -1; keys may repeat with other checks."""
    at = np.searchsorted(table, keys)
    while True:
        inside = np.minimum(at, len(table) - 1)
        other = np.flatnonzero((at < len(table)) & (table[inside] == keys) & (checks[inside] != own)) if len(table) else at[:0]
        if not len(other):
            break
        at[other] += 1
    if not len(table):
        return np.full(len(keys), -1)
    return np.where((at < len(table)) & (table[inside] == keys), at, -1)


def by_bytes(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose strings of one column have about most bytes together; a longer string is a slice of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < batch.num_rows:
        end = int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + most, "right"))
        end = min(max(end, begin + 1), batch.num_rows)
        yield batch.slice(begin, end - begin)
        begin = end


def hash_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(elements, first): each text's distinct runs of size words, sorted; element first[i] is the first of text i.

    A text of fewer words has all its words as its only run; one without words has none.
    """
    at, h = hash_runs(words, size)
    row = words.row[at]
    n = np.diff(words.first)
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        with np.errstate(over="ignore"):
            own = np.zeros(len(short), np.uint64)
            for k in range(size - 1):
                has = k < n[short]
                own[has] = _joined(own[has], words.hashes[words.first[short[has]] + k], words.lane)
            own = mix(own + n[short].astype(np.uint64))
        row, h = np.append(row, short), np.append(h, own)
        order = np.argsort(row, kind="stable")
        row, h = row[order], h[order]
    first = np.searchsorted(row, np.arange(len(n) + 1))
    for a, b in zip(first[:-1], first[1:]):
        h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[keep], np.concatenate([[0], np.cumsum(keep)])[first]
