"""Compiling a dictionary of byte patterns into one automaton of numpy tables, and figures about it."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np


@dataclass
class Automaton:
    """step[state, class] is the next state; bytes map to classes, so unused bytes share a column.

    Outputs of a state are pids[first[s]:first[s] + count[s]]: the longest pattern first, equal patterns in descending
    id, which is the order in which a match list is emitted.
    """

    lengths: np.ndarray
    classes: np.ndarray
    step: np.ndarray
    first: np.ndarray
    count: np.ndarray
    pids: np.ndarray
    own_outputs: int
    key: str = field(default="")

    @property
    def states(self) -> int:
        return len(self.first)

    @property
    def width(self) -> int:
        """Columns of the table: classes of bytes."""
        return int(self.classes.max()) + 1

    @property
    def max_length(self) -> int:
        return int(self.lengths.max()) if len(self.lengths) else 0

    @property
    def min_length(self) -> int:
        return int(self.lengths.min()) if len(self.lengths) else 0

    @property
    def halo(self) -> int:
        """Bytes before a chunk that a scan must see: longest pattern less one."""
        return max(0, self.max_length - 1)

    @cached_property
    def lanes(self) -> tuple[np.ndarray, int, np.ndarray]:
        """(step, least, own) for a scan: states are offsets of their rows, those with outputs come last and begin at least.

        own names the latter as they are in the other tables.
        """
        order = np.argsort(self.count > 0, kind="stable")
        place = np.empty(len(order), np.int32 if self.step.size < 2**31 else np.int64)
        place[order] = np.arange(len(order)) * self.step.shape[1]
        plain = int((self.count == 0).sum())
        return place[self.step[order]].ravel(), plain * self.step.shape[1], order[plain:].astype(np.int32)

    def __getstate__(self) -> dict:
        """What a scan needs: the table as lanes have it, of which a worker holds one copy, without the other."""
        self.lanes  # noqa: B018
        return self.__dict__ | {"step": None}

    def footprint(self, pattern_record: int = 16) -> int:
        """Bytes of the dense form with 256 columns of four bytes, as the formula of the reference figures has them."""
        return self.states * 1024 + 16 * self.states + 8 * self.own_outputs + 4 * len(self.pids) + int(self.lengths.sum()) + len(self.lengths) * pattern_record


def content_key(patterns: list[bytes], ids: list[int] | None = None) -> str:
    """Names a dictionary by its content, for caches."""
    h = hashlib.sha256()
    for k, p in enumerate(patterns):
        h.update(f"{ids[k] if ids else k}:{len(p)}:".encode() + p)
    return h.hexdigest()


def compile_patterns(patterns: list[bytes], ids: list[int] | None = None) -> Automaton:
    """The automaton of patterns; ids default to their places. Equal patterns are all reported. ValueError for an empty one.

    States are the distinct prefixes, level by level; each level's rows are copied from those of its failure states at
    once, so the work is a few numpy calls per level however many states there are.
    """
    if any(not p for p in patterns):
        raise ValueError("a pattern is empty")
    ids = list(range(len(patterns))) if ids is None else list(ids)
    lengths = np.zeros((max(ids) + 1) if ids else 0, np.int64)
    for i, p in zip(ids, patterns):
        lengths[i] = len(p)
    used = sorted({b for p in patterns for b in p})
    classes = np.zeros(256, np.uint8 if len(used) < 256 else np.uint16)
    classes[used] = np.arange(1, len(used) + 1)
    width = len(used) + 1
    n = len(patterns)
    size = np.array([len(p) for p in patterns], np.int64)
    at = np.zeros(n, np.int64)  # each pattern's state at the current level
    levels, edges = [np.zeros(1, np.int64)], []
    states = 1
    for depth in range(int(size.max()) if n else 0):
        live = np.flatnonzero(size > depth)
        byte = classes[np.array([patterns[k][depth] for k in live], np.int64)].astype(np.int64)
        key, back = np.unique(at[live] * width + byte, return_inverse=True)
        at[live] = states + back
        edges.append((key // width, key % width))
        levels.append(np.arange(states, states + len(key)))
        states += len(key)
    step = np.zeros((states, width), np.int32)
    fail = np.zeros(states, np.int64)
    for depth, nodes in enumerate(levels):
        if depth:
            step[nodes] = step[fail[nodes]]
        if depth < len(edges):
            parent, c = edges[depth]
            child = levels[depth + 1]
            fail[child] = step[fail[parent], c] if depth else 0
            step[parent, c] = child
    own = np.bincount(at, minlength=states) if n else np.zeros(states, np.int64)
    count = own.copy()
    for nodes in levels[1:]:
        count[nodes] += count[fail[nodes]]
    first = np.cumsum(count) - count
    pids = np.zeros(int(count.sum()), np.int32)
    order = np.lexsort([-np.array(ids, np.int64), at]) if n else np.zeros(0, np.int64)
    place = np.arange(n) - (np.cumsum(own) - own)[at[order]] if n else np.zeros(0, np.int64)
    pids[first[at[order]] + place] = np.array(ids, np.int32)[order] if n else 0
    for nodes in levels[1:]:
        more = count[nodes] - own[nodes]
        rows = np.repeat(nodes, more)
        k = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
        pids[first[rows] + own[rows] + k] = pids[first[fail[rows]] + k]
    return Automaton(lengths, classes, step, first, count, pids, n, content_key(patterns, ids))


def fold(data: bytes) -> bytes:
    """A-Z as a-z; other bytes stay."""
    return data.lower()


def human_bytes(n: float) -> str:
    """n with two decimals in B, KiB, MiB or GiB; whole bytes below 1 KiB."""
    if n < 1024:
        return f"{int(n)} B"
    for unit in ("KiB", "MiB"):
        n /= 1024
        if n < 1024:
            return f"{n:.2f} {unit}"
    return f"{n / 1024:.2f} GiB"
