"""The scan itself: many lanes of one buffer step through an automaton together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .automaton import Automaton

LANES = 16384
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32


def scan_buffer(a: Automaton, data: np.ndarray, lanes: int = LANES) -> tuple[np.ndarray, np.ndarray]:
    """(ends, states): every place (the last byte of a match) whose state has outputs, in order."""
    n = len(data)
    if not n or not len(a.pids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    halo = a.halo
    lanes = max(1, min(lanes, n // max(64, 4 * halo) or 1))
    size = -(-n // lanes)
    buffer = np.zeros(halo + size * lanes, a.classes.dtype)
    buffer[halo : halo + n] = a.classes[data]
    view = np.lib.stride_tricks.as_strided(buffer, (lanes, size + halo), (size * buffer.itemsize, buffer.itemsize))
    columns = np.ascontiguousarray(view.T)
    step, least, own = a.lanes
    state, index, hit = np.zeros(lanes, step.dtype), np.zeros(lanes, np.intp), np.zeros(lanes, bool)
    base = np.arange(lanes, dtype=np.int64) * size
    found = np.zeros(size * lanes, np.int32)  # the state at each place that has outputs; 0 never has
    for t in range(size + halo):
        np.add(state, columns[t], out=index)
        np.take(step, index, out=state, mode="clip")
        if t >= halo:
            np.greater_equal(state, least, out=hit)
            at = np.flatnonzero(hit)
            if len(at):
                found[base[at] + (t - halo)] = own[(state[at] - least) // a.width]
    ends = np.flatnonzero(found[:n])
    return ends, found[ends].astype(np.int64)


def expand(a: Automaton, ends: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ends, pattern ids) of all outputs, in order of emission."""
    n = a.count[states]
    at = np.repeat(a.first[states] - np.cumsum(n) + n, n) + np.arange(n.sum())
    return np.repeat(ends, n), a.pids[at]


def scan_texts(a: Automaton, texts: pa.Array, nocase: bool = False, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, end, pattern id) of all matches in an array of binaries, in parts of about most bytes of text.

    A match is kept if it starts inside the text in which it ends; what lanes or neighbours add starts before.
    """
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + most, "right")) - 1)
        end = min(end, len(texts))
        part = data[offsets[begin] : offsets[end]]
        ends, states = scan_buffer(a, FOLD[part] if nocase else part)
        own = offsets[begin : end + 1] - offsets[begin]
        # Matches may be many times the text: they are expanded a million at a time.
        cuts = np.searchsorted(np.cumsum(a.count[states]), np.arange(0, a.count[states].sum(), 1_000_000)) if len(states) else []
        for x, y in zip(cuts, [*cuts[1:], len(states)]):
            e, p = expand(a, ends[x:y], states[x:y])
            row = np.searchsorted(own, e, "right") - 1
            keep = e - a.lengths[p] + 1 >= own[row]
            yield row[keep] + begin, (e - own[row])[keep], p[keep]
        begin = end
