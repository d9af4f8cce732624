import pickle

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from matchloom.functions.automaton import compile_patterns, human_bytes
from matchloom.functions.kernel import scan_texts


def brute(patterns, texts):
    return sorted((r, i + len(p) - 1, k) for r, t in enumerate(texts) for k, p in enumerate(patterns) for i in range(len(t)) if t.startswith(p, i))


def found(patterns, texts):
    a = compile_patterns(patterns)
    return sorted((int(r), int(e), int(p)) for part in scan_texts(a, pa.array(texts, pa.binary())) for r, e, p in zip(*part))


CASES = {
    "nested": ([b"ox", b"fox", b"boxer", b"xe"], b"a fox and a boxer, foxes in boxes", (10, 13, 7)),
    "turning": ([b"xyx", b"yxy", b"xyxyx", b"y"], b"xyxyxyxyzyxyx" * 3, None),
    "far": ([b"A_PATTERN_OF_MANY_LETTERS", b"of", b"F"], b"..A_PATTERN_OF_MANY_LETTERS of F.." * 40, None),
    "runs": ([b"z", b"zz", b"zzz"], b"z" * 700, (2097, 4, 6)),
    "tails": ([b"s", b"ts", b"sts", b"ests"], b"tests rests " * 150, None),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(name):
    patterns, text, figures = CASES[name]
    a = compile_patterns(patterns)
    own = found(patterns, [text])
    prefixes = {p[:k] for p in patterns for k in range(len(p) + 1)}
    outputs = sum(x.endswith(p) for x in prefixes for p in patterns)
    assert own == brute(patterns, [text]) and (a.states, len(a.pids)) == (len(prefixes), outputs) and (figures is None or (len(own), a.states, len(a.pids)) == figures)
    assert a.footprint() == 1040 * a.states + 8 * len(patterns) + 4 * outputs + sum(map(len, patterns)) + 16 * len(patterns)
    back = pickle.loads(pickle.dumps(a))  # what a worker gets scans alike
    assert back.step is None and scan_all(back, text) == scan_all(a, text)


def scan_all(a, text):
    return [tuple(x.tolist() for x in part) for part in scan_texts(a, pa.array([text], pa.binary()))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=4).map(lambda b: bytes(x % 3 * 127 for x in b)), max_size=6), st.lists(st.binary(max_size=40).map(lambda b: bytes(x % 3 * 127 for x in b)), max_size=6))
def test_random(patterns, texts):
    assert found(patterns, texts) == brute(patterns, texts)


def test_emission_order_and_duplicates():
    a = compile_patterns([b"b", b"ab", b"b"])
    ((_, ends, pids),) = scan_texts(a, pa.array([b"ab"]))
    assert pids.tolist() == [1, 2, 0]


def test_empty():
    assert found([], [b"abc"]) == [] and found([b"a"], [b"", b""]) == [] and compile_patterns([]).states == 1
    assert compile_patterns([]).min_length == 0
    with pytest.raises(ValueError):
        compile_patterns([b""])


def test_human_bytes():
    assert [human_bytes(x) for x in (5, 2048, 3 << 20, 5 << 30)] == ["5 B", "2.00 KiB", "3.00 MiB", "5.00 GiB"]
