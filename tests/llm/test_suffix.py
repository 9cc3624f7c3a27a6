import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ethoflow.llm.suffix import SuffixAutomaton, permuted_common_prefixes, suffix_array


def brute(t):
    t = list(t)
    return sorted(range(len(t)), key=lambda i: t[i:])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60), st.sampled_from([4, 1000]))
def test_suffix_array_and_prefixes(letters, alphabet):
    t = np.array([*letters, 0])
    order = suffix_array(t, alphabet)
    assert order.tolist() == brute(t)
    got = permuted_common_prefixes(t, order, 9)
    for before, at in zip(order, order[1:]):
        k = 0
        while at + k < len(t) and before + k < len(t) and t[at + k] == t[before + k]:
            k += 1
        assert got[at] == min(k, 9)


def test_long_runs_and_repeats():
    r = random.Random(4)
    piece = [r.randrange(1, 30) for _ in range(300)]
    t = np.array([7] * 400 + piece + [r.randrange(1, 256) for _ in range(500)] + piece + [7] * 300 + [0])
    assert suffix_array(t, 257).tolist() == brute(t)


@settings(max_examples=100, deadline=None)
@given(st.text("ab", max_size=40), st.text("ab", max_size=40))
def test_automaton(text, probe):
    a = SuffixAutomaton()
    a.extend(text)
    for e, got in enumerate(a.matching(probe), 1):
        assert got == max(k for k in range(e + 1) if probe[e - k : e] in text)
