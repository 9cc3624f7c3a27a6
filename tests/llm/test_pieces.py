import math
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ethoflow.llm.pieces import MARK, MODEL, Pieces, load, tokens
from ethoflow.llm.queries import QUERIES

SMALL = ["a", "b", "ab", "aba", MARK, MARK + "a", MARK + "ab", MARK + MARK, "é", "bé", MARK + "béa"]


def small(extra=()):
    own = [None, *SMALL, *extra]
    return Pieces(own + [None] * 256, [0.0] + [-1.0 - 0.37 * i for i in range(len(own) - 1)] + [0.0] * 256, list(range(len(own), len(own) + 256)))


def brute(v, text):
    """Viterbi over characters with a plain dictionary."""
    if not text:
        return []
    letters = [MARK] + [("literal" if c == MARK else MARK if c == " " else c) for c in text]
    ids = {p: i for i, p in enumerate(v.pieces) if p is not None}
    top, path = [0.0] + [-math.inf] * len(letters), [[]] + [None] * len(letters)
    for s in range(len(letters)):
        for e in range(s + 1, len(letters) + 1):
            piece = "".join(letters[s:e]) if "literal" not in letters[s:e] else None
            if piece in ids and top[s] + v.scores[ids[piece]] > top[e] + 1e-12:
                top[e], path[e] = top[s] + v.scores[ids[piece]], path[s] + [ids[piece]]
        raw = (MARK if letters[s] == "literal" else letters[s]).encode()
        if top[s] + len(raw) * v.fallback > top[s + 1] + 1e-12:
            top[s + 1], path[s + 1] = top[s] + len(raw) * v.fallback, path[s] + [v.byte_ids[b] for b in raw]
    return path[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abé ▁\nx日😀", max_size=14), st.booleans())
def test_viterbi_and_round_trip(text, crossing):
    v = small(["a" + MARK + "b"] if crossing else [])
    assert v.whole == crossing
    ids = np.frombuffer(v.encoder()(text), np.int32).tolist()
    assert ids == brute(v, text)
    assert v.decode(ids) == text


@pytest.mark.skipif(not os.path.exists(MODEL), reason="no model file")
def test_model_against_brute_force(spark):
    v = load()
    for text in ("The cat, sat.\n\nÉa ça  va?", "naïve 日本語 😀 ñandú", " lead  and trail ", MARK + "x" + MARK):
        ids = np.frombuffer(v.encoder()(text), np.int32).tolist()
        assert ids == brute(v, text) and v.decode(ids) == text
    rows = [(1, None, 0), (2, "", 1), (3, "word " * 20000, 2), (None, "x y", 3), (2, "", 1)]
    got = tokens(spark.createDataFrame(rows, "doc_id long, text string, ids int")).collect()
    assert sorted((str(r.doc_id), r.decoded) for r in got) == sorted((str(r[0]), r[1] or "") for r in rows)
    assert tokens(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    told = QUERIES["op3_sentencepiece"](spark, "/root/testdata/sf0.001").collect()
    assert len(told) == 200 and all(r.round_trip for r in told)
