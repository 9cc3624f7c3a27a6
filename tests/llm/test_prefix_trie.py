"""The prefix trie against plain dictionaries."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from ethoflow.llm import prefix_trie as pt
from ethoflow.llm import queries
from tests.oracle import compare

KIND = "conv_id long, turn int, role string, text string"


def rebuilt(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:]
    return out


def brute(convs):
    """convs: {conv_id: [(role, text), ...]}."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        own = kids.get(k, [])
        leaves[k] = sum(leaves[x] for x in own) if own else 1
        saved[k] = sum(saved[x] for x in own) + (len(members[k]) - 1) * (len(k[-1][1].encode()) if k else 0)
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(k))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids.get(k, [])), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def rows_of(seed, n=200):
    r = random.Random(seed)
    pool = [("user", "hi"), ("user", "héllo"), ("assistant", "ok"), (None, "x"), ("user", None), ("", ""), ("user", "a" * 500)]
    rows = []
    for c in range(n):
        like = r.choice([0, 1, 2])
        for t in range(r.randint(1, 9)):
            role, text = pool[0 if like == 0 else r.randrange(2) if like == 1 else r.randrange(len(pool))]
            rows.append((c * r.choice([1, 1, 7]), r.choice([t, t, None, 3]), role, text))
    return rows + [(None, 0, "user", "lost"), (-3, 0, "user", "hi"), (10**12, 0, "user", "hi")] + [(5 * n, t, "user", "hi") for t in range(40)]


@pytest.mark.parametrize("most", [2, 5, 128])
def test_rebuilt_as_brute(spark, most):
    rows = rows_of(most)
    own = pt.placed(spark.createDataFrame(rows, KIND).repartition(5))
    assert got(pt.prefix_trie(pt.branched(own), own.select("conv_id"), most)) == brute(rebuilt(rows))


@pytest.mark.parametrize("most", [1 << 20, 3])
def test_plain_conversations(spark, most):
    convs = {c: [("user", "hi")] * (c % 7) + [("assistant", str(c % 3))] for c in range(300)}
    rows = [(c, t, *x) for c, v in convs.items() for t, x in enumerate(v)]
    assert got(pt.prefix_trie(pt.placed(spark.createDataFrame(rows, KIND)), None, most)) == brute(convs)


def test_long_lists_of_ends(spark, monkeypatch):
    convs = {c: [("user", "same")] for c in range(10_000)}
    rows = [(c, 0, *v[0]) for c, v in convs.items()]
    assert got(pt.prefix_trie(pt.placed(spark.createDataFrame(rows, KIND).repartition(7)))) == brute(convs)


def test_one_long_conversation(spark):
    convs = {1: [("user", str(t)) for t in range(6000)], 2: [("user", str(t)) for t in range(5990)]}
    rows = [(c, t, *x) for c, v in convs.items() for t, x in enumerate(v)]
    told = {(r.conv_id, r.depth): r for r in pt.prefix_trie(pt.placed(spark.createDataFrame(rows, KIND))).collect()}
    assert len(told) == 6001 and told[1, 0].n_leaves == 1 and told[1, 0].saved_tokens == sum(len(str(t)) for t in range(5990))


@pytest.mark.parametrize("rows", [[], [(None, 0, "user", "x")], [(3, None, None, None)], [(1, 0, "user", "a"), (1, 0, "user", "a")]])
def test_empty_and_null(spark, rows):
    own = pt.placed(spark.createDataFrame(rows, KIND))
    assert got(pt.prefix_trie(pt.branched(own), own.select("conv_id"))) == (brute(rebuilt(rows)) if any(r[0] is not None for r in rows) else [])


def test_turnless_and_other_columns(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a", 5, "x")], "conv_id int, turn int, role string, text string, depth int, k1 string")
    convs = spark.createDataFrame([(1,), (2,), (2,), (None,)], "conv_id int")
    assert got(pt.prefix_trie(pt.placed(rows), convs)) == brute({1: [("user", "a")], 2: []})


def test_labels(spark):
    rows = rows_of(3, 40)
    own = pt.branched(pt.placed(spark.createDataFrame(rows, KIND), texts=True))
    convs = rebuilt(rows)
    told = pt.labelled(pt.prefix_trie(own), own).collect()
    assert len(told) == len(brute({c: v for c, v in convs.items() if v}))
    assert all((r.role, r.text) == (convs[r.conv_id][r.depth - 1] if r.depth else (None, None)) for r in told)


def test_louds_bits():
    # a root with children 1 and 2, of which 1 has a child: under the root above them 10, then 110 10 0 0
    keys = np.array([[0, 0], [1, 0], [2, 0], [3, 0]])
    trie = pt.Louds(keys, np.array([[9, 9], [0, 0], [0, 0], [1, 0]]), np.zeros((4, 2), int), np.array([4, 5, 5, 6]), np.array([7, 7, 8, 7]))
    assert "".join("01"[b] for b in trie.bits.tolist()) == "10" + "110" + "10" + "0" + "0"
    assert trie.parent.tolist() == [-1, 0, 1, 1, 2] and trie.order.tolist() == [0, 1, 2, 3]
    assert trie.summed(np.array([0, 1, 1, 1, 1])).tolist() == [4, 4, 2, 1, 1]


def test_query(spark):
    for sf in ("sf0.001", "sf0.01"):
        compare(spark, queries.QUERIES["op13_conversation_trie"], queries.ORACLES["op13_conversation_trie"], f"/root/testdata/{sf}")
