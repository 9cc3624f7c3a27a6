"""Ranked search against scoring every document."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from ethoflow.llm import queries
from ethoflow.llm import ranked_search as rs
from tests.oracle import compare

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
KIND, ITEMS = "doc_id long, text string", "item_id string, text string"


def terms(t):
    return TERM.findall((t or "").translate(_LOW))


def brute(docs, items, k):
    words = [(i, terms(t)) for i, t in docs]
    words = [(i, w) for i, w in words if w]
    n_docs, n_terms = len(words), sum(len(w) for _, w in words)
    df = {}
    for _, w in words:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, q in asked.items():
        scored = []
        for d, w in words:
            m = 10 + 90 * len(w) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((10**9 * w.count(x)) // (1000 * w.count(x) + 8 * m)) for x in q if x in df and x in w)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


def corpus(seed, n=600):
    r = random.Random(seed)
    pool = [f"w{int(r.paretovariate(0.8))}" for _ in range(400)] + ["The", "the", "über", "日本", "Über", "a1"]
    text = lambda a, b: r.choice([" ", ", ", "-"]).join(r.choice(pool) for _ in range(r.randint(a, b)))
    docs = [(k, text(0, 60)) for k in range(n)]
    docs += docs[5:9] + [(n + j, docs[3][1]) for j in range(30)] + [(None, docs[3][1]), (None, None), (n + 50, None), (n + 51, ""), (n + 52, "?!"), (n + 53, "w1 " * 50_000)]
    items = [(f"i{j}", text(1, 12)) for j in range(25)] + [("i1", "the w2"), ("none", "zzz"), ("null", None), (None, "w1 w2 w3"), ("same", docs[3][1])]
    return docs, items


def got(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed,k", [(1, 10), (2, 1), (3, 50)])
def test_as_brute(spark, seed, k):
    docs, items = corpus(seed)
    d, i = spark.createDataFrame(docs, KIND).repartition(4), spark.createDataFrame(items, ITEMS)
    assert got(rs.ranked_search(d, i, k)) == brute(docs, items, k)


def test_blocks_of_items(spark):
    docs, items = corpus(4)
    d, i = spark.createDataFrame(docs, KIND).repartition(3), spark.createDataFrame(items, ITEMS)
    assert got(rs.ranked_search(d, i, 10, limit=1500)) == brute(docs, items, 10)


def test_small_shards(spark, monkeypatch):
    monkeypatch.setattr(rs, "SHARD_DOCS", 1)
    docs, items = corpus(5)
    words = [(i, terms(t)) for i, t in docs]
    known = np.unique(rs._terms([(t or "").encode() for _, t in items]).hash)
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs], pa.int64()), pa.array([t for _, t in docs])], names=["doc_id", "text"])
    held = list(rs._postings([batch], known))
    assert sum(b.num_rows for b in held) == sum(bool(w) for _, w in words)
    assert sum(t.num_rows for t in rs._shards(held)) == sum(bool(w) for _, w in words)


def test_few_documents_are_scored():
    r = np.random.default_rng(1)
    texts = [" ".join(f"w{int(x)}" for x in r.zipf(1.3, 80) if x < 10**6) for _ in range(20_000)]
    items = [" ".join(f"w{int(x)}" for x in r.zipf(1.3, 20) if x < 10**6) for _ in range(20)]
    sets = [np.unique(rs._terms([t.encode()]).hash) for t in items]
    known = np.unique(np.concatenate(sets))
    held = list(rs._postings([pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])], known))
    table = pa.Table.from_batches(held)
    df = np.bincount(np.concatenate([b.column(2).flatten().to_numpy() for b in held]), minlength=len(known))
    n, total = table.num_rows, int(sum(table.column("n").to_pylist()))
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df], np.int64)
    shard = rs.Shard(table, weights, n, total)
    scored = sum(shard.search(np.searchsorted(known, s), rs.Heap(10)) for s in sets)
    touched = sum(len(np.unique(np.concatenate([shard.docs[shard.first[t] : shard.first[t + 1]] for t in np.searchsorted(known, s)]))) for s in sets)
    assert scored < 0.2 * touched


@pytest.mark.parametrize("docs,items", [([], []), ([], [("i", "a")]), ([(1, "a")], []), ([(1, None)], [("i", "a")]), ([(1, "a")], [("i", "")])])
def test_empty(spark, docs, items):
    assert got(rs.ranked_search(spark.createDataFrame(docs, KIND), spark.createDataFrame(items, ITEMS))) == brute(docs, items, 10)


def test_other_columns(spark):
    docs = spark.createDataFrame([(1, "b a", 5, "x"), (2, "b", 6, "y"), (3, "c", 6, "y")], "doc_id int, text string, score int, item_id string")
    items = spark.createDataFrame([(7, "A", 9, 1)], "item_id long, text string, rank int, doc_id int")
    told = rs.ranked_search(docs, items)
    assert [(r.item_id, r["rank"], r.doc_id) for r in told.collect()] == [(7, 1, 1)] and told.schema["item_id"].dataType.simpleString() == "bigint"


def test_query(spark):
    for sf in ("sf0.001", "sf0.01"):
        assert compare(spark, queries.QUERIES["op12_ranked_search"], queries.ORACLES["op12_ranked_search"], f"/root/testdata/{sf}") > 300
