import random
import re

import pytest

from ethoflow.llm.decontaminate import contaminated, contamination
from ethoflow.llm.queries import ORACLES, QUERIES
from tests.oracle import compare

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, n):
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for i, x in items:
            v = words(x)
            for s in range(max(len(v) - n, 0) + 1) if v else ():
                win = v[s : s + n]
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit |= set(range(p, p + len(win)))
                        ids |= {str(i)} if i is not None else set()
        out.append((str(d), len(w), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [1 << 24, 0])
def test_against_brute_force(spark, limit):
    r = random.Random(8)
    some = lambda k: " ".join(r.choices(["a", "b", "Cé", "É1", "dd", "e-f", "g_h", "日本", "x9"], k=k))
    items = [(1, some(20)), (2, some(13)), (3, some(5)), (10, some(30)), (4, ""), (5, None), (6, "..."), (3, some(5)), (None, some(14))]
    docs = [(i, some(r.randrange(0, 120)) + " " + (r.choice(items)[1] or "").upper().replace("É", "É")) for i in range(60)] + [(70, None), (71, ""), (None, some(40)), (72, some(3000))]
    docs += docs[:3]
    got = contamination(spark.createDataFrame([(d, t, "w") for d, t in docs], "doc_id long, text string, word string"), spark.createDataFrame(items, "item_id long, text string"), 13, limit)
    rows = sorted(((str(x.doc_id), x.n_words, x.n_hit, list(x.item_ids), x.c) for x in got.withColumn("c", contaminated()).collect()), key=str)
    assert rows == brute(docs, items, 13)


def test_empty(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:3] for r in contamination(docs, items).collect()] == [(1, 2, 0)]
    assert contamination(docs.limit(0), items).collect() == []


def test_sql(spark):
    name = "op4_benchmark_decontamination"
    assert compare(spark, QUERIES[name], ORACLES[name], "/root/testdata/sf0.001") == 200
