import hashlib
import random
import re
from collections import Counter

import pytest

from ethoflow.llm.substring_dedup import byte_dedup, word_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(b):
    return hashlib.sha256(b).hexdigest()


def brute_bytes(rows, n):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for (d, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        out.append((d, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(bytes(c for c, g in zip(t, gone) if not g))))
    return sorted(out)


def brute_words(rows, n):
    words = {d: WORD.findall(t or "") for d, t in rows}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - n + 1):
            first.setdefault(tuple(words[d][i : i + n]), (d, i))
    out = []
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < (d, i):
                gone[i : i + n] = [True] * n
        out.append((d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g).encode())))
    return sorted(out)


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "ä,", "\u0001", "x" * 30]
    some = lambda k: " ".join(r.choices(vocabulary, k=k))
    passages = [some(k) for k in (15, 19, 20, 21, 60, 90)]
    rows = [(900, None), (901, ""), (902, " \n "), (903, "w"), (904, "ab " * 400), (905, "a" * 700), (906, some(4000) + " " + passages[4])]
    for i in range(160):
        parts = [some(r.randrange(1, 60))]
        for _ in range(r.choice([0, 1, 1, 2])):
            parts += [r.choice(passages), some(r.randrange(0, 30))]
        rows.append((i, " ".join(parts)))
    rows += [(200 + i, rows[r.randrange(7, 100)][1]) for i in range(25)]
    near = rows[20][1].split()
    for i in range(40):
        w = list(near)
        w[r.randrange(len(w))] = "changed"
        rows.append((300 + i, " ".join(w)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,most,limit", [(1, 256, 1 << 24), (2, 3, 0)])
def test_bytes(spark, seed, most, limit):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, spans int")
    assert sorted(map(tuple, byte_dedup(docs, most=most, limit=limit, shard=20_000).collect())) == brute_bytes(rows, 200)


@pytest.mark.parametrize("seed,most,limit", [(3, 256, 1 << 24), (4, 3, 0)])
def test_words(spark, seed, most, limit):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, h int")
    assert sorted(map(tuple, word_dedup(docs, most=most, limit=limit).collect())) == brute_words(rows, 20)


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert byte_dedup(none).collect() == [] and word_dedup(none).collect() == []
    long = " ".join(f"a{i}" for i in range(60))
    rows = spark.createDataFrame([(None, long), (1, long), (1, long), (2, None)], "doc_id long, text string")
    assert sorted((str(r[0]), r[2]) for r in byte_dedup(rows).collect()) == [("1", len(long)), ("1", len(long)), ("2", 0), ("None", len(long))]
    assert sorted((str(r[0]), r[2]) for r in word_dedup(rows).collect()) == [("1", 0), ("1", 0), ("2", 0), ("None", 0)]


def test_bytes_without_doc_id(spark):
    r = random.Random(7)
    text = "".join(r.choices("abcdefghij ", k=260))
    other = "".join(r.choices("abcdefghij ", k=300))
    docs = spark.createDataFrame([(None, text), (1, text), (None, other), (None, text[:230] + other[:100])], "doc_id long, text string")
    got = sorted((str(x.doc_id), x.n_bytes, x.n_removed) for x in byte_dedup(docs).collect())
    assert got == sorted([("None", 260, 260), ("1", 260, 260), ("None", 300, 0), ("None", 330, 230)])
