import random
import re

import pytest

from ethoflow.llm.ngram_join import near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(rows, k, num, den):
    sets = []
    for _, t in rows:
        w = WORD.findall(lower(t))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = sorted((find(rows[i][0]), find(rows[j][0])))
                parent[b] = a
    return sorted((d, len(s), find(d)) for (d, _), s in zip(rows, sets))


def corpus(seed, n=260):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Éa", "ä,"]
    line = " ".join(r.choices(vocabulary, k=12))
    base = [r.choices(vocabulary, k=r.choice([30, 60, 200])) for _ in range(8)]
    rows = [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one"), (1004, "ONE"), (1005, "one two"), (1006, " ".join(r.choices(vocabulary, k=5000)))]
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        text = " ".join(w)
        if r.random() < 0.3:
            text = line + " " + text
        if r.random() < 0.2:
            text = " ".join(r.choices(vocabulary, k=r.randrange(1, 40)))
        rows.append((i, text.upper() if r.random() < 0.1 and text.isascii() else text))
    return rows


@pytest.mark.parametrize("seed,k,num,den,chunk", [(1, 3, 9, 10, 100), (2, 5, 4, 5, 7), (3, 3, 9, 10, 5)])
def test_against_brute_force(spark, seed, k, num, den, chunk):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
    got = sorted(tuple(r) for r in near_duplicates(docs, k, num, den, chunk).collect())
    assert got == brute(rows, k, num, den)


def test_empty_and_nulls(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(none).collect() == []
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, got)) == sorted(map(str, [r for r in got]))
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == [("1", 2, "1"), ("1", 2, "1"), ("2", 0, "2"), ("None", 2, "None")]
