"""Line deduplication against a plain loop."""

import random

import pytest

from ethoflow.llm import line_dedup as ld
from ethoflow.llm import queries
from tests.oracle import compare

WHITE = " \t\n\x0b\x0c\r"
_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
KIND = "doc_id long, text string"


def key(line):
    return line.strip(WHITE).translate(_LOW)


def brute(rows, least, min_chars=1, keep="none"):
    held = {}
    for k, (i, t) in enumerate(rows):
        for j, x in enumerate((t or "").split("\n")):
            held.setdefault(key(x), {}).setdefault(k, j)
    gone = {x for x, rows_of in held.items() if len(x) >= min_chars and len(rows_of) >= least}
    out = []
    for k, (i, t) in enumerate(rows):
        lines = (t or "").split("\n")
        stay = []
        for j, x in enumerate(lines):
            first = min(held[key(x)], key=lambda r: (rows[r][0] is not None, rows[r][0] or 0))
            if key(x) not in gone or keep == "first" and first == k and held[key(x)][k] == j:
                stay.append(x)
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def rows_of(seed, n=300):
    r = random.Random(seed)
    pool = [f"Line {k} é{'x' * (k % 7)}" for k in range(40)] + ["", " ", "\t\x0b", "a", "ABC", "ÀB", "日本\r"]
    rows = [(k, "\n".join(r.choice(["", " ", "\t"]) + (r.choice(pool) if r.random() < 0.7 else str(r.random())) + r.choice(["", "  ", "\r"]) for _ in range(r.randint(0, 9)))) for k in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "\n"), (n + 3, "\n\n\n"), (n + 4, "w" * 300_000), (n + 5, "W" * 300_000 + "\nabc"), (None, "abc\nline 3 éxxx"), (n + 6, " " * 5000 + "abc")]


def got(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in df.collect()), key=repr)


@pytest.mark.parametrize("least,min_chars,keep", [(10, 1, "none"), (2, 1, "none"), (3, 4, "none"), (2, 1, "first"), (5, 3, "first")])
def test_as_brute(spark, least, min_chars, keep):
    rows = rows_of(least)
    docs = spark.createDataFrame(rows, KIND).repartition(5)
    want = brute(rows, least, min_chars, keep)
    assert got(ld.line_dedup(docs, least, min_chars, keep)) == want
    assert got(ld.line_dedup(docs, least, min_chars, keep, limit=0)) == want


def test_small_filter_changes_nothing(spark):
    rows = rows_of(1)
    docs = spark.createDataFrame(rows, KIND).repartition(3)
    assert got(ld.line_dedup(docs, 2, filter_bytes=512)) == brute(rows, 2)


def test_filter_has_all_repeats_and_few_others(spark):
    rows = [(k, f"own {k}\nshared {k % 1000}") for k in range(4000)]
    docs = spark.createDataFrame(rows, KIND).repartition(8)
    twice = ld.seen_twice(docs)
    holds = lambda xs: ld._holds(twice, ld._places(ld._key_hashes([x.encode() for x in xs]), len(twice) << 3))
    assert holds([f"shared {k}" for k in range(1000)]).all()
    assert holds([f"own {k}" for k in range(4000)]).mean() < 0.01


def test_repeated_rows_and_ids(spark):
    rows = [(1, "x\ny"), (1, "x\ny"), (1, "x"), (2, "z")]
    assert got(ld.line_dedup(spark.createDataFrame(rows, KIND), 2)) == [(1, 1, 1, ""), (1, 2, 2, ""), (1, 2, 2, ""), (2, 1, 0, "z")]
    first = got(ld.line_dedup(spark.createDataFrame(rows, KIND), 2, keep="first"))
    assert [r for r in first if r[1] == 2] in ([(1, 2, 0, "x\ny")] * 2, [(1, 2, 1, "y")] * 2)


@pytest.mark.parametrize("rows", [[], [(None, None)], [(1, None), (2, None)], [(1, "")]])
def test_empty(spark, rows):
    assert got(ld.line_dedup(spark.createDataFrame(rows, KIND))) == brute(rows, 10)


def test_other_columns(spark):
    docs = spark.createDataFrame([(1, "a", "k", 1, "m"), (2, "A ", "k", 2, "m")], "doc_id int, text string, key string, line int, mark string")
    assert got(ld.line_dedup(docs, 2)) == [(1, 1, 1, ""), (2, 1, 1, "")]


def test_bad_arguments(spark):
    with pytest.raises(ValueError):
        ld.line_dedup(spark.createDataFrame([], KIND), least_docs=1)


def test_query(spark):
    for sf in ("sf0.001", "sf0.01"):
        compare(spark, queries.QUERIES["op11_line_dedup"], queries.ORACLES["op11_line_dedup"], f"/root/testdata/{sf}")
