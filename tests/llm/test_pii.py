import hashlib
import random
import re

from pyspark.sql import functions as F

from ethoflow.llm.pii import BASE, estimate, listed, masked, personal_data
from ethoflow.llm.queries import QUERIES

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0


def good(kind, hit):
    d = re.sub("[^0-9]", "", hit)
    return {"email": True, "ip": all(int(p) <= 255 for p in hit.split(".")) if kind == "ip" else 0, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if good(k, m[0])]


def card(r, n=16):
    d = [r.randrange(10) for _ in range(n - 1)]
    return next("".join(map(str, d)) + c for c in "0123456789" if luhn("".join(map(str, d)) + c))


def corpus():
    r = random.Random(3)
    pieces = ["a@b.co", "x.y+z@é.de", "a@b.c-d.e_f@g.h", "_@q.r.", "1.2.3.4.5.6.7.8", "256.1.1.1", "255.0.00.1", "99999999999.1.1.1", "+1 (017) 555-7713", "+12", "+1234567", "+49 30 1234567 - ", "+1.2.3.4.5.6.7.8.9.0.1.2.3.4.5.6", "call 555-123-4567 now", "Dr. Anna Bell", 'token = "ab12cd34ef"', "joe [at] mail [dot] com", "2024-01-02", "12 345 678", "page 100 200 300", "é", "日本", "\n", "word", "@", "@@a.b", "a@b", "-", "+"]
    rows = []
    for i in range(300):
        text = " ".join(r.choice(pieces) if r.random() < 0.8 else r.choice([card(r), card(r, 19), " ".join(re.findall("....", card(r))), card(r)[:-1] + "x", str(r.randrange(10**17))]) for _ in range(r.randrange(0, 30)))
        rows.append((i, text))
    return rows + [(400, None), (401, ""), (402, "7" * 30000), (403, "a" * 30000 + "@b.c"), (404, "1 " * 9000), (405, "+1" + " 2" * 9000), (None, "a@b.cd"), (1, "a@b.cd")]


def test_base_spans(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, email string")
    got = sorted(((str(x.doc_id), x.b) for x in personal_data(docs).withColumn("b", listed("base")).collect()))
    assert got == sorted((str(i), ",".join(brute(t))) for i, t in rows)


def test_added_spans_and_mask(spark):
    docs = spark.createDataFrame(corpus()[:300], "doc_id long, text string")
    told = {r.doc_id: r for r in personal_data(docs).collect()}
    text = dict(corpus()[:300])
    kinds = {s.kind for r in told.values() for s in r.spans}
    assert {"mail", "number", "secret"} <= kinds
    for i, r in told.items():
        assert list(r.spans)[: len(r.base)] == list(r.base)
        for s in list(r.spans)[len(r.base) :]:
            assert all(s.stop <= b.start or b.stop <= s.start for b in r.base) and "2024-01-02" not in text[i][s.start : s.stop]
    out = docs.join(personal_data(docs), "doc_id").select("doc_id", masked(F.col("text"), F.col("spans")).alias("m")).collect()
    for r in out:
        want, at = "", 0
        for s in sorted(told[r.doc_id].spans, key=lambda s: (s.start, -s.stop)):
            if s.start >= at:
                want += text[r.doc_id][at : s.start] + f"<{s.kind.upper()}>"
            at = max(at, s.stop)
        assert r.m == want + text[r.doc_id][at:]


def test_estimate_finds_the_bad_labeler():
    r, seen = random.Random(1), {}
    for _ in range(4000):
        y = r.random() < 0.4
        v = tuple((1 if y else -1) if r.random() < a else (-1 if y else 1) for a in (0.95, 0.9, 0.85, 0.5))
        seen[v] = seen.get(v, 0) + 1
    post = estimate(sorted(seen.items()))
    assert post[(1, 1, 1, -1)] > 0.95 and post[(-1, -1, -1, 1)] < 0.05 and estimate([]) == {}


def test_empty_and_query(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert personal_data(none).collect() == []
    rows = QUERIES["op2_pii"](spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for x in rows:
        assert x.base_sha256 == hashlib.sha256(",".join(brute(docs[x.doc_id])).encode()).hexdigest()
        assert [x[f"n_{k}"] for k in BASE] == [sum(s.startswith(k + ":") for s in brute(docs[x.doc_id])) for k in BASE]


def test_many_matches_in_one_text(spark):
    n = 35_000
    docs = spark.createDataFrame([(1, "a@b.co 10.0.0.1 " * n)], "doc_id long, text string")
    told = personal_data(docs)
    row = told.collect()[0]
    assert (row.n_email, row.n_ip) == (n, n)
    assert [(s.start, s.stop) for s in row.base[:n]] == [(16 * i, 16 * i + 6) for i in range(n)]
    assert [(s.start, s.stop) for s in row.base[n:]] == [(16 * i + 7, 16 * i + 15) for i in range(n)]
    out = docs.join(told, "doc_id").select(masked(F.col("text"), F.col("spans")).alias("m")).collect()
    assert out[0].m == "<EMAIL> <IP> " * n


def test_recall_and_precision_of_added_spans(spark):
    r = random.Random(11)
    words = "the river was low and nobody came to see it before evening so they left".split()
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    token = lambda k: "".join(r.choice("abcdefghijkmnpqrstuvwxyzABCDEFGH0123456789") for _ in range(k))
    personal = [
        lambda: ("call me at ", f"{r.randrange(200, 999)}-{r.randrange(200, 999)}-{digits(4)}"),
        lambda: ("phone: ", f"({r.randrange(200, 999)}) {r.randrange(200, 999)}-{digits(4)}"),
        lambda: ("write to ", f"{r.choice(['joe', 'ann', 'x.y'])}{digits(2)} [at] mail{digits(2)} [dot] com"),
        lambda: ("with ", f'{r.choice(["api_key", "token", "password", "client_secret"])} = "{token(r.choice([12, 40, 200]))}"'),
        lambda: ("thanks to ", f"{r.choice(['Dr.', 'Mrs', 'Herr'])} {r.choice(['Anna', 'Émile', 'Karl'])} {r.choice(['Bell', 'Östlund', 'Weiss'])}"),
    ]
    other = [
        lambda: ("on ", f"{r.randrange(1900, 2024)}-{r.randrange(10, 13)}-{r.randrange(10, 29)}"),
        lambda: ("see page ", f"{r.randrange(100, 999)} {r.randrange(100, 999)}"),
        lambda: ("with ", f'{r.choice(["title", "colour", "layout"])} = "{r.choice(words)} {r.choice(words)}"'),
    ]
    rows, wanted = [], set()
    for i in range(400):
        text = ""
        for _ in range(r.randrange(1, 6)):
            true = r.random() < 0.5
            before, hit = r.choice(personal if true else other)()
            text += " ".join(r.choices(words, k=r.randrange(3, 12))) + " " + before
            if true:
                wanted.add((i, len(text), len(text) + len(hit)))
            text += hit + ". "
        rows.append((i, text))
    told = personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {(x.doc_id, s.start, s.stop) for x in told for s in list(x.spans)[len(x.base) :]}
    assert len(got & wanted) >= 0.95 * len(wanted), sorted(rows[d][1][a:b] for d, a, b in wanted - got)[:20]
    assert len(got & wanted) >= 0.95 * len(got), sorted(rows[d][1][a:b] for d, a, b in got - wanted)[:20]
