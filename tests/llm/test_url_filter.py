import random
import zlib
from datetime import datetime, timedelta
from urllib.parse import urlsplit

import pytest

from ethoflow.llm.queries import ORACLES, QUERIES
from ethoflow.llm.url_filter import filtered
from tests.oracle import compare

DAY0 = datetime(2024, 1, 1)


def brute(captures, entries):
    state = {}
    for e in entries:
        if None not in (e[0], e[1], e[5]):
            key = (e[0], e[1].lower(), e[2] or "/")
            at = state.setdefault(key, {})
            at[e[5]] = max(at.get(e[5], ("", "")), (e[4], e[3]))
    out = []
    for page, url, t in captures:
        host, path = "", "/"
        if url is not None:
            u = urlsplit(url)
            host, path = (u.hostname or "").rstrip("."), u.path or "/"
        active = []
        if url is not None and t is not None and host:
            labels = host.split(".")
            parents = {".".join(labels[i:]) for i in range(len(labels))}
            for (name, domain, prefix), at in state.items():
                times = [x for x in at if x <= t]
                if domain in parents and path.startswith(prefix) and times and at[max(times)][0] == "add":
                    active.append((len(domain), len(prefix), max(times), name, at[max(times)][1], domain, prefix))
        b = max(active, default=None)
        out.append((str(page), host, b[4] if b else "pass", f"{b[3]} {b[5]}{b[6]}" if b else None, len(active)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [1 << 24, 0])
def test_against_brute_force(spark, limit):
    r = random.Random(6)
    hosts = ["a.com", "www.a.com", "b.a.com", "c.org", "x.y.c.org", "com"]
    captures = [(i, f"https://{r.choice(['', 'u:p@'])}{r.choice(hosts)}{r.choice(['', '.', ':80'])}{r.choice(['', '/', '/en/1', '/en', '/de/x?q=/en/#f'])}".replace(".:", ":"), DAY0 + timedelta(days=r.randrange(20))) for i in range(300)]
    captures += [(900, None, DAY0), (901, "https://a.com", None), (902, "", DAY0), (903, "no url", DAY0), (None, "http://A.com/", DAY0 + timedelta(days=9)), (1, captures[1][1], captures[1][2])]
    entries = [(r.choice(["l1", "l2"]), r.choice(hosts).upper(), r.choice([None, "/", "/en/"]), r.choice(["block", "allow"]), r.choice(["add", "remove"]), DAY0 + timedelta(days=r.randrange(20))) for _ in range(60)]
    entries += [(None, "a.com", "/", "block", "add", DAY0), ("l1", None, "/", "block", "add", DAY0), ("l1", "a.com", "/", "block", "add", None)] + entries[:3]
    c = spark.createDataFrame([(*x, "d") for x in captures], "page_id long, url string, fetched_at timestamp_ntz, domain string")
    e = spark.createDataFrame(entries, "list string, domain string, path string, verdict string, action string, at timestamp_ntz")
    got = sorted(((str(x[0]), *tuple(x)[1:]) for x in filtered(c, e, limit).collect()), key=str)
    assert got == brute(captures, entries)
    assert filtered(c.limit(0), e).collect() == []
    assert {x.verdict for x in filtered(c, e.limit(0)).collect()} == {"pass"}


def test_query(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    day = lambda d: DAY0 + timedelta(days=d)
    hosts = {urlsplit(p.url).hostname or "" for p in pages}
    entries = [("zones", "example.net", "/", "allow", "add", day(0)), ("zones", "example.net", "/", "block", "add", day(180))]
    for h in hosts:
        c = zlib.crc32(h.encode())
        if c % 7 < 3:
            entries += [("hosts", h, "/", "block", "add", day(c % 200)), ("hosts", h, "/", "block", "remove", day(c % 200 + 60))]
        if c % 7 == 3:
            entries.append(("paths", h, "/en/", "block", "add", day(100)))
    got = sorted(((str(x[0]), *tuple(x)[1:]) for x in QUERIES["op7_url_filters"](spark, "/root/testdata/sf0.001").collect()), key=str)
    assert got == brute([(p.page_id, p.url, day(p.page_id % 365)) for p in pages], entries)
    assert len({x[2] for x in got}) == 3


def test_sql(spark):
    for sf in ("sf0.001", "sf0.01"):
        compare(spark, QUERIES["op7_url_filters"], ORACLES["op7_url_filters"], f"/root/testdata/{sf}")
