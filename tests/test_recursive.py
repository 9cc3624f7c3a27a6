"""Filters carried over batches, offline and in a stream, against plain loops; exact tests and medians."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ethoflow.functions import special
from ethoflow.operators import recursive, stats, windows
from ethoflow.streaming import live

KIND = "session_id string, frame_index long, t_sec double, ok boolean, x double, y double, value double"


def frames(seed=3, sessions=4, n=900):
    r = np.random.default_rng(seed)
    rows = []
    for s in range(sessions):
        x, y = 100.0, 100.0
        for i in range(n if s else 3):
            x, y = x + r.normal(0, 4), y + r.normal(0, 4)
            ok = bool(r.random() > 0.15) and i > s
            jump = 150 * (r.random() < 0.02)
            rows.append((f"s{s}", i, i / 25, ok, float(x + jump) if ok else None, float(y) if ok else None, float(r.normal()) if r.random() > 0.3 and i > 20 * s else None))
    return rows + [("none", i, i / 25, False, None, None, None) for i in range(4)]


def plain_average(values, decay):
    e, out = None, []
    for v in values:
        if v is not None:
            e = v if e is None else decay * e + (1 - decay) * v
        out.append(e)
    return out


def close(a, b):
    return a is None and b is None or a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


def grouped(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("decay", [0.97, 0.2])
def test_moving_average(spark, decay):
    rows = frames()
    got = {(r.session_id, r.frame_index): r.ema for r in recursive.moving_average(spark.createDataFrame(rows, KIND).repartition(5), "value", decay).collect()}
    assert len(got) == len(rows)
    for s, own in grouped(rows).items():
        for r, e in zip(own, plain_average([x[6] for x in own], decay)):
            assert close(got[s, r[1]], e), (s, r[1])


def test_kalman(spark):
    rows = frames()
    got = {(r.session_id, r.frame_index): r for r in recursive.kalman(spark.createDataFrame(rows, KIND).repartition(5)).collect()}
    for s, own in grouped(rows).items():
        nan = lambda k: np.array([np.nan if r[k] is None else r[k] for r in own], float)  # noqa: E731, B023
        x, y, quality = recursive.kalman_track(nan(2), nan(4), nan(5), np.array([r[3] for r in own]))
        for r, a, b, q in zip(own, x, y, quality):
            t = got[s, r[1]]
            assert t.quality == q and close(t.x, None if a != a else a) and close(t.y, None if b != b else b), (s, r[1], t, a, b, q)


def plain_tracks(rows, n, reach, pick):
    out, last = [], {}
    frames_of = {}
    for s, f, x, y in rows:
        if x is not None:
            frames_of.setdefault((s, f), []).append((x, y))
    for (s, f), points in sorted(frames_of.items()):
        own = last.setdefault(s, [None] * n)
        d, known, got = np.array(sorted(points)), [i for i in range(n) if last[s][i] is not None], {}
        if known:
            cost = np.array([np.hypot(*(d - np.array(own[i])).T) for i in known])
            cost = np.where(cost < reach, cost, 2 * reach)
            for i, j in zip(known, pick(cost)):
                if j >= 0 and cost[known.index(i), j] < reach:
                    got[i] = j
        free = [j for j in range(len(d)) if j not in got.values()]
        for i in range(n):
            if own[i] is None and free:
                got[i] = free.pop(0)
        for i in range(n):
            if i in got:
                own[i] = tuple(d[got[i]])
            out.append((s, f, i, *(own[i] if i in got else (None, None))))
    return sorted(out, key=repr)


def detections(seed=5):
    r = np.random.default_rng(seed)
    rows = []
    for s in ("a", "b", "c"):
        at = r.uniform(0, 600, (3, 2))
        for f in range(60):
            at += r.normal(0, 20, at.shape)
            for p in at[r.permutation(3)[: r.integers(0, 4)]]:
                rows.append((s, f, float(p[0]), float(p[1])))
    return rows + [("a", 3, None, 1.0)]


@pytest.mark.parametrize("greedy", [False, True])
def test_tracks(spark, greedy):
    rows = detections()
    df = spark.createDataFrame(rows, "session_id string, frame_index long, x double, y double").repartition(4)
    got = sorted((tuple(r) for r in recursive.tracks(df, 3, 120.0, greedy).collect()), key=repr)
    assert got == plain_tracks(rows, 3, 120.0, recursive.assign_greedy if greedy else recursive.assign_optimal)


def test_optimal_assignment_is_cheapest():
    r = np.random.default_rng(8)
    from itertools import permutations

    for _ in range(40):
        cost = r.random((3, 4))
        got = recursive.assign_optimal(cost)
        assert math.isclose(sum(cost[i, j] for i, j in enumerate(got)), min(sum(cost[i, j] for i, j in enumerate(p)) for p in permutations(range(4), 3)))


def run_stream(spark, tmp_path, rows, kind, build, name):
    """The rows in three files, one micro-batch each."""
    source = tmp_path / name
    for i in range(3):
        cut = [r for r in rows if r[1] * 3 // (max(x[1] for x in rows) + 1) == i]
        spark.createDataFrame(cut, kind).coalesce(1).write.mode("append").parquet(f"{source}/b{i}")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(source))
    q = build(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}-state").outputMode("append").trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(120)
    finally:
        q.stop()
    return spark.table(name).collect()


def test_a_stream_in_three_batches_is_the_offline_filter(spark, tmp_path):
    rows = frames(n=90)
    df = spark.createDataFrame(rows, KIND)
    smooth = {(r.session_id, r.frame_index): r for r in recursive.kalman(df, dt=0.04).collect()}
    ema = {(r.session_id, r.frame_index): r.ema for r in recursive.moving_average(df, "value").collect()}
    got = run_stream(spark, tmp_path, rows, KIND, lambda s: live.live_filtered(s, 0.04), "filtered")
    assert len(got) == len(rows)
    for r in got:
        k = (r.session_id, r.frame_index)
        none = lambda v: None if v is None or v != v else v
        assert r.quality == smooth[k].quality and close(none(r.x), smooth[k].x) and close(none(r.y), smooth[k].y) and close(none(r.ema), ema[k])


def test_a_stream_in_three_batches_is_the_offline_assignment(spark, tmp_path):
    rows = detections()
    kind = "session_id string, frame_index long, x double, y double"
    want = sorted((tuple(r) for r in recursive.tracks(spark.createDataFrame(rows, kind), 3, 120.0).collect()), key=repr)
    got = run_stream(spark, tmp_path, rows, kind, lambda s: live.live_assigned(s, 3, 120.0), "assigned")
    assert sorted(((r[0], r[1], r[2], *(None if v is None or v != v else v for v in r[3:])) for r in got), key=repr) == want


def test_a_million_frames_of_one_session(spark):
    df = spark.range(1_000_000).select(F.lit("s").alias("session_id"), F.col("id").alias("frame_index"), (F.col("id") / 25).alias("t_sec"), F.lit(True).alias("ok"), (F.col("id") % 1000).cast("double").alias("x"), F.lit(1.0).alias("y"))
    assert recursive.kalman(df).where("x is not null").count() == 1_000_000
    last = recursive.moving_average(df, "x").where("frame_index = 999999").first().ema
    assert math.isclose(last, plain_average([float(i % 1000) for i in range(990_000, 1_000_000)], 0.97)[-1], rel_tol=1e-9)


@pytest.mark.parametrize("na,nb", [(1, 1), (2, 3), (4, 4), (5, 7)])
def test_exact_mann_whitney_is_all_arrangements(na, nb):
    every = []
    for a in combinations(range(na + nb), na):
        every.append(sum(sum(1 for y in range(na + nb) if y not in a and y < x) for x in a))
    for u in range(na * nb + 1):
        least = min(u, na * nb - u)
        assert math.isclose(special.mann_whitney_exact(u, na, nb), min(1, 2 * sum(e <= least for e in every) / len(every)), rel_tol=1e-12)


def test_exact_mann_whitney_of_a_large_group():
    assert math.isclose(special.mann_whitney_exact(0, 8, 100_000), 2 / math.comb(100_008, 8), rel_tol=1e-9)
    assert special.mann_whitney_exact(400_000, 8, 100_000) == pytest.approx(1, abs=1e-4)


def test_mann_whitney_by_ranks(spark):
    r = np.random.default_rng(6)
    groups = {"A": r.normal(0, 1, 7).tolist(), "B": r.normal(1, 1, 30).tolist(), "C": r.integers(0, 3, 40).astype(float).tolist(), "D": [1.0]}
    rows = [("f", g, v) for g, vs in groups.items() for v in vs] + [("f", "A", None), ("f", None, 1.0), ("same", "A", 2.0), ("same", "B", 2.0)]
    got = {(t.feature, t.a, t.b): t for t in stats.mann_whitney(spark.createDataFrame(rows, "feature string, `group` string, value double").repartition(4), buckets=8).collect()}
    for a, b in combinations("ABCD", 2):
        x, y = groups[a], groups[b]
        u = sum((p > q) + 0.5 * (p == q) for p in x for q in y)
        n, ties = len(x) + len(y), sum(t**3 - t for t in np.unique(x + y, return_counts=True)[1].tolist())
        sd = math.sqrt(len(x) * len(y) / 12 * (n + 1 - ties / (n * (n - 1))))
        z = (abs(u - len(x) * len(y) / 2) - 0.5) / sd
        p = special.mann_whitney_exact(u, len(x), len(y)) if min(len(x), len(y)) <= 8 and not ties else min(1, math.erfc(z / math.sqrt(2)))
        t = got["f", a, b]
        assert t.u == u and math.isclose(t.z, z, rel_tol=1e-12) and math.isclose(t.p, p, rel_tol=1e-9)
    assert got["same", "A", "B"].u == 0.5 and got["same", "A", "B"].p is None


@pytest.mark.parametrize("n,most", [(0, 10), (1, 10), (2, 10), (1001, 10), (1000, 1), (1000, 10_000)])
def test_exact_medians(spark, n, most):
    r = np.random.default_rng(n + most)
    rows = [(float(r.normal()), float(r.integers(0, 3)), None if i % 3 else float(i), float("nan")) for i in range(n)]
    got = windows.medians(spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(3), list("abcd"), most)
    for k, c in enumerate("abc"):
        known = [x[k] for x in rows if x[k] is not None]
        assert got[c] == (np.median(known) if known else None)
    assert got["d"] is None
