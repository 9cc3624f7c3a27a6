"""Comparisons, samples, trajectories and densities against plain Python."""

import math

import numpy as np
from pyspark.sql import functions as F

from ethoflow.functions import scalars
from ethoflow.operators import averages, compare, sampling, summaries
from ethoflow.operators.recursive import moving_average


def _rows(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_small_groups_are_permuted(spark):
    data = [("f", "a", v) for v in (1.0, 2.0, 3.0)] + [("f", "b", v) for v in (11.0, 12.0, 13.0)] + [("g", "a", None), ("g", "a", float("nan")), ("g", "b", 0.0)]
    out = _rows(compare.compare(spark.createDataFrame(data, "feature string, group string, value double"), "b", "a", shuffles=500), "feature")
    f, g = out[("f",)], out[("g",)]
    assert f.test == "permutation" and f.mean_a == 12.0 and f.cohen_d == 10.0 and 0.05 < f.p < 0.16 and f["rank"] == 1
    assert (g.n_a, g.n_b, g.mean_b, g.p, g.cohen_d, g.sem_a) == (1, 1, 0.0, 1.0, 0.0, 0.0)


def test_no_spread_and_few_values(spark):
    data = [("same", s, 1.0) for s in "ab" for _ in range(3)] + [("far", s, v) for s, v in (("a", 1.0), ("b", 2.0)) for _ in range(3)] + [("few", "a", 1.0)] + [("few", "b", float(i)) for i in range(3)]
    out = _rows(compare.compare(spark.createDataFrame(data, "feature string, group string, value double"), "a", "b", few=0), "feature")
    assert (out[("same",)].p, out[("far",)].p, out[("few",)].test, out[("few",)].p) == (1.0, 0.0, "insufficient_n", 1.0)
    assert compare.compare(spark.createDataFrame([], "feature string, group string, value double"), "a", "b").count() == 0


def test_line_breaks_follow_the_pen(spark):
    rng = np.random.default_rng(3)
    points = [(float(rng.integers(0, 300)), float(rng.integers(0, 300)), bool(rng.random() > 0.1)) for _ in range(400)]
    df = spark.createDataFrame([(1, i, ok, x, y) for i, (x, y, ok) in enumerate(points)], "session_id int, frame_index int, ok boolean, x double, y double")
    got = {k[0]: r.drawn for k, r in _rows(summaries.line_breaks(df, 500, 400), "frame_index").items()}
    pen = None
    for i, (x, y, ok) in enumerate(points):
        if not ok:
            pen, drawn = None, False
        elif pen and math.hypot(x - pen[0], y - pen[1]) > 100:
            pen, drawn = None, False
        else:
            drawn, pen = pen is not None, (x, y)
        assert got[i] == drawn, i


def test_own_freezing_threshold(spark):
    rows = [(0, 1.0, 0.4, 0.0, 0.0), (1, 1.0, 0.6, 0.0, 0.0), (2, 3.0, None, 10.0, 0.0), (3, 1.9, None, 0.0, 9.0), (4, 50.0, 2.9, 10.0, 3.0), (5, None, None, 10.0, 3.0)]
    df = spark.createDataFrame(rows, "i int, px double, cm double, ppc double, own double")
    got = [r.z for r in df.select("i", scalars.freezing_override(*map(F.col, ("px", "cm", "ppc", "own"))).alias("z")).orderBy("i").collect()]
    assert got == [True, False, True, True, True, False]


def test_stratified_quota_and_top_up(spark):
    data = [("a", i) for i in range(50)] + [("b", 100), ("c", 200), ("c", 201)] + [(None, 300)]
    df = spark.createDataFrame(data, "g string, k int")
    out = sampling.stratified(df, 20, ["g"], ["k"]).collect()
    assert len(out) == 20 and len({r.k for r in out}) == 20
    count = {g: sum(r.g == g for r in out) for g in ("a", "b", "c", None)}
    assert count == {"a": 16, "b": 1, "c": 2, None: 1}
    assert {r.g for r in sampling.stratified(df, 2, ["g"], ["k"]).collect()} == {None, "a"}
    assert sampling.stratified(df.where("false"), 5, ["g"], ["k"]).count() == 0


def test_density_matches_plain_sums(spark):
    points = [(0.0, 0.0), (1.0, 2.0), (1.5, 2.0), (-1.0, 0.5)]
    got = _rows(averages.density(spark.createDataFrame([*points, (None, 1.0)], "x double, y double"), size=7), "ix", "iy")
    p = np.array(points)
    xs, ys = (np.linspace(p[:, i].min() - 1, p[:, i].max() + 1, 7) for i in (0, 1))
    want = np.array([[np.exp(-2 * ((p - [x, y]) ** 2).sum(1)).sum() for y in ys] for x in xs])
    want /= want.max() + 1e-8
    assert len(got) == 49 and all(abs(got[i, j].density - want[i, j]) < 1e-9 for i in range(7) for j in range(7))


def test_moving_average_skips_nulls(spark):
    values = [None, 58.2, None, 63.11, 0.0, None, 7.25]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "session_id int, frame_index int, x double")
    got = [r.ema for r in moving_average(df, "x").orderBy("frame_index").collect()]
    e, want = None, []
    for v in values:
        if v is not None:
            e = v if e is None else 0.97 * e + 0.03 * v
        want.append(e)
    assert got[0] is None and all(abs(a - b) < 1e-9 for a, b in zip(got[1:], want[1:]))
