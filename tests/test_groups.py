"""MANOVA, apparatus, geometry and Markov measures against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ethoflow.functions import geometry, special
from ethoflow.operators import sequence, stats, zones


def wide(spark, groups, seed, shift):
    r = np.random.default_rng(seed)
    rows = [(g, *map(float, r.normal(shift * k, 1, 3) * [1, 10, 100] + [0, 1e4, -5])) for k, g in enumerate(groups) for _ in range(12 + k)]
    return rows, spark.createDataFrame([*rows, (None, 1.0, 1.0, 1.0), ("a", None, 1.0, 1.0)], "`group` string, u double, v double, w double").withColumn("same", F.lit(7.0))


def test_manova_of_two_groups_is_hotelling(spark):
    rows, df = wide(spark, "ab", 1, 0.8)
    got = {r.statistic: r for r in stats.manova(df, ["u", "v", "w", "same"]).collect()}
    a, b = (np.array([r[1:] for r in rows if r[0] == g]) for g in "ab")
    pooled = (np.cov(a.T) * (len(a) - 1) + np.cov(b.T) * (len(b) - 1)) / (len(a) + len(b) - 2)
    gap = a.mean(0) - b.mean(0)
    t2 = len(a) * len(b) / (len(a) + len(b)) * gap @ np.linalg.inv(pooled) @ gap
    n = len(a) + len(b)
    f = (n - 4) / (3 * (n - 2)) * t2
    for name in ("wilks", "pillai", "hotelling_lawley", "roy"):
        assert math.isclose(got[name].f, f, rel_tol=1e-6) and math.isclose(got[name].p, special.f_upper(f, 3, n - 4), rel_tol=1e-6)


def test_manova_of_three_groups(spark):
    rows, df = wide(spark, "abc", 2, 0.5)
    got = {r.statistic: r for r in stats.manova(df, ["u", "v", "w"]).collect()}
    x = np.array([r[1:] for r in rows])
    of = [np.array([r[1:] for r in rows if r[0] == g]) for g in "abc"]
    e = sum((y - y.mean(0)).T @ (y - y.mean(0)) for y in of)
    h = sum(len(y) * np.outer(y.mean(0) - x.mean(0), y.mean(0) - x.mean(0)) for y in of)
    wilks = np.linalg.det(e) / np.linalg.det(e + h)
    assert math.isclose(got["wilks"].value, wilks, rel_tol=1e-8)
    # exact for two degrees of freedom between groups
    n, p = len(x), 3
    f = (1 - math.sqrt(wilks)) / math.sqrt(wilks) * (n - 3 - p + 1) / p
    assert math.isclose(got["wilks"].f, f, rel_tol=1e-8) and got["wilks"].df_hyp == 2 * p and got["wilks"].df_err == 2 * (n - 3 - p + 1)
    assert math.isclose(got["pillai"].value, np.trace(h @ np.linalg.inv(h + e)), rel_tol=1e-8) and got["pillai"].df_hyp == 6
    assert stats.manova(df.where("`group` = 'a'"), ["u", "v"]).collect() == [] and stats.manova(df.limit(0), ["u", "v"]).collect() == []


@pytest.mark.parametrize("kind", ["open_field", "circular_field", "plus_maze", "y_maze", "light_dark", "three_chamber", "water_maze", "novel_object", "fear_conditioning"])
def test_apparatus_lies_in_the_image(kind):
    made = geometry.apparatus(kind, 640, 480)
    assert len({n for n, _ in made}) == len(made) and all(len(p) >= 3 for _, p in made)
    assert all(-1e-9 <= q["x"] <= 640 + 1e-9 and -1e-9 <= q["y"] <= 480 + 1e-9 for _, p in made for q in p)
    with pytest.raises(ValueError):
        geometry.apparatus("other", 1, 1)


def test_arms_of_a_y_maze_are_found(spark):
    arms = geometry.apparatus("y_maze", 600, 600)
    at = [(300 + 150 * math.cos(math.radians(a)), 300 + 150 * math.sin(math.radians(a))) for a in (-90, 30, 150)] + [(5.0, 5.0)]
    df = spark.createDataFrame([("s", i, float(i), True, *p) for i, p in enumerate(at)], "session_id string, frame_index long, t_sec double, ok boolean, x double, y double")
    got = zones.assign_zones(df, zones.literal_zones([(n, n, p) for n, p in arms])).orderBy("frame_index")
    assert [r.zone_id for r in got.collect()] == ["arm a", "arm b", "arm c", None]


def test_perimeter(spark):
    df = spark.createDataFrame([([(0.0, 0.0), (3.0, 0.0), (3.0, 4.0)],)], "p array<struct<x:double,y:double>>")
    assert df.select(geometry.perimeter(F.col("p")).alias("n")).first().n == 12.0


def test_stationary_vector_and_entropy(spark):
    r = np.random.default_rng(4)
    rows = []
    for s in range(3):
        label = 0
        for i in range(400):
            label = int(r.choice(4, p=[[0.7, 0.1, 0.1, 0.1], [0.2, 0.5, 0.2, 0.1], [0.1, 0.2, 0.6, 0.1], [0.3, 0.3, 0.3, 0.1]][label]))
            rows.append((s, i, label if r.random() > 0.05 else -1))
    df = spark.createDataFrame(rows + [(9, 0, 1), (9, 1, 1)], "session_id int, frame_index long, label int").repartition(4)
    got = {x.session_id: x for x in sequence.stationary(df, 4).collect()}
    told = {x.session_id: x for x in sequence.profile(df, 4, 2.0).collect()}
    for s in range(3):
        labels = [x[2] for x in rows if x[0] == s and x[2] >= 0]
        t = np.zeros((4, 4))
        for a, b in zip(labels, labels[1:]):
            t[a, b] += 1
        t /= t.sum(1, keepdims=True)
        pi = np.full(4, 0.25)
        for _ in range(5000):  # power iteration
            pi = pi @ t
        h = -sum(pi[i] * t[i, j] * math.log(t[i, j]) for i in range(4) for j in range(4) if t[i, j] > 0)
        assert np.allclose(got[s].pi, pi, atol=1e-9) and math.isclose(got[s].entropy, h, rel_tol=1e-9) and math.isclose(got[s].entropy_normalized, h / math.log(16), rel_tol=1e-9)
        assert told[s].labels == len(labels) and math.isclose(told[s].self_rate, np.trace(t) / 4, rel_tol=1e-9) and told[s].entropy == got[s].entropy
    assert (told[9].labels, told[9].self_rate, told[9].entropy) == (2, 0.0, 0.0)


def test_fdr_of_one_family_is_the_plain_one(spark):
    r = np.random.default_rng(7)
    p = [float(x) for x in np.round(r.random(700) ** 2, 2)] + [None, 0.0, 1.0, 1.0]
    got = {t.i: t.q for t in stats.fdr(spark.createDataFrame(list(enumerate(p)), "i int, p double").repartition(4), buckets=8).collect()}
    known = sorted((x, i) for i, x in enumerate(p) if x is not None)
    least = 1.0
    for rank in range(len(known), 0, -1):
        x, i = known[rank - 1]
        least = min(least, x * len(known) / rank)
        assert math.isclose(got[i], least, rel_tol=1e-12, abs_tol=1e-15)
    assert len(got) == len(p) and got[700] is None
    assert stats.fdr(spark.createDataFrame([], "i int, p double")).collect() == []


def test_minimum_slice(spark):
    """T6 of FIXTURES.md."""
    from ethoflow.plans import registry

    got = {r.state: (r.events, r.seconds) for r in registry.QUERIES["behaviour_state_seconds"](spark, "/root/testdata/sf0.01").collect()}
    assert got == {"freezing": (260, 133.0), "immobile": (775, 444.5), "mobile": (2412, 3355.5)}
