"""Embedding, mixed effects, classifiers and diverse samples against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ethoflow.operators import classify, embedding, mixed, sampling
from ethoflow.sources.sinks import write_manifest


def clusters(n=100, d=10, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(0, 8, (3, d))
    x = np.concatenate([r.normal(c, 1, (n, d)) for c in centres])
    return x, np.repeat(np.arange(3), n)


def table(spark, x, extra=()):
    names = [f"f{i}" for i in range(x.shape[1])]
    rows = [(i, *map(float, v)) for i, v in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in names)).repartition(3), names


def test_nearest_is_exact():
    x = np.random.default_rng(2).normal(size=(700, 6)).astype(np.float32)
    near, d = embedding.nearest(x, x, 15, np.arange(700))
    plain = ((x[:, None].astype(float) - x[None]) ** 2).sum(2) + np.diag(np.full(700, np.inf))
    order = np.argsort(plain, axis=1, kind="stable")[:, :15]
    assert (near == order).all() and np.allclose(d, np.sqrt(np.take_along_axis(plain, order, 1)))


def test_memberships_sum_to_log_k():
    d = np.sort(np.random.default_rng(3).random((50, 30)), axis=1)
    w = embedding.memberships(d)
    assert np.allclose(w.sum(1), np.log2(30), atol=1e-4) and np.allclose(w[:, 0], 1)


def test_curve_has_the_published_parameters():
    assert np.allclose(embedding.curve(0.1), (1.577, 0.895), atol=1e-3) and np.allclose(embedding.curve(0.3), (0.992, 1.112), atol=1e-3)


def test_umap_keeps_clusters_and_neighbours(spark):
    x, kind = clusters()
    rows, names = table(spark, x, [(900, *[None] * 10), (901, *[float("nan")] * 10)])
    got = {r.id: (r.x, r.y, r.fitted) for r in embedding.umap(rows, ["id"], names, n_neighbors=15, epochs=100).collect()}
    assert sorted(got) == list(range(300)) and all(g[2] for g in got.values())
    at = np.array([got[i][:2] for i in range(300)])
    scaled = (x - x.mean(0)) / x.std(0)
    assert embedding.trustworthiness(scaled, at, 10) > 0.9
    d = np.sqrt(((at[:, None] - at[None]) ** 2).sum(2))
    same = kind[:, None] == kind[None]
    assert d[same].mean() * 2 < d[~same].mean()
    again = {r.id: (r.x, r.y, r.fitted) for r in embedding.umap(rows.repartition(7), ["id"], names, n_neighbors=15, epochs=100).collect()}
    assert again == got


def test_umap_places_rows_beyond_the_sample(spark):
    x, kind = clusters(120)
    rows, names = table(spark, x, [(500, *map(float, x[0]))] * 3)
    told = embedding.umap(rows, ["id"], names, n_neighbors=10, most=200, epochs=60).collect()
    assert len(told) == 363 and sum(r.fitted for r in told) == 200
    own = {r.id: (r.x, r.y) for r in told if r.id < 500}
    at = np.array([own[i] for i in range(360)])
    centres = np.stack([np.median(at[kind == c], axis=0) for c in range(3)])
    near = ((at[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    assert (near == kind).mean() > 0.98


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_umap_of_few_rows(spark, n):
    rows, names = table(spark, np.arange(12.0).reshape(6, 2)[:n])
    assert embedding.umap(rows, ["id"], names, epochs=5).count() == n


def dense(rows):
    """Maximum likelihood over the whole covariance matrix, by a fine search of the variance ratio."""
    subjects, levels = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    x = np.array([[1.0, *(r[1] == g for g in levels[1:])] for r in rows])
    s = np.array([[r[0] == k for k in subjects] for r in rows], float)
    y = np.array([r[2] for r in rows])
    n = len(y)

    def fit(u):
        v = np.eye(n) + u / (1 - u) * s @ s.T
        i = np.linalg.inv(v)
        cov = np.linalg.inv(x.T @ i @ x)
        b = cov @ x.T @ i @ y
        e = y - x @ b
        scale = e @ i @ e / n
        return -n / 2 * (math.log(2 * math.pi * scale) + 1) - np.linalg.slogdet(v)[1] / 2, b, np.sqrt(np.diag(cov) * scale), scale, u / (1 - u) * scale

    low, high = 0.0, 0.999
    for _ in range(7):
        grid = np.linspace(low, high, 30)
        k = int(np.argmax([fit(u)[0] for u in grid]))
        low, high = grid[max(k - 1, 0)], grid[min(k + 1, 29)]
    return fit(grid[k])


@pytest.mark.parametrize("spread", [0.0, 2.0])
def test_mixed_effects_equal_a_dense_fit(spark, spread):
    r = np.random.default_rng(4)
    rows = []
    for s in range(25):
        shift = r.normal(0, spread)
        for _ in range(r.integers(1, 8)):
            g = r.choice(["WT", "HET", "KO"]) if s % 2 else ["WT", "HET", "KO"][s % 3]
            rows.append((f"s{s}", str(g), float(1000 + (g == "KO") * 1.5 + shift + r.normal())))
    df = spark.createDataFrame([("speed", *x) for x in rows] + [("speed", None, "WT", 1.0), ("speed", "s1", None, 1.0), ("speed", "s1", "KO", None), ("few", "a", "WT", 1.0)], "outcome string, subject string, group string, value double")
    told = {x.parameter: x for x in mixed.mixed_effects(df.repartition(4), ["outcome"]).collect()}
    likelihood, b, se, scale, var = dense(rows)
    assert list(sorted(told)) == ["Intercept", "group[KO]", "group[WT]"]
    for name, e, s in zip(["Intercept", "group[KO]", "group[WT]"], b, se):
        x = told[name]
        assert math.isclose(x.estimate, e, rel_tol=1e-6, abs_tol=1e-5) and math.isclose(x.std_error, s, rel_tol=1e-3)
        assert math.isclose(x.p_value, math.erfc(abs(e / s) / math.sqrt(2)), rel_tol=1e-2, abs_tol=1e-12)
        assert math.isclose(x.log_likelihood, likelihood, abs_tol=1e-5) and math.isclose(x.scale, scale, rel_tol=1e-3) and math.isclose(x.group_var, var, rel_tol=1e-2, abs_tol=1e-3) and x.n_obs == len(rows)


def test_mixed_effects_of_nothing(spark):
    none = spark.createDataFrame([], "outcome string, subject string, group string, value double")
    assert mixed.mixed_effects(none, ["outcome"]).collect() == []


def plain_loop(rows, n, distance, hashes):
    """rows: (genotype, session, key, mark); hashes: key to its two ranks."""
    strata = {}
    for r in rows:
        if r[3] is not None:
            strata.setdefault(r[:2], []).append(r)
    order = sorted(strata, key=lambda s: tuple((x is not None, x or "") for x in s))
    each = max(1, n // len(order)) if order else 0
    spare, picked, marks = n - each * len(order), [], []

    def add(r):
        if any(((r[3] ^ m) & (2**64 - 1)).bit_count() < distance for m in marks):
            return False
        marks.append(r[3])
        picked.append(r[2])
        return True

    for i, s in enumerate(order):
        count = 0
        for r in sorted(strata[s], key=lambda r: hashes[r[2]][0]):
            if count >= each + (i < spare) or len(picked) >= n:
                break
            count += add(r)
    for r in sorted((r for s in order for r in strata[s]), key=lambda r: hashes[r[2]][1]):
        if len(picked) < n and r[2] not in picked:
            add(r)
    return picked


@pytest.mark.parametrize("n,like,strata", [(30, 3, 4), (30, 40, 4), (12, 5, 30), (400, 8, 5)])
def test_diverse_is_the_plain_loop(spark, n, like, strata):
    r = np.random.default_rng(n + like)
    base = [int(x) for x in r.integers(-(2**62), 2**62, max(400 // like, 1))]
    rows = []
    for i in range(400):
        mark = base[i % len(base)] ^ (1 << int(r.integers(0, 63))) ^ (1 << int(r.integers(0, 63)))
        s = i % strata
        rows.append((None if s == 1 else f"G{s % 3}", f"s{s}", i, None if i % 50 == 7 else mark))
    df = spark.createDataFrame(rows, "g string, s string, k long, m long")
    hashes = {x.k: (x.a, x.b) for x in df.select("k", sampling._draw(42, ["k"]).alias("a"), sampling._draw(43, ["k"]).alias("b")).collect()}
    got = sampling.diverse(df.repartition(5), n, ["g", "s"], ["k"], "m").orderBy("picked").collect()
    want = plain_loop(rows, n, 10, hashes)
    assert [x.k for x in got] == want and [x.picked for x in got] == list(range(len(want)))


def test_manifest(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", 1, 5), ("a", "y", 2, 1 << 40), ("b", None, 3, (1 << 33) - 1)], "g string, s string, k long, m long")
    write_manifest(sampling.diverse(df, 3, ["g", "s"], ["k"], "m", distance=2).drop("m"), f"{tmp_path}/manifest")
    files = list((tmp_path / "manifest").glob("*.csv"))
    assert len(files) == 1 and files[0].read_text().splitlines()[0] == "g,s,k" and len(files[0].read_text().splitlines()) == 4
    assert sampling.diverse(df.limit(0), 3, ["g", "s"], ["k"], "m").count() == 0


def separate(x, y, i, kinds):
    """A fit of its own without row i, by plain gradient steps with backtracking."""
    k = np.arange(len(x)) != i
    m, s = x[k].mean(0), x[k].std(0)
    z = np.c_[(x[k] - m) / s, np.ones(k.sum())]
    t = (y[k][:, None] == np.arange(kinds)).astype(float)
    w = np.zeros((kinds, z.shape[1]))
    ridge = np.r_[np.ones(x.shape[1]), 0]
    if kinds == 2:  # one set of weights: the difference of two would have half the penalty
        v = np.zeros(z.shape[1])
        for _ in range(200):
            p = 1 / (1 + np.exp(-z @ v))
            v = v - np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag(ridge), z.T @ (p - t[:, 1]) + ridge * v)
        q = 1 / (1 + np.exp(-np.r_[(x[i] - m) / s, 1] @ v))
        return np.array([1 - q, q])
    for _ in range(20_000):
        q = np.exp(z @ w.T)
        q /= q.sum(1, keepdims=True)
        w = w - 0.02 * ((q - t).T @ z + ridge * w)
    q = np.exp(w @ np.r_[(x[i] - m) / s, 1])
    return q / q.sum()


@pytest.mark.parametrize("kinds", [2, 3])
def test_leave_one_out_is_separate_fits(spark, kinds):
    r = np.random.default_rng(kinds)
    x = r.normal(size=(24, 3)) * [1, 10, 0.1] + [0, 100, 5]
    y = (np.digitize(x[:, 0] + r.normal(0, 0.7, 24), [-0.4, 0.4]) if kinds == 3 else (x[:, 0] + r.normal(0, 0.7, 24) > 0)).astype(int)
    rows = [("s", i, "abc"[y[i]], *map(float, x[i])) for i in range(24)] + [("few", 1, "a", 1.0, 1.0, 1.0), ("s", 99, None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "study string, id long, kind string, a double, b double, c double")
    got = {t.animal: t for t in classify.leave_one_out(df.repartition(3), ["study"], "id", "kind", ["a", "b", "c"]).collect()}
    assert sorted(got) == list(range(24))
    for i in range(24):
        want = separate(x, y, i, kinds)
        assert np.allclose([got[i].shares["abc"[k]] for k in range(kinds)], want, atol=2e-4)
        assert got[i].predicted == "abc"[int(want.argmax())]
    m = classify.metrics(classify.leave_one_out(df, ["study"], "id", "kind", ["a", "b", "c"]), ["study"]).first()
    found = [np.mean([got[i].predicted == "abc"[k] for i in range(24) if y[i] == k]) for k in range(kinds)]
    assert m.n == 24 and math.isclose(m.balanced_accuracy, np.mean(found)) and (m.sensitivity == found[1] if kinds == 2 else m.sensitivity is None)


def test_importances(spark):
    r = np.random.default_rng(9)
    rows = [(i, "ab"[int(v[1] > 0)], *map(float, v)) for i, v in enumerate(r.normal(size=(60, 4)))]
    df = spark.createDataFrame(rows, "id long, kind string, p double, q double, r double, s double").withColumn("study", F.lit(1))
    told = classify.importances(df, ["study"], "kind", list("pqrs")).orderBy("rank").collect()
    assert told[0].feature == "q" and told[0].importance > 0 and [t["rank"] for t in told] == [1, 2, 3, 4]
    forest = classify.forest_importances(df, "kind", list("pqrs"), trees=20).orderBy("rank").collect()
    assert forest[0].feature == "q" and math.isclose(sum(t.importance for t in forest), 1, abs_tol=1e-6)


def test_too_large_a_study(spark, monkeypatch):
    monkeypatch.setattr(classify, "MOST_ANIMALS", 3)
    df = spark.createDataFrame([(1, i, "ab"[i % 2], 1.0) for i in range(4)], "study int, id long, kind string, a double")
    with pytest.raises(ValueError, match="4 animals"):
        classify.leave_one_out(df, ["study"], "id", "kind", ["a"])
