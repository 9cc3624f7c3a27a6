"""What reviews found: ranks, whole results, and plans that grow with the tables."""

import numpy as np
from pyspark.sql import functions as F

from ethoflow.operators import compare, embedding, islands, pose
from ethoflow.plans import registry

DIR = "/root/testdata/sf0.001"

def test_p_of_no_size_rank_by_feature(spark):
    """Both p are below what one minus an area tells from 0, the second one farther."""
    noise = [x / 10 for x in range(40)]
    data = [(f, g, v + gap * (g == "a")) for f, gap in (("first", 3.0), ("second", 4.0), ("third", 0.5)) for g in "ab" for v in noise]
    got = {r.feature: (r["rank"], r.q) for r in compare.compare(spark.createDataFrame(data, "feature string, group string, value double"), "a", "b").collect()}
    assert got["second"][1] < got["first"][1] < 1e-9 < got["third"][1]
    assert {f: r for f, (r, _) in got.items()} == {"first": 1, "second": 2, "third": 3}


def test_water_maze_has_all_its_columns(spark):
    out = registry.QUERIES["water_maze"](spark, DIR)
    assert dict(out.dtypes)["platform_latency_s"] == "double"
    assert {r.platform_latency_s for r in out.collect()} == {None}  # no zone is a platform
    assert "platform_latency_s" in registry.ORACLES["water_maze"]


def _scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_frame_export_reads_events_twice(spark):
    """Once for the blocks of the moving average, once for the rows; it was five times, each with the landmarks sought anew."""
    assert _scans(registry.QUERIES["frame_export"](spark, DIR)) <= 2


def test_landmarks_by_alias(spark):
    p = lambda v: (float(v), 0.0, None)
    rows = [(1, {"SNOUT": p(1), "head": p(2), "Rump": p(3), "tail1": p(4), "other": p(5)}), (2, {"nose": None, "Head": p(6)}), (3, None), (4, {})]
    df = spark.createDataFrame(rows, "frame_index int, kps map<string,struct<x:double,y:double,likelihood:double>>")
    got = {r.frame_index: [v and v.x for v in r[2:]] for r in pose.landmarks(df).collect()}
    assert got == {1: [2.0, None, None, None, None, 3.0, 4.0], 2: [6.0] + [None] * 6, 3: [None] * 7, 4: [None] * 7}


def test_batch_export_reads_events_by_few_scans(spark):
    assert _scans(registry.QUERIES["batch_export"](spark, DIR)) <= 6
    assert _scans(registry.QUERIES["summary_unpivot"](spark, DIR)) <= 4


def test_episodes_of_several_kinds_are_those_of_each(spark):
    rows = [(s, i, i / 2 if i % 9 else None, i % 5 != 0, float(i), (i // 3) % 2 == 0, i % 4 > 0) for s in (1, 2, None) for i in range(40)]
    df = spark.createDataFrame(rows, "session_id int, frame_index int, t_sec double, ok boolean, x double, a boolean, b boolean")
    told = islands.episodes_of(df, {"a": (F.col("a"), 1.0), "b": (F.col("b"), 0.5)}).collect()
    for name, least in (("a", 1.0), ("b", 0.5)):
        want = {r.session_id: (r.total_s, r.episodes) for r in islands.episodes(df, F.col(name), least).collect()}
        assert {r.session_id: (r[f"{name}_s"], r[f"{name}_episodes"]) for r in told} == want


def test_neighbours_are_sought_in_bounded_memory():
    """Distances of 256 rows to 50,000 points and their order took over 200 MB of each task."""
    import tracemalloc

    draw = np.random.default_rng(3)
    points = draw.normal(size=(50_000, 4)).astype(np.float32)
    rows = np.arange(300)
    tracemalloc.start()
    near, d = embedding.nearest(points[rows], points, 5, rows)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 64 << 20
    for i in (0, 41, 299):
        plain = np.sqrt(((points[i].astype(float) - points) ** 2).sum(1))
        plain[i] = np.inf
        assert near[i].tolist() == np.argsort(plain, kind="stable")[:5].tolist() and np.allclose(d[i], np.sort(plain)[:5])


def test_quality_tiers_read_events_by_few_scans(spark):
    assert _scans(registry.QUERIES["pose_quality_tiers"](spark, DIR)) <= 4


def test_umap_fits_all_rows(spark):
    """Beyond 50,000 rows a part was fitted and the others were placed among it; the scale came from that part too."""
    n = 50_700
    rows = spark.range(n).select("id", (F.xxhash64("id") % 10_000 / 10_000).alias("a"), (F.xxhash64("id", F.lit(1)) % 10_000 / 10_000).alias("b"))
    told = embedding.umap(rows, ["id"], ["a", "b"], n_neighbors=3, epochs=1)
    got = told.agg(F.count("*").alias("n"), F.count_if("fitted").alias("fitted"), F.count_distinct("id").alias("ids"), F.count_distinct("x").alias("places")).first()
    assert (got.n, got.fitted, got.ids) == (n, n, n) and got.places > 0.9 * n


def test_neighbours_of_points_in_parts(monkeypatch):
    """Copies, far rows and parts of any size: equal to measuring all pairs, ties to the smaller place."""
    monkeypatch.setattr(embedding, "ROWS", 7)
    monkeypatch.setattr(embedding, "POINTS", 50)
    monkeypatch.setattr(embedding, "PAIRS", 100)
    draw = np.random.default_rng(8)
    points = draw.normal(size=(400, 5)).astype(np.float32)
    points[::3] = points[5]  # more copies than neighbours
    points[[100, 200]] *= 1000
    points[300:] = np.round(points[300:])  # equal distances
    seen = embedding.Nearest(points, 12, np.arange(400))
    for low, high in ((0, 4), (4, 130), (130, 131), (131, 400)):
        seen.meet(points[low:high], low)
    plain = ((points[:, None].astype(float) - points) ** 2).sum(2) + np.diag(np.full(400, np.inf))
    order = np.argsort(plain, axis=1, kind="stable")[:, :12]
    assert (seen.places == order).all() and (seen.squares == np.take_along_axis(plain, order, 1)).all()


def test_umap_is_the_same_by_groups_of_any_size(spark, monkeypatch):
    draw = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(draw.normal(size=(300, 3)))] + [(7, 1.0, 1.0, 1.0)] * 3, "id long, a double, b double, c double")
    own = lambda most: sorted(tuple(r) for r in embedding.umap(rows, ["id"], list("abc"), n_neighbors=6, most=most, epochs=10).collect())
    whole, part = own(None), own(200)
    assert len(whole) == len(part) == 303 and all(r[3] for r in whole) and sum(r[3] for r in part) == 200
    for name, value in (("PIECE_BYTES", 48), ("FEWEST_ASKED", 1), ("MOST_ASKED", 30)):
        monkeypatch.setattr(embedding, name, value)
    assert own(None) == whole and own(200) == part
