"""Hand-derived values of FIXTURES.md: T1 (a track with a gap), T2 (motif sequence) and T5 (geometry and pose)."""

import math

import pytest
from pyspark.sql import functions as F

from ethoflow.functions import geometry, scalars
from ethoflow.operators import islands, pose, sequence, session, track, zones

SQUARE = [{"x": 0.0, "y": 0.0}, {"x": 10.0, "y": 0.0}, {"x": 10.0, "y": 10.0}, {"x": 0.0, "y": 10.0}]


@pytest.fixture(scope="module")
def steps(spark):
    xs = [5.0, 5.0, 5.0, 5.0, 20.0, 20.0, None, 5.0, 5.0, 5.0, 5.0]
    rows = [("s", i, i / 2, x is not None, x, None if x is None else 5.0) for i, x in enumerate(xs)]
    frames = spark.createDataFrame(rows, "session_id string, frame_index long, t_sec double, ok boolean, x double, y double")
    return zones.assign_zones(track.kinematics(frames), zones.literal_zones([("Z", "Z", SQUARE)])).cache()


FREEZE, STILL = "speed_px_s < 2", "speed_px_s < 8"


def test_speeds_and_summary(steps):
    assert [r.speed_px_s for r in steps.orderBy("frame_index").collect()] == [None, 0, 0, 0, 30, 0, None, None, 0, 0, 0]
    s = session.summary(steps).first()
    assert (s.distance_px, s.mean_speed, s.max_speed, s.duration_s, s.path_efficiency) == (15.0, 3.75, 30.0, 5.0, 0.0)
    assert s.valid_fraction == pytest.approx(10 / 11)


def test_episodes_and_events(steps):
    e = islands.episodes(steps, F.expr(FREEZE), 1.0).first()
    assert (e.total_s, e.episodes) == (2.5, 2)
    state = scalars.behaviour_state(scalars.valid(F.col("ok"), F.col("x")), F.lit(False), F.coalesce(F.expr(FREEZE), F.lit(False)), F.coalesce(F.expr(STILL), F.lit(False)))
    got = [(r.state, r.start_t, r.end_t) for r in islands.behaviour_events(steps, state).orderBy("start_t").collect()]
    assert got == [("mobile", 0.0, 0.5), ("freezing", 0.5, 2.0), ("mobile", 2.0, 2.5), ("freezing", 2.5, 3.0), ("mobile", 3.5, 4.0), ("freezing", 4.0, 5.0)]


def test_zone_visits(steps, spark):
    assert [(r.entry_t, r.exit_t) for r in islands.zone_events(steps).orderBy("entry_t").collect()] == [(0.0, 2.0), (3.5, 5.0)]
    m = zones.zone_metrics(steps, spark.createDataFrame([("Z",)], "zone_id string"), 2.0).first()
    assert (m.time_s, m.entries, m.latency_s) == (4.0, 2, 0.0)


def test_time_bins(steps):
    bins = session.time_bins(steps, F.expr(STILL), F.expr(FREEZE)).orderBy("bin").collect()
    assert [(b.bins, b.distance_px, b.mean_speed, b.freezing_s, b.freezing_episodes, b.valid_fraction) for b in bins] == [(2, 15.0, 7.5, 1.5, 1, 1.0), (2, 0.0, 0.0, 0.0, 0, 0.8)]
    assert [b.label for b in bins] == ["0:00 – 0:02", "0:02 – 0:05"]


def test_motif_sequence(spark):
    rows = spark.createDataFrame([("s", i, x) for i, x in enumerate([0, 0, 1, 1, 1, 0, -1, 0])], "session_id string, frame_index long, label int")
    t = {(r.i, r.j): (r.n, r.p) for r in sequence.transitions(rows).collect()}
    assert sum(n for n, _ in t.values()) == 6
    assert {k: round(p, 6) for k, (_, p) in t.items()} == {(0, 0): 0.666667, (0, 1): 0.333333, (1, 0): 0.333333, (1, 1): 0.666667}
    s = sequence.stationary(rows, 2).first()
    assert (s.pi, s.entropy, s.entropy_normalized) == (pytest.approx([0.5, 0.5]), pytest.approx(0.636514, abs=1e-6), pytest.approx(0.459148, abs=1e-6))
    assert sequence.self_rate(rows, 2).first().self_rate == pytest.approx(2 / 3)
    assert [(r.dwell_s, r.dwell_cv) for r in sequence.dwell(rows, 2.0).orderBy("label").collect()] == [(1.0, 0.0), (1.5, 0.0)]
    assert [r.usage for r in sequence.usage(rows, 2).orderBy("label").collect()] == pytest.approx([4 / 7, 3 / 7])
    assert sequence.top_trigrams(rows).count() == 5


def test_geometry(spark):
    square = F.array(*(F.struct(F.lit(p["x"]).alias("x"), F.lit(p["y"]).alias("y")) for p in SQUARE))
    at = spark.createDataFrame([(5.0, 5.0), (0.0, 0.0), (10.0, 10.0), (15.0, 5.0), (2.0, 5.0), (13.0, 14.0)], "x double, y double").coalesce(1)
    got = at.select("x", "y", geometry.point_in_polygon(F.col("x"), F.col("y"), square).alias("inside"), geometry.border_distance(F.col("x"), F.col("y"), square).alias("d")).collect()
    assert [r.inside for r in got] == [True, True, False, False, True, False]
    d = {(r.x, r.y): r.d for r in got}
    assert (d[5, 5], d[2, 5], d[13, 14]) == (5.0, 2.0, 5.0)
    angles = spark.createDataFrame([(180.0,), (-180.0,), (190.0,), (-190.0,), (540.0,)], "a double").coalesce(1)
    assert [r.w for r in angles.select(geometry.wrap_degrees(F.col("a")).alias("w")).collect()] == [180, 180, -170, 170, 180]


def test_pose(spark):
    points = {"nose": (0, 0), "tail_base": (10, 0), "mid_spine": (5, 2), "neck": (2, 0), "hips": (8, 0)}
    rows = spark.createDataFrame([({k: (float(x), float(y), 1.0) for k, (x, y) in points.items()},)], "kps map<string,struct<x:double,y:double,likelihood:double>>")
    k = F.col("kps")
    r = rows.select(pose.curvature(k).alias("c"), pose.head_body_angle(k).alias("a"), pose.grooming(pose.curvature(k), pose.head_body_angle(k)).alias("g")).first()
    assert (r.c, r.g) == (0.2, False)
    assert math.isclose(r.a, 180.0)
