"""Published values and fixed rules: studentized range, zone roles, landmarks and motif names."""

import pytest
from pyspark.sql import functions as F

from ethoflow.functions import scalars, special
from ethoflow.operators import paradigms, pose


@pytest.mark.parametrize("q,k,df", [(3.877, 3, 10), (4.232, 5, 20), (4.646, 10, 60), (3.917, 5, 120), (3.858, 5, 100_000), (3.314, 3, 10**6), (3.633, 4, 10**7)])
def test_studentized_range_against_tables(q, k, df):
    assert special.studentized_range_upper(q, k, df) == pytest.approx(0.05, abs=3e-4)


def test_zone_roles(spark):
    names = ["Object1", "obj2", "old toy", "New", "Illuminated", "black box", "unilluminated", "Shelter", "closed arm", "close open", "close", "Central", "peripheral", "thigmo", "goal", "escape box", "NW", None]
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r.name: {k for k in scalars.ZONE_WORDS if r[k]} for r in rows.select("name", *(scalars.names_zone(F.col("name"), k).alias(k) for k in scalars.ZONE_WORDS)).collect()}
    assert "novel" in got["Object1"] and "familiar" in got["obj2"] and "familiar" in got["old toy"] and "novel" in got["New"]
    assert "light" in got["Illuminated"] and "light" in got["unilluminated"] and "dark" not in got["unilluminated"]
    assert "dark" in got["black box"] and "dark" in got["Shelter"]
    assert "closed" in got["closed arm"] and "closed" in got["close"] and "closed" not in got["close open"]
    assert "centre" in got["Central"] and "periphery" in got["peripheral"] and "periphery" in got["thigmo"]
    assert "platform" in got["goal"] and "platform" in got["escape box"] and "quadrant" in got["NW"] and got[None] == set()


def test_novel_object_by_raw_names_and_order(spark):
    rows = [("s", "z9", "object1", 9.0, 0), ("s", "z1", "object1 b", 6.0, 2), ("s", "z2", "object2", 2.0, 1)]
    zones = spark.createDataFrame(rows, "session_id string, old_id string, zone_id string, time_s double, place int")
    r = paradigms.novel_object(zones, "place").first()
    assert (r.novel_s, r.familiar_s, r.discrimination, r.preference) == (6.0, 2.0, 0.5, 0.75)


def test_landmarks_by_alias(spark):
    p = lambda x: {"x": x, "y": 0.0, "likelihood": None}
    kps = {"Nose": p(1.0), "nose": p(2.0), "LEAR": p(3.0), "ear_r": p(4.0), "cervical": p(5.0), "spine2": p(6.0), "rump": p(7.0), "tail_root": p(8.0)}
    df = spark.createDataFrame([(kps,), ({},)], f"kps {pose.KPS}")
    first, none = df.select(pose.canonical(F.col("kps")).alias("c"), pose.centroid(F.col("kps")).alias("m"), pose.all_seven(pose.canonical(F.col("kps"))).alias("all")).collect()
    assert {k: v.x for k, v in first.c.items()} == dict(nose=2.0, left_ear=3.0, right_ear=4.0, neck=5.0, mid_spine=6.0, hips=7.0, tail_base=8.0)
    assert first.m.x == 6.0 and first["all"] and none.c == {} and none.m is None and not none["all"]


def test_motif_names(spark):
    rows = [(0.4, 0.9, 0.0, 0.0, 0.0), (0.0, 0.4, 0.0, 0.0, 0.0), (0.0, 0.0, 0.05, 0.05, 0.9), (0.0, 0.0, 0.05, 0.15, 0.0), (0.0, 0.0, 0.25, 0.2, 0.3), (0.0, 0.0, 0.3, 0.7, 0.0), (0.0, 0.0, 0.1, 0.7, 0.0), (0.0, 0.0, 0.8, 0.0, 0.0), (None, None, 0.5, float("nan"), None)]
    df = spark.createDataFrame(rows, "rearing double, grooming double, speed double, turn double, curvature double")
    names = [r[0] for r in df.coalesce(1).select(scalars.motif_label({c: F.col(c) for c in df.columns})).collect()]
    assert names == ["rearing", "grooming", "stillness", "slow_movement", "hunching", "turning", "slow_movement", "running", "walking"]
