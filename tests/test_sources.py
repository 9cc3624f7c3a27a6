"""Readers, writers and streams over temporary files."""

import os

import pytest
from pyspark.sql import functions as F

from ethoflow.sources import sinks, tracking
from ethoflow.streaming import live


def _file(folder, name, text):
    path = folder / name
    path.write_text(text)
    return str(path)


def test_tracking_csv(spark, tmp_path):
    path = _file(tmp_path, "mouse.1.csv", "Time,X_cm,Y_cm,Zone\n0,1,2,A\n0.04,bad,3,\n,5,6, B \n")
    rows = tracking.read_tracking_csv(spark, path).orderBy("frame_index").collect()
    assert [(r.frame_index, r.t_sec, r.ok, r.x, r.y, r.zone_id) for r in rows] == [(0, 0.0, True, 1.0, 2.0, "A"), (1, 0.04, False, None, 3.0, None), (2, 0.08, True, 5.0, 6.0, "B")]
    with pytest.raises(ValueError):
        tracking.resolve_headers(["frame", "speed"])


def test_pose_csv_of_two_animals(spark, tmp_path):
    text = "scorer,n,n,n,n,n,n\nindividuals,a,a,a,b,b,b\nbodyparts,nose,nose,nose,nose,nose,nose\ncoords,x,y,likelihood,x,y,likelihood\n0,1,2,0.9,3,4,0.1\n1,5,6,0.7,7,8,0.8\n"
    rows = tracking.read_pose_csv(spark, _file(tmp_path, "pose.csv", text)).collect()
    got = {(r.individual, r.frame_index): (r.kps["nose"].x, r.kps["nose"].y) for r in rows}
    assert got == {("a", 0): (1.0, 2.0), ("a", 1): (5.0, 6.0), ("b", 1): (7.0, 8.0)}


def test_ttl_and_busiest_track(spark, tmp_path):
    rows = tracking.read_ttl(spark, _file(tmp_path, "ttl.csv", "t,label\n1.5,lever\nx,lost\n2,\n")).orderBy("t").collect()
    assert [(r.t, r.label) for r in rows] == [(1.5, "lever"), (2.0, "Event")]
    points = spark.createDataFrame([("s", 0, 0, 1.0, 1.0, True), ("s", 0, 0, 3.0, 5.0, True), ("s", 1, 0, 9.0, 9.0, False), ("s", 0, 1, 7.0, 7.0, True)], "session_id string, frame_index int, track int, x double, y double, visible boolean")
    assert [(r.frame_index, r.x, r.y) for r in tracking.busiest_track(points).collect()] == [(0, 2.0, 3.0)]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("s", 0, True, 1.23456, None), ("s", 1, False, None, 2.0)], "session_id string, frame_index int, ok boolean, x double, y double")
    sinks.write_frame_csv(df.coalesce(1), str(tmp_path / "csv"))
    lines = [line for p in sorted((tmp_path / "csv").glob("part-*")) for line in p.read_text().splitlines()]
    assert lines == ["session_id,frame_index,ok,x,y", "s,0,1,1.23,", "s,1,0,,2.0"]
    sinks.write_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).where(F.col("x").isNotNull()).count() == 1
    sinks.write_table(df, str(tmp_path / "table"), "session_id")
    assert sorted(r.frame_index for r in spark.read.parquet(str(tmp_path / "table")).collect()) == [0, 1]


def test_live_track_carries_state(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i, rows in enumerate(([(0, 0, 0), (1, 3, 4)], [(2, 3, 4), (3, 6, 8)])):
        text = "\n".join(f'{{"session_id": "s", "t_sec": {t}.0, "x": {x}.0, "y": {y}.0}}' for t, x, y in rows)
        os.utime(_file(source, f"{i}.json", text), (1000 + i, 1000 + i))
    stream = spark.readStream.schema("session_id string, t_sec double, x double, y double").option("maxFilesPerTrigger", 1).json(str(source))
    out = live.live_track(stream).writeStream.format("memory").queryName("live_points").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    assert out.awaitTermination(120)
    got = [(r.t_sec, r.speed, r.distance, r.points) for r in spark.table("live_points").orderBy("t_sec").collect()]
    assert got == [(0.0, None, 0.0, 1), (1.0, 5.0, 5.0, 2), (2.0, 0.0, 5.0, 3), (3.0, 5.0, 10.0, 4)]


def test_tracking_folder_of_two_layouts(spark, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    _file(folder, "a.csv", "time,x,y,zone\n0,1,2,A\n1,3,4,\n")
    _file(folder, "b.csv", "note,Pos Y,Pos X\nk,20,10\n,40,30\nz,,5\n")
    _file(folder, "c.csv", "time,x,y,zone\n5,6,7,B\n")
    _file(folder, "empty.csv", "")
    rows = tracking.read_tracking_csv(spark, str(folder), fps=10).orderBy("session_id", "frame_index").collect()
    assert [(r.session_id, r.frame_index, r.t_sec, r.ok, r.x, r.y, r.zone_id) for r in rows] == [
        ("a", 0, 0.0, True, 1.0, 2.0, "A"), ("a", 1, 1.0, True, 3.0, 4.0, None),
        ("b", 0, 0.0, True, 10.0, 20.0, None), ("b", 1, 0.1, True, 30.0, 40.0, None), ("b", 2, 0.2, False, 5.0, None, None),
        ("c", 0, 5.0, True, 6.0, 7.0, "B"),
    ]
    _file(folder, "bad.csv", "a,b\n1,2\n")
    with pytest.raises(ValueError, match="no x and y"):
        tracking.read_tracking_csv(spark, str(folder))


def test_pose_folder_of_two_layouts(spark, tmp_path):
    folder = tmp_path / "poses"
    folder.mkdir()
    _file(folder, "one.csv", "scorer,n,n,n,n\nbodyparts,nose,nose,tail,tail\ncoords,x,y,x,y\n0,1,2,3,4\n1,5,6,,8\n")
    _file(folder, "two.csv", "scorer,n,n,n\nindividuals,a,a,a\nbodyparts,ear,ear,ear\ncoords,likelihood,y,x\n0,0.9,2,1\n1,0.2,2,1\n")
    got = {(r.session_id, r.individual, r.frame_index): {k: (p.x, p.y, p.likelihood) for k, p in r.kps.items()} for r in tracking.read_pose_csv(spark, str(folder)).collect()}
    assert got == {("one", "animal", 0): {"nose": (1.0, 2.0, 1.0), "tail": (3.0, 4.0, 1.0)}, ("one", "animal", 1): {"nose": (5.0, 6.0, 1.0)}, ("two", "a", 0): {"ear": (1.0, 2.0, 0.9)}}


def test_json_documents(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    _file(folder, "a.json", '{"id": 1,\n "name": "x"}')
    _file(folder, "b.json", '{"id": oops')
    rows = tracking.read_json(spark, str(folder), "id long, name string").where("id is not null").collect()
    assert [(r.id, r.name) for r in rows] == [(1, "x")]
    assert tracking.read_json(spark, str(folder), "id long, name string").count() == 1


def test_frame_file(spark, tmp_path):
    p = lambda x, y: {"x": x, "y": y, "likelihood": 0.98765}
    df = spark.createDataFrame([("s", 0, 0.04, 10.0, 5.0, True, {"Snout": p(1.006, 2.0)}), ("s", 1, 0.08, None, None, None, {})], "session_id string, frame_index long, t_sec double, x double, y double, rearing boolean, kps map<string,struct<x:double,y:double,likelihood:double>>")
    sinks.write_frame_file(df.coalesce(1), str(tmp_path / "file"), 4.0, "kps")
    head, first, second = next(iter((tmp_path / "file").glob("part-*"))).read_text().splitlines()
    assert head.split(",")[:8] == ["session_id", "frame", "t_sec", "x_px", "y_px", "x_cm", "y_cm", "zone_id"] and len(head.split(",")) == 1 + 17 + 21
    got = dict(zip(head.split(","), first.split(",")))
    assert (got["x_cm"], got["rearing"], got["quality"], got["nose_x"], got["nose_likelihood"], got["neck_x"]) == ("2.5", "1", "ok", "1.01", "0.988", "")
    assert second.split(",")[3:7] == [""] * 4 and second.split(",")[12:14] == ["0", "0"]


def test_frames_without_the_busiest_track_take_the_first_instance(spark):
    kind = "session_id string, frame_index int, track int, instance int, x double, y double, visible boolean"
    rows = [("s", 0, 7, 1, 1.0, 1.0, True), ("s", 0, 3, 0, 9.0, 9.0, True), ("s", 1, 7, 0, 2.0, 2.0, True), ("s", 2, None, 1, 4.0, 4.0, True), ("s", 2, 3, 0, 5.0, 6.0, True), ("s", 3, 3, 0, 5.0, 5.0, False), ("s", 3, None, 1, 8.0, 8.0, True), ("s", 4, 7, 0, None, 1.0, True), ("s", 5, 7, 0, 6.0, 6.0, True)]
    got = tracking.busiest_track(spark.createDataFrame(rows, kind)).orderBy("frame_index").collect()
    assert [(r.frame_index, r.x, r.y) for r in got] == [(0, 1.0, 1.0), (1, 2.0, 2.0), (2, 5.0, 6.0), (5, 6.0, 6.0)]


def test_windows_and_sessions_of_a_stream(spark, tmp_path):
    from datetime import datetime

    source = tmp_path / "events"
    at = lambda m, s=0: datetime(2024, 1, 1, 0, m, s)
    rows = [("a", at(1), 2.0), ("a", at(4), 3.0), ("b", at(6), 1.0), ("a", at(20), 5.0), ("a", at(25), 1.0), ("b", at(59), 1.0)]
    spark.createDataFrame(rows, "session_id string, ts timestamp, value double").coalesce(1).write.parquet(str(source))

    def run(build, name):
        stream = spark.readStream.schema("session_id string, ts timestamp, value double").parquet(str(source))
        q = build(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        assert q.awaitTermination(120)
        return spark.table(name).collect()

    # the watermark ends ten minutes before the last event
    bins = run(live.binned, "live_bins")
    assert sorted((r.session_id, r.start.minute, r.n, r.total) for r in bins) == [("a", 0, 2, 5.0), ("a", 20, 1, 5.0), ("a", 25, 1, 1.0), ("b", 5, 1, 1.0)]
    visits = run(live.sessions, "live_visits")
    assert sorted((r.session_id, r.start.minute, r.stop.minute, r.n) for r in visits) == [("a", 1, 14, 2), ("a", 20, 35, 2), ("b", 6, 16, 1)]
