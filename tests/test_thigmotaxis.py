"""thigmotaxis counts valid frames outside the square, by their distance to its border."""

from ethoflow.plans import adapters, registry


def test_frames_outside_the_square(spark, monkeypatch):
    rows = [("near", True, 520.16, 100.0), ("near", True, 250.0, 250.0), ("near", False, None, None), ("far", True, 560.21, 100.0), ("far", True, 10.0, 250.0), ("corner", True, 540.0, 540.0), ("only", True, 560.0, 250.0), ("none", False, None, None)]
    frames = spark.createDataFrame([(s, i, i / 2, ok, x, y) for i, (s, ok, x, y) in enumerate(rows)], "session_id string, frame_index long, t_sec double, ok boolean, x double, y double")
    monkeypatch.setattr(adapters, "frames", lambda *_: frames)
    got = {r.session_id: r.thigmotaxis for r in registry.QUERIES["thigmotaxis"](spark, "").collect()}
    assert got == {"near": 0.5, "far": 0.5, "corner": 0.0, "only": 0.0, "none": 0.0}  # the corner is 56.6 away
