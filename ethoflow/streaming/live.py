"""Structured Streaming: time-binned occupancy with watermarks, and a stateful live tracker."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.recursive import Filter, assigned


def binned(stream: DataFrame, time: str = "ts", width: str = "5 minutes", late: str = "10 minutes", key: str = "session_id", value: str = "value") -> DataFrame:
    """Count and sum of a value by tumbling window and key; rows later than the watermark are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), key, "n", "total")


def sessions(stream: DataFrame, time: str = "ts", gap: str = "10 minutes", late: str = "10 minutes", key: str = "session_id") -> DataFrame:
    """Activity sessions that end after a gap."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), key, "n")


LIVE = "session_id string, t_sec double, x double, y double, speed double, distance double, points int"


def live_track(stream: DataFrame, trail: int = 121) -> DataFrame:
    """Speed, cumulative distance and trail length of each detection(session_id, t_sec, x, y), carried across batches.

    State: the last point, the distance so far and how many points the trail holds; detections of a batch are
    taken in time order.
    """

    def step(key, batches, state):
        x = y = t = None
        distance, n = 0.0, 0
        if state.exists:
            x, y, t, distance, n = state.get
        rows = pd.concat(list(batches)).sort_values("t_sec")
        out = []
        for r in rows.itertuples():
            d = ((r.x - x) ** 2 + (r.y - y) ** 2) ** 0.5 if x is not None else 0.0
            speed = d / (r.t_sec - t) if t is not None and r.t_sec > t else None
            distance, n = distance + d, min(trail, n + 1)
            x, y, t = float(r.x), float(r.y), float(r.t_sec)
            out.append((key[0], t, x, y, speed, distance, n))
        state.update((x, y, t, distance, n))
        yield pd.DataFrame(out, columns=["session_id", "t_sec", "x", "y", "speed", "distance", "points"])

    own = stream.select(F.col("session_id").cast("string").alias("session_id"), F.col("t_sec").cast("double").alias("t_sec"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return own.groupBy("session_id").applyInPandasWithState(step, LIVE, "x double, y double, t double, distance double, n int", "append", "NoTimeout")


FILTERED = "session_id string, frame_index long, x double, y double, quality string, ema double"


def live_filtered(stream: DataFrame, dt: float, decay: float = 0.97) -> DataFrame:
    """Smoothed x, y, quality and the moving average of ``value`` for each frame(session_id, frame_index, ok, x, y, value).

    The rows are those of ``recursive.kalman`` with the same dt and of ``recursive.moving_average``, however the frames
    are cut into micro-batches. State by session: the filter's seven numbers and the average. Frames of a batch are
    taken in order; a frame that comes after a later one of its session was seen is filtered where it comes.
    """

    def step(key, batches, state):
        held = json.loads(state.get[0]) if state.exists else {"filter": None, "ema": None}
        own, e = Filter(dt, held["filter"] and tuple(held["filter"])), held["ema"]
        out = []
        for r in pd.concat(list(batches)).sort_values("frame_index").itertuples():
            x, y, quality = own.step(bool(r.ok) and r.x == r.x and r.x is not None, r.x, r.y)
            if r.value == r.value and r.value is not None:
                e = float(r.value) if e is None else decay * e + (1 - decay) * float(r.value)
            out.append((key[0], r.frame_index, x, y, quality, e))
        state.update((json.dumps({"filter": own.state, "ema": e}),))
        yield pd.DataFrame(out, columns=["session_id", "frame_index", "x", "y", "quality", "ema"]).astype({"x": float, "y": float, "ema": float})

    own = stream.select(F.col("session_id").cast("string").alias("session_id"), F.col("frame_index").cast("long").alias("frame_index"), F.coalesce("ok", F.lit(False)).alias("ok"), *(F.col(c).cast("double").alias(c) for c in ("x", "y", "value")))
    return own.groupBy("session_id").applyInPandasWithState(step, FILTERED, "state string", "append", "NoTimeout")


ASSIGNED = "session_id string, frame_index long, animal_ix int, x double, y double"


def live_assigned(stream: DataFrame, n_animals: int, reach: float = 200.0, greedy: bool = False) -> DataFrame:
    """Each track's point by frame, as ``recursive.tracks`` gives them, from detections(session_id, frame_index, x, y).

    State by session: the tracks' last positions. A frame's detections come in one micro-batch.
    """

    def step(key, batches, state):
        last = [p and tuple(p) for p in json.loads(state.get[0])] if state.exists else [None] * n_animals
        out = []
        for frame, rows in pd.concat(list(batches)).sort_values(["frame_index", "x", "y"]).groupby("frame_index"):
            points = list(zip(rows["x"].tolist(), rows["y"].tolist()))
            out += [(key[0], int(frame), i, *(p or (None, None))) for i, p in enumerate(assigned(last, points, reach, greedy))]
        state.update((json.dumps(last),))
        yield pd.DataFrame(out, columns=["session_id", "frame_index", "animal_ix", "x", "y"]).astype({"x": float, "y": float})

    own = stream.where("x is not null and y is not null and frame_index is not null").select(F.col("session_id").cast("string").alias("session_id"), F.col("frame_index").cast("long").alias("frame_index"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return own.groupBy("session_id").applyInPandasWithState(step, ASSIGNED, "state string", "append", "NoTimeout")
