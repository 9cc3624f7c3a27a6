"""Per-session recursions that no window function expresses: moving averages, Kalman smoothing, assignment.

A session's rows are read in order, in batches, and only the filter's state is carried on: no session is held whole. The moving
average is a scan of (factor, sum) pairs, so blocks of a session are worked on apart; a Kalman filter, whose gate
depends on what came before, takes one task a session. ``streaming.live`` carries the same states across micro-batches.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Frames of a block of the moving average.
BLOCK = 512


def _carried(batches, n_keys: int, decay: float):
    """Blocks in order: what each starts from, the average at the end of the block before (at first, the first value)."""
    now, e, seen = None, None, False
    for batch in batches:
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(n_keys))))
        count, total, first = (batch.column(n_keys + 1 + i).to_pylist() for i in range(3))
        carry, earlier = [], []
        for k, c, t, v in zip(keys, count, total, first):
            if k != now:
                now, e, seen = k, None, False
            e = v if e is None else e
            carry.append(e)
            earlier.append(seen)
            if c:
                e, seen = t + decay**c * e, True
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n_keys + 1)), pa.array(carry, pa.float64()), pa.array(earlier, pa.bool_())], names=[*batch.schema.names[: n_keys + 1], "carry", "earlier"])


def moving_average(frames: DataFrame, value: str, decay: float = 0.97, keys=("session_id",), more=()) -> DataFrame:
    """Exponential average that includes the current row and skips nulls and NaNs; null before the first value.

    Blocks of frames are averaged from 0 by windows; one row for each block is read in order to find what it starts
    from, and that, times the block's decay so far, is added to its rows. more: columns of frames that come along.
    """
    if not 0 < decay < 1:
        raise ValueError("decay is between 0 and 1")
    size = max(1, min(BLOCK, int(-230 / math.log(decay))))  # powers of the decay stay within doubles
    v = F.col(value).cast("double")
    own = frames.select(*keys, F.col("frame_index").cast("long").alias("frame_index"), F.when(~F.isnan(v), v).alias("_v"), *more).withColumn("_b", F.floor(F.col("frame_index") / size))
    so_far = Window.partitionBy(*keys, "_b").orderBy("frame_index").rowsBetween(Window.unboundedPreceding, 0)
    d = F.lit(decay)
    own = own.withColumn("_c", F.count("_v").over(so_far))
    own = own.withColumn("_s", F.pow(d, "_c") * F.coalesce(F.sum((1 - decay) * F.col("_v") * F.pow(d, -F.col("_c"))).over(so_far), F.lit(0.0)))
    last = F.max_by("_s", "frame_index")
    blocks = own.groupBy(*keys, "_b").agg(F.count("_v").alias("n"), last.alias("total"), F.min_by("_v", F.when(F.col("_v").isNotNull(), F.col("frame_index"))).alias("first"))
    kinds = dict(own.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in (*keys, "_b")) + ", carry double, earlier boolean"
    carried = blocks.repartition(*keys).sortWithinPartitions(*keys, "_b").mapInArrow(lambda it: _carried(it, len(keys), decay), schema)
    carried = carried.withColumnsRenamed({k: f"_k_{k}" for k in keys}).withColumnRenamed("_b", "_kb")
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_b") == F.col("_kb")]
    ema = F.when((F.col("_c") > 0) | F.col("earlier"), F.col("_s") + F.pow(d, "_c") * F.col("carry"))
    return own.join(carried, on).select(*keys, "frame_index", ema.alias("ema"), *more)


def kalman_track(t: np.ndarray, x: np.ndarray, y: np.ndarray, ok: np.ndarray):
    """Constant-velocity filter: x, y of every frame from the first valid one on, and quality ok, low or no_detection."""
    n = len(t)
    px, py, quality = np.full(n, np.nan), np.full(n, np.nan), np.array(["no_detection"] * n, object)
    at = np.flatnonzero(ok)
    if not len(at):
        return px, py, quality
    gaps = np.sort(np.diff(t[at]))
    dt = float(gaps[len(gaps) // 2]) if len(gaps) and gaps[len(gaps) // 2] > 0 else 1.0
    a = np.eye(4)
    a[0, 2] = a[1, 3] = dt
    h = np.eye(2, 4)
    q = np.eye(4) * (15 * dt) ** 2
    s = np.array([x[at[0]], y[at[0]], 0, 0.0])
    p = np.diag([1000.0, 1000, 500, 500])
    px[at[0]], py[at[0]], quality[at[0]] = x[at[0]], y[at[0]], "ok"
    for i in range(at[0] + 1, n):
        s, p = a @ s, a @ p @ a.T + q
        if ok[i]:
            miss = np.array([x[i], y[i]]) - h @ s
            r = np.eye(2) * (400.0 if np.hypot(*miss) > 60 else 25.0)
            cov = h @ p @ h.T + r
            quality[i] = "low" if miss @ np.linalg.solve(cov, miss) > 9 else "ok"
            gain = p @ h.T @ np.linalg.inv(cov)
            s, p = s + gain @ miss, (np.eye(4) - gain @ h) @ p
            px[i], py[i] = s[0], s[1]
    return px, py, quality


class Filter:
    """The filter of ``kalman_track``, frame by frame. Both axes share one covariance, as noise and start are the same.

    state: x, y, their speeds and the covariance's three numbers, or None before the first detection.
    """

    def __init__(self, dt: float, state=None):
        self.dt, self.state = dt, state

    def step(self, ok: bool, x: float, y: float):
        """(x, y, quality) of a frame; x and y are None where there is no detection."""
        if self.state is None:
            if not ok:
                return None, None, "no_detection"
            self.state = (x, y, 0.0, 0.0, 1000.0, 0.0, 500.0)
            return x, y, "ok"
        dt, (px, py, vx, vy, a, b, c) = self.dt, self.state
        noise = (15 * dt) ** 2
        px, py = px + dt * vx, py + dt * vy
        a, b, c = a + 2 * dt * b + dt * dt * c + noise, b + dt * c, c + noise
        quality = "no_detection"
        if ok:
            mx, my = x - px, y - py
            far = math.hypot(mx, my)
            r = 400.0 if far > 60 else 25.0
            quality = "low" if far * far / (a + r) > 9 else "ok"
            g, h = a / (a + r), b / (a + r)
            px, py, vx, vy = px + g * mx, py + g * my, vx + h * mx, vy + h * my
            a, b, c = (1 - g) * a, (1 - g) * b, c - h * b
        self.state = (px, py, vx, vy, a, b, c)
        return (px, py, quality) if ok else (None, None, quality)


def frame_gap(frames: DataFrame) -> DataFrame:
    """(session_id, dt): the upper median of the times between valid frames, 1 where there is none above 0."""
    w = Window.partitionBy("session_id").orderBy("frame_index")
    good = frames.where("ok and x is not null").select("session_id", "frame_index", "t_sec")
    gaps = good.select("session_id", (F.col("t_sec") - F.lag("t_sec").over(w)).alias("gap")).where("gap is not null").groupBy("session_id", "gap").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("session_id").orderBy("gap"))
    ranked = gaps.withColumns({"c": upto, "all": F.sum("n").over(Window.partitionBy("session_id"))})
    middle = ranked.groupBy("session_id").agg(F.min(F.when(F.expr("c > all div 2"), F.col("gap"))).alias("dt"))
    return frames.select("session_id").distinct().join(middle, "session_id", "left").select("session_id", F.when(F.col("dt") > 0, F.col("dt")).otherwise(1.0).alias("dt"))


def _smoothed(batches):
    now, own = None, None
    for batch in batches:
        out = []
        columns = [batch.column(i).to_pylist() for i in range(7)]
        for session, frame, ok, x, y, quality, dt in zip(*columns):
            if own is None or session != now:
                now, own = session, Filter(dt)
            sx, sy, told = own.step(bool(ok) and x is not None and x == x, x, y)
            out.append((sx, sy, "trimmed" if quality == "trimmed" else told))
        x, y, quality = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.float64()), pa.array(y, pa.float64()), pa.array(quality, pa.string())], names=["session_id", "frame_index", "x", "y", "quality"])


def kalman(frames: DataFrame, dt: float | None = None) -> DataFrame:
    """Smoothed x, y and quality of each frame; trimmed frames keep their label, frames without detection have no point.

    dt: seconds between frames; by default each session's median time between valid frames.
    """
    own = frames if "quality" in frames.columns else frames.withColumn("quality", F.lit("ok"))
    own = own.select("session_id", F.col("frame_index").cast("long").alias("frame_index"), "t_sec", "ok", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "quality")
    own = own.join(frame_gap(own), "session_id") if dt is None else own.withColumn("dt", F.lit(float(dt)))
    ready = own.select("session_id", "frame_index", "ok", "x", "y", "quality", "dt").repartition("session_id").sortWithinPartitions("session_id", "frame_index")
    return ready.mapInArrow(_smoothed, f"session_id {dict(own.dtypes)['session_id']}, frame_index long, x double, y double, quality string")


def assign_optimal(cost: np.ndarray) -> list[int]:
    """Column of each row in the cheapest one-to-one assignment (shortest augmenting paths), -1 if columns run out."""
    n, m = cost.shape
    if n > m:
        cost = np.hstack([cost, np.full((n, n - m), cost.max(initial=0) * 2 + 1e6)])
    rows, cols = cost.shape
    u, v, match = np.zeros(rows + 1), np.zeros(cols + 1), np.zeros(cols + 1, int)
    for i in range(1, rows + 1):
        match[0], j = i, 0
        best, used, way = np.full(cols + 1, np.inf), np.zeros(cols + 1, bool), np.zeros(cols + 1, int)
        while True:
            used[j] = True
            gap = np.where(used[1:], np.inf, cost[match[j] - 1] - u[match[j]] - v[1:])
            better = gap < best[1:]
            best[1:][better], way[1:][better] = gap[better], j
            nxt = int(np.argmin(np.where(used[1:], np.inf, best[1:]))) + 1
            d = best[nxt]
            u[match[used]] += d
            v[used] -= d
            best[~used] -= d
            j = nxt
            if match[j] == 0:
                break
        while j:
            match[j], j = match[way[j]], way[j]
    out = [-1] * n
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def assign_greedy(cost: np.ndarray) -> list[int]:
    """Each row in turn takes its cheapest free column."""
    out, free = [], set(range(cost.shape[1]))
    for row in cost:
        j = min(free, key=lambda c: (row[c], c), default=-1)
        free.discard(j)
        out.append(j)
    return out


def assigned(last: list, points: list, reach: float = 200.0, greedy: bool = False) -> list:
    """The point that each track takes in a frame (None: none); ``last``, the tracks' last positions, is brought up to date.

    Cost is distance, twice the reach beyond it; pairs within the reach are taken. A track not seen yet takes a point
    that no other one took.
    """
    d = np.array(points, float).reshape(-1, 2)
    known = [i for i in range(len(last)) if last[i] is not None]
    got: dict[int, int] = {}
    if known and len(d):
        cost = np.array([np.hypot(*(d - last[i]).T) for i in known])
        cost = np.where(cost < reach, cost, 2 * reach)
        for row, (i, j) in enumerate(zip(known, (assign_greedy if greedy else assign_optimal)(cost))):
            if j >= 0 and cost[row, j] < reach:
                got[i] = j
    free = [j for j in range(len(d)) if j not in got.values()]
    for i in range(len(last)):
        if last[i] is None and free:
            got[i] = free.pop(0)
    for i, j in got.items():
        last[i] = (float(d[j, 0]), float(d[j, 1]))
    return [last[i] if i in got else None for i in range(len(last))]


def _assigned(batches, n_animals: int, reach: float, greedy: bool):
    now, last, points = None, [None] * n_animals, []
    out: list[tuple] = []
    kinds = [None, pa.int64(), pa.int32(), pa.float64(), pa.float64()]
    told = lambda: pa.RecordBatch.from_arrays([pa.array(c, t or kind) for c, t in zip(zip(*out), kinds)], names=["session_id", "frame_index", "animal_ix", "x", "y"])

    def ended():
        for i, p in enumerate(assigned(last, points, reach, greedy)):
            out.append((*now, i, *(p or (None, None))))

    for batch in batches:
        kind = batch.schema.field(0).type
        for session, frame, x, y in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if now != (session, frame):
                if now is not None:
                    ended()
                    if now[0] != session:
                        last = [None] * n_animals
                now, points = (session, frame), []
            points.append((x, y))
        if len(out) >= 2000:
            yield told()
            out = []
    if now is not None:
        ended()
        yield told()


def tracks(detections: DataFrame, n_animals: int, reach: float = 200.0, greedy: bool = False) -> DataFrame:
    """(session, frame, animal_ix, x, y) from detections(session_id, frame_index, x, y): each track's point, or null.

    As in ``assigned``, by the cheapest assignment, or with ``greedy`` each track in turn. Tracks keep their last position.
    Detections without x or y are left out; those of a frame are taken in the order of x, y.
    """
    own = detections.where("x is not null and y is not null and frame_index is not null").select("session_id", F.col("frame_index").cast("long").alias("frame_index"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    ready = own.repartition("session_id").sortWithinPartitions("session_id", "frame_index", "x", "y")
    return ready.mapInArrow(lambda it: _assigned(it, n_animals, reach, greedy), f"session_id {dict(own.dtypes)['session_id']}, frame_index long, animal_ix int, x double, y double")
