"""Frame tracks: trimming, steps between frames, headings, gap filling. One window per session and order.

Frames: session_id, frame_index, t_sec, ok, x, y (+ anything). All columns of one call share a window, so a
session is exchanged and sorted once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.geometry import wrap_degrees
from ..functions.scalars import valid

KEY = ["session_id"]


def ordered(keys=KEY, order="frame_index"):
    return Window.partitionBy(*keys).orderBy(order)


def trimmed(frames: DataFrame, fps: float, start_s: float = 0, end_s: float = 0) -> DataFrame:
    """Frames outside [start, end) stay, with ok false and quality 'trimmed'; 0 switches a bound off."""
    out = F.lit(False)
    if start_s > 0:
        out = out | (F.col("frame_index") < int(start_s * fps))
    if end_s > 0:
        out = out | (F.col("frame_index") >= int(end_s * fps))
    quality = F.col("quality") if "quality" in frames.columns else F.lit("ok")
    return frames.withColumns({"quality": F.when(out, "trimmed").otherwise(quality), "ok": F.col("ok") & ~out})


def kinematics(frames: DataFrame, px_per_cm: float = 0.0, min_heading_px: float = 0.5, keys=KEY) -> DataFrame:
    """Adds steps between consecutive valid frames; any invalid frame breaks the chain.

    dist_px (also where dt <= 0), dt_s, speed_px_s, dist_cm, speed_cm_s, heading_deg (only over steps longer
    than min_heading_px), heading_delta_deg against the last heading across gaps, angular_velocity_deg_s.
    """
    w = ordered(keys)
    v = valid(F.col("ok"), F.col("x"))
    before = F.lag(F.struct(v.alias("v"), "x", "y", "t_sec")).over(w)
    step = frames.withColumn("_p", before).withColumn("_both", v & F.coalesce(F.col("_p.v"), F.lit(False)))
    dx, dy = F.col("x") - F.col("_p.x"), F.col("y") - F.col("_p.y")
    dist, dt = F.hypot(dx, dy), F.col("t_sec") - F.col("_p.t_sec")
    ppc = F.lit(float(px_per_cm))
    step = step.withColumns({"dist_px": F.when(F.col("_both"), dist), "dt_s": F.when(F.col("_both"), dt)})
    step = step.withColumn("speed_px_s", F.when(F.col("dt_s") > 0, F.col("dist_px") / F.col("dt_s")))
    step = step.withColumns({"dist_cm": F.when(ppc > 0, F.col("dist_px") / ppc), "speed_cm_s": F.when(ppc > 0, F.col("speed_px_s") / ppc), "heading_deg": F.when(F.col("dist_px") > min_heading_px, F.degrees(F.atan2(dy, dx)))})
    last = F.last("heading_deg", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    step = step.withColumn("heading_delta_deg", F.when(F.col("heading_deg").isNotNull() & last.isNotNull(), wrap_degrees(F.col("heading_deg") - last)))
    return step.withColumn("angular_velocity_deg_s", F.when(F.col("dt_s") > 0, F.col("heading_delta_deg") / F.col("dt_s"))).drop("_p", "_both")


def since_last_valid(frames: DataFrame, keys=KEY) -> DataFrame:
    """Adds dist_px and speed_px_s against the last valid frame, however long ago it was."""
    w = ordered(keys).rowsBetween(Window.unboundedPreceding, -1)
    v = valid(F.col("ok"), F.col("x"))
    last = F.last(F.when(v, F.struct("x", "y", "t_sec")), ignorenulls=True).over(w)
    out = frames.withColumn("_p", last)
    dist, dt = F.hypot(F.col("x") - F.col("_p.x"), F.col("y") - F.col("_p.y")), F.col("t_sec") - F.col("_p.t_sec")
    out = out.withColumn("dist_px", F.when(v & F.col("_p").isNotNull(), dist))
    return out.withColumn("speed_px_s", F.when(F.col("dist_px").isNotNull() & (dt > 0), F.col("dist_px") / dt)).drop("_p")


def filled(frames: DataFrame, most: int = 3, keys=KEY) -> DataFrame:
    """Inner gaps of up to ``most`` invalid frames, filled by a line between their neighbours (quality 'interpolated')."""
    w = ordered(keys)
    v = valid(F.col("ok"), F.col("x")) & (F.coalesce(F.col("quality"), F.lit("ok")) != "trimmed" if "quality" in frames.columns else F.lit(True))
    point = F.when(v, F.struct("frame_index", "x", "y"))
    out = frames.withColumns({
        "_a": F.last(point, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "_b": F.first(point, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)),
    })
    gap = F.col("_b.frame_index") - F.col("_a.frame_index") - 1
    fill = ~v & F.col("_a").isNotNull() & F.col("_b").isNotNull() & (gap <= most)
    at = (F.col("frame_index") - F.col("_a.frame_index")) / (gap + 1)
    quality = F.col("quality") if "quality" in frames.columns else F.lit("ok")
    return out.withColumns({
        "x": F.when(fill, F.col("_a.x") + at * (F.col("_b.x") - F.col("_a.x"))).otherwise(F.col("x")),
        "y": F.when(fill, F.col("_a.y") + at * (F.col("_b.y") - F.col("_a.y"))).otherwise(F.col("y")),
        "quality": F.when(fill, "interpolated").otherwise(quality),
        "ok": fill | F.col("ok"),
    }).drop("_a", "_b")


def inter_animal_distance(frames: DataFrame, px_per_cm: float = 0.0) -> DataFrame:
    """Distance of animals 0 and 1 by frame, from frames with animal_ix; null where either is invalid."""
    pair = frames.where("animal_ix in (0, 1)").groupBy("session_id", "frame_index").agg(*(F.max(F.when((F.col("animal_ix") == i) & valid(F.col("ok"), F.col("x")), F.struct("x", "y"))).alias(f"_{i}") for i in (0, 1)))
    d = F.hypot(F.col("_0.x") - F.col("_1.x"), F.col("_0.y") - F.col("_1.y"))
    return pair.select("session_id", "frame_index", d.alias("inter_animal_dist_px"), F.when(F.lit(px_per_cm > 0), d / (px_per_cm or 1.0)).alias("inter_animal_dist_cm"))


def top_blobs(detections: DataFrame, n: int, least: float = 80, most: float = 25_000) -> DataFrame:
    """The n largest detections of each frame within the area limits."""
    w = Window.partitionBy("session_id", "frame_index").orderBy(F.desc("area"), "blob")
    return detections.where(F.col("area").between(least, most)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def trail(frames: DataFrame, length: int, keys=KEY) -> DataFrame:
    """The last ``length`` valid points up to each frame."""
    w = ordered(keys).rowsBetween(-(length - 1), 0)
    return frames.withColumn("trail", F.collect_list(F.when(valid(F.col("ok"), F.col("x")), F.struct("x", "y"))).over(w))


def strided(frames: DataFrame, points: int, keys=KEY) -> DataFrame:
    """Every floor(n / points)-th row of each session, in order."""
    n = F.count("*").over(Window.partitionBy(*keys))
    row = F.row_number().over(ordered(keys)) - 1
    return frames.withColumns({"_n": n, "_r": row}).where("_r % greatest(1, _n div {}) = 0".format(points)).drop("_n", "_r")


def corrected(frames: DataFrame, fixes: DataFrame) -> DataFrame:
    """Point updates by (session_id, frame_index): fixes(x, y) replace, with quality 'manual'; null x deletes ('manual_delete')."""
    f = fixes.select("session_id", "frame_index", F.col("x").alias("_x"), F.col("y").alias("_y"), F.lit(True).alias("_fix"))
    out = frames.join(f, ["session_id", "frame_index"], "left")
    fix = F.coalesce("_fix", F.lit(False))
    quality = F.col("quality") if "quality" in frames.columns else F.lit("ok")
    return out.withColumns({"x": F.when(fix, F.col("_x")).otherwise(F.col("x")), "y": F.when(fix, F.col("_y")).otherwise(F.col("y")), "ok": F.when(fix, F.col("_x").isNotNull()).otherwise(F.col("ok")), "quality": F.when(fix & F.col("_x").isNull(), "manual_delete").when(fix, "manual").otherwise(quality)}).drop("_x", "_y", "_fix")


def speed_extremes(frames: DataFrame) -> DataFrame:
    """Mean and largest |angular velocity| of sessions with five values or more, and the largest speed (1 at least)."""
    a = F.abs("angular_velocity_deg_s")
    return frames.groupBy("session_id").agg(F.when(F.count(a) >= 5, F.avg(a)).alias("mean_ang"), F.when(F.count(a) >= 5, F.max(a)).alias("max_ang"), F.greatest(F.lit(1.0), F.coalesce(F.max("speed_cm_s"), F.max("speed_px_s"))).alias("top_speed"))


def column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c
