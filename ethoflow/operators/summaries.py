"""Smaller operators: drawn trajectories, headings of the tracker, calibration, conditioning, arms, platforms, protocols."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.geometry import point_in_polygon, wrap_degrees
from ..functions.scalars import names_zone, valid
from .paradigms import fear_epochs
from .track import KEY, ordered

S = "session_id"
#: Words of epochs: fixed values.
BASELINE_WORDS = ["baseline", "pre", "iti"]
CS_WORDS = ["cs", "tone", "recall"]


def line_breaks(frames: DataFrame, width: float, height: float, share: float = 0.2, keys=KEY) -> DataFrame:
    """Adds drawn: whether a line leads to this frame from the one before.

    A step of more than ``share`` of the larger side isn't drawn, and its point starts no line; so of jumps in a row
    every second one isn't even tested, its point starting afresh.
    """
    w = ordered(keys)
    v = valid(F.col("ok"), F.col("x"))
    p = F.lag(F.struct(v.alias("v"), "x", "y")).over(w)
    own = frames.withColumns({"_p": p, "_n": F.row_number().over(w)})
    both = v & F.coalesce(F.col("_p.v"), F.lit(False))
    far = F.hypot(F.col("x") - F.col("_p.x"), F.col("y") - F.col("_p.y")) > share * max(width, height)
    own = own.withColumns({"_both": both, "_far": both & F.coalesce(far, F.lit(False))})
    since = F.col("_n") - F.coalesce(F.max(F.when(~F.col("_far"), F.col("_n"))).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    own = own.withColumn("_cut", F.col("_far") & (since % 2 == 1))
    drawn = F.col("_both") & ~F.col("_cut") & ~F.coalesce(F.lag("_cut").over(w), F.lit(False))
    return own.withColumn("drawn", drawn).drop("_p", "_n", "_both", "_far", "_cut")


def visible_points(kps: Column, least: float) -> Column:
    """Keypoints of a likelihood of ``least`` or more, an unknown one being 1; 0 shows all."""
    return F.map_filter(kps, lambda k, v: F.coalesce(v["likelihood"], F.lit(1.0)) >= least) if least > 0 else kps


def tracker_headings(frames: DataFrame, min_px: float = 1.0, keys=KEY) -> DataFrame:
    """Valid frames with heading_deg and heading_delta_deg against the valid frame before, null where that has no heading."""
    w = ordered(keys)
    own = frames.where(valid(F.col("ok"), F.col("x")))
    own = own.withColumn("_p", F.lag(F.struct("x", "y")).over(w))
    dx, dy = F.col("x") - F.col("_p.x"), F.col("y") - F.col("_p.y")
    own = own.withColumn("heading_deg", F.when(F.hypot(dx, dy) > min_px, F.degrees(F.atan2(dy, dx))))
    return own.withColumn("heading_delta_deg", wrap_degrees(F.col("heading_deg") - F.lag("heading_deg").over(w))).drop("_p")


def px_per_cm(ax: Column, ay: Column, bx: Column, by: Column, cm: Column) -> Column:
    """Scale from two points and their real distance; null where that isn't positive."""
    return F.when(cm > 0, F.hypot(bx - ax, by - ay) / cm)


def inside_arena(detections: DataFrame, arena: Column) -> DataFrame:
    """Detections inside a polygon; all, where it has fewer than three corners."""
    return detections.where((F.size(arena) < 3) | point_in_polygon(F.col("x"), F.col("y"), arena))


def _says(name: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.lower(name).contains(w) for w in words))


def fear_summary(frames: DataFrame, epochs: DataFrame, freezing: Column, min_s: float = 1.0) -> DataFrame:
    """baseline_pct of the last epoch that is a baseline, and mean_cs_pct of the others that are a stimulus.

    Epochs (session_id, epoch_id, name, start_t, end_t); one without valid frames has 0 %.
    """
    frozen = fear_epochs(frames, epochs, freezing, min_s).select(S, "epoch_id", "freezing_s")
    span = F.greatest(F.col("end_t") - F.col("start_t"), F.lit(0.001))
    own = epochs.join(frozen, [S, "epoch_id"], "left").withColumn("_pct", 100 * F.coalesce("freezing_s", F.lit(0.0)) / span)
    base = _says(F.col("name"), BASELINE_WORDS)
    stimulus = ~base & _says(F.col("name"), CS_WORDS)
    return own.groupBy(S).agg(F.max_by(F.when(base, F.col("_pct")), F.when(base, F.col("start_t"))).alias("baseline_pct"), F.avg(F.when(stimulus, F.col("_pct"))).alias("mean_cs_pct"))


def arm_visits(events: DataFrame, arms: list[str]) -> DataFrame:
    """Visits of each arm, in sessions of three arms and three visits or more."""
    n = events.where(F.col("zone_id").isin(arms)).groupBy(S, "zone_id").agg(F.count("*").alias("visits"))
    w = Window.partitionBy(S)
    own = n.withColumns({"_arms": F.count("*").over(w), "_all": F.sum("visits").over(w)})
    return own.where("_arms >= 3 and _all >= 3").drop("_arms", "_all")


def platform(zones: DataFrame, frames: DataFrame, x: float, y: float, px_per_cm: float) -> DataFrame:
    """Latency of the platform zone, and the mean distance of valid frames from its centre in cm (null without a scale)."""
    latency = zones.where(names_zone(F.col("zone_id"), "platform")).groupBy(S).agg(F.min("latency_s").alias("latency_s"))
    d = F.when(valid(F.col("ok"), F.col("x")), F.hypot(F.col("x") - x, F.col("y") - y))
    mean = F.avg(d) / px_per_cm if px_per_cm > 0 else F.lit(None).cast("double")
    return frames.groupBy(S).agg(mean.alias("proximity_cm")).join(latency, S)


def protocols(imports: DataFrame) -> DataFrame:
    """imports(seq, json): the last import of each id, with its name; texts that aren't protocols are left out."""
    own = imports.select("seq", F.from_json("json", "id string, name string").alias("p")).where("p.id is not null")
    return own.groupBy(F.col("p.id").alias("id")).agg(F.max("seq").alias("seq"), F.max_by("p.name", "seq").alias("name"))
