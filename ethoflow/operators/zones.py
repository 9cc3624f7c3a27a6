"""Zone assignment and zone metrics. A session's few zones are an array column; frames are never multiplied."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.geometry import border_distance, point_in_polygon
from ..functions.scalars import valid

POINTS = "array<struct<x:double,y:double>>"
ZONE = f"struct<zone_order:int,zone_id:string,zone_name:string,points:{POINTS}>"


def zone_array(zones: DataFrame) -> DataFrame:
    """(session_id, zones): polygons of three vertices or more, in their order."""
    own = zones.where(F.size("points") >= 3).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("zone_order", "zone_id", "zone_name", "points"))).alias("zones"))
    return own


def literal_zones(zones: list[tuple[str, str, list[dict]]]):
    """Zones given by the caller, (id, name, points), as one constant array column for every session."""
    one = lambda i, z: F.struct(F.lit(i).alias("zone_order"), F.lit(z[0]).alias("zone_id"), F.lit(z[1]).alias("zone_name"), F.array(*(F.struct(F.lit(float(p["x"])).alias("x"), F.lit(float(p["y"])).alias("y")) for p in z[2])).alias("points"))
    return F.array(*(one(i, z) for i, z in enumerate(zones) if len(z[2]) >= 3))


def assign_zones(frames: DataFrame, zones) -> DataFrame:
    """zone_id of the first zone that holds the point, null for invalid frames. zones: a DataFrame or an array Column."""
    if isinstance(zones, DataFrame):
        frames = frames.drop("zones").join(zone_array(zones), "session_id", "left")
        array = F.col("zones")
    else:
        array = zones
    hit = F.filter(array, lambda z: point_in_polygon(F.col("x"), F.col("y"), z["points"]))
    first = F.when(valid(F.col("ok"), F.col("x")), F.get(hit, F.lit(0))["zone_id"])
    return frames.withColumn("zone_id", first).drop("zones")


def zone_metrics(frames: DataFrame, zones: DataFrame, fps: float) -> DataFrame:
    """For each session and zone: time (frames / fps), entries, first latency, mean speed and distance in the zone.

    Steps join consecutive rows inside the zone, so they bridge the gaps between visits. zones(zone_id) lists
    what is reported, with 0 where a zone has no frame: they gather in one row, as a session's zones are a handful. Frames are
    read and exchanged once: visits, steps and sums share their partitioning by session.
    """
    s = Window.partitionBy("session_id").orderBy("frame_index")
    w = Window.partitionBy("session_id", "_z").orderBy("frame_index")
    own = frames.select("session_id", "frame_index", "t_sec", "x", "y", F.when(valid(F.col("ok"), F.col("x")), F.col("zone_id")).alias("_z"))
    own = own.withColumn("_e", (~F.lag("_z").over(s).eqNullSafe(F.col("_z"))).cast("int")).withColumn("_p", F.lag(F.struct("x", "y", "t_sec")).over(w))
    d, dt = F.hypot(F.col("x") - F.col("_p.x"), F.col("y") - F.col("_p.y")), F.col("t_sec") - F.col("_p.t_sec")
    inside = own.groupBy("session_id", "_z").agg((F.count("*") / F.lit(float(fps))).alias("time_s"), F.sum("_e").alias("entries"), F.min("t_sec").alias("latency_s"), F.avg(F.when(dt > 0, d / dt)).alias("mean_speed"), F.sum(d).alias("distance"))
    values = ["time_s", "entries", "latency_s", "mean_speed", "distance"]
    # frames outside all zones keep their session in the result
    by = inside.groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.when(F.col("_z").isNotNull(), F.struct("_z", F.struct(*values))))).alias("_m"))
    listed = zones.agg(F.collect_set("zone_id").alias("_zones"))  # one row
    out = by.crossJoin(F.broadcast(listed)).select("session_id", "_m", F.explode("_zones").alias("zone_id")).withColumn("_v", F.try_element_at("_m", "zone_id"))
    zero = F.lit(0.0)
    return out.select("session_id", "zone_id", F.coalesce("_v.time_s", zero).alias("time_s"), F.coalesce("_v.entries", F.lit(0).cast("long")).alias("entries"), "_v.latency_s", "_v.mean_speed", F.coalesce("_v.distance", zero).alias("distance"))


def thigmotaxis_share(arena, px_per_cm: float = 0.0, margin_cm: float = 5.0, margin_px: float = 50.0):
    """The aggregate of ``thigmotaxis``."""
    margin = margin_cm * px_per_cm if px_per_cm > 0 else margin_px
    near = border_distance(F.col("x"), F.col("y"), arena) <= margin
    return F.coalesce(F.avg(F.when(valid(F.col("ok"), F.col("x")), near.cast("int"))), F.lit(0.0))


def thigmotaxis(frames: DataFrame, arena, px_per_cm: float = 0.0, margin_cm: float = 5.0, margin_px: float = 50.0) -> DataFrame:
    """Share of valid frames whose border distance is within the margin; 0 without valid frames."""
    return frames.groupBy("session_id").agg(thigmotaxis_share(arena, px_per_cm, margin_cm, margin_px).alias("thigmotaxis"))


def heatmap(frames: DataFrame, width: float, height: float, columns: int = 80) -> DataFrame:
    """Occupancy count and mean speed by cell of a grid, with the count over the session's largest count."""
    rows = max(1, round(columns * height / width))
    cell = lambda c, size, n: F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor(F.col(c) / size * n))).cast("int")
    own = frames.where(valid(F.col("ok"), F.col("x"))).groupBy("session_id", cell("x", width, columns).alias("cx"), cell("y", height, rows).alias("cy")).agg(F.count("*").alias("n"), F.avg("speed_px_s").alias("mean_speed"))
    return own.withColumn("level", F.col("n") / F.max("n").over(Window.partitionBy("session_id")))


def cumulative_zone_time(frames: DataFrame, fps: float, points: int = 500) -> DataFrame:
    """Running seconds in each frame's zone, told at every floor(n / points)-th frame."""
    s = Window.partitionBy("session_id")
    z = Window.partitionBy("session_id", "zone_id").orderBy("frame_index").rowsBetween(Window.unboundedPreceding, 0)
    own = frames.withColumns({"cumulative_s": F.count("zone_id").over(z) / F.lit(float(fps)), "_n": F.count("*").over(s), "_r": F.row_number().over(s.orderBy("frame_index")) - 1})
    return own.where(f"_r % greatest(1, _n div {points}) = 0").select("session_id", "frame_index", "t_sec", "zone_id", "cumulative_s")


def nearest_frame(frames: DataFrame, clicks: DataFrame, within: float) -> DataFrame:
    """For each click(session_id, click_id, cx, cy) the closest valid frame nearer than ``within``."""
    own = frames.where(valid(F.col("ok"), F.col("x"))).select("session_id", "frame_index", "x", "y")
    d = F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"))
    near = own.join(clicks, "session_id").withColumn("distance", d).where(F.col("distance") < within)
    return near.groupBy("session_id", "click_id").agg(F.min(F.struct("distance", "frame_index")).alias("m")).select("session_id", "click_id", "m.frame_index", "m.distance")
