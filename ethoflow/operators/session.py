"""Session aggregates: kinematics, time bins, place preference, rotations, social proximity, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.scalars import time_label, valid
from .islands import episodes_of, runs
from .pose import CANONICAL, landmarks
from .zones import thigmotaxis_share


def summary(steps: DataFrame, *more) -> DataFrame:
    """Distance, speeds, duration (time of the last frame), valid share, rotations and path efficiency by session; more aggregates may follow."""
    v = valid(F.col("ok"), F.col("x"))
    point = F.struct("x", "y")
    turn = F.col("heading_delta_deg")
    out = steps.groupBy("session_id").agg(
        F.count("*").alias("frames"),
        F.coalesce(F.sum("dist_px"), F.lit(0.0)).alias("distance_px"),
        F.avg("speed_px_s").alias("mean_speed"),
        F.max("speed_px_s").alias("max_speed"),
        F.max_by("t_sec", "frame_index").alias("duration_s"),
        F.avg(v.cast("int")).alias("valid_fraction"),
        (F.coalesce(F.sum(F.when(turn > 0, turn)), F.lit(0.0)) / 360).alias("rotations_cw"),
        (F.coalesce(F.sum(F.when(turn <= 0, -turn)), F.lit(0.0)) / 360).alias("rotations_ccw"),
        F.min_by(F.when(v, point), F.when(v, F.col("frame_index"))).alias("_a"),
        F.max_by(F.when(v, point), F.when(v, F.col("frame_index"))).alias("_b"),
        *more,
    )
    straight = F.hypot(F.col("_b.x") - F.col("_a.x"), F.col("_b.y") - F.col("_a.y"))
    return out.withColumn("path_efficiency", F.when(F.col("distance_px") > 0, F.round(straight / F.col("distance_px"), 4))).drop("_a", "_b")


def time_bins(steps: DataFrame, immobile, freezing, target_s: float = 300.0, least: int = 2, most: int = 12, min_s: float = 1.0) -> DataFrame:
    """Equal bins of a session, floor(duration / target) of them within [least, most]; [t0, t1), so the last instant is out.

    Distance, mean speed, valid share, immobile and freezing time and freezing episodes; state restarts at each edge.
    """
    v = valid(F.col("ok"), F.col("x"))
    session = steps.groupBy("session_id").agg(F.max_by("t_sec", "frame_index").alias("_d")).where("_d > 0")
    n = F.greatest(F.lit(least), F.least(F.lit(most), F.floor(F.col("_d") / target_s).cast("int")))
    own = steps.join(session, "session_id").withColumn("bins", n).withColumn("bin", F.floor(F.col("t_sec") / (F.col("_d") / F.col("bins"))).cast("int")).where("bin < bins and bin >= 0")
    first = F.row_number().over(Window.partitionBy("session_id", "bin").orderBy("frame_index")) == 1
    own = own.withColumns({"_first": first, "_freeze": v & F.coalesce(freezing, F.lit(False)), "_still": v & F.coalesce(immobile, F.lit(False))})
    sums = own.groupBy("session_id", "bin").agg(
        F.max("bins").alias("bins"), F.max("_d").alias("_d"),
        F.coalesce(F.sum(F.when(~F.col("_first"), F.col("dist_px"))), F.lit(0.0)).alias("distance_px"),
        F.avg(F.when(~F.col("_first"), F.col("speed_px_s"))).alias("mean_speed"), F.avg(v.cast("int")).alias("valid_fraction"),
    )
    out = sums
    for name, flag in (("freezing", "_freeze"), ("immobile", "_still")):
        r = runs(own, F.col(flag), ["session_id", "bin"])
        long = F.col("state") & (F.col("duration_s") >= min_s)
        out = out.join(r.groupBy("session_id", "bin").agg(F.coalesce(F.sum(F.when(long, F.col("duration_s"))), F.lit(0.0)).alias(f"{name}_s"), F.count_if(long).alias(f"{name}_episodes")), ["session_id", "bin"])
    width = F.col("_d") / F.col("bins")
    label = F.concat(time_label(F.col("bin") * width), F.lit(" – "), time_label((F.col("bin") + 1) * width))
    return out.withColumn("label", label).drop("_d")


def place_preference(frames: DataFrame, fps: float, least: int = 20) -> DataFrame:
    """Time in halves of the session's bounding box, and (left - right) / (left + right); from ``least`` frames on."""
    keep = valid(F.col("ok"), F.col("x")) & (F.coalesce(F.col("quality"), F.lit("ok")) != "trimmed" if "quality" in frames.columns else F.lit(True))
    own = frames.where(keep)
    box = own.groupBy("session_id").agg(F.count("*").alias("_n"), ((F.min("x") + F.max("x")) / 2).alias("_mx"), ((F.min("y") + F.max("y")) / 2).alias("_my")).where(f"_n >= {least}")
    share = lambda c: F.count_if(c) / F.lit(float(fps))
    out = own.join(box, "session_id").groupBy("session_id").agg(share(F.col("x") < F.col("_mx")).alias("left_s"), share(F.col("x") >= F.col("_mx")).alias("right_s"), share(F.col("y") < F.col("_my")).alias("top_s"), share(F.col("y") >= F.col("_my")).alias("bottom_s"))
    total = F.col("left_s") + F.col("right_s")
    return out.withColumn("preference", F.when(total > 0, (F.col("left_s") - F.col("right_s")) / total))


def social(pairs: DataFrame, near_px: float, min_s: float = 0.5) -> DataFrame:
    """Time near, episodes and first latency from (session_id, frame_index, t_sec, inter_animal_dist_px)."""
    near = F.coalesce(F.col("inter_animal_dist_px") < near_px, F.lit(False))
    r = runs(pairs, near)
    long = F.col("state") & (F.col("duration_s") >= min_s)
    first = pairs.groupBy("session_id").agg(F.min(F.when(near, F.col("t_sec"))).alias("latency_s"), F.avg("inter_animal_dist_px").alias("mean_distance"))
    return r.groupBy("session_id").agg(F.coalesce(F.sum(F.when(long, F.col("duration_s"))), F.lit(0.0)).alias("near_s"), F.count_if(long).alias("episodes")).join(first, "session_id")


def rearing_by_zone(frames: DataFrame) -> DataFrame:
    """map zone -> rearing events, taken as a third of the zone's rearing frames, 1 at least."""
    n = frames.where("rearing and zone_id is not null").groupBy("session_id", "zone_id").agg(F.count("*").alias("n"))
    return n.groupBy("session_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("zone_id", F.greatest(F.lit(1), F.expr("cast(n div 3 as int)")).alias("n"))))).alias("rearing"))


def rounded(frames: DataFrame) -> DataFrame:
    """frames with the digits of the per-frame file, under their own names; booleans as 0 and 1, nested columns left out."""
    digits = {"t_sec": 4, "x": 2, "y": 2, "area_px": 2, "speed_px_s": 3, "speed_cm_s": 3, "heading_deg": 2, "heading_delta_deg": 2, "angular_velocity_deg_s": 3}
    flags = ("ok", "rearing", "grooming")
    return frames.select(*(F.round(c, digits[c]).alias(c) if c in digits else F.col(c).cast("int").alias(c) if c in flags else F.col(c) for c in frames.columns if frames.schema[c].dataType.simpleString().split("<")[0] not in ("array", "map", "struct")))


#: Columns of the per-frame file and the digits of those that are rounded: fixed names and digits.
FRAME_COLUMNS = {"frame": None, "t_sec": 4, "x_px": 2, "y_px": 2, "x_cm": 3, "y_cm": 3, "zone_id": None, "speed_px_s": 3, "speed_cm_s": 3, "heading_deg": 2, "body_length_px": 2, "rearing": None, "grooming": None, "ear_span_px": 2, "spine_curvature": 4, "head_body_angle_deg": 2, "quality": None}


def frame_export(frames: DataFrame, px_per_cm: float = 0.0, kps: str | None = None) -> DataFrame:
    """session_id and the columns of the per-frame file; with ``kps``, a map of landmarks, x, y and likelihood of each.

    A column that frames lack is null (quality is ok); rearing and grooming are 0 or 1; cm need a calibration. Centimetres and
    landmarks are rounded like the rest. Writers leave nulls empty.
    """
    have = set(frames.columns)
    of = lambda c: F.col(c) if c in have else F.lit(None)
    cm = lambda c: F.col(c) / px_per_cm if px_per_cm > 0 else F.lit(None)
    flag = lambda c: F.coalesce(of(c).cast("boolean"), F.lit(False)).cast("int")
    raw = {"frame": F.col("frame_index"), "x_px": F.col("x"), "y_px": F.col("y"), "x_cm": cm("x"), "y_cm": cm("y"), "zone_id": of("zone_id").cast("string"), "rearing": flag("rearing"), "grooming": flag("grooming"), "quality": of("quality").cast("string") if "quality" in have else F.lit("ok")}
    base = [(raw[c] if c in raw else of(c)).alias(c) if d is None else F.round((raw[c] if c in raw else of(c)).cast("double"), d).alias(c) for c, d in FRAME_COLUMNS.items()]
    if kps is None:
        return frames.select("session_id", *base)
    point = lambda c, f, d: F.round(F.col(f"lm_{c}")[f], d).alias(f"{c}_{f}")
    whole = landmarks(frames, kps)
    likely = lambda c: F.when(F.col(f"lm_{c}").isNotNull(), F.round(F.coalesce(F.col(f"lm_{c}")["likelihood"], F.lit(1.0)), 3)).alias(f"{c}_likelihood")
    return whole.select("session_id", *base, *(x for c in CANONICAL for x in (point(c, "x", 2), point(c, "y", 2), likely(c))))


def metrics(steps: DataFrame, freezing, immobile, arena, px_per_cm: float = 0.0, min_s: float = 1.0, rearing_min_s: float = 0.2, rears: DataFrame | None = None) -> DataFrame:
    """The metrics of a session under the names and digits of its summary file, from ``track.kinematics`` rows.

    freezing and immobile are conditions on a row; a column rearing, where there is one, gives rearing times; it may come in rows of
    its own (``rears``: session_id, frame_index, t_sec, ok, x, rearing), so that steps aren't joined with it. Mobile time is what of
    the duration isn't immobile. Centimetres are null without calibration. Steps are read twice: for sums, and for episodes.
    """
    base = summary(steps, thigmotaxis_share(arena, px_per_cm).alias("thigmotaxis")).drop("frames")
    num = lambda c, d: F.round(F.col(c), d)
    cm = lambda c, d: F.round(F.col(c) / px_per_cm, d) if px_per_cm > 0 else F.lit(None).cast("double")
    base = base.select(
        "session_id", num("duration_s", 3).alias("duration_s"), num("valid_fraction", 4).alias("valid_fraction"), num("distance_px", 2).alias("total_distance_px"), cm("distance_px", 3).alias("total_distance_cm"),
        num("mean_speed", 3).alias("mean_speed_px_s"), cm("mean_speed", 3).alias("mean_speed_cm_s"), num("max_speed", 3).alias("max_speed_px_s"), cm("max_speed", 3).alias("max_speed_cm_s"),
        "path_efficiency", num("rotations_cw", 2).alias("clockwise_rotations"), num("rotations_ccw", 2).alias("anticlockwise_rotations"), num("thigmotaxis", 4).alias("thigmotaxis_fraction"),
    )
    kinds = {"freezing": (freezing, min_s), "immobile": (immobile, min_s)}
    if rears is None:
        kinds["rearing"] = (F.col("rearing") if "rearing" in steps.columns else F.lit(False), rearing_min_s)
    long = episodes_of(steps, kinds)
    if rears is not None:
        long = long.join(episodes_of(rears, {"rearing": (F.col("rearing"), rearing_min_s)}), "session_id")
    long = long.select("session_id", *(x for name in ("freezing", "immobile", "rearing") for x in (F.round(f"{name}_s", 3).alias(f"total_time_{name}_s"), f"{name}_episodes")))
    base = base.join(long, "session_id")
    mobile = F.round(F.greatest(F.lit(0.0), F.col("duration_s") - F.col("total_time_immobile_s")), 3)
    return base.withColumn("total_time_mobile_s", mobile).drop("immobile_episodes")


#: Rows of the summary file: metric, the column of ``metrics`` and the unit; fixed names, in their order.
SUMMARY = [
    ("duration", "duration_s", "s"), ("tracked_fraction", "valid_fraction", ""), ("total_distance_px", "total_distance_px", "px"), ("total_distance_cm", "total_distance_cm", "cm"),
    ("mean_speed_px_s", "mean_speed_px_s", "px/s"), ("mean_speed_cm_s", "mean_speed_cm_s", "cm/s"), ("max_speed_px_s", "max_speed_px_s", "px/s"), ("max_speed_cm_s", "max_speed_cm_s", "cm/s"),
    ("time_mobile_s", "total_time_mobile_s", "s"), ("time_immobile_s", "total_time_immobile_s", "s"), ("time_freezing_s", "total_time_freezing_s", "s"), ("freezing_episodes", "freezing_episodes", ""), ("thigmotaxis_fraction", "thigmotaxis_fraction", ""),
]


def summary_export(rows: DataFrame) -> DataFrame:
    """``metrics`` as (session_id, position, metric, value, unit), thirteen rows a session."""
    each = F.array(*(F.struct(F.lit(i).alias("position"), F.lit(m).alias("metric"), F.col(c).cast("double").alias("value"), F.lit(u).alias("unit")) for i, (m, c, u) in enumerate(SUMMARY)))
    return rows.select("session_id", F.inline(each))


#: Fixed columns of the batch file, in their order.
META = ["animal_id", "treatment", "trial", "session", "experiment_id", "experimenter"]
BATCH = ["job_id", *META, "duration_s", "total_distance_cm", "total_distance_px", "mean_speed_cm_s", "mean_speed_px_s", "max_speed_cm_s", "total_time_mobile_s", "total_time_immobile_s", "total_time_freezing_s", "freezing_episodes", "thigmotaxis_fraction", "path_efficiency", "clockwise_rotations", "anticlockwise_rotations", "total_time_rearing_s", "rearing_episodes", "valid_fraction"]


def batch_export(rows: DataFrame, meta: DataFrame, zones: DataFrame, zone_names: list[str]) -> DataFrame:
    """One row for each session: the fixed columns, then zone_<name>_{time_s,entries,latency_s} in the given order of names.

    rows: of ``metrics``; meta: session_id with any of META, others are empty; zones: of ``zones.zone_metrics``.
    """
    wide = zones.groupBy("session_id").pivot("zone_id", zone_names).agg(F.round(F.first("time_s"), 3).alias("time_s"), F.first("entries").alias("entries"), F.round(F.first("latency_s"), 3).alias("latency_s"))
    wide = wide.select("session_id", *(F.col(f"`{z}_{m}`").alias(f"zone_{z}_{m}") for z in zone_names for m in ("time_s", "entries", "latency_s")))
    own = meta.select("session_id", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in meta.columns else F.lit("").alias(c) for c in META))
    whole = rows.withColumn("job_id", F.col("session_id").cast("string")).join(own, "session_id", "left").join(wide, "session_id", "left")
    return whole.select(*(F.coalesce(c, F.lit("")).alias(c) if c in META else c for c in BATCH), *wide.columns[1:])
