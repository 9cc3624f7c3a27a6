"""Pose: keypoint aliases, body measures, normalised features and quality control, as map and array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.geometry import wrap_degrees
from ..functions.scalars import qc_grade, qc_tier
from .islands import longest_gap
from .recursive import moving_average

S = "session_id"
KPS = "map<string,struct<x:double,y:double,likelihood:double>>"
CANONICAL = ["nose", "left_ear", "right_ear", "neck", "mid_spine", "hips", "tail_base"]
#: Names under which trackers report the landmarks, and the point that stands for the body: fixed values.
ALIASES = {
    "nose": ["nose", "snout", "head", "rostrum"],
    "left_ear": ["left_ear", "leftear", "lear", "ear_left", "l_ear", "ear_l"],
    "right_ear": ["right_ear", "rightear", "rear", "ear_right", "r_ear", "ear_r"],
    "neck": ["neck", "throat", "nape", "cervical"],
    "mid_spine": ["mid_spine", "midspine", "spine_mid", "mid_back", "dorsum", "back_mid", "spine2"],
    "hips": ["hips", "hip", "rump", "sacrum", "pelvis", "haunch", "tail_root_up"],
    "tail_base": ["tail_base", "tailbase", "tail1", "tail_root", "tailroot", "base_tail"],
}
BODY = ["mid_spine", "midspine", "spine2", "spine1", "center", "body", "thorax", "mid", "midbody", "mid_body", "back"]


def _named(kps: Column, names: list[str]) -> Column:
    """The keypoint of the first of these names; exact names go before those that differ in case."""
    low = F.map_entries(kps)
    folded = lambda n: F.get(F.filter(low, lambda e: F.lower(e["key"]) == n), F.lit(0))["value"]
    return F.coalesce(*(F.try_element_at(kps, F.lit(n)) for n in names), *map(folded, names))


def canonical(kps: Column) -> Column:
    """The seven landmarks by alias: exact names in order first, then without regard to case."""
    whole = F.map_from_arrays(F.array(*map(F.lit, CANONICAL)), F.array(*(_named(kps, ALIASES[c]) for c in CANONICAL)))
    return F.map_filter(whole, lambda k, v: v.isNotNull())


def likely(kps: Column, least: float = 0.6) -> Column:
    """Keypoints of that likelihood or more; a missing one counts as 1."""
    return F.map_filter(kps, lambda k, v: F.coalesce(v["likelihood"], F.lit(1.0)) >= least)


def all_seven(kps, least: float = 0.6) -> Column:
    good = F.lit(True)
    for p in (_p(kps, c) for c in CANONICAL):
        good = good & F.coalesce(F.coalesce(p["likelihood"], F.when(p.isNotNull(), 1.0)) >= least, F.lit(False))
    return good


def centroid(kps: Column) -> Column:
    """The body point by its aliases, else the mean of all keypoints."""
    body = _named(kps, BODY)
    mean = lambda f: F.aggregate(F.map_values(kps), F.lit(0.0), lambda a, v: a + v[f]) / F.size(kps)
    return F.when(F.size(kps) > 0, F.struct(F.coalesce(body["x"], mean("x")).alias("x"), F.coalesce(body["y"], mean("y")).alias("y")))


def heading(kps: Column) -> Column:
    """Direction from tail to nose in degrees, where they are more than 0.5 apart along an axis."""
    dx, dy = _p(kps, "nose")["x"] - _p(kps, "tail_base")["x"], _p(kps, "nose")["y"] - _p(kps, "tail_base")["y"]
    return F.when((F.abs(dx) > 0.5) | (F.abs(dy) > 0.5), F.degrees(F.atan2(dy, dx)))


def landmarks(frames: DataFrame, kps: str = "kps") -> DataFrame:
    """frames with a column for each landmark (lm_nose, ...), found by alias once a row.

    The columns come from a generator, behind which no expression is copied: measures of many landmarks stay short plans. As in
    ``_named``, exact names go before those that differ in case; each known point gets its landmark and its turn by one look-up.
    """
    turns = {n: 100 * i + j for i, c in enumerate(CANONICAL) for j, n in enumerate(ALIASES[c])}
    table = F.create_map(*(F.lit(x) for pair in turns.items() for x in pair))
    turn = lambda e: F.coalesce(F.try_element_at(table, e["key"]), F.try_element_at(table, F.lower(e["key"])) + 50)
    found = F.transform(F.map_entries(kps), lambda e, i: F.struct(turn(e).alias("turn"), i.alias("i"), e["value"].alias("p")))
    found = F.sort_array(F.filter(found, lambda e: e["turn"].isNotNull() & e["p"].isNotNull()))
    own = frames.select("*", F.inline(F.array(F.struct(found.alias("_found")))))
    own = own.select("*", F.inline(F.array(F.struct(F.transform("_found", lambda e: F.floor(e["turn"] / 100).cast("int")).alias("_at")))))
    seven = F.struct(*(F.get("_found", (F.array_position("_at", F.lit(i)) - 1).cast("int"))["p"].alias(f"lm_{c}") for i, c in enumerate(CANONICAL)))
    return own.select(*frames.columns, F.inline(F.array(seven)))


def bound() -> dict[str, Column]:
    """The columns of ``landmarks`` by name, which all measures below take in place of a map."""
    return {c: F.col(f"lm_{c}") for c in CANONICAL}


def _p(kps, name: str) -> Column:
    return kps[name] if isinstance(kps, dict) else F.try_element_at(kps, F.lit(name))


def _span(kps, a: str, b: str) -> Column:
    return F.hypot(_p(kps, a)["x"] - _p(kps, b)["x"], _p(kps, a)["y"] - _p(kps, b)["y"])


def body_length(kps: Column) -> Column:
    return F.round(_span(kps, "nose", "tail_base"), 2)


def ear_span(kps: Column) -> Column:
    return F.round(_span(kps, "left_ear", "right_ear"), 2)


def head_angle(kps: Column) -> Column:
    """Direction from the neck to the nose (farther than 0.3), else from the middle of the ears."""
    n, k, l, r = (_p(kps, x) for x in ("nose", "neck", "left_ear", "right_ear"))
    dx, dy = n["x"] - k["x"], n["y"] - k["y"]
    ex, ey = n["x"] - (l["x"] + r["x"]) / 2, n["y"] - (l["y"] + r["y"]) / 2
    far = lambda a, b: (F.abs(a) > 0.3) | (F.abs(b) > 0.3)
    return F.coalesce(F.when(far(dx, dy), F.degrees(F.atan2(dy, dx))), F.when(far(ex, ey), F.degrees(F.atan2(ey, ex))))


def curvature(kps: Column) -> Column:
    """Distance of the mid spine from the line nose - tail, over its length; null below length 1."""
    n, t, m = (_p(kps, x) for x in ("nose", "tail_base", "mid_spine"))
    dx, dy = t["x"] - n["x"], t["y"] - n["y"]
    length = F.hypot(dx, dy)
    return F.when(length >= 1, F.round(F.abs(dx * (n["y"] - m["y"]) - (n["x"] - m["x"]) * dy) / (length * length), 4))


def head_body_angle(kps: Column) -> Column:
    n, k, h = (_p(kps, x) for x in ("nose", "neck", "hips"))
    ax, ay, bx, by = n["x"] - k["x"], n["y"] - k["y"], h["x"] - k["x"], h["y"] - k["y"]
    size = F.hypot(ax, ay) * F.hypot(bx, by)
    return F.when(size > 1e-9, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ax * bx + ay * by) / size)))))


def grooming(curve: Column, angle: Column) -> Column:
    return F.coalesce(curve > 0.25, angle > 90, F.lit(False))


def normalised(kps: Column) -> Column:
    """Twelve numbers: six landmarks about the mid spine (else the nose), rotated onto the body axis, over its length.

    Null without nose, tail, length 1 and four of the six; a missing landmark has NaN.
    """
    n, t = _p(kps, "nose"), _p(kps, "tail_base")
    o = F.coalesce(_p(kps, "mid_spine"), n)
    dx, dy = t["x"] - n["x"], t["y"] - n["y"]
    length = F.hypot(dx, dy)
    c, s = dx / length, -dy / length
    six = ["nose", "left_ear", "right_ear", "neck", "hips", "tail_base"]
    px, py = (lambda k: _p(kps, k)["x"] - o["x"]), (lambda k: _p(kps, k)["y"] - o["y"])
    nan = F.lit(float("nan"))
    values = F.array(*(F.coalesce(v, nan) for k in six for v in ((px(k) * c - py(k) * s) / length, (px(k) * s + py(k) * c) / length)))
    have = sum((_p(kps, k).isNotNull().cast("int") for k in six), F.lit(0))
    return F.when((length >= 1) & (have >= 4), values)


FEATURES = [f"{k}_{a}" for k in ("nose", "left_ear", "right_ear", "neck", "hips", "tail_base") for a in "xy"] + ["speed", "turning", "curvature", "sin_angle", "cos_angle", "ear_span", "grooming", "rearing"]


def feature_rows(frames: DataFrame, fps: float, kps: str = "kps") -> DataFrame:
    """features (20 numbers, in the order of FEATURES) and valid, for frames(session_id, frame_index, kps, speed, rearing):
    normalised pose, speed and turning over their session's 95th percentile, curvature, sine and cosine of the head-body
    angle, ear span over body length, grooming, rearing. What can't be told is NaN; a frame without NaN is valid."""
    w, whole = Window.partitionBy(S).orderBy("frame_index"), Window.partitionBy(S)
    k = bound()
    own = landmarks(frames, kps).select(S, "frame_index", "speed", "rearing", normalised(k).alias("_n"), curvature(k).alias("_c"), head_body_angle(k).alias("_d"), F.try_divide(_span(k, "left_ear", "right_ear"), _span(k, "nose", "tail_base")).alias("_e"), head_angle(k).alias("_h"))
    own = own.withColumn("_t", F.abs(wrap_degrees(F.col("_h") - F.lag("_h").over(w))) * fps)
    # the same exchange and sort serve the lag and the percentiles
    scale = lambda c: F.greatest(F.lit(1e-6), F.coalesce(F.percentile(c, 0.95).over(whole), F.lit(1.0)))
    own = own.withColumns({"_ps": scale("speed"), "_pt": scale("_t")})
    nan = lambda c: F.coalesce(c, F.lit(float("nan")))
    angle = F.radians("_d")
    more = [F.col("speed") / F.col("_ps"), F.col("_t") / F.col("_pt"), F.col("_c"), F.sin(angle), F.cos(angle), F.col("_e"), grooming(F.col("_c"), F.col("_d")).cast("double"), F.coalesce(F.col("rearing"), F.lit(False)).cast("double")]
    features = F.concat(F.coalesce(F.col("_n"), F.array_repeat(F.lit(float("nan")), 12)), F.array(*map(nan, more)))
    return own.select(S, "frame_index", features.alias("features")).withColumn("valid", ~F.exists("features", F.isnan))


def _mean(c) -> Column:
    """The mean of measures as decimals: sums that no order of rows changes."""
    return F.avg(F.col(c).cast("decimal(24,12)") if isinstance(c, str) else c.cast("decimal(24,12)")).cast("double")


def body_means(rows: DataFrame, px_per_cm: float = 0.0, keys=(S,)) -> DataFrame:
    """Mean body length (px, and cm where calibrated), ear span, curvature and head-body angle of the rows that have them."""
    cm = F.round(F.col("mean_body_length_px") / px_per_cm, 2) if px_per_cm > 0 else F.lit(None).cast("double")
    own = rows.groupBy(*keys).agg(F.round(_mean("body_length"), 2).alias("mean_body_length_px"), F.round(_mean("ear_span"), 2).alias("mean_ear_span_px"), F.round(_mean("curvature"), 4).alias("mean_curvature"), F.round(_mean("head_body_angle"), 2).alias("mean_head_body_deg"))
    return own.withColumn("mean_body_length_cm", cm)


def upper_median(rows: DataFrame, value: str, keys=(S,)) -> DataFrame:
    """The middle value, the upper one of two."""
    w = Window.partitionBy(*keys).orderBy(value)
    own = rows.where(F.col(value).isNotNull()).withColumns({"_r": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy(*keys))})
    return own.where(F.col("_r") == F.floor(F.col("_n") / 2)).select(*keys, F.col(value).alias("median"))


def rearing(frames: DataFrame, value: str, fraction: float, more=()) -> DataFrame:
    """session_id, frame_index and rearing: the value is below a fraction of its running average (current row included).

    Body length goes with 0.55, a blob's area with 0.40. Rows without a value aren't rearing. more: columns that come along.
    """
    base = moving_average(frames, value, more=(value, *more))
    return base.select(S, "frame_index", F.coalesce(F.col(value) < fraction * F.col("ema"), F.lit(False)).alias("rearing"), *more)


#: Limits of the graded measures, as (acceptable, borderline): fixed values. Jitter is graded by pixels and by body length.
QC_LIMITS = {"valid_share": (0.75, 0.50), "likelihood": (0.70, 0.50), "length_cv": (0.08, 0.15), "max_gap": (15, 45), "jitter_px": (3.0, 6.0), "jitter_norm": (0.025, 0.05)}


def quality(frames: DataFrame, least: float = 0.6) -> DataFrame:
    """By session and landmark: share of frames without it, mean likelihood, median jitter between consecutive frames."""
    # a frame meets the one before it whole: seven points a row are ordered, not seven rows
    w = Window.partitionBy(S).orderBy("frame_index")
    own = frames.select(S, "frame_index", F.array(*(F.try_element_at(F.col("kps"), F.lit(c)) for c in CANONICAL)).alias("_p"))
    own = own.withColumn("_q", F.when(F.lag("frame_index").over(w) + 1 == F.col("frame_index"), F.lag("_p").over(w)))
    good = lambda p: F.coalesce(F.coalesce(p["likelihood"], F.when(p.isNotNull(), 1.0)) >= least, F.lit(False))

    def point(i: int) -> Column:
        p, q = F.get("_p", F.lit(i)), F.get("_q", F.lit(i))
        jitter = F.when(good(p) & good(q), F.hypot(p["x"] - q["x"], p["y"] - q["y"]))
        return F.struct(F.lit(CANONICAL[i]).alias("kp"), good(p).alias("_good"), F.when(p.isNotNull(), F.coalesce(p["likelihood"], F.lit(1.0))).alias("_l"), jitter.alias("_j"))

    own = own.select(S, F.inline(F.array(*map(point, range(len(CANONICAL))))))
    return own.groupBy(S, "kp").agg(F.avg((~F.col("_good")).cast("int")).alias("missing"), _mean("_l").alias("likelihood"), F.median("_j").alias("jitter"))


def length_quality(rows: DataFrame, value: str = "body_length") -> DataFrame:
    """Median, interquartile range, variation and share outside the Tukey fences of a measure, by session."""
    q = rows.groupBy(S).agg(F.percentile(value, [0.25, 0.5, 0.75]).alias("_q"), (F.stddev_pop(value) / F.avg(value)).alias("cv"))
    q1, q3 = F.col("_q")[0], F.col("_q")[2]
    out = F.when((F.col(value) < q1 - 1.5 * (q3 - q1)) | (F.col(value) > q3 + 1.5 * (q3 - q1)), 1.0).when(F.col(value).isNotNull(), 0.0)
    return rows.join(q, S).groupBy(S).agg(F.first(F.col("_q")[1]).alias("median"), F.first(q3 - q1).alias("iqr"), F.first("cv").alias("cv"), F.avg(out).alias("outliers"))


def quality_tiers(frames: DataFrame, least: float = 0.6) -> DataFrame:
    """By session: the five measures of tracking quality (jitter in two units), their grades, and the tier."""
    whole = landmarks(frames.select(S, "frame_index", "t_sec", "kps")).withColumn("_v", all_seven(bound(), least)).select(S, "frame_index", "t_sec", "_v")
    share = whole.groupBy(S).agg(F.avg(F.col("_v").cast("int")).alias("valid_share"))
    gap = longest_gap(whole, ~F.col("_v")).select(S, "max_gap", "gaps_5")
    by_point = quality(frames, least).groupBy(S).agg(F.min(F.coalesce("likelihood", F.lit(0.0))).alias("likelihood"), F.avg(F.coalesce("jitter", F.lit(0.0))).alias("jitter_px"))
    # too few lengths have no spread
    lengths = frames.select(S, _span(F.col("kps"), "nose", "tail_base").alias("_d"))
    size = lengths.groupBy(S).agg(F.percentile("_d", 0.5).alias("median"), (F.stddev_pop("_d") / F.avg("_d")).alias("length_cv"), F.count("_d").alias("_n"))
    own = share.join(gap, S).join(by_point, S).join(size, S)
    own = own.withColumns({"length_cv": F.when(F.col("_n") > 2, F.coalesce("length_cv", F.lit(0.0))).otherwise(0.0), "jitter_norm": F.when(F.col("median") > 0, F.col("jitter_px") / F.col("median")).otherwise(0.0)})
    high = {"valid_share", "likelihood"}
    grade = {k: qc_grade(F.col(k), a, b, k not in high) for k, (a, b) in QC_LIMITS.items()}
    worse = F.greatest(grade["jitter_px"], grade["jitter_norm"])
    five = {"g_valid": grade["valid_share"], "g_likelihood": grade["likelihood"], "g_length": grade["length_cv"], "g_gap": grade["max_gap"], "g_jitter": worse}
    return own.withColumns(five).withColumn("tier", qc_tier(*map(F.col, five))).select(S, *QC_LIMITS, "gaps_5", *five, "tier")
