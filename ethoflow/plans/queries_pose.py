"""Queries of the pose family, over keypoints derived from the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pose, track
from . import adapters as A
from .registry import query

_ROUND = 4


def _r(df, *names, digits=_ROUND):
    return df.withColumns({n: F.round(n, digits) for n in names})


def _canonical(spark, sf):
    own = A.keypoints(spark, sf)
    return own.withColumns({"raw": F.col("kps"), "kps": pose.canonical(F.col("kps"))})


def _measures(spark, sf):
    return _measured(pose.landmarks(A.keypoints(spark, sf)))


def _measured(own, *more):
    k = pose.bound()
    return own.select("session_id", "frame_index", *more, pose.body_length(k).alias("body_length"), pose.ear_span(k).alias("ear_span"), pose.heading(k).alias("heading"), pose.head_angle(k).alias("head_angle"), pose.curvature(k).alias("curvature"), pose.head_body_angle(k).alias("head_body_angle"), pose.all_seven(k).alias("all_seven"))


_ANGLES = ("heading", "head_angle", "head_body_angle")


@query(f"""{A.with_('f', 'kp', 'pm')} SELECT session_id, frame_index, body_length, ear_span, round(heading, 4) AS heading, round(head_angle, 4) AS head_angle, curvature, round(head_body_angle, 4) AS head_body_angle, all_seven,
coalesce(curvature > 0.25, head_body_angle > 90, FALSE) AS grooming FROM pm""")
def pose_measures(spark, sf):
    """SCL12, SCL14 to SCL18, SCL6 (nose and tail), SCL28: landmarks by alias and the measures of each frame."""
    own = _measures(spark, sf)
    return _r(own.withColumn("grooming", pose.grooming(F.col("curvature"), F.col("head_body_angle"))), *_ANGLES)


_MEAN = lambda a: "(" + " + ".join(f"coalesce({n}_{a}, 0)" for n, *_ in A.KEYPOINTS) + ") / nullif(" + " + ".join(f"(({n}_{a} IS NOT NULL)::INT)" for n, *_ in A.KEYPOINTS) + ", 0)"


@query(f"""{A.with_('f', 'kp')} SELECT session_id, frame_index, round({_MEAN('x')}, 4) AS x, round({_MEAN('y')}, 4) AS y FROM kp""")
def pose_centroid(spark, sf):
    """SCL13: the raw names hold no body point, so the mean of all points counts."""
    c = pose.centroid(F.col("raw"))
    return _r(_canonical(spark, sf).select("session_id", "frame_index", c["x"].alias("x"), c["y"].alias("y")), "x", "y")


_SIX = ["nose", "left_ear", "right_ear", "neck", "hips", "tail_base"]
_LEN = "sqrt((tail_base_x - nose_x) ** 2 + (tail_base_y - nose_y) ** 2)"
_OX, _OY = "coalesce(mid_spine_x, nose_x)", "coalesce(mid_spine_y, nose_y)"
_TURNED = ", ".join(f"round((({n}_x - {_OX}) * (tail_base_x - nose_x) + ({n}_y - {_OY}) * (tail_base_y - nose_y)) / len / len, 4) + 0e0 AS {n}_u, round((({n}_y - {_OY}) * (tail_base_x - nose_x) - ({n}_x - {_OX}) * (tail_base_y - nose_y)) / len / len, 4) + 0e0 AS {n}_v" for n in _SIX)


@query(f"""{A.with_('f', 'kp')}, n AS (SELECT *, {_LEN} AS len, {' + '.join(f'({n}_x IS NOT NULL)::INT' for n in _SIX)} AS have FROM kp)
SELECT session_id, frame_index, {_TURNED} FROM n WHERE len >= 1 AND have >= 4""")
def pose_normalised(spark, sf):
    """SCL26: six landmarks about the mid spine, along the body axis, over its length; a missing one is null."""
    own = pose.landmarks(A.keypoints(spark, sf)).select("session_id", "frame_index", pose.normalised(pose.bound()).alias("v")).where("v is not null")
    at = lambda i: F.round(F.when(~F.isnan(F.col("v")[i]), F.col("v")[i]), 4)
    # -0.0 and 0.0 are one number
    return own.select("session_id", "frame_index", *((at(2 * i + j) + F.lit(0.0)).alias(f"{n}_{a}") for i, n in enumerate(_SIX) for j, a in enumerate("uv")))


def _exact(value, unit, digits):
    """The mean of whole multiples of 1 / unit, rounded half up, without a sum of fractions."""
    return f"((2 * sum(CAST(round({value} * {unit}) AS BIGINT))::HUGEINT * {10**digits} + {unit} * count({value})) // nullif(2 * {unit} * count({value}), 0)) / {10**digits}e0"


@query(f"""{A.with_('f', 'kp', 'pm')}, m AS (SELECT session_id, {_exact('body_length', 100, 2)} AS mean_body_length_px, {_exact('ear_span', 100, 2)} AS mean_ear_span_px, {_exact('curvature', 10000, 4)} AS mean_curvature, round(avg(head_body_angle), 2) AS mean_head_body_deg FROM pm GROUP BY session_id)
SELECT *, round(mean_body_length_px / 4, 2) AS mean_body_length_cm FROM m""")
def pose_means(spark, sf):
    """AGG6, calibrated at 4 px a cm."""
    return pose.body_means(_measures(spark, sf), 4.0)


@query(f"""{A.with_('f', 'kp', 'pm')}, r AS (SELECT session_id, body_length, row_number() OVER (PARTITION BY session_id ORDER BY body_length) - 1 AS r, count(*) OVER (PARTITION BY session_id) AS n FROM pm WHERE body_length IS NOT NULL)
SELECT session_id, body_length AS median FROM r WHERE r = n // 2""")
def upper_median_length(spark, sf):
    """AGG43."""
    return pose.upper_median(_measures(spark, sf), "body_length")


_LONG = " UNION ALL ".join(f"SELECT session_id, frame_index, '{n}' AS kp, {n}_x AS x, {n}_y AS y, {n}_l AS l FROM kp" for n, *_ in A.KEYPOINTS)
_QUALITY = f"""lo AS ({_LONG}), lj AS (SELECT *, lag(x) OVER w AS bx, lag(y) OVER w AS by_, lag(l) OVER w AS bl FROM lo WINDOW w AS (PARTITION BY session_id, kp ORDER BY frame_index)),
ql AS (SELECT session_id, kp, avg(CASE WHEN coalesce(l >= 0.6, FALSE) THEN 0 ELSE 1 END) AS missing, {_exact('l', 100, 4)} AS likelihood, median(sqrt((x - bx) ** 2 + (y - by_) ** 2)) FILTER (WHERE l >= 0.6 AND bl >= 0.6) AS jitter FROM lj GROUP BY ALL)"""


@query(f"""{A.with_('f', 'kp')}, {_QUALITY} SELECT session_id, kp, round(missing, 4) AS missing, round(likelihood, 4) AS likelihood, round(jitter, 4) AS jitter FROM ql""")
def pose_quality(spark, sf):
    """AGG20 by landmark."""
    return _r(pose.quality(_canonical(spark, sf)), "missing", "likelihood", "jitter")


@query(f"""{A.with_('f', 'kp', 'pm')}, {_QUALITY}, {A.islands('pm', 'NOT all_seven', name='g').replace('t_sec', 'frame_index')},
gp AS (SELECT session_id, coalesce(max(n) FILTER (WHERE state), 0) AS max_gap, count(*) FILTER (WHERE state AND n >= 5) AS gaps_5 FROM g GROUP BY 1),
ln AS (SELECT session_id, sqrt((nose_x - tail_base_x) ** 2 + (nose_y - tail_base_y) ** 2) AS v FROM kp),
ls AS (SELECT session_id, median(v) AS med, CASE WHEN count(v) > 2 THEN stddev_pop(v) / avg(v) ELSE 0 END AS length_cv FROM ln GROUP BY 1),
vs AS (SELECT session_id, avg(all_seven::INT) AS valid_share FROM pm GROUP BY 1),
qs AS (SELECT session_id, min(coalesce(likelihood, 0)) AS likelihood, avg(coalesce(jitter, 0)) AS jitter_px FROM ql GROUP BY 1),
m AS (SELECT *, CASE WHEN med > 0 THEN jitter_px / med ELSE 0 END AS jitter_norm FROM vs JOIN gp USING (session_id) JOIN ls USING (session_id) JOIN qs USING (session_id)),
gr AS (SELECT *, CASE WHEN valid_share >= 0.75 THEN 'A' WHEN valid_share >= 0.5 THEN 'B' ELSE 'C' END AS g_valid, CASE WHEN likelihood >= 0.7 THEN 'A' WHEN likelihood >= 0.5 THEN 'B' ELSE 'C' END AS g_likelihood,
CASE WHEN length_cv <= 0.08 THEN 'A' WHEN length_cv <= 0.15 THEN 'B' ELSE 'C' END AS g_length, CASE WHEN max_gap <= 15 THEN 'A' WHEN max_gap <= 45 THEN 'B' ELSE 'C' END AS g_gap,
CASE WHEN jitter_px > 6 OR jitter_norm > 0.05 THEN 'C' WHEN jitter_px > 3 OR jitter_norm > 0.025 THEN 'B' ELSE 'A' END AS g_jitter FROM m)
SELECT session_id, round(valid_share, 4) AS valid_share, round(likelihood, 4) AS likelihood, round(length_cv, 4) AS length_cv, max_gap, round(jitter_px, 4) AS jitter_px, round(jitter_norm, 4) AS jitter_norm, gaps_5, g_valid, g_likelihood, g_length, g_gap, g_jitter,
CASE WHEN 'C' IN (g_valid, g_likelihood, g_length, g_gap, g_jitter) OR len(list_filter([g_valid, g_likelihood, g_length, g_gap, g_jitter], lambda x: x = 'B')) >= 3 THEN 'C' WHEN len(list_filter([g_valid, g_likelihood, g_length, g_gap, g_jitter], lambda x: x = 'B')) = 2 THEN 'B' ELSE 'A' END AS tier FROM gr""")
def pose_quality_tiers(spark, sf):
    """SCL31, AGG20 by session: five graded measures, and the tier."""
    return _r(pose.quality_tiers(_canonical(spark, sf)), "valid_share", "likelihood", "length_cv", "jitter_px", "jitter_norm")


_REARING = lambda source, value, fraction: f"""v AS (SELECT session_id, frame_index, {value} AS v, list({value}) FILTER (WHERE {value} IS NOT NULL) OVER (PARTITION BY session_id ORDER BY frame_index) AS past FROM {source}),
rr AS (SELECT session_id, frame_index, coalesce(v < {fraction} * CASE WHEN len(past) > 0 THEN list_reduce(past, lambda a, x: 0.97 * a + 0.03 * x) END, FALSE) AS rearing FROM v)"""  # noqa: E731


@query(f"{A.with_('f', 'kp', 'pm')}, {_REARING('pm', 'body_length', '0.55')} SELECT * FROM rr")
def rearing_by_length(spark, sf):
    """SCL19: body length below 0.55 of its running average."""
    return pose.rearing(_measures(spark, sf), "body_length", 0.55)


@query(f"{A.with_('f')}, {_REARING('f', 'x', '0.4')} SELECT * FROM rr")
def rearing_by_area(spark, sf):
    """SCL20: area (here the x of a frame) below 0.40 of its running average."""
    return pose.rearing(A.frames(spark, sf), "x", 0.40)



_UV = ", ".join(f"(({n}_x - {_OX}) * (tail_base_x - nose_x) + ({n}_y - {_OY}) * (tail_base_y - nose_y)) / len / len AS {n}_u, (({n}_y - {_OY}) * (tail_base_x - nose_x) - ({n}_x - {_OX}) * (tail_base_y - nose_y)) / len / len AS {n}_v" for n in _SIX)


@query(f"""{A.with_('f', 'k', 'kp', 'pm')}, {_REARING('pm', 'body_length', '0.55')}, n AS (SELECT *, {_LEN} AS len, {' + '.join(f'({n}_x IS NOT NULL)::INT' for n in _SIX)} AS have FROM kp),
uv AS (SELECT session_id, frame_index, {_UV} FROM n WHERE len >= 1 AND have >= 4),
h AS (SELECT session_id, frame_index, curvature, head_body_angle, head_angle - lag(head_angle) OVER (PARTITION BY session_id ORDER BY frame_index) AS d FROM pm),
m AS (SELECT h.*, abs(CASE WHEN d > 180 THEN d - 360 WHEN d <= -180 THEN d + 360 ELSE d END) * {A.FPS} AS t, speed_px_s AS s, rearing, sqrt((left_ear_x - right_ear_x) ** 2 + (left_ear_y - right_ear_y) ** 2) / nullif({_LEN}, 0) AS e
      FROM h JOIN k USING (session_id, frame_index) JOIN kp USING (session_id, frame_index) JOIN rr USING (session_id, frame_index)),
a AS (SELECT session_id, frame_index, {', '.join(f'{n}_{x} AS {n}_{y}' for n in _SIX for x, y in (('u', 'x'), ('v', 'y')))}, s / greatest(1e-6, coalesce(quantile_cont(s, 0.95) OVER w, 1)) AS speed, t / greatest(1e-6, coalesce(quantile_cont(t, 0.95) OVER w, 1)) AS turning, curvature,
      sin(radians(head_body_angle)) AS sin_angle, cos(radians(head_body_angle)) AS cos_angle, e AS ear_span, coalesce(curvature > 0.25, head_body_angle > 90, FALSE)::INT::DOUBLE AS grooming, rearing::INT::DOUBLE AS rearing
      FROM m LEFT JOIN uv USING (session_id, frame_index) WINDOW w AS (PARTITION BY session_id))
SELECT session_id, frame_index, {' AND '.join(f'{c} IS NOT NULL' for c in pose.FEATURES)} AS valid, {', '.join(f'round({c}, 4) + 0e0 AS {c}' for c in pose.FEATURES)} FROM a""")
def pose_features(spark, sf):
    """SCL27: the twenty numbers of a frame, and whether all are known."""
    own = A.with_keypoints(track.kinematics(A.frames(spark, sf, "event_id"))).select("session_id", "frame_index", "kps", F.col("speed_px_s").alias("speed"))
    own = pose.rearing(_measured(pose.landmarks(own), "kps", "speed"), "body_length", 0.55, ("kps", "speed"))
    told = pose.feature_rows(own, A.FPS)
    at = lambda i: F.round(F.nanvl(F.col("features")[i], F.lit(None).cast("double")), 4) + F.lit(0.0)
    return told.select("session_id", "frame_index", "valid", *(at(i).alias(c) for i, c in enumerate(pose.FEATURES)))
