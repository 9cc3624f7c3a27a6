"""The files that sessions are exported to, as rows: all columns, at five pixels a centimetre."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import phenotype, pose, sequence, session, track, zones
from . import adapters as A
from .queries_pose import _REARING, _measured
from .queries_sequence import K
from .queries_track import _EDGES, _TURN, _ZONE_SUMS, _zone_metrics, freeze, still
from .registry import ORACLES, query

PPC = 5.0
_ZONES = [r[0] for r in A.RECTANGLES]


def _steps(spark, sf):
    return track.kinematics(A.frames(spark, sf, "event_id"), PPC)


def _metrics(spark, sf):
    arena = F.array(*(F.struct(F.lit(p["x"]).alias("x"), F.lit(p["y"]).alias("y")) for p in geometry.rectangle(0, 0, 500, 500)))
    own = _measured(pose.landmarks(A.keypoints(spark, sf)), "t_sec", "ok", "x")
    rears = pose.rearing(own, "body_length", 0.55, ("t_sec", "ok", "x"))
    return session.metrics(_steps(spark, sf), freeze(), still(), arena, PPC, rears=rears)


_KP = ", ".join(f"round({n}_x, 2) AS {n}_x, round({n}_y, 2) AS {n}_y, round({n}_l, 3) AS {n}_likelihood" for n in pose.CANONICAL)


@query(f"""{A.with_('f', 'k', 'z', 'kp', 'pm')}, {_REARING('pm', 'body_length', '0.55')}
SELECT session_id, frame_index AS frame, round(t_sec, 4) AS t_sec, round(k.x, 2) AS x_px, round(k.y, 2) AS y_px, round(k.x / 5, 3) AS x_cm, round(k.y / 5, 3) AS y_cm, zone_id, round(speed_px_s, 3) AS speed_px_s, round(speed_px_s / 5, 3) AS speed_cm_s,
round(CASE WHEN dist_px > 0.5 THEN degrees(atan2(k.y - py, k.x - px)) END, 2) AS heading_deg, body_length AS body_length_px, rearing::INT AS rearing, coalesce(curvature > 0.25, head_body_angle > 90, FALSE)::INT AS grooming,
ear_span AS ear_span_px, curvature AS spine_curvature, round(head_body_angle, 2) AS head_body_angle_deg, 'ok' AS quality, {_KP}
FROM z AS k JOIN kp USING (session_id, frame_index) JOIN pm USING (session_id, frame_index) JOIN rr USING (session_id, frame_index)""")
def frame_export(spark, sf):
    """SNK1: the per-frame file with its landmarks."""
    own = zones.assign_zones(_steps(spark, sf), A.zones_column())
    keep = ("t_sec", "x", "y", "zone_id", "speed_px_s", "speed_cm_s", "heading_deg", "kps")
    m = _measured(pose.landmarks(A.with_keypoints(own)), *keep)
    m = m.select("session_id", "frame_index", *keep, F.col("body_length").alias("body_length_px"), F.col("ear_span").alias("ear_span_px"), F.col("curvature").alias("spine_curvature"), F.col("head_body_angle").alias("head_body_angle_deg"), pose.grooming(F.col("curvature"), F.col("head_body_angle")).alias("grooming"))
    own = pose.rearing(m, "body_length_px", 0.55, (*keep, "body_length_px", "ear_span_px", "spine_curvature", "head_body_angle_deg", "grooming"))
    return session.frame_export(own, PPC, "kps")


_LONG = lambda name, cond, s: f"{A.islands(*cond, name=name)}, {name}t AS (SELECT session_id, round(coalesce(sum(end_t - start_t) FILTER (WHERE state AND end_t - start_t >= {s}), 0), 3) AS {name}_s, count(*) FILTER (WHERE state AND end_t - start_t >= {s}) AS {name}_n FROM {name} GROUP BY 1)"
#: mt: the metrics of a session.
_METRICS = f"""{_TURN}, {A.SQL['kp']}, {A.SQL['pm']}, {_REARING('pm', 'body_length', '0.55')}, kr AS (SELECT k.*, rearing FROM k JOIN rr USING (session_id, frame_index)),
{_LONG('fz', ('k', f'ok AND coalesce(speed_px_s < {A.FREEZING}, FALSE)'), 1)}, {_LONG('im', ('k', f'ok AND coalesce(speed_px_s < {A.IMMOBILE}, FALSE)'), 1)}, {_LONG('re', ('kr', 'ok AND rearing'), 0.2)},
su AS (SELECT session_id, round(arg_max(t_sec, frame_index), 3) AS duration_s, round(avg(ok::INT), 4) AS valid_fraction, round(coalesce(sum(dist_px), 0), 2) AS total_distance_px, round(coalesce(sum(dist_px), 0) / 5, 3) AS total_distance_cm,
  round(avg(speed_px_s), 3) AS mean_speed_px_s, round(avg(speed_px_s) / 5, 3) AS mean_speed_cm_s, round(max(speed_px_s), 3) AS max_speed_px_s, round(max(speed_px_s) / 5, 3) AS max_speed_cm_s,
  round(sqrt((arg_max(x, frame_index) FILTER (WHERE ok) - arg_min(x, frame_index) FILTER (WHERE ok)) ** 2 + (arg_max(y, frame_index) FILTER (WHERE ok) - arg_min(y, frame_index) FILTER (WHERE ok)) ** 2) / nullif(sum(dist_px), 0), 4) AS path_efficiency,
  round(coalesce(sum(delta) FILTER (WHERE delta > 0), 0) / 360, 2) AS clockwise_rotations, round(coalesce(sum(-delta) FILTER (WHERE delta <= 0), 0) / 360, 2) AS anticlockwise_rotations,
  round(coalesce(avg(CASE WHEN ok THEN (least({_EDGES}) <= 25)::INT END), 0), 4) AS thigmotaxis_fraction FROM d GROUP BY session_id),
mt AS (SELECT su.*, round(greatest(0, duration_s - im_s), 3) AS total_time_mobile_s, im_s AS total_time_immobile_s, fz_s AS total_time_freezing_s, fz_n AS freezing_episodes, re_s AS total_time_rearing_s, re_n AS rearing_episodes
  FROM su JOIN fzt USING (session_id) JOIN imt USING (session_id) JOIN ret USING (session_id))"""


@query(f"""{_METRICS} {' UNION ALL '.join(f"SELECT session_id, {i} AS position, '{m}' AS metric, CAST({c} AS DOUBLE) AS value, '{u}' AS unit FROM mt" for i, (m, c, u) in enumerate(session.SUMMARY))}""")
def summary_unpivot(spark, sf):
    """SNK2: all thirteen metrics."""
    return session.summary_export(_metrics(spark, sf))


_PIVOT = ", ".join(f"any_value(round(time_s, 3)) FILTER (WHERE zone_id = '{z}') AS zone_{z}_time_s, any_value(entries) FILTER (WHERE zone_id = '{z}') AS zone_{z}_entries, any_value(round(latency_s, 3)) FILTER (WHERE zone_id = '{z}') AS zone_{z}_latency_s" for z in _ZONES)


@query(f"""{_METRICS}, {A.SQL['z']}, {_ZONE_SUMS}, pv AS (SELECT session_id, {_PIVOT} FROM zm GROUP BY session_id)
SELECT CAST(session_id AS VARCHAR) AS job_id, 'animal ' || session_id AS animal_id, CASE WHEN session_id % 2 = 0 THEN 'vehicle' ELSE 'drug' END AS treatment, CAST(session_id % 3 AS VARCHAR) AS trial, '' AS session, '' AS experiment_id, '' AS experimenter,
{', '.join(session.BATCH[7:])}, pv.* EXCLUDE (session_id) FROM mt JOIN pv USING (session_id)""")
def batch_export(spark, sf):
    """SNK3: all fixed columns, and every zone."""
    s = F.col("session_id")
    rows = _metrics(spark, sf)
    sessions = A.table(spark, sf, "events").select(F.col("user_id").alias("session_id")).distinct()
    meta = sessions.select("session_id", F.concat(F.lit("animal "), s.cast("string")).alias("animal_id"), F.when(s % 2 == 0, "vehicle").otherwise("drug").alias("treatment"), (s % 3).alias("trial"))
    return session.batch_export(rows, meta, _zone_metrics(spark, sf), _ZONES)


@query(f"""SELECT session_id, 'motif_' || label AS feature, usage AS value FROM ({ORACLES['motif_usage']}) UNION ALL SELECT session_id, 'self_rate', self_rate FROM ({ORACLES['self_transition_rate']})
UNION ALL SELECT session_id, metric, coalesce(value, 0) FROM ({ORACLES['summary_unpivot']})""")
def phenotype_vectors(spark, sf):
    """AGG34: usage of motifs, the profile of the sequence and all metrics, as one vector a session."""
    labels = A.labels(spark, sf)
    wide = _metrics(spark, sf).select("session_id", *(F.col(c).alias(m) for m, c, _ in session.SUMMARY))
    own = phenotype.vectors(sequence.usage(labels, K), sequence.self_rate(labels, K), wide)
    return own.withColumn("value", F.round("value", 6))
