"""Queries of the track engine over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry, scalars
from ..operators import islands, paradigms, session, track, zones
from . import adapters as A
from .registry import query

_ROUND = 4


def _r(df, *names, digits=_ROUND):
    return df.withColumns({n: F.round(n, digits) for n in names})


def _steps(spark, sf):
    return track.kinematics(A.frames(spark, sf))


def _zoned(spark, sf):
    return zones.assign_zones(_steps(spark, sf), A.zones_column())




def freeze():
    return F.coalesce(F.col("speed_px_s") < A.FREEZING, F.lit(False))


def still():
    return F.coalesce(F.col("speed_px_s") < A.IMMOBILE, F.lit(False))


def _state():
    return scalars.behaviour_state(scalars.valid(F.col("ok"), F.col("x")), F.lit(False), freeze(), still())


_STATE = f"CASE WHEN NOT ok THEN 'untracked' WHEN coalesce(speed_px_s < {A.FREEZING}, FALSE) THEN 'freezing' WHEN coalesce(speed_px_s < {A.IMMOBILE}, FALSE) THEN 'immobile' ELSE 'mobile' END"


@query(f"{A.with_('f', 'k')}, {A.islands('k', _STATE)} SELECT state, count(*) AS events, round(sum(end_t - start_t), 4) AS seconds FROM i WHERE end_t > start_t AND state <> 'untracked' GROUP BY state")
def behaviour_state_seconds(spark, sf):
    """WIN1, SCL21-24, WIN4: events and seconds in each behaviour state."""
    e = islands.behaviour_events(_steps(spark, sf), _state())
    return _r(e.groupBy("state").agg(F.count("*").alias("events"), F.sum("duration_s").alias("seconds")), "seconds")


@query(f"{A.with_('f', 'k')}, {A.islands('k', _STATE)} SELECT session_id, state, start_t, end_t, end_t - start_t AS duration_s FROM i WHERE end_t > start_t AND state <> 'untracked'")
def behaviour_events(spark, sf):
    """WIN4."""
    return islands.behaviour_events(_steps(spark, sf), _state())


@query(f"{A.with_('f', 'k')} SELECT session_id, frame_index, t_sec, ok, x, y, round(dist_px, 4) AS dist_px, round(speed_px_s, 4) AS speed_px_s FROM k")
def frame_kinematics(spark, sf):
    """WIN1, SCL1, SCL5, SCL8: steps between consecutive valid frames."""
    return _r(_steps(spark, sf).select("session_id", "frame_index", "t_sec", "ok", "x", "y", "dist_px", "speed_px_s"), "dist_px", "speed_px_s")


@query(f"""{A.with_('f')}, v AS (SELECT session_id, frame_index, t_sec, x, y, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(t_sec) OVER w AS pt FROM f WHERE ok WINDOW w AS (PARTITION BY session_id ORDER BY frame_index))
SELECT session_id, frame_index, round(sqrt((x-px)*(x-px)+(y-py)*(y-py)), 4) AS dist_px, round(sqrt((x-px)*(x-px)+(y-py)*(y-py)) / (t_sec - pt), 4) AS speed_px_s FROM v""")
def steps_since_last_valid(spark, sf):
    """WIN1b: against the last valid frame, over gaps."""
    own = track.since_last_valid(A.frames(spark, sf)).where("ok")
    return _r(own.select("session_id", "frame_index", "dist_px", "speed_px_s"), "dist_px", "speed_px_s")


_TURN = f"""{A.with_('f', 'k')}, h AS (SELECT *, CASE WHEN dist_px > 0.5 THEN degrees(atan2(y - py, x - px)) END AS head FROM k),
g AS (SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM h),
d AS (SELECT *, 180 - ((180 - (head - before)) - 360 * floor((180 - (head - before)) / 360)) AS delta FROM g)"""


@query(f"""{_TURN}, a AS (SELECT session_id, count(*) AS frames, round(coalesce(sum(dist_px), 0), 4) AS distance_px, round(avg(speed_px_s), 4) AS mean_speed, round(max(speed_px_s), 4) AS max_speed,
arg_max(t_sec, frame_index) AS duration_s, round(avg(ok::INT), 4) AS valid_fraction, round(coalesce(sum(delta) FILTER (WHERE delta > 0), 0) / 360, 4) AS rotations_cw, round(coalesce(sum(-delta) FILTER (WHERE delta <= 0), 0) / 360, 4) AS rotations_ccw,
arg_min(x, frame_index) FILTER (WHERE ok) AS ax, arg_min(y, frame_index) FILTER (WHERE ok) AS ay, arg_max(x, frame_index) FILTER (WHERE ok) AS bx, arg_max(y, frame_index) FILTER (WHERE ok) AS by_, coalesce(sum(dist_px), 0) AS total FROM d GROUP BY session_id)
SELECT session_id, frames, distance_px, mean_speed, max_speed, duration_s, valid_fraction, rotations_cw, rotations_ccw, CASE WHEN total > 0 THEN round(sqrt((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)) / total, 4) END AS path_efficiency FROM a""")
def session_summary(spark, sf):
    """AGG1, AGG2, AGG4, AGG5, SCL6, SCL7, WIN1c."""
    return _r(session.summary(_steps(spark, sf)), "distance_px", "mean_speed", "max_speed", "valid_fraction", "rotations_cw", "rotations_ccw")


@query(f"{_TURN} SELECT session_id, CASE WHEN count(delta) >= 5 THEN round(avg(abs(delta / 0.5e0)), 3) END AS mean_ang, CASE WHEN count(delta) >= 5 THEN round(max(abs(delta / 0.5e0)), 3) END AS max_ang, round(greatest(1, max(speed_px_s)), 4) AS top_speed FROM d GROUP BY session_id")
def angular_velocity(spark, sf):
    """AGG42, AGG44."""
    return _r(_r(track.speed_extremes(_steps(spark, sf)), "top_speed"), "mean_ang", "max_ang", digits=3)


@query(f"{A.with_('f', 'k', 'z')} SELECT session_id, frame_index, zone_id FROM z")
def zone_assignment(spark, sf):
    """SCL9, JN1: first zone that holds the point."""
    return _zoned(spark, sf).select("session_id", "frame_index", "zone_id")


@query(f"{A.with_('f', 'k', 'z')}, {A.islands('z', 'zone_id')} SELECT session_id, state AS zone_id, start_t AS entry_t, end_t AS exit_t, end_t - start_t AS duration_s FROM i WHERE state IS NOT NULL")
def zone_events(spark, sf):
    """WIN3."""
    return islands.zone_events(_zoned(spark, sf))


#: zm: the metrics of each zone of a session, from z.
_ZONE_SUMS = f"""{A.islands('z', 'zone_id')}, names AS (SELECT unnest({[r[0] for r in A.RECTANGLES]}) AS zone_id),
st AS (SELECT session_id, zone_id, t_sec, x, y, lag(x) OVER w AS qx, lag(y) OVER w AS qy, lag(t_sec) OVER w AS qt FROM z WHERE zone_id IS NOT NULL WINDOW w AS (PARTITION BY session_id, zone_id ORDER BY frame_index)),
ag AS (SELECT session_id, zone_id, count(*) / 2e0 AS time_s, min(t_sec) AS latency_s, avg(sqrt((x-qx)*(x-qx)+(y-qy)*(y-qy)) / (t_sec - qt)) AS mean_speed, sum(sqrt((x-qx)*(x-qx)+(y-qy)*(y-qy))) AS distance FROM st GROUP BY ALL),
en AS (SELECT session_id, state AS zone_id, count(*) AS entries FROM i WHERE state IS NOT NULL GROUP BY ALL),
zm AS (SELECT session_id, zone_id, coalesce(time_s, 0) AS time_s, coalesce(entries, 0) AS entries, latency_s, mean_speed, coalesce(distance, 0) AS distance
FROM (SELECT DISTINCT session_id FROM f) CROSS JOIN names LEFT JOIN ag USING (session_id, zone_id) LEFT JOIN en USING (session_id, zone_id))"""
_ZM = f"{A.with_('f', 'k', 'z')}, {_ZONE_SUMS}"


def _zone_metrics(spark, sf):
    return zones.zone_metrics(_zoned(spark, sf), A.zone_rows(spark), A.FPS)


@query(f"{_ZM} SELECT session_id, zone_id, time_s, entries, latency_s, round(mean_speed, 4) AS mean_speed, round(distance, 4) AS distance FROM zm")
def zone_metrics(spark, sf):
    """AGG3, WIN16."""
    return _r(_zone_metrics(spark, sf), "mean_speed", "distance")


def _episodes(name, limit, min_s):
    cond = f"ok AND coalesce(speed_px_s < {limit}, FALSE)"
    sql = f"{A.with_('f', 'k')}, {A.islands('k', cond)} SELECT session_id, coalesce(sum(end_t - start_t) FILTER (WHERE state AND end_t - start_t >= {min_s}), 0) AS total_s, count(*) FILTER (WHERE state AND end_t - start_t >= {min_s}) AS episodes FROM i GROUP BY session_id"

    def run(spark, sf):
        """WIN2, WIN2a."""
        return islands.episodes(_steps(spark, sf), F.col("speed_px_s") < limit, min_s)

    run.__name__ = name
    query(sql)(run)


_episodes("freezing_episodes", A.FREEZING, 1.0)
_episodes("immobile_episodes", A.IMMOBILE, 1.0)
_episodes("short_immobile_episodes", A.IMMOBILE, 0.5)

_BOUT = f"CASE WHEN NOT ok THEN 'lost' WHEN coalesce(speed_px_s < {A.IMMOBILE}, FALSE) THEN 'freeze' ELSE 'move' END"


@query(f"""{A.with_('f', 'k', 'z')}, {A.islands('z', _BOUT, extra=', avg(speed_px_s) AS mean_speed, arg_min(coalesce(zone_id, chr(0)), frame_index) AS zone0')},
j AS (SELECT *, lead(state) OVER (PARTITION BY session_id ORDER BY run_id) AS after FROM i), b AS (SELECT *, CASE WHEN after = 'lost' THEN last_t ELSE end_t END AS stop_t FROM j)
SELECT session_id, start_t, stop_t, stop_t - start_t AS duration_s, round(mean_speed, 4) AS mean_speed, nullif(zone0, chr(0)) AS zone_id FROM b WHERE state = 'freeze' AND stop_t - start_t >= 1""")
def freeze_bouts(spark, sf):
    """WIN4b."""
    return _r(islands.freeze_bouts(_zoned(spark, sf), still()), "mean_speed")


@query(f"{A.with_('f')}, {A.islands('f', 'NOT ok')} SELECT session_id, coalesce(max(n) FILTER (WHERE state), 0) AS max_gap, count(*) FILTER (WHERE state AND n >= 5) AS gaps_5 FROM i GROUP BY session_id")
def tracking_gaps(spark, sf):
    """WIN11."""
    return islands.longest_gap(A.frames(spark, sf), ~F.col("ok"))


_CLOCK = lambda s: f"(CAST(floor({s} / 60) AS INT) || ':' || lpad(CAST(CAST(floor({s}) AS INT) % 60 AS VARCHAR), 2, '0'))"
_BINS = f"""{A.with_('f', 'k')}, du AS (SELECT session_id, arg_max(t_sec, frame_index) AS dur FROM f GROUP BY 1), bb AS (SELECT k.*, dur, greatest(2, least(12, CAST(floor(dur / 10e0) AS INT))) AS bins FROM k JOIN du USING (session_id) WHERE dur > 0),
bq AS (SELECT *, CAST(floor(t_sec / (dur / bins)) AS INT) AS bin FROM bb), br AS (SELECT *, row_number() OVER (PARTITION BY session_id, bin ORDER BY frame_index) = 1 AS fst FROM bq WHERE bin < bins),
{A.islands('br', f'ok AND coalesce(speed_px_s < {A.FREEZING}, FALSE)', 'x', 'session_id, bin')}, {A.islands('br', f'ok AND coalesce(speed_px_s < {A.IMMOBILE}, FALSE)', 'y', 'session_id, bin')},
xs AS (SELECT session_id, bin, coalesce(sum(end_t - start_t) FILTER (WHERE state AND end_t - start_t >= 1), 0) AS freezing_s, count(*) FILTER (WHERE state AND end_t - start_t >= 1) AS freezing_episodes FROM x GROUP BY ALL),
ys AS (SELECT session_id, bin, coalesce(sum(end_t - start_t) FILTER (WHERE state AND end_t - start_t >= 1), 0) AS immobile_s, count(*) FILTER (WHERE state AND end_t - start_t >= 1) AS immobile_episodes FROM y GROUP BY ALL)
SELECT session_id, bin, any_value(bins) AS bins, round(coalesce(sum(dist_px) FILTER (WHERE NOT fst), 0), 4) AS distance_px, round(avg(speed_px_s) FILTER (WHERE NOT fst), 4) AS mean_speed, round(avg(ok::INT), 4) AS valid_fraction,
any_value(freezing_s) AS freezing_s, any_value(freezing_episodes) AS freezing_episodes, any_value(immobile_s) AS immobile_s, any_value(immobile_episodes) AS immobile_episodes, {_CLOCK('bin * any_value(dur / bins)')} || ' – ' || {_CLOCK('(bin + 1) * any_value(dur / bins)')} AS label FROM br JOIN xs USING (session_id, bin) JOIN ys USING (session_id, bin) GROUP BY session_id, bin"""


@query(_BINS)
def time_bins(spark, sf):
    """AGG9, with bins of about 10 s."""
    return _r(session.time_bins(_steps(spark, sf), still(), freeze(), target_s=10.0), "distance_px", "mean_speed", "valid_fraction")


_EDGES = ", ".join(f"sqrt((x - {px}) ** 2 + (y - {py}) ** 2)" for px, py in (("0", "least(500, greatest(0, y))"), ("500", "least(500, greatest(0, y))"), ("least(500, greatest(0, x))", "0"), ("least(500, greatest(0, x))", "500")))


@query(f"{A.with_('f')} SELECT session_id, round(coalesce(avg(CASE WHEN ok THEN (least({_EDGES}) <= 50)::INT END), 0), 4) AS thigmotaxis FROM f GROUP BY session_id")
def thigmotaxis(spark, sf):
    """SCL10, AGG8: border of the [0, 500] square, for every valid frame, by the distance to its nearest edge."""
    arena = F.array(*(F.struct(F.lit(p["x"]).alias("x"), F.lit(p["y"]).alias("y")) for p in geometry.rectangle(0, 0, 500, 500)))
    return _r(zones.thigmotaxis(A.frames(spark, sf), arena), "thigmotaxis")


@query(f"""{A.with_('f', 'k')}, g AS (SELECT session_id, least(79, greatest(0, CAST(floor(x / 500e0 * 80) AS INT))) AS cx, least(79, greatest(0, CAST(floor(y / 500e0 * 80) AS INT))) AS cy, count(*) AS n, avg(speed_px_s) AS mean_speed FROM k WHERE ok GROUP BY ALL)
SELECT session_id, cx, cy, n, round(mean_speed, 4) AS mean_speed, round(n / max(n) OVER (PARTITION BY session_id), 4) AS level FROM g""")
def heatmap(spark, sf):
    """AGG41."""
    return _r(zones.heatmap(_steps(spark, sf), 500.0, 500.0), "mean_speed", "level")


@query(f"""{A.with_('f')}, b AS (SELECT session_id, (min(x) + max(x)) / 2 AS mx, (min(y) + max(y)) / 2 AS my FROM f WHERE ok GROUP BY 1 HAVING count(*) >= 20),
s AS (SELECT session_id, count(*) FILTER (WHERE x < mx) / 2e0 AS left_s, count(*) FILTER (WHERE x >= mx) / 2e0 AS right_s, count(*) FILTER (WHERE y < my) / 2e0 AS top_s, count(*) FILTER (WHERE y >= my) / 2e0 AS bottom_s FROM f JOIN b USING (session_id) WHERE ok GROUP BY 1)
SELECT *, round((left_s - right_s) / (left_s + right_s), 4) AS preference FROM s""")
def place_preference(spark, sf):
    """AGG12."""
    return _r(session.place_preference(A.frames(spark, sf), A.FPS), "preference")


@query(f"""{A.with_('f', 'k', 'z')}, n AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS n, row_number() OVER (PARTITION BY session_id ORDER BY frame_index) - 1 AS r,
count(zone_id) OVER (PARTITION BY session_id, zone_id ORDER BY frame_index) / 2e0 AS cumulative_s FROM z) SELECT session_id, frame_index, t_sec, zone_id, cumulative_s FROM n WHERE r % greatest(1, n // 20) = 0""")
def cumulative_zone_time(spark, sf):
    """WIN12, SMP5."""
    return zones.cumulative_zone_time(_zoned(spark, sf), A.FPS, 20)


_SIDES = lambda a, b, wa, wb: f"""{_ZM}, q AS (SELECT session_id, {', '.join(f"coalesce(sum(time_s) FILTER (WHERE {w}), 0) AS {r}_s, CAST(coalesce(sum(entries) FILTER (WHERE {w}), 0) AS BIGINT) AS {r}_entries, round(coalesce(sum(distance) FILTER (WHERE {w}), 0), 4) AS {r}_distance, min(latency_s) FILTER (WHERE {w}) AS {r}_latency_s" for r, w in ((a, wa), (b, wb)))} FROM zm GROUP BY session_id)
SELECT *, CASE WHEN {a}_s + {b}_s > 0 THEN round(100 * {a}_s / ({a}_s + {b}_s), 4) END AS {a}_pct, CASE WHEN {a}_s + {b}_s > 0 THEN round(100 * {b}_s / ({a}_s + {b}_s), 4) END AS {b}_pct FROM q"""  # noqa: E731


@query(_SIDES("open", "closed", "zone_id = 'open_n'", "zone_id = 'closed_e'"))
def plus_maze(spark, sf):
    """AGG19, SCL25."""
    return _r(paradigms.plus_maze(_zone_metrics(spark, sf)), "open_distance", "closed_distance", "open_pct", "closed_pct")


@query(_SIDES("centre", "periphery", "zone_id = 'center'", "zone_id = 'periphery'"))
def open_field(spark, sf):
    """AGG18."""
    return _r(paradigms.open_field(_zone_metrics(spark, sf)), "centre_distance", "periphery_distance", "centre_pct", "periphery_pct")


def _renamed(df, names):
    return df.withColumn("zone_id", F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[F.col("zone_id")])


_LD = {"center": "light box", "open_n": "hall", "closed_e": "dark box", "periphery": "dark rim"}


@query(_SIDES("light", "dark", "zone_id = 'center'", "zone_id IN ('closed_e', 'periphery')").replace("SELECT *, CASE WHEN light_s", """, mv AS (SELECT session_id, count(*) FILTER (WHERE p <> side) AS transitions FROM
(SELECT session_id, side, lag(side) OVER (PARTITION BY session_id ORDER BY entry_t) AS p FROM (SELECT session_id, start_t AS entry_t, CASE WHEN state = 'center' THEN 'light' ELSE 'dark' END AS side FROM i WHERE state IN ('center', 'closed_e', 'periphery'))) GROUP BY 1)
SELECT q.*, coalesce(transitions, 0) AS transitions, CASE WHEN light_s""").replace("AS dark_pct FROM q", "AS dark_pct FROM q LEFT JOIN mv USING (session_id)"))
def light_dark(spark, sf):
    """AGG13, JN7."""
    zm, ev = _renamed(_zone_metrics(spark, sf), _LD), _renamed(islands.zone_events(_zoned(spark, sf)), _LD)
    return _r(paradigms.light_dark(zm, ev), "light_distance", "dark_distance", "light_pct", "dark_pct")


@query(f"""{_ZM}, q AS (SELECT session_id, max(time_s) FILTER (WHERE zone_id = 'center') AS novel_s, max(time_s) FILTER (WHERE zone_id = 'open_n') AS familiar_s FROM zm GROUP BY 1)
SELECT *, round((novel_s - familiar_s) / (novel_s + familiar_s), 4) AS discrimination, round(novel_s / (novel_s + familiar_s), 4) AS preference FROM q WHERE novel_s + familiar_s > 0""")
def novel_object(spark, sf):
    """AGG10."""
    zm = _renamed(_zone_metrics(spark, sf), {"center": "novel object", "open_n": "familiar object", "closed_e": "c", "periphery": "p"})
    return _r(paradigms.novel_object(zm), "discrimination", "preference")


@query(f"""{_ZM}, ra AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY time_s DESC, zone_id) AS r, sum(time_s) OVER (PARTITION BY session_id) AS t FROM zm)
SELECT session_id, {', '.join(f"round(max(CASE WHEN r = {i + 1} AND t > 0 THEN 100 * time_s / t END), 4) AS {n}" for i, n in enumerate(('target_pct', 'opposite_pct', 'left_pct', 'right_pct')))}, CAST(NULL AS DOUBLE) AS platform_latency_s FROM ra GROUP BY session_id""")
def water_maze(spark, sf):
    """AGG16, WIN14: no zone of the adapter is a platform; ``water_maze_platform`` has one."""
    return _r(paradigms.water_maze(_zone_metrics(spark, sf), [r[0] for r in A.RECTANGLES]), "target_pct", "opposite_pct", "left_pct", "right_pct")


@query(f"""{A.with_('f', 'k', 'z')}, {A.islands('z', 'zone_id')}, v AS (SELECT session_id, state AS s, lag(state, 1) OVER w AS s1, lag(state, 2) OVER w AS s2 FROM i WHERE state IS NOT NULL WINDOW w AS (PARTITION BY session_id ORDER BY start_t)),
g AS (SELECT session_id, count(*) AS visits, count(DISTINCT s) AS arms, count(*) FILTER (WHERE s <> s1 AND s1 <> s2 AND s <> s2) AS alternations FROM v GROUP BY 1)
SELECT *, round(100 * alternations / greatest(1, visits - 2), 4) AS alternation_pct FROM g WHERE visits >= 3 AND arms >= 3""")
def y_maze(spark, sf):
    """AGG17: every zone is an arm."""
    return _r(paradigms.y_maze(islands.zone_events(_zoned(spark, sf)), [r[0] for r in A.RECTANGLES]), "alternation_pct")


@query(f"""{A.with_('f', 'k')}, ep AS (SELECT 0 AS epoch_id, 'baseline' AS name, 0e0 AS a, 10e0 AS b UNION ALL SELECT 1, 'tone', 12e0, 20e0), r AS (SELECT k.*, epoch_id, name, b - a AS span FROM k JOIN ep ON t_sec BETWEEN a AND b WHERE ok),
{A.islands('r', f'coalesce(speed_px_s < {A.IMMOBILE}, FALSE)', keys='session_id, epoch_id', extra=', any_value(name) AS name, any_value(span) AS span')},
g AS (SELECT session_id, epoch_id, any_value(name) AS name, any_value(span) AS span_s, coalesce(sum(end_t - start_t) FILTER (WHERE state AND end_t - start_t >= 1), 0) AS freezing_s, count(*) FILTER (WHERE state AND end_t - start_t >= 1) AS episodes FROM i GROUP BY ALL)
SELECT *, round(100 * freezing_s / span_s, 4) AS freezing_pct FROM g""")
def fear_epochs(spark, sf):
    """AGG14, AGG52, JN6: frames in epochs, bounds inclusive."""
    f = _steps(spark, sf)
    epochs = f.select("session_id").distinct().crossJoin(F.broadcast(spark.createDataFrame([(0, "baseline", 0.0, 10.0), (1, "tone", 12.0, 20.0)], "epoch_id int, name string, start_t double, end_t double")))
    return _r(paradigms.fear_epochs(f, epochs, still()), "freezing_pct")


@query(f"""{A.with_('f')}, g AS (SELECT *, max(CASE WHEN ok THEN frame_index END) OVER w AS a, min(CASE WHEN ok THEN frame_index END) OVER (PARTITION BY session_id ORDER BY frame_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM f WINDOW w AS (PARTITION BY session_id ORDER BY frame_index))
SELECT g.session_id, g.frame_index, round(CASE WHEN g.ok THEN g.x WHEN b - a - 1 <= 3 THEN p.x + (g.frame_index - a) * (q.x - p.x) / (b - a) END, 4) AS x, CASE WHEN g.ok THEN 'ok' WHEN b - a - 1 <= 3 THEN 'interpolated' ELSE 'ok' END AS quality
FROM g LEFT JOIN f p ON p.session_id = g.session_id AND p.frame_index = a LEFT JOIN f q ON q.session_id = g.session_id AND q.frame_index = b""")
def gap_fill(spark, sf):
    """WIN7."""
    return _r(track.filled(A.frames(spark, sf)).select("session_id", "frame_index", "x", "quality"), "x")


@query(f"{A.with_('f')} SELECT session_id, frame_index, CASE WHEN frame_index < 10 OR frame_index >= 40 THEN FALSE ELSE ok END AS ok, CASE WHEN frame_index < 10 OR frame_index >= 40 THEN 'trimmed' ELSE 'ok' END AS quality FROM f")
def trim(spark, sf):
    """SCL2."""
    return track.trimmed(A.frames(spark, sf), A.FPS, 5.0, 20.0).select("session_id", "frame_index", "ok", "quality")


@query(f"""{A.with_('f', 'k')}, c AS (SELECT DISTINCT session_id, 0 AS click_id, 250e0 AS cx, 250e0 AS cy FROM f), d AS (SELECT session_id, click_id, frame_index, sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy)) AS d FROM k JOIN c USING (session_id) WHERE ok)
SELECT session_id, click_id, frame_index, round(d, 4) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY session_id, click_id ORDER BY d, frame_index) AS r FROM d WHERE d < 40) WHERE r = 1""")
def nearest_frame(spark, sf):
    """JN10."""
    f = _steps(spark, sf)
    clicks = f.select("session_id").distinct().select("session_id", F.lit(0).alias("click_id"), F.lit(250.0).alias("cx"), F.lit(250.0).alias("cy"))
    return _r(zones.nearest_frame(f, clicks, 40.0), "distance")


@query(f"{A.with_('f')}, n AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS n, row_number() OVER (PARTITION BY session_id ORDER BY frame_index) - 1 AS r FROM f) SELECT session_id, frame_index, x, y FROM n WHERE r % greatest(1, n // 8) = 0")
def stride_sample(spark, sf):
    """SMP5, SNK6 stride."""
    return track.strided(A.frames(spark, sf), 8).select("session_id", "frame_index", "x", "y")


@query(f"{A.with_('f')} SELECT session_id, frame_index, CASE WHEN frame_index = 3 THEN 1e0 WHEN frame_index = 5 THEN NULL ELSE x END AS x, CASE WHEN frame_index = 3 THEN 2e0 WHEN frame_index = 5 THEN NULL ELSE y END AS y, CASE WHEN frame_index = 3 THEN TRUE WHEN frame_index = 5 THEN FALSE ELSE ok END AS ok, CASE WHEN frame_index = 3 THEN 'manual' WHEN frame_index = 5 THEN 'manual_delete' ELSE 'ok' END AS quality FROM f")
def frame_correction(spark, sf):
    """JN2: point updates by key."""
    f = A.frames(spark, sf)
    fixes = f.where("frame_index in (3, 5)").select("session_id", "frame_index", F.when(F.col("frame_index") == 3, 1.0).alias("x"), F.when(F.col("frame_index") == 3, 2.0).alias("y"))
    return track.corrected(f, fixes).select("session_id", "frame_index", "x", "y", "ok", "quality")


@query(f"""{A.with_('f')}, m AS (SELECT a.session_id, a.frame_index, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS d, a.t_sec FROM f a JOIN f b ON a.session_id % 2 = 0 AND b.session_id = a.session_id + 1 AND a.frame_index = b.frame_index),
d AS (SELECT *, coalesce(d < 150, FALSE) AS near FROM m), {A.islands('d', 'near')}, o AS (SELECT session_id, min(t_sec) FILTER (WHERE near) AS latency_s, round(avg(d), 4) AS mean_distance FROM d GROUP BY 1)
SELECT session_id, coalesce(sum(end_t - start_t) FILTER (WHERE state AND end_t - start_t >= 0.5), 0) AS near_s, count(*) FILTER (WHERE state AND end_t - start_t >= 0.5) AS episodes, any_value(latency_s) AS latency_s, any_value(mean_distance) AS mean_distance FROM i JOIN o USING (session_id) GROUP BY session_id""")
def social_proximity(spark, sf):
    """AGG7, AGG11, JN15: users 2k and 2k + 1 are the animals 0 and 1 of session 2k."""
    f = A.frames(spark, sf)
    pair = f.withColumns({"animal_ix": F.pmod("session_id", F.lit(2)).cast("int"), "session_id": F.col("session_id") - F.pmod("session_id", F.lit(2))})
    d = track.inter_animal_distance(pair).join(pair.groupBy("session_id", "frame_index").agg(F.countDistinct("animal_ix").alias("n"), F.min("t_sec").alias("t_sec")).where("n = 2"), ["session_id", "frame_index"])
    return _r(session.social(d, 150.0), "mean_distance")


@query(f"{A.with_('f', 'k', 'z')}, {A.islands('z', 'zone_id')} SELECT session_id, state AS zone_id, count(*) AS events, sum(end_t - start_t) AS seconds, round(100 * sum(end_t - start_t) / any_value(dur), 4) AS pct FROM i JOIN (SELECT session_id, max(t_sec) AS dur FROM f GROUP BY 1) USING (session_id) WHERE state IS NOT NULL AND dur > 0 GROUP BY ALL")
def event_log(spark, sf):
    """AGG50, AGG51, SRT4, SNK8."""
    z = _zoned(spark, sf)
    d = z.groupBy("session_id").agg(F.max("t_sec").alias("_d")).where("_d > 0")
    own = islands.zone_events(z).join(d, "session_id").groupBy("session_id", "zone_id").agg(F.count("*").alias("events"), F.sum("duration_s").alias("seconds"), F.first("_d").alias("_d"))
    return _r(own.select("session_id", "zone_id", "events", "seconds", (100 * F.col("seconds") / F.col("_d")).alias("pct")), "pct")


@query("SELECT user_id AS session_id, event_type AS behavior, ts_s AS start_t, nx AS end_t, nx - ts_s AS duration_s FROM (SELECT user_id, event_type, epoch(ts) AS ts_s, lead(epoch(ts)) OVER w AS nx, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts)) WHERE r % 2 = 1")
def manual_scores(spark, sf):
    """UDF4: start and stop toggles as intervals."""
    e = A.table(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.col("event_type").alias("behavior"), F.col("ts").cast("timestamp").cast("double").alias("t"))
    return islands.paired_toggles(e)


@query("SELECT user_id AS session_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS r FROM events WHERE value BETWEEN 80 AND 25000) WHERE r <= 2")
def largest_blobs(spark, sf):
    """SRC6: top detections by area; an event type of a user is a frame, a value an area."""
    e = A.table(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.col("event_type").alias("frame_index"), F.col("event_id").alias("blob"), F.col("value").alias("area"))
    return track.top_blobs(e, 2).select("session_id", F.col("blob").alias("event_id"), F.col("area").alias("value"))


@query()
def kalman_tracks(spark, sf):
    """WIN6: constant-velocity smoothing of each session."""
    from ..operators.recursive import kalman

    return _r(kalman(A.frames(spark, sf)), "x", "y")


@query(f"""{A.with_('f')}, v AS (SELECT session_id, frame_index, list(x) FILTER (WHERE x IS NOT NULL) OVER (PARTITION BY session_id ORDER BY frame_index) AS past FROM f)
SELECT session_id, frame_index, round(CASE WHEN len(past) > 0 THEN list_reduce(past, lambda a, x: 0.97e0 * a + 0.03e0 * x) END + 1e-9, 4) AS ema FROM v""")
def moving_average(spark, sf):
    """WIN5. Averages of hundredths are often exact halves of the last digit told: both sides lift them over the edge."""
    from ..operators.recursive import moving_average as ema

    return _r(ema(A.frames(spark, sf), "x").withColumn("ema", F.col("ema") + 1e-9), "ema")


@query()
def assigned_tracks(spark, sf):
    """JN11: two animals; a user pair's points are the detections."""
    from ..operators.recursive import tracks

    f = A.frames(spark, sf).where("ok")
    return tracks(f.withColumn("session_id", F.col("session_id") - F.pmod("session_id", F.lit(2))), 2)
