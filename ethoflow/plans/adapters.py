"""The driver tables in the shapes of the track model, and the same definitions as SQL.

frames: one session for each user, in event order, two frames a second; an 'error' event is an invalid frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.geometry import rectangle
from ..operators.zones import literal_zones

FPS = 2.0
IMMOBILE, FREEZING = 150.0, 60.0
#: Zones of the adapter: (id, x0, y0, x1, y1), first match wins.
RECTANGLES = [("center", 150, 150, 350, 350), ("open_n", 200, 0, 300, 150), ("closed_e", 350, 200, 500, 300), ("periphery", 0, 0, 500, 500)]
ZONES = literal_zones
#: Of an embedding.
DIMENSIONS = 64
EVENT_TYPES = "('click', 'error', 'purchase', 'signup', 'view')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value", "props")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ok = F.col("event_type") != "error"
    k = F.get_json_object("props", "$.k").cast("int")
    out = e.withColumn("frame_index", (F.row_number().over(w) - 1).cast("long"))
    return out.select(F.col("user_id").alias("session_id"), "frame_index", (F.col("frame_index") / F.lit(FPS)).alias("t_sec"), ok.alias("ok"), F.when(ok, F.col("value")).alias("x"), F.when(ok, k * 5.0).alias("y"), "event_type", *more)


def zones_column():
    return literal_zones([(n, n, rectangle(*b)) for n, *b in RECTANGLES])


def zone_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r[0],) for r in RECTANGLES], "zone_id string")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Motif labels: 'error' is -1, the other event types are numbered in alphabetical order."""
    f = frames(spark, sf_dir)
    label = F.expr("case event_type when 'click' then 0 when 'purchase' then 1 when 'signup' then 2 when 'view' then 3 when 'error' then -1 else 4 end")
    return f.select("session_id", "frame_index", label.cast("int").alias("label"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows of embeddings: session = label, frames in vec_id order, all dimensions; every 13th is invalid."""
    w = Window.partitionBy("label").orderBy("vec_id")
    own = table(spark, sf_dir, "embeddings").withColumn("frame_index", (F.row_number().over(w) - 1).cast("long"))
    valid = F.col("vec_id") % 13 != 0
    return own.select(F.col("label").alias("session_id"), "frame_index", valid.alias("valid"), *(F.when(valid, F.col("embedding")[i].cast("double")).alias(f"d{i}") for i in range(DIMENSIONS)))


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long values (feature, group, value) by customer: balance, and sum, mean and count of orders, by market segment."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("spent"), F.avg("o_totalprice").alias("mean_order"), F.count("*").cast("double").alias("orders"))
    own = c.join(o, "c_custkey", "left")
    return own.select(F.col("c_custkey").alias("animal"), F.col("c_mktsegment").alias("group"), F.expr("stack(4, 'balance', c_acctbal, 'spent', spent, 'mean_order', mean_order, 'orders', orders) as (feature, value)"))


_zone_case = "CASE WHEN NOT ok THEN NULL " + " ".join(f"WHEN x >= {a} AND x < {c} AND y >= {b} AND y < {d} THEN '{n}'" for n, a, b, c, d in RECTANGLES) + " END"

#: The same as common table expressions.
SQL = {
    "f": """f AS (SELECT user_id AS session_id, frame_index, frame_index / 2e0 AS t_sec, event_type <> 'error' AS ok, CASE WHEN event_type <> 'error' THEN value END AS x,
CASE WHEN event_type <> 'error' THEN CAST(json_extract_string(props, '$.k') AS INTEGER) * 5e0 END AS y, event_type
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index FROM events))""",
    "k": """p AS (SELECT *, lag(ok) OVER w AS pok, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(t_sec) OVER w AS pt FROM f WINDOW w AS (PARTITION BY session_id ORDER BY frame_index)),
k AS (SELECT *, CASE WHEN ok AND pok THEN sqrt((x - px) * (x - px) + (y - py) * (y - py)) END AS dist_px,
CASE WHEN ok AND pok THEN sqrt((x - px) * (x - px) + (y - py) * (y - py)) / (t_sec - pt) END AS speed_px_s FROM p)""",
    "z": f"z AS (SELECT *, {_zone_case} AS zone_id FROM k)",
    "s": """s AS (SELECT session_id, frame_index, CASE event_type WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'view' THEN 3 WHEN 'error' THEN -1 ELSE 4 END AS label FROM f)""",
    "e": "e AS (SELECT label AS session_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_index, vec_id % 13 <> 0 AS valid, " + ", ".join(f"CASE WHEN vec_id % 13 <> 0 THEN CAST(embedding[{i + 1}] AS DOUBLE) END AS d{i}" for i in range(DIMENSIONS)) + " FROM embeddings)",
    "c": """o AS (SELECT o_custkey, sum(o_totalprice) AS spent, avg(o_totalprice) AS mean_order, CAST(count(*) AS DOUBLE) AS orders FROM orders GROUP BY o_custkey),
w AS (SELECT c_custkey AS animal, c_mktsegment AS grp, c_acctbal AS balance, spent, mean_order, orders FROM customer LEFT JOIN o ON c_custkey = o_custkey),
c AS (SELECT animal, grp, 'balance' AS feature, balance AS value FROM w UNION ALL SELECT animal, grp, 'spent', spent FROM w
UNION ALL SELECT animal, grp, 'mean_order', mean_order FROM w UNION ALL SELECT animal, grp, 'orders', orders FROM w)""",
}


def normal_p(z: str) -> str:
    """SQL of the two-sided p of z >= 0 by Simpson's rule over the normal density; 1 below."""
    return f"CASE WHEN {z} <= 0 THEN 1 ELSE greatest(0, 1 - sqrt(2 / pi()) * least({z}, 40) / 6000 * list_sum(list_transform(range(0, 2001), lambda i: CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-0.5 * (i * least({z}, 40) / 2000e0) ** 2)))) END"


def with_(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)


def islands(source: str, state: str, name: str = "i", keys: str = "session_id", extra: str = "") -> str:
    """Runs of equal state of a CTE, as CTEs ending in ``name`` (run_id, state, start_t, last_t, n, end_t)."""
    return f"""{name}0 AS (SELECT *, {state} AS state FROM {source}),
{name}1 AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR state IS DISTINCT FROM lag(state) OVER w THEN 1 ELSE 0 END AS chg FROM {name}0 WINDOW w AS (PARTITION BY {keys} ORDER BY frame_index)),
{name}2 AS (SELECT *, sum(chg) OVER (PARTITION BY {keys} ORDER BY frame_index) AS run_id FROM {name}1),
{name}3 AS (SELECT {keys}, run_id, any_value(state) AS state, min(t_sec) AS start_t, max(t_sec) AS last_t, count(*) AS n{extra} FROM {name}2 GROUP BY {keys}, run_id),
{name} AS (SELECT *, coalesce(lead(start_t) OVER (PARTITION BY {keys} ORDER BY run_id), last_t) AS end_t FROM {name}3)"""


#: Keypoints of a frame: landmark, the raw name of its tracker, and its offsets from the frame's point by event_id.
KEYPOINTS = [
    ("nose", "Snout", "10 + event_id % 7 - 3", "event_id % 5"),
    ("left_ear", "leftear", "6", "4 + event_id % 3"),
    ("right_ear", "ear_r", "6", "-4 - event_id % 2"),
    ("neck", "nape", "4", "event_id % 4 - 1"),
    ("mid_spine", "mid_back", "0", "event_id % 9 - 4"),
    ("hips", "Rump", "-6", "event_id % 3"),
    ("tail_base", "tail1", "-12", "-(event_id % 4)"),
]


def keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with kps under raw names; a point is missing where (event_id + its number) mod 11 is 0."""
    return with_keypoints(frames(spark, sf_dir, "event_id"))


def with_keypoints(f: DataFrame) -> DataFrame:
    """kps for frames that still have their event_id."""
    point = lambda j, x, y: F.when((F.col("event_id") + j) % 11 != 0, F.struct(F.expr(f"cast(x + {x} as double)").alias("x"), F.expr(f"cast(y + {y} as double)").alias("y"), F.expr(f"(event_id * 7 + {j * 13}) % 100 / 100d").alias("likelihood")))
    whole = F.map_from_arrays(F.array(*(F.lit(raw) for _, raw, _, _ in KEYPOINTS)), F.array(*(point(j, x, y) for j, (_, _, x, y) in enumerate(KEYPOINTS))))
    none = F.create_map().cast("map<string,struct<x:double,y:double,likelihood:double>>")
    return f.withColumn("kps", F.when(F.col("ok"), F.map_filter(whole, lambda k, v: v.isNotNull())).otherwise(none))


_points = ", ".join(f"CASE WHEN ok AND (event_id + {j}) % 11 <> 0 THEN x + {x} END AS {n}_x, CASE WHEN ok AND (event_id + {j}) % 11 <> 0 THEN y + {y} END AS {n}_y, CASE WHEN ok AND (event_id + {j}) % 11 <> 0 THEN (event_id * 7 + {j * 13}) % 100 / 100e0 END AS {n}_l" for j, (n, _, x, y) in enumerate(KEYPOINTS))
_hyp = lambda a, b: f"sqrt(({a}_x - {b}_x) ** 2 + ({a}_y - {b}_y) ** 2)"
_norm = f"({_hyp('nose', 'neck')} * {_hyp('hips', 'neck')})"
_axis = "sqrt((tail_base_x - nose_x) ** 2 + (tail_base_y - nose_y) ** 2)"
#: kp: points by landmark; pm: the measures of a frame.
SQL["kp"] = f"kp AS (SELECT session_id, frame_index, ok, {_points} FROM (SELECT f.*, event_id FROM f JOIN (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index, event_id FROM events) USING (session_id, frame_index)))"
SQL["pm"] = f"""pm AS (SELECT session_id, frame_index, round({_hyp('nose', 'tail_base')}, 2) AS body_length, round({_hyp('left_ear', 'right_ear')}, 2) AS ear_span,
CASE WHEN abs(nose_x - tail_base_x) > 0.5 OR abs(nose_y - tail_base_y) > 0.5 THEN degrees(atan2(nose_y - tail_base_y, nose_x - tail_base_x)) END AS heading,
coalesce(CASE WHEN abs(nose_x - neck_x) > 0.3 OR abs(nose_y - neck_y) > 0.3 THEN degrees(atan2(nose_y - neck_y, nose_x - neck_x)) END,
CASE WHEN abs(nose_x - (left_ear_x + right_ear_x) / 2) > 0.3 OR abs(nose_y - (left_ear_y + right_ear_y) / 2) > 0.3 THEN degrees(atan2(nose_y - (left_ear_y + right_ear_y) / 2, nose_x - (left_ear_x + right_ear_x) / 2)) END) AS head_angle,
CASE WHEN {_axis} >= 1 THEN round(abs((tail_base_x - nose_x) * (nose_y - mid_spine_y) - (nose_x - mid_spine_x) * (tail_base_y - nose_y)) / ({_axis} * {_axis}), 4) END AS curvature,
CASE WHEN {_norm} > 1e-9 THEN degrees(acos(greatest(-1, least(1, ((nose_x - neck_x) * (hips_x - neck_x) + (nose_y - neck_y) * (hips_y - neck_y)) / {_norm})))) END AS head_body_angle,
coalesce({' AND '.join(f'{n}_l >= 0.6' for n, *_ in KEYPOINTS)}, FALSE) AS all_seven FROM kp)"""
