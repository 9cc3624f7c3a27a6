"""Readers: tracking CSV with free headers, pose CSV of one or many animals, TTL events, JSON tables."""

from __future__ import annotations

import csv

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Accepted header names (fixed values), exact without regard to case, then as substring.
HEADERS = {
    "time": ["time", "t", "timestamp", "time(s)", "time_s"],
    "x": ["x", "x_cm", "x_px", "centre x", "center x", "pos x", "x_pos"],
    "y": ["y", "y_cm", "y_px", "centre y", "center y", "pos y", "y_pos"],
    "zone": ["zone", "zone_id", "zone id", "current zone"],
}


def resolve_headers(names: list[str]) -> dict[str, str | None]:
    """Which column is time, x, y and zone; x and y are required."""
    low = {n.strip().lower(): n for n in reversed(names)}
    out = {}
    for role, words in HEADERS.items():
        exact = next((low[w] for w in words if w in low), None)
        # single letters match nearly every header, so substrings start at two characters
        out[role] = exact or next((n for w in words if len(w) > 1 for n in names if w in n.strip().lower()), None)
    if out["x"] is None or out["y"] is None:
        raise ValueError(f"no x and y column among {names}")
    return out


def _header_lines(spark: SparkSession, path: str, n: int) -> dict[str, list[str]]:
    """The first n lines of every file under a path, read where the files lie."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))

    def head(batches):
        seen: dict[str, int] = {}
        for batch in batches:
            keep = []
            for f, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                seen[f] = seen.get(f, 0) + (s == 0)
                keep.append(s == 0 and seen[f] <= n)
            yield batch.select(["file", "value"]).filter(pa.array(keep, pa.bool_()))

    out: dict[str, list[str]] = {}
    for r in lines.mapInArrow(head, "file string, value string").collect():  # n lines a file, as the listing of files
        out.setdefault(r.file, []).append(r.value)
    return out


_STEM = r"^(.*?)(\.[^.]*)?$"


def read_tracking_csv(spark: SparkSession, path: str, fps: float = 25.0, short_time_is_index: bool = False) -> DataFrame:
    """Frames of one CSV file or a folder of files, one session each (the file name without its ending).

    Each file is read by its own header; files of one layout are one scan. x and y that are no numbers are null, ok needs
    both; a missing time is frame / fps. With short_time_is_index times below 2 after the first row are replaced as well.
    File order is the row order. An empty file has no frames; a header without x or y is an error.
    """
    layouts: dict[tuple, list[str]] = {}
    for file, (line, *_) in sorted(_header_lines(spark, path, 1).items()):
        names = next(csv.reader([line.lstrip("\ufeff")]), [])
        roles = resolve_headers(names)
        at = tuple(names.index(roles[r]) if roles[r] is not None else None for r in ("time", "x", "y", "zone"))
        layouts.setdefault((len(names), at), []).append(file)
    out = None
    for (n, (time, x, y, zone)), files in layouts.items():
        raw = spark.read.option("header", True).schema(", ".join(f"c{i} string" for i in range(n))).csv(files)
        num = lambda i: F.expr(f"try_cast(trim(c{i}) as double)") if i is not None else F.lit(None).cast("double")
        label = F.nullif(F.trim(F.col(f"c{zone}")), F.lit("")) if zone is not None else F.lit(None).cast("string")
        own = raw.select(F.regexp_extract(F.col("_metadata.file_name"), _STEM, 1).alias("session_id"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"), num(x).alias("x"), num(y).alias("y"), num(time).alias("t"), label.alias("zone_id"))
        own = own.withColumn("frame_index", F.row_number().over(Window.partitionBy("session_id").orderBy("_b", "_i")) - 1)
        out = own if out is None else out.unionByName(own)
    if out is None:
        return spark.createDataFrame([], "session_id string, frame_index long, t_sec double, ok boolean, x double, y double, zone_id string")
    late = (F.col("frame_index") > 0) & (F.col("t") < 2) if short_time_is_index else F.lit(False)
    t = F.when(F.col("t").isNull() | late, F.col("frame_index") / F.lit(float(fps))).otherwise(F.col("t"))
    ok = F.col("x").isNotNull() & F.col("y").isNotNull()
    return out.select("session_id", F.col("frame_index").cast("long").alias("frame_index"), t.alias("t_sec"), ok.alias("ok"), "x", "y", "zone_id")


def _pose_layout(head: list[str]) -> tuple:
    """((individual, keypoint, column of x, of y, of likelihood or None), ...) from the header lines of a pose table."""
    cells = [next(csv.reader([x]), []) for x in head]
    many = len(cells) > 1 and cells[1][:1] and cells[1][0].strip().lower() == "individuals"
    if len(cells) < (4 if many else 3):
        return ()
    who = cells[1] if many else ["", *["animal"] * (len(cells[0]) - 1)]
    at: dict = {}
    for i, (a, p, c) in enumerate(zip(who, cells[2 if many else 1], cells[3 if many else 2])):
        if i:
            at.setdefault((a, p), {})[c.strip().lower()] = i
    return tuple((a, p, c["x"], c["y"], c.get("likelihood")) for (a, p), c in at.items() if "x" in c and "y" in c)


def read_pose_csv(spark: SparkSession, path: str, least: float = 0.6) -> DataFrame:
    """(session_id, individual, frame_index, kps) from pose tables with header rows scorer, [individuals,] bodyparts, coords.

    Each file is read by its own header lines, which alone come to the driver; files of one layout are one scan. Keypoints
    below ``least`` or without numbers are left out; without a likelihood column it is 1. Rows whose index is no number
    are skipped, files without keypoints too. A table of one animal has the individual 'animal'.
    """
    layouts: dict[tuple, list[str]] = {}
    for file, head in sorted(_header_lines(spark, path, 4).items()):
        layouts.setdefault(_pose_layout(head), []).append(file)
    cell = lambda i: F.expr(f"try_cast(try_element_at(cells, {i + 1}) as double)")
    kind = "session_id string, frame_index long, p struct<individual:string,kp:string,x:double,y:double,likelihood:double>"
    rows = spark.createDataFrame([], kind)
    for points, files in layouts.items():
        if not points:
            continue
        own = spark.read.text(files).select(F.regexp_extract(F.col("_metadata.file_name"), _STEM, 1).alias("session_id"), F.split("value", ",").alias("cells"))
        own = own.withColumn("frame_index", F.expr("try_cast(cells[0] as long)")).where("frame_index is not null")
        one = [F.struct(F.lit(a).alias("individual"), F.lit(p).alias("kp"), cell(x).alias("x"), cell(y).alias("y"), (cell(c) if c is not None else F.lit(1.0)).alias("likelihood")) for a, p, x, y, c in points]
        rows = rows.unionByName(own.select("session_id", "frame_index", F.explode(F.array(*one)).alias("p")))
    rows = rows.where(f"p.x is not null and p.y is not null and p.likelihood >= {least} and not isnan(p.x) and not isnan(p.likelihood)")
    kp = F.struct("p.x", "p.y", "p.likelihood")
    return rows.groupBy("session_id", F.col("p.individual").alias("individual"), "frame_index").agg(F.map_from_entries(F.collect_list(F.struct(F.col("p.kp").alias("key"), kp.alias("value")))).alias("kps"))


def read_ttl(spark: SparkSession, path: str) -> DataFrame:
    """(t, label) events of a CSV with a header; rows without a number are dropped, a missing label is 'Event'."""
    raw = spark.read.option("header", True).csv(path)
    label = F.col(raw.columns[1]) if len(raw.columns) > 1 else F.lit(None).cast("string")
    return raw.select(F.expr(f"try_cast(`{raw.columns[0]}` as double)").alias("t"), F.coalesce(F.nullif(F.trim(label), F.lit("")), F.lit("Event")).alias("label")).where("t is not null and not isnan(t)")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, one a file; those that don't parse are left out, without a look at the others twice."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("multiLine", True).json(path)


def busiest_track(points: DataFrame) -> DataFrame:
    """Per-frame centre of the session's most frequent track (ties: the smaller), mean of its visible points.

    points: session_id, frame_index, track, x, y, visible, and instance, the place of a point's animal in its frame, where there
    is one. In a frame without that track the first instance counts (without instances the smallest track, null last). A frame
    whose instance shows no point has no row.
    """
    order = F.col("instance") if "instance" in points.columns else F.col("track")
    own = points.withColumn("_o", order)
    seen = F.col("visible") & F.col("x").isNotNull() & F.col("y").isNotNull()
    one = own.groupBy("session_id", "frame_index", "track", "_o").agg(F.avg(F.when(seen, F.col("x"))).alias("x"), F.avg(F.when(seen, F.col("y"))).alias("y"))
    n = one.where("track is not null").groupBy("session_id", "track").agg(F.countDistinct("frame_index").alias("n"))
    best = n.groupBy("session_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "track")).alias("m")).select("session_id", F.col("m.track").alias("_best"))
    rank = F.struct((~F.col("track").eqNullSafe(F.col("_best"))).alias("a"), F.col("_o").isNull().alias("b"), F.col("_o").alias("c"), F.col("track").alias("d"))
    chosen = one.join(best, "session_id", "left").groupBy("session_id", "frame_index").agg(F.min_by(F.struct("x", "y"), rank).alias("p"))
    return chosen.where("p.x is not null").select("session_id", "frame_index", "p.x", "p.y")
