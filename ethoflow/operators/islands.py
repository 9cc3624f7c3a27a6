"""Runs of equal state along a session (gaps and islands): episodes, zone visits, behaviour events, bouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.scalars import valid

KEY = ["session_id"]


def runs(frames: DataFrame, state: Column, keys=KEY, order: str = "frame_index", extra: dict[str, Column] | None = None) -> DataFrame:
    """One row for each run of equal state: keys, run_id, state, start_t, last_t, end_t, duration_s, n.

    end_t is the time of the next run's first frame, for the last run that of its own last frame. A null
    state is a state. extra: further aggregates over the run's frames.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    marked = frames.withColumn("_s", state)
    changed = F.coalesce(~F.lag("_s").over(w).eqNullSafe(F.col("_s")) | (F.row_number().over(w) == 1), F.lit(True))
    numbered = marked.withColumn("_c", changed.cast("int")).withColumn("run_id", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = numbered.groupBy(*keys, "run_id").agg(F.first("_s").alias("state"), F.min("t_sec").alias("start_t"), F.max("t_sec").alias("last_t"), F.count("*").alias("n"), *(c.alias(k) for k, c in (extra or {}).items()))
    after = F.lead("start_t").over(Window.partitionBy(*keys).orderBy("run_id"))
    return out.withColumn("end_t", F.coalesce(after, F.col("last_t"))).withColumn("duration_s", F.col("end_t") - F.col("start_t"))


def episodes(frames: DataFrame, condition: Column, min_s: float, keys=KEY) -> DataFrame:
    """total_s and episodes of valid frames where condition holds for min_s or longer; sessions without any have 0."""
    hit = valid(F.col("ok"), F.col("x")) & F.coalesce(condition, F.lit(False))
    r = runs(frames, hit, keys)
    long = F.col("state") & (F.col("duration_s") >= min_s)
    return r.groupBy(*keys).agg(F.coalesce(F.sum(F.when(long, F.col("duration_s"))), F.lit(0.0)).alias("total_s"), F.count_if(long).alias("episodes"))


def episodes_of(frames: DataFrame, kinds: dict[str, tuple[Column, float]], keys=KEY) -> DataFrame:
    """<kind>_s and <kind>_episodes as in ``episodes``, for each kind's (condition, min_s), from one pass over the frames."""
    w = Window.partitionBy(*keys).orderBy("frame_index")
    ok = valid(F.col("ok"), F.col("x"))
    at = list(enumerate(kinds.items()))
    own = frames.select(*keys, "frame_index", "t_sec", *((ok & F.coalesce(c, F.lit(False))).alias(f"_s{i}") for i, (_, (c, _)) in at))
    own = own.withColumns({f"_c{i}": F.coalesce(~F.lag(f"_s{i}").over(w).eqNullSafe(F.col(f"_s{i}")), F.lit(True)).cast("int") for i, _ in at})
    own = own.withColumns({f"_r{i}": F.sum(f"_c{i}").over(w.rowsBetween(Window.unboundedPreceding, 0)) for i, _ in at})
    each = own.select(*keys, "t_sec", F.inline(F.array(*(F.struct(F.lit(i).alias("_k"), F.col(f"_r{i}").alias("run_id"), F.col(f"_s{i}").alias("state")) for i, _ in at))))
    r = each.groupBy(*keys, "_k", "run_id").agg(F.first("state").alias("state"), F.min("t_sec").alias("start_t"), F.max("t_sec").alias("last_t"))
    after = F.lead("start_t").over(Window.partitionBy(*keys, "_k").orderBy("run_id"))
    r = r.withColumn("duration_s", F.coalesce(after, F.col("last_t")) - F.col("start_t"))
    told = []
    for i, (name, (_, least)) in at:
        long = (F.col("_k") == i) & F.col("state") & (F.col("duration_s") >= least)
        told += [F.coalesce(F.sum(F.when(long, F.col("duration_s"))), F.lit(0.0)).alias(f"{name}_s"), F.count_if(long).alias(f"{name}_episodes")]
    return r.groupBy(*keys).agg(*told)


def zone_events(frames: DataFrame, keys=KEY) -> DataFrame:
    """Visits: zone, entry_t, exit_t, duration_s. Invalid frames close a visit."""
    r = runs(frames, F.when(valid(F.col("ok"), F.col("x")), F.col("zone_id")), keys)
    return r.where("state is not null").select(*keys, F.col("state").alias("zone_id"), F.col("start_t").alias("entry_t"), F.col("end_t").alias("exit_t"), "duration_s")


def behaviour_events(frames: DataFrame, state: Column, keys=KEY) -> DataFrame:
    """Runs of behaviour states longer than 0 s, without 'untracked'."""
    return runs(frames, state, keys).where("duration_s > 0 and state <> 'untracked'").select(*keys, "state", "start_t", "end_t", "duration_s")


def freeze_bouts(frames: DataFrame, condition: Column, min_s: float = 1.0, keys=KEY) -> DataFrame:
    """Bouts with mean speed and the zone of their first frame; one that ends by tracking loss ends at its last frame."""
    v = valid(F.col("ok"), F.col("x"))
    state = F.when(~v, "lost").when(F.coalesce(condition, F.lit(False)), "freeze").otherwise("move")
    r = runs(frames, state, keys, extra={"mean_speed": F.avg("speed_px_s"), "zone_id": F.min_by("zone_id", "frame_index")})
    after = F.lead("state").over(Window.partitionBy(*keys).orderBy("run_id"))
    end = F.when(after == "lost", F.col("last_t")).otherwise(F.col("end_t"))
    r = r.withColumn("stop_t", end).withColumn("duration_s", F.col("stop_t") - F.col("start_t"))
    return r.where((F.col("state") == "freeze") & (F.col("duration_s") >= min_s)).select(*keys, "start_t", "stop_t", "duration_s", "mean_speed", "zone_id")


def longest_gap(frames: DataFrame, bad: Column, keys=KEY) -> DataFrame:
    """Longest run of bad frames, and how many runs have five or more."""
    r = runs(frames, bad, keys)
    return r.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("state"), F.col("n"))), F.lit(0)).alias("max_gap"), F.count_if(F.col("state") & (F.col("n") >= 5)).alias("gaps_5"))


def paired_toggles(log: DataFrame, keys=("session_id", "behavior")) -> DataFrame:
    """Start/stop toggles (t) as intervals: odd rows open, the next row closes; an open one has a null end."""
    w = Window.partitionBy(*keys).orderBy("t")
    own = log.withColumns({"_r": F.row_number().over(w), "end_t": F.lead("t").over(w)})
    return own.where("_r % 2 = 1").select(*keys, F.col("t").alias("start_t"), "end_t", (F.col("end_t") - F.col("t")).alias("duration_s"))
