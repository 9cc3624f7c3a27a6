"""Maze and test paradigms, from zone metrics and zone events. Names say a zone's role by keyword."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.scalars import names_zone, valid
from .islands import runs

S = "session_id"


def _sum(flag: Column, value: str) -> Column:
    return F.coalesce(F.sum(F.when(flag, F.col(value))), F.lit(0))


def novel_object(zones: DataFrame, order: str = "zone_id") -> DataFrame:
    """Discrimination (n - f) / (n + f) and preference n / (n + f).

    Of several zones of a role the last counts, by the column ``order`` (the zones' own order where they have one).
    """
    n, f = names_zone(F.col("zone_id"), "novel"), names_zone(F.col("zone_id"), "familiar")
    last = lambda flag: F.max_by(F.when(flag, F.col("time_s")), F.when(flag, F.col(order)))
    own = zones.groupBy(S).agg(last(n).alias("novel_s"), last(f).alias("familiar_s"))
    total = F.col("novel_s") + F.col("familiar_s")
    return own.where(total > 0).withColumns({"discrimination": (F.col("novel_s") - F.col("familiar_s")) / total, "preference": F.col("novel_s") / total})


def two_sided(zones: DataFrame, a: str, b: str) -> DataFrame:
    """Times, entries, distances and shares of two zone roles (open and closed arms, light and dark, centre and periphery)."""
    fa, fb = names_zone(F.col("zone_id"), a), names_zone(F.col("zone_id"), b)
    own = zones.groupBy(S).agg(*(x for r, f in ((a, fa), (b, fb)) for x in (_sum(f, "time_s").alias(f"{r}_s"), _sum(f, "entries").cast("long").alias(f"{r}_entries"), _sum(f, "distance").alias(f"{r}_distance"), F.min(F.when(f, F.col("latency_s"))).alias(f"{r}_latency_s"))))
    total = F.col(f"{a}_s") + F.col(f"{b}_s")
    return own.withColumns({f"{a}_pct": F.when(total > 0, 100 * F.col(f"{a}_s") / total), f"{b}_pct": F.when(total > 0, 100 * F.col(f"{b}_s") / total)})


def plus_maze(zones: DataFrame) -> DataFrame:
    return two_sided(zones, "open", "closed")


def open_field(zones: DataFrame) -> DataFrame:
    return two_sided(zones, "centre", "periphery")


def light_dark(zones: DataFrame, events: DataFrame) -> DataFrame:
    """Two-sided metrics and changes between light and dark over the visits to either."""
    side = F.when(names_zone(F.col("zone_id"), "light"), "light").when(names_zone(F.col("zone_id"), "dark"), "dark")
    w = Window.partitionBy(S).orderBy("entry_t")
    own = events.withColumn("side", side).where("side is not null").withColumn("_p", F.lag("side").over(w))
    moves = own.groupBy(S).agg(F.count_if(F.col("_p") != F.col("side")).alias("transitions"))
    return two_sided(zones, "light", "dark").join(moves, S, "left").fillna({"transitions": 0})


def fear_epochs(frames: DataFrame, epochs: DataFrame, freezing: Column, min_s: float = 1.0) -> DataFrame:
    """Freezing in each epoch(session_id, epoch_id, name, start_t, end_t), bounds inclusive, over valid frames."""
    own = frames.where(valid(F.col("ok"), F.col("x"))).withColumn("_f", F.coalesce(freezing, F.lit(False)))
    e = epochs.select(S, "epoch_id", "name", F.col("start_t").alias("_a"), F.col("end_t").alias("_b"))
    inside = own.join(e, S).where("t_sec between _a and _b")
    r = runs(inside, F.col("_f"), [S, "epoch_id"], extra={"name": F.first("name"), "span": F.first(F.col("_b") - F.col("_a"))})
    long = F.col("state") & (F.col("duration_s") >= min_s)
    out = r.groupBy(S, "epoch_id").agg(F.first("name").alias("name"), F.first("span").alias("span_s"), F.coalesce(F.sum(F.when(long, F.col("duration_s"))), F.lit(0.0)).alias("freezing_s"), F.count_if(long).alias("episodes"))
    return out.withColumn("freezing_pct", F.when(F.col("span_s") > 0, 100 * F.col("freezing_s") / F.col("span_s")))


def water_maze(zones: DataFrame, quadrants: list[str]) -> DataFrame:
    """Quadrant shares by rank of occupancy (target, opposite, left, right) and latency of the first platform zone."""
    q = zones.where(F.col("zone_id").isin(quadrants))
    rank = F.row_number().over(Window.partitionBy(S).orderBy(F.desc("time_s"), "zone_id"))
    ranked = q.withColumns({"_r": rank, "_t": F.sum("time_s").over(Window.partitionBy(S))})
    share = lambda i: F.max(F.when((F.col("_r") == i) & (F.col("_t") > 0), 100 * F.col("time_s") / F.col("_t")))
    out = ranked.groupBy(S).agg(*(share(i + 1).alias(n) for i, n in enumerate(("target_pct", "opposite_pct", "left_pct", "right_pct"))))
    latency = zones.where(names_zone(F.col("zone_id"), "platform")).groupBy(S).agg(F.min("latency_s").alias("platform_latency_s"))
    return out.join(latency, S, "left")


def y_maze(events: DataFrame, arms: list[str]) -> DataFrame:
    """Alternations: consecutive visits to three different arms, and their share of visits - 2; from three arms and visits on."""
    w = Window.partitionBy(S).orderBy("entry_t")
    own = events.where(F.col("zone_id").isin(arms))
    own = own.withColumns({"_1": F.lag("zone_id", 1).over(w), "_2": F.lag("zone_id", 2).over(w)})
    alt = (F.col("zone_id") != F.col("_1")) & (F.col("_1") != F.col("_2")) & (F.col("zone_id") != F.col("_2"))
    out = own.groupBy(S).agg(F.count("*").alias("visits"), F.countDistinct("zone_id").alias("arms"), F.count_if(alt).alias("alternations"))
    return out.where("visits >= 3 and arms >= 3").withColumn("alternation_pct", 100 * F.col("alternations") / F.greatest(F.lit(1), F.col("visits") - 2))
