"""Feature rows, sliding windows over frames, imputation and frame labels from windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

S = "session_id"
LENGTH, STEP, MOST_INVALID = 20, 5, 0.25


def imputed(rows: DataFrame, dims: list[str], most: int = 5) -> DataFrame:
    """Inner gaps of up to ``most`` invalid rows get values on a line between their neighbours, and become valid."""
    w = Window.partitionBy(S).orderBy("frame_index")
    point = F.when(F.col("valid"), F.struct("frame_index", *dims))
    own = rows.withColumns({"_a": F.last(point, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_b": F.first(point, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    gap = F.col("_b.frame_index") - F.col("_a.frame_index") - 1
    fill = ~F.col("valid") & F.col("_a").isNotNull() & F.col("_b").isNotNull() & (gap <= most)
    at = (F.col("frame_index") - F.col("_a.frame_index")) / (gap + 1)
    return own.withColumns({**{d: F.when(fill, F.col(f"_a.{d}") + at * (F.col(f"_b.{d}") - F.col(f"_a.{d}"))).otherwise(F.col(d)) for d in dims}, "valid": F.col("valid") | fill}).drop("_a", "_b")


def sliding(rows: DataFrame, dims: list[str], length: int = LENGTH, step: int = STEP, most_invalid: float = MOST_INVALID) -> DataFrame:
    """Mean and population deviation of each dimension over valid rows of windows of ``length`` frames every ``step``.

    Each frame goes to the length / step windows that hold it, so one aggregation serves all. A window is
    valid with two valid rows or more and at most the given share of invalid ones. Windows lie within the session.
    """
    last = F.max("frame_index").over(Window.partitionBy(S))
    lo = F.greatest(F.lit(0), F.ceil((F.col("frame_index") - (length - 1)) / step)).cast("long")
    own = rows.withColumn("_last", last).withColumn("_w", F.explode(F.sequence(lo, F.floor(F.col("frame_index") / step)))).withColumn("window_start", F.col("_w") * step)
    own = own.where(f"window_start + {length - 1} <= _last")
    kept = lambda d: F.when(F.col("valid"), F.col(d))
    out = own.groupBy(S, "window_start").agg(F.count_if("valid").alias("n_valid"), *(f(kept(d)).alias(f"{n}_{d}") for d in dims for n, f in (("mean", F.avg), ("std", F.stddev_pop))))
    return out.withColumn("valid", (F.col("n_valid") >= 2) & (F.lit(length) - F.col("n_valid") <= most_invalid * length))


def frame_labels(frames: DataFrame, windows: DataFrame, length: int = LENGTH, step: int = STEP) -> DataFrame:
    """label of the latest valid window that covers each frame, else -1. An equality join on candidate starts."""
    lo = F.greatest(F.lit(0), F.ceil((F.col("frame_index") - (length - 1)) / step)).cast("long")
    own = frames.select(S, "frame_index").withColumn("_w", F.explode(F.sequence(lo, F.floor(F.col("frame_index") / step)))).withColumn("window_start", F.col("_w") * step)
    hit = own.join(windows.where("valid").select(S, "window_start", "label"), [S, "window_start"], "left")
    return hit.groupBy(S, "frame_index").agg(F.coalesce(F.max_by(F.col("label"), F.when(F.col("label").isNotNull(), F.col("window_start"))), F.lit(-1)).alias("label"))


def p95(rows: DataFrame, value: str, keys=(S,)) -> DataFrame:
    """The interpolated 95th percentile of each session, 1e-6 at least, 1.0 without values."""
    return rows.groupBy(*keys).agg(F.greatest(F.lit(1e-6), F.coalesce(F.percentile(value, 0.95), F.lit(1.0))).alias("p95"))


def medians(rows: DataFrame, dims: list[str], most: int = 10_000) -> dict[str, float | None]:
    """The exact median of each column over its known values, by selection.

    A bracket around the middle is narrowed by approximate percentiles of what lies in it, until it has ``most`` different
    values at most; those are counted, and the values of the middle ranks read off. Nothing is ordered but these.
    """
    clean = lambda d: F.when(~F.isnan(d), F.col(d).cast("double"))
    own = rows.select(*(clean(d).alias(d) for d in dims))
    first = own.agg(*(x for i, d in enumerate(dims) for x in (F.count(d).alias(f"n{i}"), F.min(d).alias(f"a{i}"), F.max(d).alias(f"b{i}")))).first()
    total = {i: first[f"n{i}"] for i in range(len(dims)) if first[f"n{i}"]}
    # values in [low, high]: the middle ranks are among them; below: how many are smaller than low
    low, high = ({i: first[f"{x}{i}"] for i in total} for x in "ab")
    below, within = dict.fromkeys(total, 0), dict(total)
    open_ = {i for i in total if low[i] < high[i] and total[i] > most}
    while open_:
        aim = {i: (((total[i] - 1) // 2 - below[i]) / within[i], (total[i] // 2 + 1 - below[i]) / within[i]) for i in open_}
        inside = {i: F.when(F.col(dims[i]).between(low[i], high[i]), F.col(dims[i])) for i in open_}
        share = [F.percentile_approx(inside[i], [max(a - 2e-4, 0.0), min(b + 2e-4, 1.0)], 10_000).alias(f"p{i}") for i, (a, b) in aim.items()]
        got = own.agg(*share).first()
        tried = {i: got[f"p{i}"] for i in open_}
        told = own.agg(*(x for i, (a, b) in tried.items() for x in (F.count_if(F.col(dims[i]) < a).alias(f"l{i}"), F.count_if(F.col(dims[i]).between(a, b)).alias(f"w{i}")))).first()
        for i, (a, b) in tried.items():
            lower, count = told[f"l{i}"], told[f"w{i}"]
            # an approximation that misses the middle leaves the bracket as it is, which is then counted whole
            if lower > (total[i] - 1) // 2 or lower + count <= total[i] // 2 or (a, b) == (low[i], high[i]):
                open_.discard(i)
                continue
            low[i], high[i], below[i], within[i] = a, b, lower, count
            if a == b or count <= most:
                open_.discard(i)
    if not total:
        return dict.fromkeys(dims)
    pair = F.array(*(F.struct(F.lit(i).alias("i"), F.when(F.col(dims[i]).between(low[i], high[i]), F.col(dims[i])).alias("v")) for i in total))
    counts = own.select(F.inline(pair)).where("v is not null").groupBy("i", "v").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("i").orderBy("v"))
    ranks = rows.sparkSession.createDataFrame([(i, below[i], total[i]) for i in total], "i int, below long, total long")
    placed = counts.withColumn("c", upto).join(F.broadcast(ranks), "i").withColumn("c", F.col("c") + F.col("below"))
    at = lambda r: F.min(F.when(F.col("c") > r, F.col("v")))
    middle = {r.i: (r.a + r.b) / 2 for r in placed.groupBy("i").agg(at(F.expr("(total - 1) div 2")).alias("a"), at(F.expr("total div 2")).alias("b")).collect()}
    return {d: middle.get(i) for i, d in enumerate(dims)}


def median_filled(rows: DataFrame, dims: list[str]) -> DataFrame:
    """Nulls and NaNs replaced by the column's exact median over all rows; a column without values stays null."""
    filled = medians(rows, dims)
    return rows.withColumns({d: F.coalesce(F.when(~F.isnan(d), F.col(d)), F.lit(filled[d]).cast("double")) for d in dims})


def standardized(rows: DataFrame, dims: list[str]) -> DataFrame:
    """Zero mean and unit population deviation by column; a constant column becomes 0."""
    stats = rows.agg(*(x for d in dims for x in (F.avg(d).alias(f"_a_{d}"), F.stddev_pop(d).alias(f"_s_{d}"))))
    own = rows.crossJoin(F.broadcast(stats))  # one row
    return own.withColumns({d: F.when(F.col(f"_s_{d}") > 0, (F.col(d) - F.col(f"_a_{d}")) / F.col(f"_s_{d}")).otherwise(0.0) for d in dims}).select(*rows.columns)


def nearest_centroid(rows: DataFrame, dims: list[str], centroids: list[list[float]]) -> DataFrame:
    """label: index of the closest centroid (ties: the first). Centroids are constants of the plan."""
    d2 = F.array(*(sum(((F.col(d) - F.lit(float(c))) ** 2 for d, c in zip(dims, centre)), F.lit(0.0)) for centre in centroids))
    return rows.withColumn("label", (F.array_position(d2, F.array_min(d2)) - 1).cast("int"))


def valid_share(rows: DataFrame) -> DataFrame:
    share = F.coalesce(F.avg(F.col("valid").cast("int")), F.lit(0.0))
    return rows.groupBy(S).agg(share.alias("valid_fraction"), (share < 0.2).alias("warning"))


def as_array(dims: list[str]) -> Column:
    return F.array(*(F.col(d).cast("double") for d in dims))
