"""Cohort averages of motif sequences, and density grids of embedded windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .sequence import S, transitions, usage


def _enough(rows: DataFrame, least: int) -> DataFrame:
    return rows.withColumn("_n", F.count_if(F.col("label") >= 0).over(Window.partitionBy(S))).where(F.col("_n") >= least).drop("_n")


def cohort_transitions(rows: DataFrame, least: int = 4) -> DataFrame:
    """Mean of the sessions' transition matrices, over all sessions: one of fewer than ``least`` labels adds zeros."""
    total = _enough(rows, least).transform(transitions).groupBy("i", "j").agg(F.sum("p").alias("_s"))
    n = rows.agg(F.countDistinct(S).alias("_n"))
    return total.crossJoin(F.broadcast(n)).select("i", "j", (F.col("_s") / F.col("_n")).alias("p"))  # n is one row


def cohort_usage(rows: DataFrame, k: int, least: int = 4) -> DataFrame:
    """Mean use of each of k motifs, over all sessions, as in cohort_transitions."""
    total = usage(_enough(rows, least), k).groupBy("label").agg(F.sum("usage").alias("_s"))
    n = rows.agg(F.countDistinct(S).alias("_n"))
    return total.crossJoin(F.broadcast(n)).select("label", (F.col("_s") / F.col("_n")).alias("usage"))


def usage_by_genotype(rows: DataFrame, genotypes: DataFrame, k: int) -> DataFrame:
    """Mean use of each motif by genotype(session_id, genotype)."""
    return usage(rows, k).join(genotypes, S).groupBy("genotype", "label").agg(F.avg("usage").alias("usage"), F.count("*").alias("sessions"))


def density(points: DataFrame, size: int = 50, bandwidth: float = 0.5, pad: float = 1.0) -> DataFrame:
    """(ix, iy, density): Gaussian density of (x, y) over a grid that reaches ``pad`` beyond the points, over its peak.

    A kernel is a factor by column times a factor by row, so a point makes ``size`` rows that are summed before
    the shuffle, not ``size`` squared.
    """
    own = points.where("x is not null and y is not null").select(F.col("x").cast("double"), F.col("y").cast("double"))
    box = own.agg(*(f(c).alias(f"_{n}{c}") for c in "xy" for n, f in (("a", F.min), ("b", F.max))))

    def factors(c: str):
        low, high = F.col(f"_a{c}") - pad, F.col(f"_b{c}") + pad
        step = (high - low) / (size - 1)
        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.exp(-0.5 * ((F.col(c) - (low + i * step)) / bandwidth) ** 2))

    both = own.crossJoin(F.broadcast(box)).select(factors("x").alias("_fx"), factors("y").alias("_fy"))  # box is one row
    columns = both.select("_fy", F.posexplode("_fx").alias("ix", "_f"))
    sums = columns.groupBy("ix").agg(*(F.sum(F.col("_f") * F.col("_fy")[j]).alias(f"_{j}") for j in range(size)))
    grid = sums.select("ix", F.posexplode(F.array(*(F.col(f"_{j}") for j in range(size)))).alias("iy", "_d"))
    peak = F.max("_d").over(Window.partitionBy(F.lit(0)))  # size squared rows
    return grid.select("ix", "iy", (F.col("_d") / (peak + 1e-8)).alias("density"))


def density_by_group(points: DataFrame, group: str, size: int = 40, share: float = 0.04, reach: int = 2, least: int = 5) -> DataFrame:
    """(group, ix, iy, density): counts of cells of one grid over all points, spread over the cells within ``reach``, over the group's peak.

    The kernel's deviation is ``share`` of the larger range. Groups of fewer than ``least`` points are left out, and cells that
    nothing reaches. Points are counted by cell before anything is spread.
    """
    own = points.where("x is not null and y is not null").select(F.col(group).alias("group"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    box = own.agg(*(f(c).alias(f"_{n}{c}") for c in "xy" for n, f in (("a", F.min), ("b", F.max))))
    wide = {c: F.when(F.col(f"_b{c}") > F.col(f"_a{c}"), F.col(f"_b{c}") - F.col(f"_a{c}")).otherwise(1.0) for c in "xy"}
    cell = lambda c: F.floor((F.col(c) - F.col(f"_a{c}")) / wide[c] * (size - 1)).cast("int")
    counts = own.crossJoin(F.broadcast(box)).groupBy("group", cell("x").alias("cx"), cell("y").alias("cy"), wide["x"].alias("wx"), wide["y"].alias("wy")).agg(F.count("*").alias("n"))  # box is one row
    near = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)))
    far = (F.col("i") * F.col("wx") / size) ** 2 + (F.col("j") * F.col("wy") / size) ** 2
    weight = F.exp(-0.5 * far / (share * F.greatest("wx", "wy")) ** 2)
    spread = counts.select("*", F.inline(near)).select("group", (F.col("cx") + F.col("i")).alias("ix"), (F.col("cy") + F.col("j")).alias("iy"), (F.col("n") * weight).alias("_d"))
    grid = spread.where(f"ix between 0 and {size - 1} and iy between 0 and {size - 1}").groupBy("group", "ix", "iy").agg(F.sum("_d").alias("_d"))
    many = own.groupBy("group").agg(F.count("*").alias("_n")).where(f"_n >= {least}").select(F.col("group").alias("_g"))
    grid = grid.join(many, F.col("group").eqNullSafe(F.col("_g")), "left_semi")
    return grid.select(F.col("group").alias(group), "ix", "iy", (F.col("_d") / F.max("_d").over(Window.partitionBy("group"))).alias("density"))
