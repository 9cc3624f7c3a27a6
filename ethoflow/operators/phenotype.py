"""Per-animal feature vectors in long form (animal, feature, value), their z-scores, exports and group summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vectors(usage: DataFrame, profiles: DataFrame, metrics: DataFrame, key: str = "session_id") -> DataFrame:
    """Long vectors: usage of each motif (motif_<i>), then every numeric column of profiles and metrics."""
    own = usage.select(key, F.concat(F.lit("motif_"), F.col("label")).alias("feature"), F.col("usage").alias("value"))
    for wide in (profiles, metrics):
        names = [c for c in wide.columns if c != key]
        own = own.union(wide.select(key, F.expr(f"stack({len(names)}, " + ", ".join(f"'{c}', cast(`{c}` as double)" for c in names) + ") as (feature, value)")))
    return own.withColumn("value", F.nanvl(F.coalesce("value", F.lit(0.0)), F.lit(0.0)))


def z_scores(rows: DataFrame, reference: str, key: str = "animal") -> DataFrame:
    """z against the reference genotype (population deviation; below 1e-8 it counts as 1); all animals, if it has none."""
    own = rows.withColumn("value", F.nanvl(F.coalesce("value", F.lit(0.0)), F.lit(0.0)))
    ref = F.col("genotype") == reference
    some = own.groupBy("feature").agg(*(x for c, n in ((ref, "r"), (F.lit(True), "a")) for x in (F.avg(F.when(c, F.col("value"))).alias(f"{n}_m"), F.stddev_pop(F.when(c, F.col("value"))).alias(f"{n}_s"))))
    m = F.coalesce("r_m", "a_m")
    s = F.when(F.col("r_m").isNotNull(), F.col("r_s")).otherwise(F.col("a_s"))
    some = some.select("feature", m.alias("_m"), F.when(s < 1e-8, 1.0).otherwise(s).alias("_s"))
    return own.join(some, "feature").withColumn("z", (F.col("value") - F.col("_m")) / F.col("_s")).drop("_m", "_s")


def export(rows: DataFrame, features: list[str], key: str = "animal") -> DataFrame:
    """Wide rows: each feature and z_<feature>, 0 where missing."""
    wide = rows.groupBy(key, "genotype").pivot("feature", features).agg(F.first("value").alias("value"), F.first("z").alias("z"))
    return wide.select(key, "genotype", *(F.coalesce(F.col(f"{f}_value"), F.lit(0.0)).alias(f) for f in features), *(F.coalesce(F.col(f"{f}_z"), F.lit(0.0)).alias(f"z_{f}") for f in features))


def group_summary(rows: DataFrame, groups: list[str], sample: bool = False) -> DataFrame:
    """n, mean and standard error by the given columns; population deviation, or the sample's."""
    sd = F.stddev_samp("value") if sample else F.stddev_pop("value")
    return rows.groupBy(*groups).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.coalesce(sd / F.sqrt(F.count("value")), F.lit(0.0)).alias("sem"))


def radar(rows: DataFrame, features: list[str]) -> DataFrame:
    """Mean, standard error and |mean| over the feature's largest |mean| among groups (0.01 at least)."""
    from pyspark.sql import Window

    own = group_summary(rows.where(F.col("feature").isin(features)), ["genotype", "feature"])
    top = F.greatest(F.lit(0.01), F.max(F.abs("mean")).over(Window.partitionBy("feature")))
    return own.withColumn("scaled", F.abs("mean") / top)


def learning_curve(rows: DataFrame, treatments: list[str]) -> DataFrame:
    """Mean by trial (rows) and treatment (columns), ordered by the trial's number."""
    from ..functions.scalars import trial_number

    return rows.groupBy("trial").pivot("treatment", treatments).agg(F.avg("value")).withColumn("trial_number", trial_number(F.col("trial")))


def upsert(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows whose key changes have are replaced by them."""
    return rows.join(changes.select(key), key, "left_anti").unionByName(changes)


def qc_joined(animals: DataFrame, reports: DataFrame, key: str = "animal") -> DataFrame:
    """Animals with their report columns, and qc_available."""
    return animals.join(reports.withColumn("_r", F.lit(True)), key, "left").withColumn("qc_available", F.col("_r").isNotNull()).drop("_r")
