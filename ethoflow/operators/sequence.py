"""Markov analysis of motif label sequences; -1 is unassigned and dropped before neighbours are paired."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .islands import runs

S = "session_id"


def _labels(rows: DataFrame) -> DataFrame:
    return rows.where("label >= 0").select(S, "frame_index", "label")


def _w():
    return Window.partitionBy(S).orderBy("frame_index")


def transitions(rows: DataFrame) -> DataFrame:
    """(session, i, j, n, p): counts of label pairs and row-normalised probabilities; missing pairs are 0."""
    pair = _labels(rows).withColumn("j", F.lead("label").over(_w())).where("j is not null")
    n = pair.groupBy(S, F.col("label").alias("i"), "j").agg(F.count("*").alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(S, "i")))


def usage(rows: DataFrame, k: int) -> DataFrame:
    """Share of each of k labels, 0 where unseen."""
    n = _labels(rows).groupBy(S, "label").agg(F.count("*").alias("n"))
    every = n.select(S).distinct().withColumn("label", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    out = every.join(n, [S, "label"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("usage", F.col("n") / F.sum("n").over(Window.partitionBy(S)))


def dwell(rows: DataFrame, fps: float) -> DataFrame:
    """Mean run length in seconds and its coefficient of variation (population) by label."""
    numbered = _labels(rows).withColumn("t_sec", F.col("frame_index") / F.lit(float(fps)))
    r = runs(numbered, F.col("label"))
    d = F.col("n") / F.lit(float(fps))
    out = r.groupBy(S, F.col("state").alias("label")).agg(F.avg(d).alias("dwell_s"), F.stddev_pop(d).alias("_sd"), F.count("*").alias("bouts"))
    return out.withColumn("dwell_cv", F.when(F.col("dwell_s") > 0, F.col("_sd") / F.col("dwell_s")).otherwise(0.0)).drop("_sd")


def self_rate(rows: DataFrame, k: int) -> DataFrame:
    """Mean of the transition matrix's diagonal over all k labels."""
    return transitions(rows).groupBy(S).agg((F.coalesce(F.sum(F.when(F.col("i") == F.col("j"), F.col("p"))), F.lit(0.0)) / k).alias("self_rate"))


def top_trigrams(rows: DataFrame, n: int = 5) -> DataFrame:
    """The n most frequent label triples with their share; ties by first appearance."""
    w = _w()
    own = _labels(rows).withColumns({"b": F.lead("label", 1).over(w), "c": F.lead("label", 2).over(w)}).where("c is not null")
    g = own.groupBy(S, F.col("label").alias("a"), "b", "c").agg(F.count("*").alias("n"), F.min("frame_index").alias("_first"))
    s = Window.partitionBy(S)
    g = g.withColumns({"share": F.col("n") / F.sum("n").over(s), "rank": F.row_number().over(s.orderBy(F.desc("n"), "_first"))})
    return g.where(F.col("rank") <= n).drop("_first")


def markov_order(rows: DataFrame, k: int, least: int = 100, ratio: float = 3.84) -> DataFrame:
    """Log-likelihoods of first and second order, and order 2 where the likelihood ratio over k * k * (k - 1) exceeds ``ratio``."""
    w = _w()
    own = _labels(rows).withColumns({"b": F.lead("label", 1).over(w), "c": F.lead("label", 2).over(w)})

    def likelihood(df, given, name):
        n = df.groupBy(S, *given).agg(F.count("*").alias("n"))
        p = F.col("n") / F.sum("n").over(Window.partitionBy(S, *given[:-1]))
        return n.withColumn("_l", F.col("n") * F.log(p)).groupBy(S).agg(F.sum("_l").alias(name))

    total = own.groupBy(S).agg(F.count("*").alias("labels"))
    out = total.join(likelihood(own.where("b is not null"), ["label", "b"], "ll1"), S, "left").join(likelihood(own.where("c is not null"), ["label", "b", "c"], "ll2"), S, "left")
    lr = 2 * (F.col("ll2") - F.col("ll1"))
    second = (F.col("labels") >= least) & F.lit(k >= 2) & (lr / F.lit(float(max(1, k * k * (k - 1)))) > ratio)
    return out.withColumn("markov_order", F.when(second, 2).otherwise(1))


def stationary(rows: DataFrame, k: int) -> DataFrame:
    """(session, pi, entropy, entropy_normalized): stationary vector by eigenvector, transition entropy over ln(k * k).

    A session's transitions are k * k rows at most, so its group is bounded by the number of motifs.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.zeros((k, k))
        t[pdf["i"], pdf["j"]] = pdf["p"]
        values, vectors = np.linalg.eig(t.T)
        v = np.abs(np.real(vectors[:, np.argmin(np.abs(values - 1))]))
        pi = v / v.sum() if v.sum() > 0 else np.full(k, 1 / k)
        with np.errstate(divide="ignore", invalid="ignore"):
            h = float(-np.nansum(pi[:, None] * np.where(t > 0, t * np.log(t), 0)))
        return pd.DataFrame({S: [pdf[S].iloc[0]], "pi": [pi.tolist()], "entropy": [h], "entropy_normalized": [h / np.log(k * k) if k > 1 else 0.0]})

    schema = f"{S} {dict(rows.dtypes)[S]}, pi array<double>, entropy double, entropy_normalized double"
    return transitions(rows).select(S, "i", "j", "p").groupBy(S).applyInPandas(one, schema)


def profile(rows: DataFrame, k: int, fps: float, least: int = 4) -> DataFrame:
    """Self rate, entropy and label count by session; zeros for sessions of fewer than ``least`` labels."""
    n = rows.groupBy(S).agg(F.count_if(F.col("label") >= 0).alias("labels"))
    out = n.join(self_rate(rows, k), S, "left").join(stationary(rows, k).drop("pi"), S, "left")
    few = F.col("labels") < least
    return out.select(S, "labels", *(F.when(few, 0.0).otherwise(F.coalesce(c, F.lit(0.0))).alias(c) for c in ("self_rate", "entropy", "entropy_normalized")))
