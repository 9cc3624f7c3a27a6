"""Linear mixed effects: group as fixed effect, a random intercept by subject, by maximum likelihood.

One aggregation leaves a row for each subject, the next a row for each pattern of a subject's counts by group. With the
ratio r of the two variances given, all else is closed; the profile likelihood over r / (1 + r) is searched on a grid that
narrows, each pass being one aggregation of the patterns for all outcomes and grid points. The driver solves systems of as many
unknowns as there are groups.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Grid points of a pass, and passes; each narrows the bracket to two of GRID steps.
GRID, PASSES = 24, 9


def _profile(counts, sums, square, ratio: float, patterns: dict):
    """(log likelihood, means, covariance of means, residual variance) at a ratio; patterns: sums over subjects."""
    g = len(counts)
    a = np.diag(counts).astype(float)
    for i in range(g):
        for j in range(i, g):
            a[i, j] -= patterns[f"c{i}_{j}"]
            a[j, i] = a[i, j]
    b = sums - np.array([patterns[f"t{i}"] for i in range(g)])
    inverse = np.linalg.inv(a)
    means = inverse @ b
    n = counts.sum()
    scale = max((square - patterns["q"] - b @ means) / n, 1e-300)
    return -n / 2 * (math.log(2 * math.pi * scale) + 1) - patterns["logs"] / 2, means, inverse * scale, scale


def mixed_effects(rows: DataFrame, keys: list[str], subject: str = "subject", group: str = "group", value: str = "value") -> DataFrame:
    """For each key: parameter, estimate, std_error, z, p_value, group_var, scale, log_likelihood and n_obs.

    Model: value ~ group (treatment coding: the first level in order is the intercept) + a random intercept of the subject;
    maximum likelihood, not restricted. p is two-sided by the normal distribution. group_var is the subjects' variance, scale the
    residual one. Rows with a null key, subject, group or value are left out, and keys with fewer than four rows or fewer
    than two groups. A subject may have rows in several groups. Groups are a handful: their pairs are columns.
    """
    own = rows.select(*keys, F.col(subject).alias("s"), F.col(group).cast("string").alias("g"), F.col(value).cast("double").alias("v")).dropna()
    own = own.where(~F.isnan("v"))
    levels = sorted(r.g for r in own.select("g").distinct().collect())
    g = len(levels)
    # values are centred first: sums of squares keep their digits
    centre = {tuple(r[:-1]): r[-1] for r in own.groupBy(*keys).agg(F.avg("v").alias("_c")).collect()} if g else {}
    if not centre:
        return _told(rows, keys, [])
    spark = rows.sparkSession
    kinds = ", ".join(f"`{c}` {t}" for c, t in own.select(*keys).dtypes)
    centres = spark.createDataFrame([(*k, v) for k, v in centre.items()], f"{kinds}, _c double")
    own = own.join(F.broadcast(centres), keys).withColumn("v", F.col("v") - F.col("_c"))
    count = [F.count_if(F.col("g") == x).cast("double").alias(f"n{i}") for i, x in enumerate(levels)]
    total = [F.coalesce(F.sum(F.when(F.col("g") == x, F.col("v"))), F.lit(0.0)).alias(f"y{i}") for i, x in enumerate(levels)]
    subjects = own.groupBy(*keys, "s").agg(*count, *total, F.sum("v").alias("t"), F.sum(F.col("v") ** 2).alias("q"))
    n = [f"n{i}" for i in range(g)]
    patterns = subjects.groupBy(*keys, *n).agg(F.count("*").alias("m"), *(F.sum(f"y{i}").alias(f"y{i}") for i in range(g)), F.sum("t").alias("t"), F.sum(F.col("t") ** 2).alias("tt"), F.sum("q").alias("q")).persist()
    try:
        whole = {}
        for r in patterns.groupBy(*keys).agg(*(F.sum(F.col(c) * F.col("m")).alias(c) for c in n), *(F.sum(f"y{i}").alias(f"y{i}") for i in range(g)), F.sum("q").alias("q")).collect():
            counts, sums = np.array([r[c] for c in n]), np.array([r[f"y{i}"] for i in range(g)])
            have = np.flatnonzero(counts > 0)
            if counts.sum() >= 4 and len(have) >= 2:
                whole[tuple(r[k] for k in keys)] = (have, counts[have], sums[have], r.q)
        best, bracket = {}, dict.fromkeys(whole, (0.0, 1 - 1e-9))
        size = sum((F.col(c) for c in n), F.lit(0.0))
        w = F.col("r") / (1 + F.col("r") * size)
        sums = {f"c{i}_{j}": w * F.col(n[i]) * F.col(n[j]) * F.col("m") for i in range(g) for j in range(i, g)}
        sums |= {f"t{i}": w * F.col(n[i]) * F.col("t") for i in range(g)} | {"q": w * F.col("tt"), "logs": F.col("m") * F.log1p(F.col("r") * size)}
        for _ in range(PASSES):
            grid = [(*k, i, x / (1 - x)) for k, (low, high) in bracket.items() for i, x in enumerate(np.linspace(low, high, GRID).tolist())]
            if not grid:
                break
            points = spark.createDataFrame(grid, f"{kinds}, i int, r double")
            found: dict = {}
            for row in patterns.drop("q").join(F.broadcast(points), keys).groupBy(*keys, "i", "r").agg(*(F.sum(e).alias(c) for c, e in sums.items())).collect():
                key = tuple(row[k] for k in keys)
                have, counts, y, q = whole[key]
                own_sums = {f"c{a}_{b}": row[f"c{i}_{j}"] for a, i in enumerate(have) for b, j in enumerate(have) if a <= b} | {f"t{a}": row[f"t{i}"] for a, i in enumerate(have)} | {"q": row.q, "logs": row.logs}
                found.setdefault(key, []).append((*_profile(counts, y, q, row.r, own_sums), row.r, row.i))
            for key, tried in found.items():
                top = max(tried, key=lambda x: x[0])
                if key not in best or top[0] >= best[key][0]:
                    best[key] = top
                low, high = bracket[key]
                at = np.linspace(low, high, GRID)
                bracket[key] = (at[max(top[-1] - 1, 0)], at[min(top[-1] + 1, GRID - 1)])
    finally:
        patterns.unpersist()
    out = []
    for key, (likelihood, means, cov, scale, ratio, _) in best.items():
        have, counts, _, _ = whole[key]
        for a, i in enumerate(have):
            first = a == 0
            estimate = float(means[0] + centre[key] if first else means[a] - means[0])
            error = math.sqrt(max(cov[0, 0] if first else cov[a, a] + cov[0, 0] - 2 * cov[0, a], 0))
            z = estimate / error if error > 0 else math.nan
            name = "Intercept" if first else f"{group}[{levels[i]}]"
            out.append((*key, name, estimate, error, z, math.erfc(abs(z) / math.sqrt(2)), float(ratio * scale), float(scale), float(likelihood), int(counts.sum())))
    return _told(rows, keys, out)


def _told(rows: DataFrame, keys: list[str], out: list) -> DataFrame:
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.select(*keys).dtypes)
    return rows.sparkSession.createDataFrame(out, f"{kinds}, parameter string, estimate double, std_error double, z double, p_value double, group_var double, scale double, log_likelihood double, n_obs long")
