"""Group statistics over long rows (feature, group, value): moments by partial aggregation, formulas on top.

Tail probabilities need a special function; they are computed over the few rows of moments by a pandas UDF.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import DoubleType

from ..functions import special
from ..functions.scalars import stars


@F.pandas_udf(DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([special.t_two_sided(a, b) for a, b in zip(t.astype(float), df.astype(float))])


@F.pandas_udf(DoubleType())
def f_p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series([special.f_upper(a, b, c) for a, b, c in zip(f.astype(float), d1.astype(float), d2.astype(float))])


def _known(rows: DataFrame) -> DataFrame:
    return rows.where("value is not null and not isnan(value) and `group` is not null")


def moments(rows: DataFrame) -> DataFrame:
    """n, mean, sample variance by feature and group; groups of one value are left out."""
    return _known(rows).groupBy("feature", "group").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v")).where("n >= 2")


def pairs(rows: DataFrame) -> DataFrame:
    """Moments of every ordered pair of groups a < b of a feature."""
    m = moments(rows)
    a = m.select("feature", F.col("group").alias("a"), F.col("n").alias("na"), F.col("m").alias("ma"), F.col("v").alias("va"))
    b = m.select("feature", F.col("group").alias("b"), F.col("n").alias("nb"), F.col("m").alias("mb"), F.col("v").alias("vb"))
    return a.join(b, "feature").where("a < b")


def welch(rows: DataFrame) -> DataFrame:
    """t, Satterthwaite df and Cohen's d (pooled) of every pair; no t where both variances are 0."""
    p = pairs(rows)
    sa, sb = F.col("va") / F.col("na"), F.col("vb") / F.col("nb")
    se = sa + sb
    pooled = F.sqrt(((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / (F.col("na") + F.col("nb") - 2))
    return p.select("feature", "a", "b", "na", "nb", "ma", "mb", F.when(se > 0, (F.col("ma") - F.col("mb")) / F.sqrt(se)).alias("t"), F.when(se > 0, se * se / (sa * sa / (F.col("na") - 1) + sb * sb / (F.col("nb") - 1))).alias("df"), F.when(pooled > 1e-10, (F.col("ma") - F.col("mb")) / pooled).otherwise(0.0).alias("cohen_d"))


def anova(rows: DataFrame) -> DataFrame:
    """F with its degrees of freedom by feature, from two groups on."""
    m = moments(rows)
    g = m.groupBy("feature").agg(F.count("*").alias("k"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"), F.sum(F.col("n") * F.col("m") ** 2).alias("_s"), F.sum((F.col("n") - 1) * F.col("v")).alias("ssw"))
    ssb = F.col("_s") - F.col("n") * F.col("grand") ** 2
    d1, d2 = F.col("k") - 1, F.col("n") - F.col("k")
    return g.where("k >= 2 and n > k").select("feature", "k", "n", F.when(F.col("ssw") > 0, (ssb / d1) / (F.col("ssw") / d2)).alias("f"), d1.alias("d1"), d2.alias("d2"))


def group_test(rows: DataFrame) -> DataFrame:
    """Per feature: Welch for two groups, ANOVA for more, with p and stars; nothing for fewer."""
    two = moments(rows).groupBy("feature").agg(F.count("*").alias("k"))
    w = welch(rows).join(two.where("k = 2"), "feature").select("feature", F.lit("welch").alias("test"), F.col("t").alias("statistic"), t_p("t", "df").alias("p"))
    f = anova(rows).where("k > 2").select("feature", F.lit("anova").alias("test"), F.col("f").alias("statistic"), f_p("f", F.col("d1").cast("double"), F.col("d2").cast("double")).alias("p"))
    return w.union(f).withColumn("stars", stars(F.col("p")))


def post_hoc(rows: DataFrame) -> DataFrame:
    """Welch p of every pair, multiplied by the number of the feature's pairs (Bonferroni), 1 at most."""
    w = welch(rows).withColumn("_n", F.count("*").over(Window.partitionBy("feature")))
    p = F.coalesce(t_p("t", "df"), F.lit(1.0))
    return w.withColumn("p_adjusted", F.least(F.lit(1.0), p * F.col("_n"))).drop("_n")


def tukey(rows: DataFrame) -> DataFrame:
    """Tukey-Kramer HSD of every pair, from three groups on."""
    base = anova(rows).where("k > 2").select("feature", "k", "d2", F.lit(1).alias("_"))
    mse = moments(rows).groupBy("feature").agg((F.sum((F.col("n") - 1) * F.col("v")) / (F.sum("n") - F.count("*"))).alias("mse"))

    @F.pandas_udf(DoubleType())
    def q_p(q: pd.Series, k: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([special.studentized_range_upper(abs(a), int(b), float(c)) for a, b, c in zip(q, k, df)])

    own = pairs(rows).join(base, "feature").join(mse, "feature")
    q = (F.col("ma") - F.col("mb")) / F.sqrt(F.col("mse") / 2 * (1 / F.col("na") + 1 / F.col("nb")))
    return own.select("feature", "a", "b", q.alias("q"), q_p(q, "k", "d2").alias("p"))


@F.pandas_udf(DoubleType())
def u_p(u: pd.Series, z: pd.Series, na: pd.Series, nb: pd.Series, tie: pd.Series) -> pd.Series:
    def one(u, z, a, b, tie):
        if min(a, b) <= 8 and tie == 0 and a * b <= special.MOST_EXACT:
            return special.mann_whitney_exact(u, int(a), int(b))
        return min(1.0, math.erfc(z / math.sqrt(2))) if z == z else float("nan")

    return pd.Series([one(*x) for x in zip(u.astype(float), z.astype(float), na, nb, tie)])


def mann_whitney(rows: DataFrame, buckets: int = 256) -> DataFrame:
    """U of a against b for every pair of groups, the normal approximation's z (tie and continuity corrected) and p.

    p is two-sided: exact where a group has eight values at most and the pair no ties, else by z; null where all values of
    the pair are one. Values are counted by group; what lies below a value is the sum of the buckets before its own
    and of the bucket's smaller values, so no task orders a feature's values. Groups are a handful: each is a column of counts.
    """
    own = _known(rows).select("feature", F.col("group").cast("string").alias("group"), F.col("value").cast("double").alias("value"))
    levels = sorted(r.group for r in own.select("group").distinct().collect())
    g = range(len(levels))
    empty = "feature string, a string, b string, na long, nb long, u double, z double, p double"
    if len(levels) < 2:
        return rows.sparkSession.createDataFrame([], empty)
    per = own.groupBy("feature", "value").agg(*(F.count_if(F.col("group") == x).alias(f"n{i}") for i, x in zip(g, levels)))
    cuts = own.groupBy("feature").agg(F.percentile_approx("value", [i / buckets for i in range(1, buckets)], 10_000).alias("cuts"))
    per = per.join(cuts, "feature").withColumn("k", F.size(F.filter(F.array_distinct("cuts"), lambda c: c <= F.col("value")))).drop("cuts")
    before = Window.partitionBy("feature").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    inside = Window.partitionBy("feature", "k").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0)
    totals = per.groupBy("feature", "k").agg(*(F.sum(f"n{i}").alias(f"t{i}") for i in g))
    totals = totals.select("feature", "k", *(F.coalesce(F.sum(f"t{i}").over(before), none).alias(f"t{i}") for i in g))
    below = per.join(totals, ["feature", "k"]).select("feature", *(f"n{i}" for i in g), *((F.col(f"t{i}") + F.coalesce(F.sum(f"n{i}").over(inside), none)).alias(f"c{i}") for i in g))
    n = lambda i: F.col(f"n{i}")
    t = lambda i, j: n(i) + n(j)
    pairs_ = [(i, j) for i in g for j in g if i < j]
    sums = [x for i, j in pairs_ for x in (F.sum(n(i) * (2 * F.col(f"c{j}") + n(j))).alias(f"u{i}_{j}"), F.sum(t(i, j).cast("double") ** 3 - t(i, j)).alias(f"e{i}_{j}"))]
    whole = below.groupBy("feature").agg(*(F.sum(n(i)).alias(f"n{i}") for i in g), *sums)
    each = F.array(*(F.struct(F.lit(levels[i]).alias("a"), F.lit(levels[j]).alias("b"), n(i).alias("na"), n(j).alias("nb"), (F.col(f"u{i}_{j}") / 2).alias("u"), F.col(f"e{i}_{j}").alias("tie")) for i, j in pairs_))
    s = whole.select("feature", F.inline(each)).where("na > 0 and nb > 0")
    size = F.col("na") + F.col("nb")
    sd = F.sqrt(F.col("na") * F.col("nb") / 12.0 * ((size + 1) - F.try_divide(F.col("tie"), size * (size - 1))))
    z = F.when(sd > 0, (F.abs(F.col("u") - F.col("na") * F.col("nb") / 2) - 0.5) / sd)
    s = s.withColumn("z", z)
    return s.select("feature", "a", "b", "na", "nb", "u", "z", F.nanvl(u_p("u", "z", "na", "nb", "tie"), F.lit(None).cast("double")).alias("p"))


def fdr(rows: DataFrame, keys: list[str] | None = None, buckets: int = 256) -> DataFrame:
    """Benjamini-Hochberg q for rows with p: the least p * n / rank of this rank and above; null where p is.

    A family (rows of equal keys) is ranked in one task. Without keys all rows are one family: equal p have equal q, so p are counted
    first; ranks and least values of buckets of p are joined by one row for each bucket, and no task orders all tests.
    """
    if keys:
        base = Window.partitionBy(*keys)
        own = rows.withColumns({"_n": F.count("p").over(base), "_r": F.row_number().over(base.orderBy("p", *(c for c in rows.columns if c not in (*keys, "p"))))})
        own = own.withColumn("_a", F.col("p") * F.col("_n") / F.col("_r"))
        return own.withColumn("q", F.least(F.lit(1.0), F.min("_a").over(base.orderBy("_r").rowsBetween(0, Window.unboundedFollowing)))).drop("_n", "_r", "_a")
    known = rows.where("p is not null").groupBy("p").agg(F.count("*").alias("c"))
    cuts = rows.agg(F.percentile_approx("p", [i / buckets for i in range(1, buckets)], 10_000)).first()[0] or []
    marks = F.array(*(F.lit(float(c)) for c in sorted(set(cuts)))).cast("array<double>")
    known = known.withColumn("k", F.size(F.filter(marks, lambda c: c <= F.col("p"))))
    inside = Window.partitionBy("k").orderBy("p")
    # a row for each bucket
    up, down = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = known.groupBy("k").agg(F.sum("c").alias("s"))
    sizes = sizes.select("k", F.coalesce(F.sum("s").over(up), F.lit(0)).alias("before"), F.sum("s").over(Window.partitionBy(F.lit(0))).alias("n"))
    ranked = known.join(F.broadcast(sizes), "k").withColumn("a", F.col("p") * F.col("n") / (F.col("before") + F.sum("c").over(inside)))
    least = ranked.groupBy("k").agg(F.min("a").alias("m")).select("k", F.min("m").over(down).alias("above"))
    q = ranked.join(F.broadcast(least), "k").select(F.col("p").alias("_p"), F.least(F.lit(1.0), F.col("above"), F.min("a").over(inside.rowsBetween(0, Window.unboundedFollowing))).alias("q"))
    return rows.join(q, F.col("p") == F.col("_p"), "left").drop("_p")


def permutation(rows: DataFrame, n: int = 10_000, seed: int = 42) -> DataFrame:
    """Two-sided permutation p of the difference of means for each pair of groups and feature.

    p = (c + 1) / (n + 1). One pair's values meet in one task: this is a test for small groups.
    """
    own = _known(rows)
    g = own.select("feature", "group").distinct()
    p = g.withColumnRenamed("group", "a").join(g.withColumnRenamed("group", "b"), "feature").where("a < b")
    both = own.join(p, "feature").where("`group` = a or `group` = b").select("feature", "a", "b", "group", "value")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["group", "value"])
        mine = (pdf["group"] == pdf["a"]).to_numpy()
        x, m = pdf["value"].to_numpy(float), int(mine.sum())
        x = np.concatenate([x[mine], x[~mine]])
        seen = abs(x[:m].mean() - x[m:].mean()) if 0 < m < len(x) else np.nan
        rng, count = np.random.default_rng(seed), 0
        for _ in range(n if np.isfinite(seen) else 0):
            rng.shuffle(x)
            count += abs(x[:m].mean() - x[m:].mean()) >= seen - 1e-12
        return pd.DataFrame({"feature": [pdf["feature"].iloc[0]], "a": [pdf["a"].iloc[0]], "b": [pdf["b"].iloc[0]], "p": [(count + 1) / (n + 1) if np.isfinite(seen) else np.nan]})

    return both.groupBy("feature", "a", "b").applyInPandas(one, "feature string, a string, b string, p double")


#: Permutations of a block, whose sums travel together.
PERMUTATIONS = 500


def _mixed(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64 (public domain constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _dealt(batches, tests: dict, n: int, seed: int):
    """One task: for each test and permutation how many of its rows are dealt to the first group, and their sum."""
    marks = _mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    held: dict = {}
    for batch in batches:
        feature, group = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        value, mark = batch.column(2).to_numpy(), batch.column(3).to_numpy().view(np.uint64)
        of = {}
        for i, f in enumerate(zip(feature, group)):
            of.setdefault(f, []).append(i)
        for (f, g), rows in of.items():
            for low in range(0, len(rows), 64):
                some = np.array(rows[low : low + 64])
                for first in range(0, n, PERMUTATIONS):
                    drawn = _mixed(mark[some][:, None] ^ marks[first : first + PERMUTATIONS])
                    for test, share, middle in tests.get((f, g), ()):
                        mine = drawn < np.uint64(min(int(share * 2**64), 2**64 - 1))
                        counts, sums = held.setdefault(test, (np.zeros(n), np.zeros(n)))
                        counts[first : first + PERMUTATIONS] += mine.sum(0)
                        sums[first : first + PERMUTATIONS] += (value[some] - middle) @ mine
    for test, (counts, sums) in held.items():
        low = np.arange(0, n, PERMUTATIONS)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(low), test, np.int32)), pa.array((low // PERMUTATIONS).astype(np.int32)), *(pa.array([x[a : a + PERMUTATIONS].tolist() for a in low], pa.list_(pa.float64())) for x in (counts, sums))], names=["test", "block", "counts", "sums"])


def _extreme(batches, sizes: dict):
    """Blocks in order, from all tasks: how many permutations were defined, and how many as extreme as what was seen."""
    now, held = None, None

    def told():
        n, total, seen = sizes[now[0]]
        a = held[0]
        good = (a > 0) & (a < n)
        gap = np.abs(held[1][good] / a[good] - (total - held[1][good]) / (n - a[good]))
        return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([int(good.sum())]), pa.array([int((gap >= seen - 1e-12 * max(seen, 1)).sum())])], names=["test", "n", "c"])

    for batch in batches:
        for test, block, counts, sums in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if (test, block) != now:
                if now is not None:
                    yield told()
                now, held = (test, block), [np.zeros(len(counts)), np.zeros(len(counts))]
            held[0] += counts
            held[1] += sums
    if now is not None:
        yield told()


def permutation_whole(rows: DataFrame, key: str, n: int = 10_000, seed: int = 42) -> DataFrame:
    """feature, a, b, na, nb, difference of means and its two-sided permutation p, for groups of any size.

    In a permutation each row of a pair goes to the first group with probability na / (na + nb), by a hash of its ``key``
    and the permutation's number; so sizes vary, as they don't in ``permutation``, which holds a pair in one task. Tasks return the
    counts and sums of each permutation, and only these meet. p = (c + 1) / (m + 1) over the m permutations in which neither
    group is empty. key tells rows of a feature apart. Groups and features are few: n numbers of each pair travel.
    """
    spark = rows.sparkSession
    own = _known(rows.select("feature", F.col("group").cast("string").alias("group"), F.col("value").cast("double").alias("value"), F.col(key).alias("key"))).select("feature", "group", "value", F.xxhash64("key").alias("mark"))
    told = {(r.feature, r["group"]): (r.n, r.m) for r in own.groupBy("feature", "group").agg(F.count("*").alias("n"), F.avg("value").alias("m")).collect()}
    tests, sizes, names = {}, {}, []
    for f, a in sorted(told):
        for g, b in sorted(told):
            if f == g and a < b:
                (na, ma), (nb, mb), t = told[f, a], told[g, b], len(names)
                middle = (na * ma + nb * mb) / (na + nb)  # sums about the mean keep their digits
                for x in (a, b):
                    tests.setdefault((f, x), []).append((t, na / (na + nb), middle))
                sizes[t] = (na + nb, 0.0, abs(ma - mb))
                names.append((t, f, a, b, na, nb, ma - mb))
    kinds = "test int, feature string, a string, b string, na long, nb long, difference double"
    shared = spark.sparkContext.broadcast((tests, sizes))
    blocks = own.mapInArrow(lambda it: _dealt(it, shared.value[0], n, seed), "test int, block int, counts array<double>, sums array<double>")
    counts = blocks.repartition("test", "block").sortWithinPartitions("test", "block").mapInArrow(lambda it: _extreme(it, shared.value[1]), "test int, n long, c long")
    p = counts.groupBy("test").agg(((F.sum("c") + 1) / (F.sum("n") + 1)).alias("p"))
    return p.join(F.broadcast(spark.createDataFrame(names, kinds)), "test").select("feature", "a", "b", "na", "nb", "difference", "p")


def rough_p(t: Column, na: Column, nb: Column) -> Column:
    """p of z = t (1 - 1 / (4 df)), df the smaller group less one, by a rational approximation of erf."""
    df = F.least(na, nb) - 1
    z = F.abs(t * (1 - 1 / (4 * df))) / F.sqrt(F.lit(2.0))
    # fixed values: formula 7.1.26 of Abramowitz and Stegun
    k = 1 / (1 + 0.3275911 * z)
    poly = ((((1.061405429 * k - 1.453152027) * k + 1.421413741) * k - 0.284496736) * k + 0.254829592) * k
    return poly * F.exp(-z * z)


def _manova_f(roots: np.ndarray, p: int, q: int, v: float) -> list[tuple]:
    """(statistic, value, F, df of hypothesis, df of error) from the roots of E^-1 H: the usual F approximations (Rao; Pillai).

    p features, q degrees of freedom between and v within groups.
    """
    s, m, n = min(p, q), (abs(p - q) - 1) / 2, (v - p - 1) / 2
    wilks = float(np.prod(1 / (1 + roots)))
    t = math.sqrt((p * p * q * q - 4) / (p * p + q * q - 5)) if p * p + q * q > 5 else 1.0
    error = (v - (p - q + 1) / 2) * t - (p * q - 2) / 2
    share = wilks ** (1 / t)
    out = [("wilks", wilks, (1 - share) / share * error / (p * q) if share > 0 else math.inf, p * q, error)]
    pillai = float((roots / (1 + roots)).sum())
    d1, d2 = s * (2 * m + s + 1), s * (2 * n + s + 1)
    out.append(("pillai", pillai, d2 / d1 * pillai / (s - pillai) if pillai < s else math.inf, d1, d2))
    trace = float(roots.sum())
    if n > 1:
        b = (p + 2 * n) * (q + 2 * n) / (2 * (2 * n + 1) * (n - 1))
        d1, d2 = p * q, 4 + (p * q + 2) / (b - 1)
        f = d2 / d1 * trace / ((d2 - 2) / (2 * n))
    else:
        d1, d2 = s * (2 * m + s + 1), s * (s * n + 1)
        f = d2 / d1 / s * trace
    out.append(("hotelling_lawley", trace, f, d1, d2))
    most, r = float(roots.max()), max(p, q)
    return [*out, ("roy", most, (v - r + q) / r * most, r, v - r + q)]


def manova(rows: DataFrame, dims: list[str]) -> DataFrame:
    """Pillai, Wilks, Hotelling-Lawley and Roy over features of ``dims`` by group, each with F, its degrees of freedom and p.

    Features without spread are dropped, rows without group or with an unknown feature too; nothing is told of fewer than two
    groups or features, or too few rows. Sums and cross products are aggregated about the means; only groups * dims^2 numbers
    come to the driver.
    """
    spark, kind = rows.sparkSession, "statistic string, value double, f double, df_hyp double, df_err double, p double"
    own = rows.where(" and ".join(["`group` is not null", *(f"`{d}` is not null and not isnan(`{d}`)" for d in dims)])).select("group", *(F.col(d).cast("double").alias(d) for d in dims))
    middle = own.agg(*(F.avg(d).alias(d) for d in dims)).first()
    if any(middle[d] is None for d in dims):
        return spark.createDataFrame([], kind)
    own = own.withColumns({d: F.col(d) - middle[d] for d in dims})  # squares keep their digits
    cross = [(i, j) for i in range(len(dims)) for j in range(i, len(dims))]
    got = own.groupBy("group").agg(F.count("*").alias("n"), *(F.sum(d).alias(f"s{i}") for i, d in enumerate(dims)), *(F.sum(F.col(dims[i]) * F.col(dims[j])).alias(f"c{i}_{j}") for i, j in cross)).collect()
    n = np.array([r.n for r in got], float)
    s = np.array([[r[f"s{i}"] for i in range(len(dims))] for r in got], float)
    total = np.zeros((len(dims), len(dims)))
    for r in got:
        for i, j in cross:
            total[i, j] += r[f"c{i}_{j}"]
            total[j, i] = total[i, j]
    mean = s.sum(0) / n.sum()
    spread = np.sqrt(np.maximum(np.diag(total) / n.sum() - mean**2, 0)) > 1e-6
    p, q, v = int(spread.sum()), len(got) - 1, float(n.sum() - len(got))
    if p < 2 or q < 1 or v < p + 1:
        return spark.createDataFrame([], kind)
    between = (s.T / n) @ s - n.sum() * np.outer(mean, mean)
    within = total - (s.T / n) @ s
    h, e = between[np.ix_(spread, spread)], within[np.ix_(spread, spread)]
    roots = np.sort(np.maximum(np.real(np.linalg.eigvals(np.linalg.pinv(e) @ h)), 0))[::-1][: min(p, q)]
    told = [(name, x, f, float(d1), float(d2), special.f_upper(f, d1, d2) if math.isfinite(f) else 0.0) for name, x, f, d1, d2 in _manova_f(roots, p, q, v)]
    return spark.createDataFrame(told, kind)
