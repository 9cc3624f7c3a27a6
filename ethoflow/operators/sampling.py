"""Samples drawn by a hash of the keys, so a lost task draws the same rows again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def _draw(seed: int, keys: list[str]) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def subsample(rows: DataFrame, n: int, keys: list[str], seed: int = 42) -> DataFrame:
    """Exactly n rows without replacement (all, if fewer), in the order of their keys."""
    return rows.withColumn("_h", _draw(seed, keys)).orderBy("_h", *keys).limit(n).drop("_h").orderBy(*keys)


def stratified(rows: DataFrame, n: int, strata: list[str], keys: list[str], seed: int = 42) -> DataFrame:
    """n rows, dealt evenly to strata (the first ones by name take the remainder) and topped up from all other rows.

    Every stratum has a quota of one at least, while n lasts. No stratum can give more than n rows, so ranks stop at n
    before rows meet; a null stratum is one of its own.
    """
    w = Window.partitionBy(*strata).orderBy("_h", *keys)
    own = rows.withColumn("_h", _draw(seed, keys)).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    # a row for each stratum: few by nature
    every = rows.select(*(F.col(s).alias(f"_{s}") for s in strata)).distinct()
    every = every.withColumns({"_i": F.row_number().over(Window.orderBy(*(f"_{s}" for s in strata))), "_k": F.count("*").over(Window.partitionBy(F.lit(0)))})
    each = F.greatest(F.lit(1), F.floor(F.lit(n) / F.col("_k")).cast("int"))
    every = every.withColumn("_q", each + (F.col("_i") <= F.lit(n) - each * F.col("_k")).cast("int"))
    same = [F.col(s).eqNullSafe(F.col(f"_{s}")) for s in strata]
    dealt = own.join(every, same).withColumn("_more", ~((F.col("_r") <= F.col("_q")) & (F.col("_i") <= n)))
    return dealt.orderBy("_more", "_h", *keys).limit(n).select(*rows.columns)


def bagged(rows: DataFrame, keys: list[str], round_: Column, share: float = 0.8, seed: int = 42) -> DataFrame:
    """Adds in_bag, about ``share`` of the rows of a round; the others are held out."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), round_.cast("string"), *(F.col(k).cast("string") for k in keys)))
    return rows.withColumn("in_bag", F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / 4294967296.0 < share)


def _unlike(rows: DataFrame, marks: list[int], distance: int) -> DataFrame:
    """Rows whose mark differs from each of these few marks in ``distance`` bits or more."""
    if not marks:
        return rows
    taken = F.array(*(F.lit(m).cast("long") for m in marks))
    return rows.where(F.forall(taken, lambda m: F.bit_count(m.bitwiseXOR(F.col("_mark"))) >= distance))


def diverse(rows: DataFrame, n: int, strata: list[str], keys: list[str], mark: str, distance: int = 10, seed: int = 42) -> DataFrame:
    """n rows of which no two are near duplicates: their 64-bit marks differ in ``distance`` bits or more.

    The plain loop this equals: strata in order of their names (nulls first) have a quota of n div strata (one at least, the first
    ones take the remainder); each takes its rows in the order of a hash, passing over those too like any row taken so far;
    then all rows are gone through once more, in another hash order, until n are taken. Rows without mark are left out; a mark is a
    long, such as the difference hash of a frame. Returns rows and ``picked``, the order in which they were taken.

    Here each round drops all rows that are too like the ones taken, in one pass, and only the first of what is left
    come to the driver, some n at a time; it goes through them in order and starts the next round where they end.
    """
    spark = rows.sparkSession
    own = rows.where(F.col(mark).isNotNull()).select(*strata, *keys, F.col(mark).cast("long").alias("_mark")).withColumns({"_h": _draw(seed, keys), "_g": _draw(seed + 1, keys)})
    stratum = F.struct(*strata)
    every = own.select(*strata).distinct()
    k = every.count()
    each = max(1, n // k) if k else 0
    # with more strata than n no quota is above one, and no stratum has to be known by number
    more = {tuple(r) for r in every.orderBy(stratum).limit(max(n - each * k, 0)).collect()}
    taken: list[tuple] = []
    marks: list[int] = []
    kinds = dict(own.dtypes)

    def near(m: int) -> bool:
        return any(((m ^ x) & (2**64 - 1)).bit_count() < distance for x in marks)

    def literal(names, values):
        return F.struct(*(F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(names, values)))

    # the loop stands in stratum ``now``, which has ``have`` rows so far, behind the hash ``after``
    now, have, after, open_ = None, 0, None, k > 0
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy("_h", *keys))
    while open_ and len(taken) < n:
        left = _unlike(own, marks, distance)
        if now is not None:
            here = literal(strata, now)
            left = left.where((stratum > here) | ((stratum == here) & (F.col("_h") > after)))
        deep, wide = 2 * (each + 1), 2 * n + each + 1
        some = left.withColumn("_r", rank).where(F.col("_r") <= deep).orderBy(stratum, "_r").limit(wide).collect()
        open_ = len(some) == wide
        for i, r in enumerate(some):
            s = tuple(r[c] for c in strata)
            if s != now:
                now, have = s, 0
            quota, after = each + (s in more), r["_h"]
            if have < quota and len(taken) < n and not near(r["_mark"]):
                taken.append((*s, *(r[c] for c in keys)))
                marks.append(r["_mark"])
                have += 1
            ends = i + 1 == len(some) or tuple(some[i + 1][c] for c in strata) != s
            if ends and have < quota and r["_r"] == deep:
                open_ = True  # this stratum needs more of its rows before others go on
                break
    held = set(taken)
    after = None
    while len(taken) < n:
        left = _unlike(own, marks, distance)
        if after is not None:
            left = left.where(F.struct("_g", *keys) > literal(["_g", *keys], after))
        some = left.orderBy("_g", *keys).limit(2 * n).collect()
        for r in some:
            row = (*(r[c] for c in strata), *(r[c] for c in keys))
            if len(taken) < n and row not in held and not near(r._mark):
                taken.append(row)
                held.add(row)
                marks.append(r._mark)
        if len(some) < 2 * n:
            break
        after = tuple(some[-1][c] for c in ("_g", *keys))
    names = [*strata, *keys]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", picked int"
    picks = spark.createDataFrame([(*t, i) for i, t in enumerate(taken)], schema).withColumnsRenamed({c: f"_{c}" for c in names})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names]
    return rows.join(F.broadcast(picks), same).drop(*(f"_{c}" for c in names))

