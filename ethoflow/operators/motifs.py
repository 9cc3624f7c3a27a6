"""Motif discovery: scaling, PCA, k-means over a sweep of k, choice of k, stability, classification.

All k-means fits of a sweep (each k, each start, each bootstrap draw) take their steps together: the centres of all fits go to
the tasks, one scan of the windows returns the sums of every cluster of every fit, and fits that stand still leave the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .recursive import assign_optimal

#: Steps of one k-means fit, and the share of the mean variance below which centres count as standing still.
MOST_STEPS, STILL = 300, 1e-4
#: Windows of a matrix product (a row of it has a number for each cluster of each fit), and of a task where there are many.
ROWS, WINDOWS = 2048, 16_000


def scaled(rows: DataFrame, column: str = "features") -> DataFrame:
    """Zero mean, unit population deviation. The library divides by the sample deviation, so a factor follows."""
    n = rows.count()
    model = StandardScaler(inputCol=column, outputCol="_s", withMean=True, withStd=True).fit(rows)
    from pyspark.ml.feature import ElementwiseProduct
    from pyspark.ml.linalg import Vectors

    k = float(np.sqrt(n / max(n - 1, 1)))
    out = model.transform(rows)
    return ElementwiseProduct(scalingVec=Vectors.dense([k] * len(model.mean)), inputCol="_s", outputCol="scaled").transform(out).drop("_s")


def reduced(rows: DataFrame, most: int = 15, column: str = "scaled") -> DataFrame:
    k = min(most, rows.select(column).first()[0].size)
    return PCA(k=k, inputCol=column, outputCol="pca").fit(rows).transform(rows)


@dataclass
class Fit:
    """A k-means fit: of the windows in draw ``bag`` (-1: all)."""

    k: int
    seed: int
    bag: int = -1
    centres: np.ndarray | None = None
    cost: float = np.inf


def _points(rows: DataFrame, bags=None) -> DataFrame:
    return rows.select(vector_to_array("pca").alias("p"), (F.lit(0) if bags is None else bags).cast("long").alias("bags"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _sums(batches, fits: list[tuple[int, np.ndarray]]):
    """One task: n, cost and sums of each cluster of each fit.

    The centres of all fits of a draw stand in one matrix, so that some rows take two matrix products for all of them: one for
    the distances and one, with a 1 at each fit's nearest centre, for the sums.
    """
    held, of = None, {}
    for i, (bag, centres) in enumerate(fits):
        of.setdefault(bag, []).append((i, centres))
    stacked = {bag: np.concatenate([c for _, c in own]) for bag, own in of.items()}
    sizes = {bag: (c**2).sum(1) for bag, c in stacked.items()}
    for batch in batches:
        if not batch.num_rows:
            continue
        x, bags = _matrix(batch.column(0)), batch.column(1).to_numpy()
        if held is None:
            held = [np.zeros((len(c), x.shape[1] + 2)) for _, c in fits]
        for bag, own in of.items():
            seen = x if bag < 0 else x[(bags >> bag) & 1 == 1]
            for low in range(0, len(seen), ROWS):
                some = seen[low : low + ROWS]
                at, square = np.arange(len(some)), (some**2).sum(1)
                d = sizes[bag] - 2 * (some @ stacked[bag].T)
                chosen, first = np.zeros_like(d), 0
                for i, centres in own:
                    near = d[:, first : first + len(centres)].argmin(1)
                    cost = np.maximum(d[at, first + near] + square, 0)
                    chosen[at, first + near] = 1
                    held[i][:, 0] += np.bincount(near, minlength=len(centres))
                    held[i][:, 1] += np.bincount(near, cost, minlength=len(centres))
                    first += len(centres)
                sums, first = chosen.T @ some, 0
                for i, centres in own:
                    held[i][:, 2:] += sums[first : first + len(centres)]
                    first += len(centres)
    if held:  # one batch for all clusters of all fits
        fit = np.repeat(np.arange(len(fits), dtype=np.int32), [len(t) for t in held])
        cluster = np.concatenate([np.arange(len(t), dtype=np.int32) for t in held])
        total = np.concatenate(held)
        yield pa.RecordBatch.from_arrays([pa.array(fit), pa.array(cluster), *(pa.array(np.ascontiguousarray(c)) for c in total.T)], names=["fit", "cluster", "n", "cost", *(f"s{j}" for j in range(total.shape[1] - 2))])


def _tasks(points: DataFrame, n: int) -> int:
    """A task returns a row for each cluster of each fit, about a thousand, so it should see many more windows than that, but no
    core should wait: two tasks a core of a thousand windows or more, or tasks of WINDOWS."""
    return max(min(1 + n // 1000, 2 * points.sparkSession.sparkContext.defaultParallelism), 1 + n // WINDOWS)


def _scan(points: DataFrame, fits: list[Fit], d: int) -> list[np.ndarray]:
    """For each fit a row for each cluster: n, cost and the sums of its windows."""
    shared = points.sparkSession.sparkContext.broadcast([(f.bag, f.centres) for f in fits])
    names = ["n", "cost", *(f"s{j}" for j in range(d))]
    told = points.mapInArrow(lambda it: _sums(it, shared.value), "fit int, cluster int, " + ", ".join(f"{c} double" for c in names))
    out = [np.zeros((f.k, d + 2)) for f in fits]
    for r in told.groupBy("fit", "cluster").agg(*(F.sum(c).alias(c) for c in names)).collect():  # clusters of all fits
        out[r.fit][r.cluster] = [r[c] for c in names]
    shared.destroy()
    return out


def _spread(some: np.ndarray, k: int, seed: int) -> np.ndarray:
    """First centres by k-means++ (Arthur and Vassilvitskii, 2007), each the best of a few draws."""
    draw, tries = np.random.default_rng(seed), 2 + int(np.log(k))
    at = [int(draw.integers(len(some)))]
    d = ((some - some[at[0]]) ** 2).sum(1)
    while len(at) < k:
        total = d.sum()
        tried = np.searchsorted(np.cumsum(d), draw.random(tries) * total, side="right").clip(0, len(some) - 1) if total > 0 else draw.integers(0, len(some), tries)
        left = [np.minimum(d, ((some - some[i]) ** 2).sum(1)) for i in tried]
        best = int(np.argmin([x.sum() for x in left]))
        at.append(int(tried[best]))
        d = left[best]
    return some[at].copy()


def kmeans(points: DataFrame, fits: list[Fit], some: np.ndarray, bags: np.ndarray | None = None) -> list[Fit]:
    """The fits with centres and cost, over points(p array, bags long); ``some`` is a bounded sample of p that the first centres come from.

    A fit of draw j sees the windows whose bit j of bags is set. A cluster that loses all its windows keeps its centre.
    """
    d = some.shape[1]
    for f in fits:
        own = some if f.bag < 0 or bags is None else some[(bags >> f.bag) & 1 == 1]
        f.centres = _spread(own if len(own) >= f.k else some, f.k, f.seed)
    still = STILL * float(some.var(0).mean())
    moving = list(fits)
    for _ in range(MOST_STEPS):
        if not moving:
            break
        left = []
        for f, total in zip(moving, _scan(points, moving, d)):
            f.cost = float(total[:, 1].sum())
            now = np.where(total[:, :1] > 0, total[:, 2:] / np.maximum(total[:, :1], 1), f.centres)
            shift = float(((now - f.centres) ** 2).sum())
            f.centres = now
            if shift > still:
                left.append(f)
        moving = left
    for f, total in zip(fits, _scan(points, fits, d)):
        f.cost = float(total[:, 1].sum())
    return fits


def _best(fits: list[Fit], of) -> dict:
    out: dict = {}
    for f in fits:
        if of(f) not in out or f.cost < out[of(f)].cost:
            out[of(f)] = f
    return out


def nearest(centres: np.ndarray):
    """The number of the nearest centre to the vector pca; ties go to the first."""
    d = [F.aggregate(F.zip_with(vector_to_array("pca"), F.array(*map(F.lit, c.tolist())), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x) for c in centres]
    return (F.array_position(F.array(*d), F.array_min(F.array(*d))) - 1).cast("int")


def silhouette(points: np.ndarray, labels: np.ndarray, block: int = 256) -> float:
    """Mean Euclidean silhouette of a bounded sample, some rows of distances at a time."""
    kinds, own = np.unique(labels, return_inverse=True)
    if len(kinds) < 2:
        return 0.0
    of = np.eye(len(kinds))[own]
    n, sizes, total = of.sum(0), (points**2).sum(1), 0.0
    for low in range(0, len(points), block):
        some, mine = points[low : low + block], own[low : low + block]
        at = np.arange(len(some))
        d = np.sqrt(np.maximum((some**2).sum(1)[:, None] + sizes - 2 * some @ points.T, 0))
        d[at, low + at] = 0
        sums = d @ of
        a = sums[at, mine] / np.maximum(n[mine] - 1, 1)
        other = sums / n
        other[at, mine] = np.inf
        b = other.min(1)
        total += float(np.where(n[mine] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-12), 0).sum())
    return total / len(points)


def choose_k(ks: list[int], scores: list[float], costs: list[float], flat: float = 0.05) -> int:
    """The k of the best silhouette, or the first inner k up to it whose drop of cost is below a share of the whole drop."""
    best = ks[int(np.argmax(scores))]
    span = costs[0] - costs[-1]
    for i in range(1, len(ks) - 1):
        if span > 0 and (costs[i - 1] - costs[i]) / span < flat and ks[i] <= best:
            return ks[i]
    return best


def _keys(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c not in ("features", "scaled", "pca", "label")]


def discover(windows: DataFrame, most_k: int = 20, starts: int = 5, sample: int = 5000, seed: int = 42, last_starts: int = 20):
    """(labelled windows, k, sweep): sweep rows are (k, cost, silhouette). Needs ten windows with vectors in ``features``.

    First centres and the silhouette come from a bounded sample of ``sample`` windows, chosen by hash. The chosen k is fitted
    again with ``last_starts`` starts, and labels are of that fit.
    """
    n = windows.count()
    if n < 10:
        raise ValueError(f"ten valid windows are needed, there are {n}")
    reduced_ = reduced(scaled(windows))
    some = _sample(reduced_, windows, sample)
    points = _points(reduced_).repartition(_tasks(reduced_, n)).persist()  # dozens of scans follow: no tasks of a few rows
    try:
        ks = range(2, min(most_k, n // 5) + 1)
        best = _best(kmeans(points, [Fit(k, seed + i) for k in ks for i in range(starts)], some), lambda f: f.k)
        sweep = [(k, f.cost, silhouette(some, ((some[:, None] - f.centres) ** 2).sum(2).argmin(1))) for k, f in best.items()]
        k = choose_k([x[0] for x in sweep], [x[2] for x in sweep], [x[1] for x in sweep])
        last = _best(kmeans(points, [Fit(k, seed + i) for i in range(last_starts)], some), lambda f: f.k)[k]
    finally:
        points.unpersist()
    return reduced_.withColumn("label", nearest(last.centres)), k, sweep


def _sample(rows: DataFrame, keyed: DataFrame, n: int) -> np.ndarray:
    own = rows.orderBy(F.xxhash64(*_keys(keyed)), *_keys(keyed)).limit(n).select(vector_to_array("pca").alias("p")).toArrow()
    return np.array(own.column("p").to_pylist())


def stability(labelled: DataFrame, k: int, times: int = 10, share: float = 0.8, starts: int = 5, seed: int = 42, sample: int = 5000) -> float:
    """Mean agreement of ``label`` with k-means of a share of the windows, on the others; ``times`` draws by hash.

    Needs the columns of ``discover``; at most 62 draws. A draw that leaves fewer than two windows is left out; 0 without draws.
    """
    keys = _keys(labelled)
    drawn = [F.pmod(F.xxhash64(*keys, F.lit(seed + i)), F.lit(1_000_000)) < int(share * 1_000_000) for i in range(times)]
    bags = sum((F.when(c, F.lit(1 << i)).otherwise(0) for i, c in enumerate(drawn)), F.lit(0).cast("long"))
    rows = labelled.select(*keys, "pca", F.col("label").alias("was"), bags.alias("bags"))
    n = rows.count()
    first = rows.orderBy(F.xxhash64(*keys), *keys).limit(sample).select(vector_to_array("pca").alias("p"), "bags").toArrow()
    some, its = np.array(first.column("p").to_pylist()), first.column("bags").to_numpy()
    points = _points(rows, F.col("bags")).repartition(_tasks(rows, n)).persist()
    try:
        best = _best(kmeans(points, [Fit(k, seed + i, b) for b in range(times) for i in range(starts)], some, its), lambda f: f.bag)
    finally:
        points.unpersist()
    each = F.array(*(F.struct(F.lit(b).alias("draw"), nearest(f.centres).alias("label"), (F.shiftright("bags", b).bitwiseAND(F.lit(1).cast("long")) == 0).alias("held")) for b, f in best.items()))
    counts = rows.select("was", F.inline(each)).where("held").groupBy("draw", "was", "label").count().collect()  # times * k * k at most
    got = []
    for b in best:
        own = [(r.was, r.label, r["count"]) for r in counts if r.draw == b]
        if sum(c for *_, c in own) >= 2:
            got.append(_matched(own))
    return float(np.mean(got)) if got else 0.0


def _matched(counts: list[tuple]) -> float:
    """Of counts (a, b, n): the share in which a and b agree under the best matching of their values."""
    ka, kb = sorted({c[0] for c in counts}), sorted({c[1] for c in counts})
    table = np.zeros((len(ka), len(kb)))
    for a, b, n in counts:
        table[ka.index(a), kb.index(b)] = n
    match = assign_optimal(table.max() - table)
    return float(sum(table[i, j] for i, j in enumerate(match) if 0 <= j < len(kb)) / table.sum())


def agreement(labels: DataFrame, a: str, b: str) -> float:
    """Share of rows on which two labelings agree under the best matching of their labels."""
    return _matched([(r[a], r[b], r["count"]) for r in labels.groupBy(a, b).count().collect()])  # k * k at most


def classification_metrics(rows: DataFrame, buckets: int = 256) -> DataFrame:
    """From (y, pred, score), y and pred 0 or 1: balanced accuracy, sensitivity, specificity and AUC by rank.

    Rows are counted by score; ranks are cumulative counts of buckets of scores, then of the scores of a bucket,
    so no task orders all scores. Only ``buckets`` cut points come to the driver. Rows without y or score are left out.
    """
    from pyspark.sql import Window

    count = lambda c, name: F.count_if(F.expr(c)).alias(name)
    own = rows.where("y is not null and score is not null")
    per = own.groupBy("score").agg(count("y = 1", "pos"), count("y = 0", "neg"), count("y = 1 and pred = 1", "tp"), count("y = 0 and pred = 0", "tn"), F.count("*").alias("n"))
    cuts = own.agg(F.percentile_approx("score", [i / buckets for i in range(1, buckets)], 10_000)).first()[0] or []
    marks = F.array(*(F.lit(float(c)) for c in sorted(set(cuts)))).cast("array<double>")
    per = per.withColumn("b", F.size(F.filter(marks, lambda c: c <= F.col("score"))))
    lower = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # one row for each bucket
    before = per.groupBy("b").agg(F.sum("n").alias("_n")).select("b", F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("before"))
    inside = Window.partitionBy("b").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    ranked = per.join(F.broadcast(before), "b").withColumn("r", F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0)) + (F.col("n") + 1) / 2.0)
    s = ranked.agg(*(F.sum(c).alias(c) for c in ("tp", "tn", "pos", "neg")), F.sum(F.col("pos") * F.col("r")).alias("rp"))
    sens, spec = F.try_divide("tp", "pos"), F.try_divide("tn", "neg")
    auc = F.try_divide(F.col("rp") - F.col("pos") * (F.col("pos") + 1) / 2, F.col("pos") * F.col("neg"))
    return s.select("tp", "tn", "pos", "neg", sens.alias("sensitivity"), spec.alias("specificity"), ((sens + spec) / 2).alias("balanced_accuracy"), auc.alias("auc"))
