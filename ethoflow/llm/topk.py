"""Exact top-k by inner product with a pivot table, in blocks.

Vectors become integers floor(scale * x). A few rows serve as pivots, and every row's distances to all of them
are computed once and stored. Together with the norm, a row's distances to the first pivots determine its
apex over them (n-simplex projection; Connor et al., 2017): coordinates a(x) in the span of the pivots, and
the length r(x) of what lies outside. (|a(q) - a(x)|^2 + (r(q) - r(x))^2) is the largest lower bound of the squared
distance that follows from those distances, so a(q).a(x) + r(q) r(x) is the least upper bound of the inner product.

1. Each query's k-th best score is bounded from below by a search of a few blocks of rows, hashed, of fixed size.
2. Rows fall into the cell of their nearest pivot. A cell's centre, radius and longest remainder bound the score of
   all its rows: queries go only to the cells that can beat their bound, before anything is shuffled.
3. Blocks of queries meet blocks of a cell (a stated query set against all rows, in blocks). A query evaluates
   the rows of a block in the order of their bounds, until the next bound can't beat its k-th score.
4. Ranks come from a window by query, which Spark cuts to k rows on each side of the shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import BROADCAST_BYTES, key_groups, written

#: Pivots, queries and candidates of a block, rows of the seed. All are fixed, so a task holds the same at any input size.
PIVOTS, QUERY_BLOCK, BLOCK, SEED = 56, 8192, 8192, 4096
#: Queries whose bounds are held at once.
_PART = 256
#: Sums of products stay exact as doubles below this; beyond it they are summed as Python integers.
_EXACT = float(2**53)
_LONG = 2**63 - 1


def integers(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """(id, v array<double>) of the rows whose vector, and each of its components, is there and finite."""
    # doubles beyond 2^53 are whole: floor() would cut them to the range of a long
    whole = lambda x: F.when(F.abs(x) < _EXACT, F.floor(x).cast("double")).otherwise(x)
    v = F.transform(vec_col, lambda x: whole(x.cast("double") * scale))
    fit = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & F.coalesce(fit, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def matrix(column, width: int) -> np.ndarray:
    """Rows of a list column, short ones filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    sizes = np.diff(np.asarray(column.offsets))
    out = np.zeros((len(column), width))
    rows = np.repeat(np.arange(len(column)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Pivots:
    """Pivots, and what turns distances to them into coordinates over an orthonormal base of their span."""

    def __init__(self, rows: np.ndarray, shift: int = 0):
        #: vectors are divided by 2^shift, so that squares of large components stay finite
        self.shift = shift
        rows = np.ldexp(rows, -shift)
        # a pivot that (nearly) lies in the span of those before it tells nothing
        base: list[np.ndarray] = []
        chosen = []
        for i, p in enumerate(rows):
            rest = p.astype(float)
            for b in base * 2:
                rest = rest - (rest @ b) * b
            if np.linalg.norm(rest) > 1e-6 * (np.linalg.norm(p) + 1e-300):
                base.append(rest / np.linalg.norm(rest))
                chosen.append(i)
        width = rows.shape[1]
        self.rows = rows[chosen].reshape(-1, width)
        self.norms = (self.rows**2).sum(1)
        base_ = np.array(base).reshape(-1, width)
        # base = turn @ pivots
        self.turn = np.linalg.lstsq(self.rows.T, base_.T, rcond=None)[0].T if len(chosen) else np.zeros((0, 0))

    def squares(self, v: np.ndarray) -> np.ndarray:
        return (np.ldexp(v, -self.shift) ** 2).sum(1)

    def distances(self, v: np.ndarray) -> np.ndarray:
        v = np.ldexp(v, -self.shift)
        return np.sqrt(np.maximum((v**2).sum(1)[:, None] + self.norms - 2 * (v @ self.rows.T), 0))

    def apex(self, norms: np.ndarray, distances: np.ndarray) -> np.ndarray:
        """Coordinates, then the remainder's length, from squared norms and distances."""
        inner = (norms[:, None] + self.norms - distances**2) / 2
        a = inner @ self.turn.T
        # the remainder must not come out too short, so it gets what rounding can have taken
        most = np.maximum(norms, self.norms.max(initial=0))
        lost = 1e-13 * (most + most**1.5 * np.abs(self.turn).sum(1).max(initial=0))
        return np.concatenate([a, np.sqrt(np.maximum(norms - (a**2).sum(1), 0) + lost)[:, None]], axis=1)


def _slack(p: Pivots, norms: np.ndarray, q_norms: np.ndarray) -> float:
    """What rounding can add to a bound; distances are squared again, so errors go with the largest norm and the base change."""
    most = max(norms.max(initial=0), q_norms.max(initial=0), p.norms.max(initial=0)) + 1
    return float(1e-12 * most * (1 + np.abs(p.turn).sum(1).max(initial=0) * np.sqrt(most)) + 1e-6)


def _small(a: np.ndarray, b: np.ndarray) -> bool:
    with np.errstate(over="ignore"):
        return bool(np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(a.shape[-1], 1) < _EXACT)


def _products(q: np.ndarray, c: np.ndarray, small: bool) -> np.ndarray:
    """Inner products of one vector with rows: exact, and held to the range of a long."""
    if small:
        return (c @ q).astype(np.int64)
    ints = [int(x) for x in q]
    return np.array([max(-_LONG, min(_LONG, sum(a * int(b) for a, b in zip(ints, row)))) for row in c.tolist()], np.int64)


def _bounds(a: np.ndarray, b: np.ndarray, slack: float, shift: int) -> np.ndarray:
    """Upper bounds of inner products; scores are held to a long's range, and so are these from below."""
    top = a @ b.T + slack
    if shift:
        with np.errstate(over="ignore"):
            top = np.maximum(np.ldexp(top, 2 * shift), -float(_LONG))
    return top


def block_top(queries, q_ids, q_apex, least, cands, c_ids, c_apex, slack: float, k: int, shift: int = 0):
    """(query, candidate, score) of the k best of each query in a block of candidates, and how many were evaluated.

    Rows of scores below least[query] are left out: k rows elsewhere reach it.
    """
    out, evaluated, small = ([], [], []), 0, _small(queries, cands)
    for i in range(len(queries)):
        if i % _PART == 0:
            bounds = _bounds(q_apex[i : i + _PART], c_apex, slack, shift)
        bound, q = bounds[i % _PART], queries[i]
        left = np.flatnonzero(bound >= least[i])
        left = left[c_ids[left] != q_ids[i]]
        order = left[np.argsort(-bound[left], kind="stable")]
        best_s, best_c = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, step = 0, max(64, 2 * k)
        while at < len(order):
            if len(best_s) == k and bound[order[at]] < best_s[-1]:
                break  # nothing further can reach the k-th score
            part = order[at : at + step]
            evaluated += len(part)
            best_s = np.concatenate([best_s, _products(q, cands[part], small)])
            best_c = np.concatenate([best_c, c_ids[part]])
            top = np.lexsort((best_c, ~best_s))[:k]  # ~s falls as s grows, with no overflow
            best_s, best_c = best_s[top], best_c[top]
            at += step
            step = min(step * 2, 4096)
        out[0].append(np.full(len(best_s), q_ids[i]))
        out[1].append(best_c)
        out[2].append(best_s)
    none = np.zeros(0, np.int64)
    return [np.concatenate([*v, none]).astype(np.int64) for v in out], evaluated


def _table(batches, pivots: Pivots, width: int, cells: int):
    """id, v, size of v, distances to the pivots, number of the nearest of the first ``cells`` pivots."""
    for batch in batches:
        v = matrix(batch.column(1), width)
        d = pivots.distances(v)
        cell = d[:, :cells].argmin(1) if d.shape[1] else np.zeros(len(v), int)
        offsets = pa.array(np.arange(len(v) + 1) * d.shape[1], pa.int32())
        sizes = np.diff(np.asarray(batch.column(1).offsets))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes.astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(d.ravel())), pa.array(cell.astype(np.int32))], names=["id", "v", "w", "d", "cell"])


def _read(table, pivots: Pivots, width: int):
    v = matrix(table.column("v"), width)
    norms = pivots.squares(v)
    return table.column("id").to_numpy(), v, norms, pivots.apex(norms, matrix(table.column("d"), len(pivots.rows)))


def _cells(batches, pivots: Pivots, width: int):
    """For each (w, cell) in a task's batches: rows, sums of apexes, their bounding box and largest norm."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        _, _, norms, apex = _read(table, pivots, width)
        w, cell = table.column("w").to_numpy(), table.column("cell").to_numpy()
        rows = []
        for a, b in sorted(set(zip(w.tolist(), cell.tolist()))):
            own = apex[(w == a) & (cell == b)]
            rows.append((a, b, own.min(0).tolist(), own.max(0).tolist()))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64())))], names=["w", "cell", "low", "high"])


def _asked(batches, pivots: Pivots, width: int, seeds: dict, boxes: dict, slack: float, k: int):
    """Each query once for each cell that can hold one of its k best, with the least score that counts."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        ids, v, norms, apex = _read(table, pivots, width)
        sizes = table.column("w").to_numpy()
        take, cells, least = [], [], []
        for i in range(len(ids)):
            low = -np.inf
            if sizes[i] in seeds:
                s_ids, s_v = seeds[sizes[i]]
                scores = _products(v[i], s_v[s_ids != ids[i]], _small(v[i], s_v))
                if len(scores) >= k:
                    low = float(np.partition(scores, len(scores) - k)[len(scores) - k])
            if sizes[i] in boxes:
                names, lows, highs = boxes[sizes[i]]
                # the largest inner product with a point of the box, coordinate by coordinate; the remainder is never negative
                top = _bounds(np.maximum(lows * apex[i], highs * apex[i]), np.ones((1, lows.shape[1])), slack, pivots.shift)[:, 0]
                for j in np.flatnonzero(top >= low).tolist():
                    take.append(i)
                    cells.append(names[j])
                    least.append(low)
        rows = batch.take(pa.array(take, pa.int64()))
        yield pa.RecordBatch.from_arrays([rows.column(k) for k in range(4)] + [pa.array(cells, pa.int32()), pa.array(least, pa.float64())], names=["id", "v", "w", "d", "cell", "least"])


def _pairs(batches, pivots: Pivots, width: int, k: int):
    for _, table in key_groups(batches, ["w", "cell", "qb", "cb"]):
        probe = np.array(table.column("probe").to_pylist(), bool)
        if probe.any() and not probe.all():
            ids, v, norms, apex = _read(table, pivots, width)
            least = table.column("least").to_numpy()
            slack = _slack(pivots, norms[~probe], norms[probe])
            (q, c, s), _ = block_top(v[probe], ids[probe], apex[probe], least[probe], v[~probe], ids[~probe], apex[~probe], slack, k, pivots.shift)
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(c), pa.array(s)], names=["query_id", "vec_id", "score"])


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int = PIVOTS, query_block: int = QUERY_BLOCK, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query its k candidates of the highest inner product.

    Ties go to the smaller vec_id; a row is no candidate of the query with its own id. Vectors that are null
    or hold a null or non-finite component take no part; vectors of different lengths have no inner product, so a query
    meets those of its own length. A candidate id that repeats counts once for each row; a query id that
    repeats is searched once (its largest vector). Scores are exact; those outside the range of a long are held at its
    ends, where ties go by vec_id too. Empty vectors score 0 with one another.
    """
    spark = vectors.sparkSession
    plain = written(integers(vectors, id_col, vec_col, scale), "vectors")
    asking = written(integers(queries, id_col, vec_col, scale).groupBy("id").agg(F.max("v").alias("v")), "queries")
    largest = F.max(F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))).alias("top")
    told = plain.agg(F.max(F.size("v")).alias("width"), F.count("*").alias("n"), largest).first()
    if not told.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(told.width, 1)
    top = [told.top, asking.agg(largest).first().top or 0.0]
    shift = max(0, int(np.frexp(max(top))[1]) - 53)
    # the same few rows whatever the order of the table, as their ids are hashed
    few = max(pivots, min(seed, BROADCAST_BYTES // (8 * width)))
    sample = plain.orderBy(F.xxhash64("id"), "id", "v").limit(few).collect()
    values = lambda rows: matrix(pa.array([r.v for r in rows], pa.list_(pa.float64())), width)
    table = Pivots(values(sample[: min(pivots, width)]), shift)
    seeds = {}
    for w in {len(r.v) for r in sample}:
        same = [r for r in sample if len(r.v) == w]
        seeds[w] = (np.array([r.id for r in same]), values(same))
    kinds = "id long, v array<double>, w int, d array<double>, cell int"
    # cells hold a block of rows or more, else queries would be copied to many small ones
    cells = max(1, told.n // block)
    cands = written(plain.mapInArrow(lambda it: _table(it, table, width, cells), kinds), "pivots")
    own = asking.mapInArrow(lambda it: _table(it, table, width, cells), kinds)
    # one row for each length and cell; lengths are few, cells at most as many as pivots
    each = F.posexplode(F.arrays_zip("low", "high"))
    boxes = cands.mapInArrow(lambda it: _cells(it, table, width), "w int, cell int, low array<double>, high array<double>")
    boxes = boxes.select("w", "cell", each.alias("i", "x")).groupBy("w", "cell", "i").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high"))
    boxes = boxes.groupBy("w", "cell").agg(F.array_sort(F.collect_list(F.struct("i", "low", "high"))).alias("x")).collect()
    known = {w: ([r.cell for r in boxes if r.w == w], np.array([[x.low for x in r.x] for r in boxes if r.w == w]), np.array([[x.high for x in r.x] for r in boxes if r.w == w])) for w in {r.w for r in boxes}}
    slack = _slack(table, *(np.array([width * np.ldexp(x, -shift) ** 2]) for x in top))
    asks = written(own.select("id", "v", "w", "d").mapInArrow(lambda it: _asked(it, table, width, seeds, known, slack, k), kinds + ", least double"), "asks")
    # blocks of each cell
    held = cands.groupBy("w", "cell").count().select("w", "cell", F.ceil(F.col("count") / block).cast("int").alias("n_c"))
    wanted = asks.groupBy("w", "cell").count().select("w", "cell", F.ceil(F.col("count") / query_block).cast("int").alias("n_q"))
    grid = held.join(wanted, ["w", "cell"]).collect()  # a row for each length and cell
    pairs = sum(r.n_c * r.n_q for r in grid)
    place = F.broadcast(spark.createDataFrame(grid, "w int, cell int, n_c int, n_q int"))
    rows = cands.join(place, ["w", "cell"]).select("id", "v", "w", "d", "cell", F.lit(False).alias("probe"), F.lit(0.0).alias("least"), F.explode(F.sequence(F.lit(0), F.col("n_q") - 1)).alias("qb"), F.pmod(F.xxhash64("id", "v"), F.col("n_c")).cast("int").alias("cb"))
    ask = asks.join(place, ["w", "cell"]).select("id", "v", "w", "d", "cell", F.lit(True).alias("probe"), "least", F.pmod(F.xxhash64("id"), F.col("n_q")).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.col("n_c") - 1)).alias("cb"))
    key = ["w", "cell", "qb", "cb"]
    met = rows.unionByName(ask).repartition(max(1, min(pairs, 20_000)), *key).sortWithinPartitions(*key)
    near = met.mapInArrow(lambda it: _pairs(it, table, width, k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
