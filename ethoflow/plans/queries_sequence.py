"""Queries over motif labels, feature rows and sliding windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import motifs, sequence, windows
from . import adapters as A
from .queries_track import _r
from .registry import query

K = 5
DIMS = [f"d{i}" for i in range(A.DIMENSIONS)]
_L = f"{A.with_('f', 's')}, l AS (SELECT * FROM s WHERE label >= 0), b AS (SELECT *, lead(label, 1) OVER w AS j, lead(label, 2) OVER w AS c FROM l WINDOW w AS (PARTITION BY session_id ORDER BY frame_index)), n AS (SELECT session_id, label AS i, j, count(*) AS n FROM b WHERE j IS NOT NULL GROUP BY ALL), t AS (SELECT *, n / sum(n) OVER (PARTITION BY session_id, i) AS p FROM n)"


@query(f"{_L} SELECT session_id, i, j, n, round(p, 6) AS p FROM t")
def transitions(spark, sf):
    """AGG25."""
    return _r(sequence.transitions(A.labels(spark, sf)), "p", digits=6)


@query(f"{_L}, u AS (SELECT session_id, label, count(*) AS n FROM l GROUP BY ALL), g AS (SELECT session_id, label, coalesce(n, 0) AS n FROM (SELECT DISTINCT session_id FROM u) CROSS JOIN (SELECT unnest(range({K}))::INT AS label) LEFT JOIN u USING (session_id, label)) SELECT session_id, label, n, round(n / sum(n) OVER (PARTITION BY session_id), 6) AS usage FROM g")
def motif_usage(spark, sf):
    """AGG30."""
    return _r(sequence.usage(A.labels(spark, sf), K), "usage", digits=6)


@query(f"{_L}, lt AS (SELECT *, frame_index / 2e0 AS t_sec FROM l), {A.islands('lt', 'label')}, g AS (SELECT session_id, state AS label, avg(n / 2e0) AS m, stddev_pop(n / 2e0) AS sd, count(*) AS bouts FROM i GROUP BY ALL) SELECT session_id, label, round(m, 6) AS dwell_s, bouts, round(CASE WHEN m > 0 THEN sd / m ELSE 0 END, 5) AS dwell_cv FROM g")
def motif_dwell(spark, sf):
    """AGG29."""
    return _r(_r(sequence.dwell(A.labels(spark, sf), A.FPS), "dwell_s", digits=6), "dwell_cv", digits=5)


@query(f"{_L} SELECT session_id, round(coalesce(sum(p) FILTER (WHERE i = j), 0) / {K}, 6) AS self_rate FROM t GROUP BY session_id")
def self_transition_rate(spark, sf):
    """AGG28."""
    return _r(sequence.self_rate(A.labels(spark, sf), K), "self_rate", digits=6)


@query(f"{_L}, g AS (SELECT session_id, label AS a, j AS b, c, count(*) AS n, min(frame_index) AS fst FROM b WHERE c IS NOT NULL GROUP BY ALL), r AS (SELECT *, n / sum(n) OVER (PARTITION BY session_id) AS share, CAST(row_number() OVER (PARTITION BY session_id ORDER BY n DESC, fst) AS INT) AS rank FROM g) SELECT session_id, a, b, c, n, round(share, 6) AS share, rank FROM r WHERE rank <= 5")
def top_trigrams(spark, sf):
    """AGG31."""
    return _r(sequence.top_trigrams(A.labels(spark, sf)), "share", digits=6)


@query(f"""{_L}, l1 AS (SELECT session_id, sum(n * ln(p)) AS ll1 FROM t GROUP BY 1), g AS (SELECT session_id, label AS a, j AS b, c, count(*) AS n FROM b WHERE c IS NOT NULL GROUP BY ALL), g2 AS (SELECT *, n / sum(n) OVER (PARTITION BY session_id, a, b) AS p FROM g),
l2 AS (SELECT session_id, sum(n * ln(p)) AS ll2 FROM g2 GROUP BY 1), c0 AS (SELECT session_id, count(*) AS labels FROM l GROUP BY 1)
SELECT session_id, labels, round(ll1, 4) AS ll1, round(ll2, 4) AS ll2, CASE WHEN labels >= 30 AND 2 * (ll2 - ll1) / {K * K * (K - 1)}e0 > 3.84 THEN 2 ELSE 1 END AS markov_order FROM c0 LEFT JOIN l1 USING (session_id) LEFT JOIN l2 USING (session_id)""")
def markov_order(spark, sf):
    """AGG32, from 30 labels on."""
    return _r(sequence.markov_order(A.labels(spark, sf), K, least=30), "ll1", "ll2")


@query()
def stationary_distribution(spark, sf):
    """AGG26, AGG27."""
    own = sequence.stationary(A.labels(spark, sf), K)
    return _r(own.select("session_id", F.transform("pi", lambda x: F.round(x, 8)).alias("pi"), "entropy", "entropy_normalized"), "entropy", "entropy_normalized", digits=8)


@query()
def sequence_profile(spark, sf):
    """AGG33: profile with zeros for short sequences."""
    return _r(sequence.profile(A.labels(spark, sf), K, A.FPS), "self_rate", "entropy", "entropy_normalized", digits=8)


_WIN = f"""{A.with_('e')}, w0 AS (SELECT e.*, unnest(range(CAST(greatest(0, ceil((frame_index - 19) / 5e0)) AS BIGINT), frame_index // 5 + 1)) * 5 AS window_start, max(frame_index) OVER (PARTITION BY session_id) AS last FROM e),
w AS (SELECT session_id, window_start, count(*) FILTER (WHERE valid) AS n_valid, {', '.join(f"{f}({d}) AS {n}_{d}" for d in DIMS for n, f in (('mean', 'avg'), ('std', 'stddev_pop')))} FROM w0 WHERE window_start + 19 <= last GROUP BY ALL)"""


@query(f"{_WIN} SELECT session_id, window_start, n_valid, n_valid >= 2 AND 20 - n_valid <= 5 AS valid, {', '.join(f'round({n}_{d}, 5) AS {n}_{d}' for d in DIMS for n in ('mean', 'std'))} FROM w")
def sliding_windows(spark, sf):
    """WIN9, WIN10."""
    return _r(windows.sliding(A.features(spark, sf), DIMS), *(f"{n}_{d}" for d in DIMS for n in ("mean", "std")), digits=5)


@query(f"""{_WIN}, v AS (SELECT session_id, window_start, CAST((window_start // 5) % 3 AS INT) AS label FROM w WHERE n_valid >= 2 AND 20 - n_valid <= 5)
SELECT e.session_id, e.frame_index, coalesce(arg_max(v.label, v.window_start), -1) AS label FROM e LEFT JOIN v ON v.session_id = e.session_id AND v.window_start <= e.frame_index AND e.frame_index < v.window_start + 20 GROUP BY ALL""")
def frame_labels(spark, sf):
    """JN14: label of the latest valid window over each frame."""
    f = A.features(spark, sf)
    w = windows.sliding(f, DIMS).withColumn("label", F.expr("cast((window_start div 5) % 3 as int)"))
    return windows.frame_labels(f, w)


@query(f"{A.with_('e')}, l AS (UNPIVOT (SELECT session_id, {', '.join(DIMS)} FROM e) ON {', '.join(DIMS)} INTO NAME dim VALUE v) SELECT session_id, dim, round(greatest(1e-6, quantile_cont(v, 0.95)), 6) AS p95 FROM l GROUP BY ALL")
def p95_scale(spark, sf):
    """AGG23: every dimension of each session."""
    own = A.features(spark, sf).unpivot(["session_id"], DIMS, "dim", "v")
    return _r(windows.p95(own, "v", ("session_id", "dim")), "p95", digits=6)


@query(f"{A.with_('e')}, m AS (SELECT {', '.join(f'median({d}) AS m{d}' for d in DIMS)} FROM e) SELECT session_id, frame_index, {', '.join(f'round(coalesce({d}, m{d}), 6) AS {d}' for d in DIMS)} FROM e CROSS JOIN m")
def median_imputation(spark, sf):
    """AGG24."""
    return _r(windows.median_filled(A.features(spark, sf), DIMS).select("session_id", "frame_index", *DIMS), *DIMS, digits=6)


@query(f"{A.with_('e')}, m AS (SELECT {', '.join(f'avg({d}) AS m{d}, stddev_pop({d}) AS s{d}' for d in DIMS)} FROM e WHERE valid) SELECT session_id, frame_index, {', '.join(f'round(({d} - m{d}) / s{d}, 5) AS {d}' for d in DIMS)} FROM e CROSS JOIN m WHERE valid")
def standard_scaling(spark, sf):
    """ML1: population deviation."""
    own = A.features(spark, sf).where("valid")
    return _r(windows.standardized(own, DIMS).select("session_id", "frame_index", *DIMS), *DIMS, digits=5)


_CENTRES = [[(-1) ** (i + j) * (j + 1) / 100 for j in range(A.DIMENSIONS)] for i in range(2)] + [[((j * 7) % 11 - 5) / 20 for j in range(A.DIMENSIONS)]]
_D2 = lambda c: " + ".join(f"({d} - ({v}e0)) * ({d} - ({v}e0))" for d, v in zip(DIMS, c))


@query(f"{A.with_('e')}, q AS (SELECT *, [{', '.join(_D2(c) for c in _CENTRES)}] AS q FROM e WHERE valid) SELECT session_id, frame_index, CAST(list_position(q, list_min(q)) - 1 AS INT) AS label FROM q")
def nearest_centroid(spark, sf):
    """JN13."""
    return windows.nearest_centroid(A.features(spark, sf).where("valid"), DIMS, _CENTRES).select("session_id", "frame_index", "label")


_FILLED = lambda d: f"round(CASE WHEN g.valid THEN g.{d} WHEN b - a - 1 <= 5 THEN p.{d} + (g.frame_index - a) * (q.{d} - p.{d}) / (b - a) END, 5) AS {d}"


@query(f"""{A.with_('e')}, g AS (SELECT *, max(CASE WHEN valid THEN frame_index END) OVER (PARTITION BY session_id ORDER BY frame_index) AS a, min(CASE WHEN valid THEN frame_index END) OVER (PARTITION BY session_id ORDER BY frame_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM e)
SELECT g.session_id, g.frame_index, g.valid OR coalesce(b - a - 1 <= 5, FALSE) AS valid, {', '.join(map(_FILLED, DIMS))}
FROM g LEFT JOIN e p ON p.session_id = g.session_id AND p.frame_index = a LEFT JOIN e q ON q.session_id = g.session_id AND q.frame_index = b""")
def feature_imputation(spark, sf):
    """WIN8."""
    own = windows.imputed(A.features(spark, sf), DIMS).select("session_id", "frame_index", F.coalesce("valid", F.lit(False)).alias("valid"), *DIMS)
    return _r(own, *DIMS, digits=5)


@query(f"{A.with_('e')} SELECT session_id, round(avg(valid::INT), 6) AS valid_fraction, avg(valid::INT) < 0.2 AS warning FROM e GROUP BY 1")
def valid_share(spark, sf):
    """AGG22."""
    return _r(windows.valid_share(A.features(spark, sf)), "valid_fraction", digits=6)


@query()
def motif_discovery(spark, sf):
    """ML1-ML6: scaling, PCA, k-means sweep, choice of k and bootstrap stability over windows; labels by window."""
    from pyspark.ml.feature import VectorAssembler

    names = [f"{n}_{d}" for d in DIMS for n in ("mean", "std")]
    w = windows.sliding(A.features(spark, sf), DIMS).where("valid").select("session_id", "window_start", *names)
    v = VectorAssembler(inputCols=names, outputCol="features").transform(w).select("session_id", "window_start", "features")
    labelled, k, _ = motifs.discover(v)
    return labelled.select("session_id", "window_start", "label", F.lit(k).alias("k"), F.lit(motifs.stability(labelled, k)).alias("stability"))
