import numpy as np
import pyarrow as pa

from ethoflow.llm.queries import ORACLES, QUERIES
from ethoflow.llm.topk import Pivots, _asked, _cells, _slack, _table, block_top, exact_top_k
from tests.oracle import compare


def brute(rows, k):
    ok = [(i, np.floor(64 * np.array(v, float))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % 20 == 0:
            best = sorted((-int(a @ b), c) for c, b in ok if c != q)[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    return sorted(out)


def test_against_brute_force(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.normal(size=8)]) for i in range(400)] + [(400 + i, [0.5] * 8) for i in range(60)]
    rows += [(500, None), (520, [1.0] * 7 + [None]), (540, [1.0] * 7 + [float("nan")]), (560, [float("inf")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, id int")
    got = exact_top_k(df, df.where("vec_id % 20 = 0"), k=7, pivots=5, query_block=6, block=50)
    assert sorted(map(tuple, got.collect())) == brute(rows, 7)
    few = df.where("vec_id < 3")
    assert sorted(map(tuple, exact_top_k(few, few.where("vec_id = 0")).collect())) == brute([x for x in rows if x[0] in (0, 1, 2)], 20)
    assert exact_top_k(df.limit(0), df).collect() == []


def _evaluated(c, q, k, pivots):
    p = Pivots(c[100 : 100 + pivots])
    n, m = (c**2).sum(1), (q**2).sum(1)
    c_apex, q_apex = p.apex(n, p.distances(c)), p.apex(m, p.distances(q))
    (_, _, s), evaluated = block_top(q, np.arange(len(q)), q_apex, np.full(len(q), -np.inf), c, np.arange(len(c)), c_apex, _slack(p, n, m), k)
    full = q @ c.T
    full[np.arange(len(q)), np.arange(len(q))] = -np.inf
    assert (s.reshape(len(q), k) == -np.sort(-full, axis=1)[:, :k]).all()
    return evaluated / (len(q) * len(c))


def test_bounds_save_work():
    r = np.random.default_rng(2)
    centres = r.normal(size=(40, 8)) * 300
    c = np.floor(centres[r.integers(0, 40, 8000)] + r.normal(size=(8000, 8)) * 5)
    assert _evaluated(c, c[:20], 10, 6) < 0.05
    # unit vectors of no structure, as the stored ones
    c = r.normal(size=(8000, 64))
    c = np.floor(64 * c / np.linalg.norm(c, axis=1)[:, None])
    assert _evaluated(c, c[:50], 20, 56) < 0.2


def test_cells_are_dropped():
    r = np.random.default_rng(3)
    c = np.floor(np.concatenate([r.normal(size=(50, 6)) + d for d in 400 * np.eye(6)]) * 4)
    p = Pivots(c[[0, 50, 100, 150, 200, 250]])
    n = (c**2).sum(1)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(300)), pa.array(c.tolist(), pa.list_(pa.float64()))], names=["id", "v"])
    table = next(_table([batch], p, 6, 6))
    cells = next(_cells([table], p, 6)).to_pylist()
    boxes = {6: ([x["cell"] for x in cells], np.array([x["low"] for x in cells]), np.array([x["high"] for x in cells]))}
    asked = next(_asked([table.slice(0, 50)], p, 6, {6: (np.arange(300), c)}, boxes, _slack(p, n, n), 5))
    assert asked.num_rows == 50 and set(asked.column(4).to_pylist()) == {0}


def test_lengths_and_large_components(spark):
    rows = [(0, [1.0, 2.0]), (1, [3.0, -1.0]), (20, [1.0, 2.0, 3.0]), (2, [2.0, 2.0, 1.0]), (3, []), (40, []), (60, [1e17, 1.0]), (61, [1e17, 1.5]), (4, [1e300, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = exact_top_k(df, df.where("vec_id % 20 = 0"), k=3, scale=1.0)
    top, want = 2**63 - 1, []
    ints = [(i, [int(np.floor(x)) if abs(x) < 2**53 else int(x) for x in v]) for i, v in rows]
    for q, a in ints:
        if q % 20 == 0:
            scored = sorted((-max(-top, min(top, sum(x * y for x, y in zip(a, b)))), c) for c, b in ints if c != q and len(a) == len(b))[:3]
            want += [(q, i + 1, c, -s) for i, (s, c) in enumerate(scored)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_sql(spark):
    compare(spark, QUERIES["op6_exact_top_k"], ORACLES["op6_exact_top_k"], "/root/testdata/sf0.001")
