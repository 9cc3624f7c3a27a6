"""Queries of comparisons, cohort averages, samples, calibrated states and the smaller operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import scalars
from ..operators import averages, compare, islands, sampling, session, stats, summaries, track
from . import adapters as A
from .queries_cohort import _C, _P, T_P
from .queries_pose import _REARING, _canonical, _measures
from .queries_sequence import _L, K
from .queries_track import _ZM, _r, _renamed, _steps, _zone_metrics, _zoned, still
from .registry import query


@query(f"""{_C}, v AS (SELECT feature, grp, coalesce(value, 0) AS value FROM c WHERE grp IN ('AUTOMOBILE', 'BUILDING')),
m AS (SELECT feature, {', '.join(f"count(*) FILTER (WHERE grp = '{g}') AS n_{n}, avg(value) FILTER (WHERE grp = '{g}') AS mean_{n}, stddev_pop(value) FILTER (WHERE grp = '{g}') AS sd_{n}, var_samp(value) FILTER (WHERE grp = '{g}') AS v_{n}" for n, g in (('a', 'AUTOMOBILE'), ('b', 'BUILDING')))} FROM v GROUP BY 1),
st AS (SELECT *, (mean_a - mean_b) / sqrt(v_a / n_a + v_b / n_b) AS t, pow(v_a / n_a + v_b / n_b, 2) / (pow(v_a / n_a, 2) / (n_a - 1) + pow(v_b / n_b, 2) / (n_b - 1)) AS df FROM m),
{T_P('st', 'feature')}, r AS (SELECT *, row_number() OVER (ORDER BY p, feature) AS r, count(*) OVER () AS n FROM m JOIN tp USING (feature)),
q AS (SELECT *, least(1, min(p * n / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM r)
SELECT feature, n_a, n_b, round(mean_a, 4) AS mean_a, round(mean_b, 4) AS mean_b, round(sd_a / sqrt(n_a), 4) AS sem_a, round(sd_b / sqrt(n_b), 4) AS sem_b, round((mean_a - mean_b) / sqrt(((n_a - 1) * v_a + (n_b - 1) * v_b) / (n_a + n_b - 2)), 4) AS cohen_d, 'welch' AS test, round(p, 6) AS p, round(q, 6) AS q,
q < 0.05 AS significant, CASE WHEN q < 0.001 THEN '***' WHEN q < 0.01 THEN '**' WHEN q < 0.05 THEN '*' ELSE 'ns' END AS stars, CAST(row_number() OVER (ORDER BY q, feature) AS INT) AS rank FROM q""")
def group_comparison(spark, sf):
    """STA11, LIM1: two segments over every feature, ranked by q; the first three discriminate best."""
    own = compare.compare(A.cohort(spark, sf), "AUTOMOBILE", "BUILDING")
    return _r(_r(own, "mean_a", "mean_b", "sem_a", "sem_b", "cohen_d"), "p", "q", digits=6)


@query(f"""{_P}, ts AS (SELECT feature, a, b, na, nb, (ma - mb) / sqrt(va / na + vb / nb) AS t FROM p), z AS (SELECT *, abs(t * (1 - 1 / (4e0 * (least(na, nb) - 1)))) / sqrt(2e0) AS z FROM ts), k AS (SELECT *, 1 / (1 + 0.3275911e0 * z) AS k FROM z)
SELECT feature, a, b, round((((((1.061405429e0 * k - 1.453152027e0) * k + 1.421413741e0) * k - 0.284496736e0) * k + 0.254829592e0) * k) * exp(-z * z), 6) AS p FROM k""")
def rough_p_values(spark, sf):
    """STA6."""
    w = stats.welch(A.cohort(spark, sf))
    return _r(w.select("feature", "a", "b", stats.rough_p(F.col("t"), F.col("na"), F.col("nb")).alias("p")), "p", digits=6)


_GENOTYPE = "CASE session_id % 3 WHEN 0 THEN 'WT' WHEN 1 THEN 'KO' ELSE 'HET' END"


def _genotype():
    return F.expr(_GENOTYPE)


@query(f"""WITH RECURSIVE {A.SQL['f']}, v AS (SELECT session_id, {_GENOTYPE} AS grp, avg(ok::INT) AS value FROM f GROUP BY ALL), g AS (SELECT grp, count(*) AS n, avg(value) AS mean FROM v GROUP BY 1 HAVING count(*) >= 2 ORDER BY grp LIMIT 2),
r AS (SELECT grp, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2e0 AS r, count(*) OVER (PARTITION BY value) AS t FROM v SEMI JOIN g USING (grp)),
s AS (SELECT (SELECT min(grp) FROM g) AS a, (SELECT max(grp) FROM g) AS b, sum(r) FILTER (WHERE grp = (SELECT min(grp) FROM g)) AS ra, sum(t * t - 1) AS tie FROM r),
u AS (SELECT a, b, x.n AS na, y.n AS nb, round(x.mean, 6) AS mean_a, round(y.mean, 6) AS mean_b, ra - x.n * (x.n + 1) / 2e0 AS u, (abs(ra - x.n * (x.n + 1) / 2e0 - x.n * y.n / 2e0) - 0.5e0) / sqrt(x.n * y.n / 12e0 * ((x.n + y.n + 1) - tie / ((x.n + y.n) * (x.n + y.n - 1e0)))) AS z, least(x.n, y.n) <= 8 AND tie = 0 AS exact FROM s JOIN g x ON x.grp = a JOIN g y ON y.grp = b),
dp AS (SELECT 0 AS i, 0 AS k, 0 AS v, CAST(1 AS HUGEINT) AS c, CAST(na AS INT) AS na, CAST(nb AS INT) AS nb FROM u WHERE exact
UNION ALL SELECT i + 1, k, v, CAST(sum(c) AS HUGEINT), na, nb FROM (SELECT i, k + t AS k, v + t * (i - k) AS v, c, na, nb FROM dp, (VALUES (0), (1)) AS q(t) WHERE i < na + nb AND k + t <= na AND i + 1 - k - t <= nb) GROUP BY ALL),
ex AS (SELECT least(1, 2e0 * sum(c) FILTER (WHERE v <= (SELECT least(u, na * nb - u) FROM u)) / sum(c)) AS p FROM dp WHERE i = na + nb)
SELECT a, b, na, nb, mean_a, mean_b, u, round(z, 5) AS z, round(CASE WHEN exact THEN (SELECT p FROM ex) ELSE {A.normal_p('z')} END, 6) AS p FROM u""")
def quality_by_genotype(spark, sf):
    """AGG21: valid share of sessions between the first two genotypes; the SQL counts arrangements where p is exact."""
    own = A.frames(spark, sf).groupBy("session_id").agg(F.avg(F.col("ok").cast("int")).alias("valid")).withColumn("genotype", _genotype())
    return _r(_r(compare.quality_by_genotype(own, "valid"), "mean_a", "mean_b", "p", digits=6), "z", digits=5)


_ENOUGH = "ls AS (SELECT * FROM s WHERE label >= 0 QUALIFY count(*) OVER (PARTITION BY session_id) >= 4), al AS (SELECT count(DISTINCT session_id) AS sessions FROM s)"


@query(f"""{A.with_('f', 's')}, {_ENOUGH}, b AS (SELECT session_id, label AS i, lead(label) OVER (PARTITION BY session_id ORDER BY frame_index) AS j FROM ls), n AS (SELECT session_id, i, j, count(*) AS n FROM b WHERE j IS NOT NULL GROUP BY ALL), t AS (SELECT *, n / sum(n) OVER (PARTITION BY session_id, i) AS p FROM n)
SELECT i, j, round(sum(p) / any_value(sessions), 6) AS p FROM t CROSS JOIN al GROUP BY i, j""")
def cohort_transitions(spark, sf):
    """AGG45: mean transition matrix."""
    return _r(averages.cohort_transitions(A.labels(spark, sf)), "p", digits=6)


@query(f"""{A.with_('f', 's')}, {_ENOUGH}, u AS (SELECT session_id, label, count(*) AS n FROM ls GROUP BY ALL), t AS (SELECT label, n / sum(n) OVER (PARTITION BY session_id) AS p FROM u)
SELECT k AS label, round(coalesce(sum(p), 0) / any_value(sessions), 6) AS usage FROM (SELECT unnest(range({K}))::INT AS k) CROSS JOIN al LEFT JOIN t ON label = k GROUP BY k""")
def cohort_usage(spark, sf):
    """AGG45: mean use of motifs."""
    return _r(averages.cohort_usage(A.labels(spark, sf), K), "usage", digits=6)


@query(f"""{_L}, u AS (SELECT session_id, {', '.join(f'count(*) FILTER (WHERE label = {i}) / count(*) AS u{i}' for i in range(K))} FROM l GROUP BY 1), w AS ({' UNION ALL '.join(f'SELECT session_id, {i} AS label, u{i} AS u FROM u' for i in range(K))})
SELECT {_GENOTYPE} AS genotype, label, round(avg(u), 6) AS usage, count(*) AS sessions FROM w GROUP BY ALL""")
def usage_by_genotype(spark, sf):
    """AGG46."""
    own = A.labels(spark, sf)
    return _r(averages.usage_by_genotype(own, own.select("session_id").distinct().withColumn("genotype", _genotype()), K), "usage", digits=6)


@query(f"""{_L}, u AS (SELECT session_id, label, count(*) AS n FROM l GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY session_id) AS p FROM u)
SELECT session_id, round(-sum(p * ln(p)), 6) AS entropy, round(coalesce(any_value(n) FILTER (WHERE label = 0) / any_value(n) FILTER (WHERE label = 1), 0), 6) AS ratio FROM (SELECT * FROM p WHERE p > 0) GROUP BY 1""")
def usage_entropy(spark, sf):
    """SCL33: entropy of a vector, and a ratio with a default."""
    n = A.labels(spark, sf).where("label >= 0").groupBy("session_id").agg(F.array(*(F.count_if(F.col("label") == i).cast("double") for i in range(K))).alias("v"))
    own = n.select("session_id", scalars.entropy(F.col("v")).alias("entropy"), scalars.safe_ratio(F.when(F.col("v")[0] > 0, F.col("v")[0]), F.col("v")[1]).alias("ratio"))
    # -0.0 and 0.0 are one number
    return _r(own, "entropy", "ratio", digits=6).withColumn("entropy", F.col("entropy") + F.lit(0.0))


@query("""WITH p AS (SELECT CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), b AS (SELECT min(x) - 1 AS ax, max(x) + 1 AS bx, min(y) - 1 AS ay, max(y) + 1 AS "by" FROM p),
g AS (SELECT i AS ix, j AS iy, ax + i * (bx - ax) / 49 AS gx, ay + j * ("by" - ay) / 49 AS gy FROM b CROSS JOIN range(0, 50) a(i) CROSS JOIN range(0, 50) c(j)), d AS (SELECT ix, iy, sum(exp(-0.5e0 * ((x - gx) ** 2 + (y - gy) ** 2) / 0.25e0)) AS d FROM g CROSS JOIN p GROUP BY ALL)
SELECT CAST(ix AS INT) AS ix, CAST(iy AS INT) AS iy, round(d / (max(d) OVER () + 1e-8), 5) AS density FROM d""")
def density_grid(spark, sf):
    """AGG48: 50 x 50 cells over two dimensions of the embeddings."""
    p = A.table(spark, sf, "embeddings").select(F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return _r(averages.density(p), "density", digits=5)


@query("""WITH p AS (SELECT label AS genotype, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), b AS (SELECT min(x) AS ax, max(x) - min(x) AS wx, min(y) AS ay, max(y) - min(y) AS wy FROM p),
c AS (SELECT genotype, CAST(floor((x - ax) / wx * 39) AS INT) AS cx, CAST(floor((y - ay) / wy * 39) AS INT) AS cy, wx, wy, count(*) AS n FROM p, b GROUP BY ALL),
g AS (SELECT genotype, cx + i AS ix, cy + j AS iy, sum(n * exp(-0.5e0 * ((i * wx / 40) ** 2 + (j * wy / 40) ** 2) / (0.04e0 * greatest(wx, wy)) ** 2)) AS d FROM c, range(-2, 3) a(i), range(-2, 3) e(j) WHERE cx + i BETWEEN 0 AND 39 AND cy + j BETWEEN 0 AND 39 GROUP BY ALL)
SELECT genotype, CAST(ix AS INT) AS ix, CAST(iy AS INT) AS iy, round(d / max(d) OVER (PARTITION BY genotype), 5) AS density FROM g WHERE genotype IN (SELECT genotype FROM p GROUP BY 1 HAVING count(*) >= 5)""")
def density_by_genotype(spark, sf):
    """AGG48 by genotype: a 40 x 40 grid, spread over five by five cells."""
    e = A.table(spark, sf, "embeddings").select(F.col("label").alias("genotype"), F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"))
    return _r(averages.density_by_group(e, "genotype"), "density", digits=5)


@query(f"{A.with_('f')} SELECT session_id, frame_index, x FROM f ORDER BY md5('42:' || session_id || ':' || frame_index), session_id, frame_index LIMIT 500")
def frame_subsample(spark, sf):
    """SMP1: a sample of exactly 500 frames."""
    return sampling.subsample(A.frames(spark, sf), 500, ["session_id", "frame_index"]).select("session_id", "frame_index", "x")


@query("""WITH h AS (SELECT c_custkey, c_mktsegment, c_nationkey, md5('42:' || c_custkey) AS h FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY h, c_custkey) AS r FROM h),
s AS (SELECT c_mktsegment, c_nationkey, row_number() OVER (ORDER BY c_mktsegment, c_nationkey) AS i, count(*) OVER () AS k FROM (SELECT DISTINCT c_mktsegment, c_nationkey FROM customer)), q AS (SELECT *, greatest(1, 200 // k) AS e FROM s),
d AS (SELECT *, NOT (r <= e + (i <= 200 - e * k)::INT AND i <= 200) AS more FROM r JOIN q USING (c_mktsegment, c_nationkey))
SELECT c_custkey, c_mktsegment, c_nationkey FROM d ORDER BY more, h, c_custkey LIMIT 200""")
def stratified_sample(spark, sf):
    """SMP2, SNK11 rows: 200 customers over segment and nation, topped up."""
    c = A.table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return sampling.stratified(c, 200, ["c_mktsegment", "c_nationkey"], ["c_custkey"])


@query("SELECT c_custkey, CAST(r AS INT) AS round, ('0x' || substr(md5('42:' || r || ':' || c_custkey), 1, 8))::BIGINT / 4294967296e0 < 0.8e0 AS in_bag FROM customer CROSS JOIN range(0, 10) t(r)")
def bootstrap_bags(spark, sf):
    """SMP4: ten bags of about 80 %, and what they hold out."""
    own = A.table(spark, sf, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("round"))
    return sampling.bagged(own, ["c_custkey"], F.col("round"))


@query(f"{_ZM} SELECT session_id, zone_id, row_number() OVER (PARTITION BY session_id ORDER BY time_s DESC, zone_id)::INT AS by_time, row_number() OVER (PARTITION BY session_id ORDER BY latency_s ASC NULLS LAST, zone_id)::INT AS earliest, row_number() OVER (PARTITION BY session_id ORDER BY latency_s DESC NULLS LAST, zone_id)::INT AS latest FROM zm")
def zone_table_order(spark, sf):
    """SRT3: positions of a session's zones under three sorts, nulls last both ways."""
    w = Window.partitionBy("session_id")
    at = lambda c: F.row_number().over(w.orderBy(c, "zone_id"))
    return _zone_metrics(spark, sf).select("session_id", "zone_id", at(F.desc_nulls_last("time_s")).alias("by_time"), at(F.asc_nulls_last("latency_s")).alias("earliest"), at(F.desc_nulls_last("latency_s")).alias("latest"))


@query(f"{A.with_('f', 'k', 'z')}, {A.islands('z', 'zone_id')} SELECT session_id, state AS zone_id, start_t AS entry_t, row_number() OVER (PARTITION BY session_id ORDER BY start_t)::INT AS position FROM i WHERE state IS NOT NULL")
def visit_order(spark, sf):
    """SRT2."""
    w = Window.partitionBy("session_id").orderBy("entry_t")
    return islands.zone_events(_zoned(spark, sf)).select("session_id", "zone_id", "entry_t", F.row_number().over(w).alias("position"))


@query("WITH l AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 5 = 0 THEN 'pilot' ELSE 'session ' || (c_custkey * 7) % 101 END AS label FROM customer) SELECT c_custkey, label, row_number() OVER (PARTITION BY c_nationkey ORDER BY regexp_extract(label, '^[^0-9]*'), coalesce(try_cast(nullif(regexp_extract(label, '[0-9]+'), '') AS INT), 0), label, c_custkey)::INT AS position FROM l")
def natural_order(spark, sf):
    """SRT5: session 9 before session 10, within a nation."""
    label = F.when(F.col("c_custkey") % 5 == 0, "pilot").otherwise(F.concat(F.lit("session "), (F.col("c_custkey") * 7 % 101).cast("string")))
    own = A.table(spark, sf, "customer").select("c_custkey", "c_nationkey", label.alias("label"))
    return own.select("c_custkey", "label", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(scalars.natural_key(F.col("label")), "c_custkey")).alias("position"))


@query(f"""{A.with_('f')}, e AS (SELECT session_id, arg_min(x, frame_index) AS ax, arg_min(y, frame_index) AS ay, arg_max(x, frame_index) AS bx, arg_max(y, frame_index) AS "by" FROM f WHERE ok GROUP BY 1) SELECT session_id, round(sqrt((bx - ax) ** 2 + ("by" - ay) ** 2) / 30, 4) AS px_per_cm FROM e""")
def calibration(spark, sf):
    """SCL4: first and last point of a session, 30 cm apart."""
    p = F.struct("x", "y")
    e = A.frames(spark, sf).where("ok").groupBy("session_id").agg(F.min_by(p, "frame_index").alias("a"), F.max_by(p, "frame_index").alias("b"))
    return _r(e.select("session_id", summaries.px_per_cm(F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y"), F.lit(30.0)).alias("px_per_cm")), "px_per_cm")


@query(f"""{A.with_('f', 'k')}, c AS (SELECT session_id, speed_px_s / 40 AS v, 2e0 * (session_id % 3) AS o, dist_px / 40 AS d FROM k)
SELECT session_id, round(coalesce(sum(d), 0), 4) AS distance_cm, count(*) FILTER (WHERE v < 2) AS immobile, count(*) FILTER (WHERE v < 0.5) AS freezing, count(*) FILTER (WHERE v < CASE WHEN o > 0 THEN o ELSE 0.5 END) AS freezing_own FROM c GROUP BY 1""")
def calibrated_states(spark, sf):
    """SCL3, SCL21, SCL22, SCL23 at 40 px a cm; every third session has no threshold of its own."""
    ppc = F.lit(40.0)
    own = track.kinematics(A.frames(spark, sf), 40.0)
    px, cm = F.col("speed_px_s"), F.col("speed_cm_s")
    flags = {"immobile": scalars.immobile(px, cm, ppc), "freezing": scalars.freezing(px, cm, ppc), "freezing_own": scalars.freezing_override(px, cm, ppc, F.pmod("session_id", F.lit(3)) * 2.0)}
    return _r(own.groupBy("session_id").agg(F.coalesce(F.sum(scalars.to_cm(F.col("dist_px"), ppc)), F.lit(0.0)).alias("distance_cm"), *(F.count_if(c).alias(n) for n, c in flags.items())), "distance_cm")


@query(f"""{A.with_('f')}, p AS (SELECT *, row_number() OVER w AS n, ok AND coalesce(lag(ok) OVER w, FALSE) AS b, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) > 100 AS far FROM f WINDOW w AS (PARTITION BY session_id ORDER BY frame_index)),
c AS (SELECT *, b AND coalesce(far, FALSE) AS c FROM p), s AS (SELECT *, n - coalesce(max(CASE WHEN NOT c THEN n END) OVER (PARTITION BY session_id ORDER BY frame_index), 0) AS r FROM c), t AS (SELECT *, c AND r % 2 = 1 AS cut FROM s)
SELECT session_id, frame_index, b AND NOT cut AND NOT coalesce(lag(cut) OVER (PARTITION BY session_id ORDER BY frame_index), FALSE) AS drawn FROM t""")
def trajectory_lines(spark, sf):
    """SCL38: lines broken at jumps over a fifth of a 500 x 500 canvas."""
    return summaries.line_breaks(A.frames(spark, sf), 500, 500).select("session_id", "frame_index", "drawn")


@query(f"""{A.with_('f', 'kp')} SELECT session_id, frame_index, ({' + '.join(f'coalesce({n}_l >= 0.4, FALSE)::INT' for n, *_ in A.KEYPOINTS)})::INT AS points FROM kp""")
def visible_points(spark, sf):
    """SCL38: keypoints of a likelihood of 0.4 or more."""
    return _canonical(spark, sf).select("session_id", "frame_index", F.size(summaries.visible_points(F.col("kps"), 0.4)).alias("points"))


@query(f"""{A.with_('f')}, p AS (SELECT session_id, frame_index, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM f WHERE ok WINDOW w AS (PARTITION BY session_id ORDER BY frame_index)), h AS (SELECT *, CASE WHEN sqrt(dx * dx + dy * dy) > 1 THEN degrees(atan2(dy, dx)) END AS h FROM p),
d AS (SELECT *, h - lag(h) OVER (PARTITION BY session_id ORDER BY frame_index) AS d FROM h) SELECT session_id, frame_index, round(h, 4) AS heading_deg, round(d - 360 * ceil((d - 180) / 360), 4) AS heading_delta_deg FROM d""")
def tracker_headings(spark, sf):
    """WIN1c, SCL6: the tracker's rule, over valid frames."""
    return _r(summaries.tracker_headings(A.frames(spark, sf)).select("session_id", "frame_index", "heading_deg", "heading_delta_deg"), "heading_deg", "heading_delta_deg")


_POSED = f"{_REARING('f', 'x', '0.4')}, jr AS (SELECT f.*, rearing, coalesce(curvature > 0.25, head_body_angle > 90, FALSE) AS grooming FROM f JOIN rr USING (session_id, frame_index) JOIN pm USING (session_id, frame_index))"


def _posed(spark, sf):
    from ..operators import pose

    m = _measures(spark, sf)
    flags = m.select("session_id", "frame_index", pose.grooming(F.col("curvature"), F.col("head_body_angle")).alias("grooming")).join(pose.rearing(A.frames(spark, sf), "x", 0.40), ["session_id", "frame_index"])
    return _zoned(spark, sf).join(flags, ["session_id", "frame_index"])


@query(f"""{A.with_('f', 'kp', 'pm')}, {_POSED}, {A.islands('jr', 'ok AND rearing', name='ri')}, {A.islands('jr', 'ok AND grooming', name='gi')}
{' UNION ALL '.join(f"SELECT session_id, '{n}' AS behaviour, coalesce(sum(end_t - start_t) FILTER (WHERE state AND end_t - start_t >= {s}), 0) AS total_s, count(*) FILTER (WHERE state AND end_t - start_t >= {s}) AS episodes FROM {t} GROUP BY session_id" for n, t, s in (('rearing', 'ri', 0.2), ('grooming', 'gi', 0.5)))}""")
def pose_episodes(spark, sf):
    """WIN2a: episodes of rearing from 0.2 s and of grooming from 0.5 s."""
    own = _posed(spark, sf)
    one = lambda n, s: islands.episodes(own, F.col(n), s).withColumn("behaviour", F.lit(n))
    return one("rearing", 0.2).unionByName(one("grooming", 0.5))


@query(f"""{A.with_('f', 'k', 'z', 'kp', 'pm')}, {_POSED} SELECT session_id, zone_id, greatest(1, count(*) // 3)::INT AS rearing FROM jr JOIN (SELECT session_id, frame_index, zone_id FROM z) USING (session_id, frame_index) WHERE rearing AND zone_id IS NOT NULL GROUP BY ALL""")
def rearing_zones(spark, sf):
    """AGG15."""
    return session.rearing_by_zone(_posed(spark, sf)).select("session_id", F.explode("rearing").alias("zone_id", "rearing"))


_EPOCHS = [(0, "pre", 0.0, 5.0), (1, "tone", 6.0, 10.0), (2, "ITI", 11.0, 14.0), (3, "CS 2", 15.0, 22.0), (4, "shock", 23.0, 25.0)]


@query(f"""{A.with_('f', 'k')}, ep(epoch_id, name, a, b) AS (VALUES {', '.join(f"({i}, '{n}', {a}e0, {b}e0)" for i, n, a, b in _EPOCHS)}), r AS (SELECT k.*, epoch_id FROM k JOIN ep ON t_sec BETWEEN a AND b WHERE ok),
{A.islands('r', f'coalesce(speed_px_s < {A.IMMOBILE}, FALSE)', keys='session_id, epoch_id')}, g AS (SELECT session_id, epoch_id, sum(end_t - start_t) FILTER (WHERE state AND end_t - start_t >= 1) AS s FROM i GROUP BY ALL),
e AS (SELECT DISTINCT session_id, ep.* FROM f CROSS JOIN ep), pc AS (SELECT session_id, name, a, 100 * coalesce(s, 0) / (b - a) AS pct FROM e LEFT JOIN g USING (session_id, epoch_id))
SELECT session_id, round(arg_max(pct, a) FILTER (WHERE name IN ('pre', 'ITI')), 4) AS baseline_pct, round(avg(pct) FILTER (WHERE name IN ('tone', 'CS 2')), 4) AS mean_cs_pct FROM pc GROUP BY 1""")
def fear_conditioning(spark, sf):
    """AGG14: baseline and mean over stimuli; epochs without frames count."""
    f = _steps(spark, sf)
    epochs = f.select("session_id").distinct().crossJoin(F.broadcast(spark.createDataFrame(_EPOCHS, "epoch_id int, name string, start_t double, end_t double")))  # five literal rows
    return _r(summaries.fear_summary(f, epochs, still()), "baseline_pct", "mean_cs_pct")


@query(f"""{A.with_('f', 'k', 'z')}, {A.islands('z', 'zone_id')}, n AS (SELECT session_id, state AS zone_id, count(*) AS visits FROM i WHERE state IS NOT NULL GROUP BY ALL)
SELECT session_id, zone_id, visits FROM n QUALIFY count(*) OVER (PARTITION BY session_id) >= 3 AND sum(visits) OVER (PARTITION BY session_id) >= 3""")
def arm_visits(spark, sf):
    """AGG17: visits by arm."""
    return summaries.arm_visits(islands.zone_events(_zoned(spark, sf)), [r[0] for r in A.RECTANGLES])


@query(f"""{_ZM}, d AS (SELECT session_id, avg(sqrt((x - 250) ** 2 + (y - 250) ** 2)) FILTER (WHERE ok) / 4 AS d FROM f GROUP BY 1) SELECT session_id, round(d, 4) AS proximity_cm, latency_s FROM d JOIN zm USING (session_id) WHERE zone_id = 'center'""")
def water_maze_platform(spark, sf):
    """AGG16: latency of a zone whose name says platform, and the distance from it at 4 px a cm."""
    zm = _renamed(_zone_metrics(spark, sf), {"center": "Escape disc", "open_n": "a", "closed_e": "b", "periphery": "c"})
    return _r(summaries.platform(zm, A.frames(spark, sf), 250.0, 250.0, 4.0), "proximity_cm")


_MOTIF = ("rearing", "grooming", "speed", "turn", "curvature")


@query(f"""WITH c AS (SELECT vec_id, {', '.join(f'abs(CAST(embedding[{i + 1}] AS DOUBLE)) * 4 AS {n}' for i, n in enumerate(_MOTIF))} FROM embeddings)
SELECT vec_id, CASE WHEN rearing > 0.3 THEN 'rearing' WHEN grooming > 0.3 THEN 'grooming' WHEN speed < 0.1 AND turn < 0.1 THEN 'stillness' WHEN curvature > 0.25 AND speed < 0.3 THEN 'hunching' WHEN turn > 0.6 AND speed > 0.2 THEN 'turning' WHEN speed > 0.7 THEN 'running' WHEN speed > 0.3 THEN 'walking' ELSE 'slow_movement' END AS name FROM c""")
def motif_names(spark, sf):
    """SCL30: five dimensions of a vector stand for a motif's mean features."""
    c = {n: F.abs(F.col("embedding")[i].cast("double")) * 4 for i, n in enumerate(_MOTIF)}
    return A.table(spark, sf, "embeddings").select("vec_id", scalars.motif_label(c).alias("name"))


@query(f"""{A.with_('f')} SELECT session_id, frame_index, count(x) OVER w AS points, first_value(x IGNORE NULLS) OVER w AS oldest FROM f WINDOW w AS (PARTITION BY session_id ORDER BY frame_index ROWS BETWEEN 120 PRECEDING AND CURRENT ROW)""")
def trails(spark, sf):
    """WIN13: the last 121 frames."""
    t = track.trail(A.frames(spark, sf), 121)
    return t.select("session_id", "frame_index", F.size("trail").cast("long").alias("points"), F.get(F.col("trail"), F.lit(0))["x"].alias("oldest"))


@query(f"{A.with_('f')} SELECT session_id, frame_index FROM f WHERE ok AND abs(x - 250) + abs(y - 250) < 250.003")
def arena_detections(spark, sf):
    """SRC7: points inside a diamond."""
    corner = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    arena = F.array(corner(250.0, -0.003), corner(500.003, 250.0), corner(250.0, 500.003), corner(-0.003, 250.0))
    return summaries.inside_arena(A.frames(spark, sf).where("ok"), arena).select("session_id", "frame_index")


@query("SELECT (c_custkey % 100)::VARCHAR AS id, max(c_custkey) AS seq, arg_max(c_name, c_custkey) AS name FROM customer WHERE c_custkey % 7 <> 0 GROUP BY 1")
def protocol_imports(spark, sf):
    """SRC15: customers import protocols as JSON, some of it broken; the last import of an id stays."""
    own = A.table(spark, sf, "customer")
    text = F.when(F.col("c_custkey") % 7 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct((F.col("c_custkey") % 100).cast("string").alias("id"), F.col("c_name").alias("name"))))
    return summaries.protocols(own.select(F.col("c_custkey").alias("seq"), text.alias("json")))


@query("SELECT c_custkey AS animal, count(*) AS results FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def animals_with_results(spark, sf):
    """JN4: animals without results are skipped."""
    r = A.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("animal")).agg(F.count("*").alias("results"))
    return A.table(spark, sf, "customer").select(F.col("c_custkey").alias("animal")).join(r, "animal")


@query(f"{A.with_('f')} SELECT session_id, count(*) AS frames, count(*) FILTER (WHERE ok) AS ok_frames FROM f GROUP BY 1")
def frame_counts(spark, sf):
    """AGG49."""
    return A.frames(spark, sf).groupBy("session_id").agg(F.count("*").alias("frames"), F.count_if("ok").alias("ok_frames"))
