"""Queries over cohorts, group statistics and tables of results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import motifs, phenotype, stats
from . import adapters as A
from .queries_track import _r
from .registry import query

_C = A.with_("c")
_M = f"{_C}, m AS (SELECT feature, grp, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM c WHERE value IS NOT NULL GROUP BY ALL HAVING count(*) >= 2)"
#: Two-sided p of t and df by Simpson's rule over the angle whose tangent is t / sqrt(df).
T_P = lambda source, keys: f"""simpson AS (SELECT i, CASE WHEN i IN (0, 1000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w FROM range(0, 1001) r(i)),
tp AS (SELECT {keys}, greatest(0, 1 - 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi()) * s * th / 3000) AS p FROM (SELECT {keys}, any_value(df) AS df, any_value(th) AS th, sum(w * pow(cos(th * i / 1000), df - 1)) AS s FROM (SELECT *, atan(abs(t) / sqrt(df)) AS th FROM {source}) CROSS JOIN simpson GROUP BY {keys}))"""  # noqa: E731
_P = f"{_M}, p AS (SELECT x.feature, x.grp AS a, y.grp AS b, x.n AS na, y.n AS nb, x.m AS ma, y.m AS mb, x.v AS va, y.v AS vb FROM m x JOIN m y ON x.feature = y.feature AND x.grp < y.grp)"


#: The features of a customer.
_FEATURES = ["balance", "spent", "mean_order", "orders"]


def _values(spark, sf):
    return A.cohort(spark, sf)


@query(f"""{_P} SELECT feature, a, b, na, nb, round(ma, 3) AS ma, round(mb, 3) AS mb, round((ma - mb) / sqrt(va / na + vb / nb), 5) AS t, round(pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)), 3) AS df,
round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 5) AS cohen_d FROM p""")
def welch_tests(spark, sf):
    """STA2, STA8, JN9: every pair of groups."""
    return _r(_r(stats.welch(_values(spark, sf)), "t", "cohen_d", digits=5), "df", "ma", "mb", digits=3)


@query(f"""{_M}, g AS (SELECT feature, count(*) AS k, CAST(sum(n) AS BIGINT) AS n, sum(n * m) / sum(n) AS grand, sum((n - 1) * v) AS ssw FROM m GROUP BY 1), b AS (SELECT feature, sum(n * pow(m - grand, 2)) AS ssb FROM m JOIN g USING (feature, n) GROUP BY 1)
SELECT 1""".replace("FROM m JOIN g USING (feature, n) GROUP BY 1)\nSELECT 1", "FROM (SELECT m.*, g.grand FROM m JOIN g USING (feature)) GROUP BY 1)\nSELECT feature, k, n, round((ssb / (k - 1)) / (ssw / (n - k)), 4) AS f, k - 1 AS d1, n - k AS d2 FROM g JOIN b USING (feature)"))
def anova(spark, sf):
    """STA3."""
    return _r(stats.anova(_values(spark, sf)), "f")


@query(f"""{_M}, g AS (SELECT feature, count(*) AS k, sum(n) AS n, sum(n * m) / sum(n) AS grand, sum((n - 1) * v) AS ssw FROM m GROUP BY 1), b AS (SELECT m.feature, sum(m.n * pow(m - grand, 2)) AS ssb FROM m JOIN g ON g.feature = m.feature GROUP BY 1),
fx AS (SELECT feature, (ssb / (k - 1)) / (ssw / (n - k)) AS f, (n - k) / 2e0 AS h FROM g JOIN b USING (feature)), x AS (SELECT *, 2 * h / (2 * h + 4 * f) AS x FROM fx),
pv AS (SELECT feature, f, pow(x, h) * (1 + h * (1 - x)) AS p FROM x)
SELECT feature, 'anova' AS test, round(f, 6) AS statistic, round(p, 6) AS p, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS stars FROM pv""")
def group_tests(spark, sf):
    """STA1, SCL29: tests with p and stars."""
    return _r(stats.group_test(_values(spark, sf)), "statistic", "p", digits=6)


@query(f"""{_P}, ts AS (SELECT feature, a, b, (ma - mb) / sqrt(va / na + vb / nb) AS t, pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)) AS df FROM p), {T_P('ts', 'feature, a, b')}
SELECT feature, a, b, round(least(1, p * count(*) OVER (PARTITION BY feature)), 6) AS p_adjusted FROM tp""")
def post_hoc(spark, sf):
    """STA5: Bonferroni-corrected Welch pairs."""
    return _r(stats.post_hoc(_values(spark, sf)).select("feature", "a", "b", "p_adjusted"), "p_adjusted", digits=6)


@query()
def tukey_hsd(spark, sf):
    """STA4."""
    return _r(stats.tukey(_values(spark, sf)), "q", "p", digits=6)


@query(f"""{_C}, k AS (SELECT * FROM c WHERE value IS NOT NULL), g AS (SELECT DISTINCT feature, grp FROM k), pr AS (SELECT x.feature, x.grp AS a, y.grp AS b FROM g x JOIN g y ON x.feature = y.feature AND x.grp < y.grp),
r AS (SELECT pr.feature, a, b, grp, rank() OVER (PARTITION BY pr.feature, a, b ORDER BY value) + (count(*) OVER (PARTITION BY pr.feature, a, b, value) - 1) / 2e0 AS r, count(*) OVER (PARTITION BY pr.feature, a, b, value) AS t FROM pr JOIN k ON k.feature = pr.feature AND grp IN (a, b)),
s AS (SELECT feature, a, b, sum(r) FILTER (WHERE grp = a) AS ra, count(*) FILTER (WHERE grp = a) AS na, count(*) FILTER (WHERE grp = b) AS nb, sum(t * t - 1) AS tie FROM r GROUP BY ALL),
zs AS (SELECT *, ra - na * (na + 1) / 2e0 AS u, (abs(ra - na * (na + 1) / 2e0 - na * nb / 2e0) - 0.5e0) / sqrt(na * nb / 12e0 * ((na + nb + 1) - tie / ((na + nb) * (na + nb - 1e0)))) AS z FROM s)
SELECT feature, a, b, na, nb, u, round(z, 5) AS z, round({A.normal_p('z')}, 6) AS p FROM zs""")
def mann_whitney(spark, sf):
    """STA7. All groups here have more than eight values, so p is that of z."""
    return _r(_r(stats.mann_whitney(_values(spark, sf)), "z", digits=5), "p", digits=6)


@query("WITH t AS (SELECT o_custkey AS family, o_orderkey AS test, CAST((o_orderkey * 7919) % 1000 AS DOUBLE) / 1000 AS p FROM orders), r AS (SELECT *, count(*) OVER (PARTITION BY family) AS n, row_number() OVER (PARTITION BY family ORDER BY p, test) AS r FROM t) SELECT family, test, p, round(least(1, min(p * n / r) OVER (PARTITION BY family ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM r")
def fdr(spark, sf):
    """STA10, WIN15: every order is a test with a p-value from its key; a customer's tests are a family."""
    t = A.table(spark, sf, "orders").select(F.col("o_custkey").alias("family"), F.col("o_orderkey").alias("test"), (F.expr("cast((o_orderkey * 7919) % 1000 as double)") / 1000).alias("p"))
    return _r(stats.fdr(t, ["family"]), "q", digits=6)


@query()
def permutation_tests(spark, sf):
    """STA9: mean difference of two groups of segments; 200 customers of neighbouring keys are a study."""
    own = A.table(spark, sf, "customer").select(F.expr("concat('study ', c_custkey div 200)").alias("feature"), F.when(F.col("c_mktsegment") < "G", "a-f").otherwise("g-z").alias("group"), F.col("c_acctbal").alias("value"))
    return stats.permutation(own)


@query()
def permutation_whole(spark, sf):
    """STA9 over all customers: every pair of segments, every feature."""
    told = stats.permutation_whole(A.cohort(spark, sf), "animal")
    return _r(told.select("feature", "a", "b", "na", "nb", "difference", "p"), "difference", digits=4)


@query()
def manova(spark, sf):
    """STA13: all four features."""
    wide = _values(spark, sf).groupBy("animal", "group").pivot("feature", _FEATURES).agg(F.first("value"))
    return _r(_r(stats.manova(wide, _FEATURES), "value", "p", digits=6), "f", "df_err", digits=4)


@query(f"""{_C}, v AS (SELECT animal, grp, feature, coalesce(value, 0) AS value FROM c), r AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS s FROM v WHERE grp = 'BUILDING' GROUP BY 1)
SELECT animal, grp AS genotype, feature, round(value, 4) AS value, round((value - m) / CASE WHEN s < 1e-8 THEN 1 ELSE s END, 5) AS z FROM v JOIN r USING (feature)""")
def phenotype_z(spark, sf):
    """AGG34, AGG35: z-scores against a reference group."""
    own = _values(spark, sf).withColumnRenamed("group", "genotype")
    return _r(_r(phenotype.z_scores(own, "BUILDING").select("animal", "genotype", "feature", "value", "z"), "value"), "z", digits=5)


@query(f"""{_C}, v AS (SELECT animal, grp, feature, coalesce(value, 0) AS value FROM c), r AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS s FROM v WHERE grp = 'BUILDING' GROUP BY 1), z AS (SELECT animal, grp, feature, value, (value - m) / s AS z FROM v JOIN r USING (feature))
SELECT animal, grp AS genotype, {', '.join(f"round(any_value(value) FILTER (WHERE feature = '{x}'), 4) AS {x}, round(any_value(z) FILTER (WHERE feature = '{x}'), 5) AS z_{x}" for x in _FEATURES)} FROM z GROUP BY ALL""")
def phenotype_export(spark, sf):
    """SNK4, ML11."""
    own = phenotype.z_scores(_values(spark, sf).withColumnRenamed("group", "genotype"), "BUILDING")
    return _r(_r(phenotype.export(own, _FEATURES), *_FEATURES), *(f"z_{x}" for x in _FEATURES), digits=5)


@query(f"{_C} SELECT grp AS \"group\", feature, count(value) AS n, round(avg(value), 4) AS mean, round(coalesce(stddev_samp(value) / sqrt(count(value)), 0), 4) AS sem FROM c GROUP BY ALL")
def group_bars(spark, sf):
    """AGG37, AGG38, AGG47: mean and standard error (sample) by group."""
    return _r(phenotype.group_summary(_values(spark, sf), ["group", "feature"], sample=True), "mean", "sem")


@query(f"{_C}, g AS (SELECT grp AS genotype, feature, count(value) AS n, avg(value) AS mean, coalesce(stddev_pop(value) / sqrt(count(value)), 0) AS sem FROM c GROUP BY ALL) SELECT genotype, feature, n, round(mean, 4) AS mean, round(sem, 4) AS sem, round(abs(mean) / greatest(0.01, max(abs(mean)) OVER (PARTITION BY feature)), 5) AS scaled FROM g")
def radar(spark, sf):
    """AGG36, SCL39."""
    own = phenotype.radar(_values(spark, sf).withColumnRenamed("group", "genotype"), _FEATURES)
    return _r(_r(own, "mean", "sem"), "scaled", digits=5)


@query("SELECT 'trial ' || l_linenumber AS trial, CAST(l_linenumber AS INT) AS trial_number, round(avg(l_quantity) FILTER (WHERE l_returnflag = 'A'), 4) AS \"A\", round(avg(l_quantity) FILTER (WHERE l_returnflag = 'N'), 4) AS \"N\", round(avg(l_quantity) FILTER (WHERE l_returnflag = 'R'), 4) AS \"R\" FROM lineitem GROUP BY l_linenumber")
def learning_curve(spark, sf):
    """AGG39, SCL35."""
    l = A.table(spark, sf, "lineitem").select(F.concat(F.lit("trial "), F.col("l_linenumber").cast("string")).alias("trial"), F.col("l_returnflag").alias("treatment"), F.col("l_quantity").alias("value"))
    return _r(phenotype.learning_curve(l, ["A", "N", "R"]), "A", "N", "R")


@query("SELECT o_custkey AS animal, " + ", ".join(f"arg_max(o_totalprice, o_orderkey) FILTER (WHERE o_orderpriority LIKE '{k}%') AS s{k}" for k in range(1, 6)) + " FROM orders GROUP BY 1")
def longitudinal(spark, sf):
    """AGG40: animal by session, the last row wins."""
    o = A.table(spark, sf, "orders")
    last = lambda k: F.max_by(F.when(F.col("o_orderpriority").startswith(k), F.col("o_totalprice")), F.when(F.col("o_orderpriority").startswith(k), F.col("o_orderkey")))
    return o.groupBy(F.col("o_custkey").alias("animal")).agg(*(last(str(k)).alias(f"s{k}") for k in range(1, 6)))


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 30")
def latest_jobs(spark, sf):
    """SRC11, SRT1, LIM2: a top-k report."""
    return A.table(spark, sf, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(30)


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '00001') OR contains(lower(c_mktsegment), '00001') OR contains(CAST(c_custkey AS VARCHAR), '00001') OR contains(CAST(c_nationkey AS VARCHAR), '00001')")
def job_search(spark, sf):
    """SCL34, over four columns."""
    c = A.table(spark, sf, "customer")
    own = c.withColumns({"_key": F.col("c_custkey").cast("string"), "_nation": F.col("c_nationkey").cast("string")})
    return own.where(scalars.any_contains("00001", "c_name", "c_mktsegment", "_key", "_nation")).select("c_custkey", "c_name")


@query("SELECT c.c_custkey AS animal, n AS report, n IS NOT NULL AS qc_available FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON c_custkey = o_custkey")
def qc_join(spark, sf):
    """JN3, JN5, AGG21 join."""
    r = A.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("animal")).agg(F.count("*").alias("report"))
    return phenotype.qc_joined(A.table(spark, sf, "customer").select(F.col("c_custkey").alias("animal")), r)


@query("SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 0e0 ELSE c_acctbal END AS c_acctbal FROM customer")
def upsert(spark, sf):
    """JN8: replace rows by key."""
    c = A.table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    changes = c.where("c_nationkey = 3").withColumn("c_acctbal", F.lit(0.0)).drop("c_nationkey")
    return phenotype.upsert(c.drop("c_nationkey"), changes, "c_custkey")


@query("""WITH y AS (SELECT o_orderkey, (o_orderstatus = 'F')::INT AS y, (o_totalprice > 150000)::INT AS pred, o_totalprice AS score FROM orders),
r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2e0 AS r FROM y), s AS (SELECT count(*) FILTER (WHERE y = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE y = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg, sum(r) FILTER (WHERE y = 1) AS rp FROM r)
SELECT tp, tn, pos, neg, round(tp / pos, 6) AS sensitivity, round(tn / neg, 6) AS specificity, round((tp / pos + tn / neg) / 2, 6) AS balanced_accuracy, round((rp - pos * (pos + 1) / 2e0) / (pos * neg), 6) AS auc FROM s""")
def classifier_metrics(spark, sf):
    """ML9: the metric block, over all orders."""
    o = A.table(spark, sf, "orders")
    rows = o.select((F.col("o_orderstatus") == "F").cast("int").alias("y"), (F.col("o_totalprice") > 150000).cast("int").alias("pred"), F.col("o_totalprice").alias("score"))
    return _r(motifs.classification_metrics(rows), "sensitivity", "specificity", "balanced_accuracy", "auc", digits=6)


@query("""SELECT p_partkey, CASE WHEN p_size <= 10 THEN 'A' WHEN p_size <= 30 THEN 'B' ELSE 'C' END AS g1, CASE WHEN p_retailprice >= 1500 THEN 'A' WHEN p_retailprice >= 1200 THEN 'B' ELSE 'C' END AS g2,
CASE WHEN p_size > 30 OR p_retailprice < 1200 THEN 'C' WHEN p_size > 10 AND p_retailprice < 1500 THEN 'B' ELSE 'A' END AS tier FROM part""")
def qc_tiers(spark, sf):
    """SCL31: grades of two measures and their tier."""
    g1, g2 = scalars.qc_grade(F.col("p_size"), 10, 30), scalars.qc_grade(F.col("p_retailprice"), 1500, 1200, low_is_good=False)
    return A.table(spark, sf, "part").select("p_partkey", g1.alias("g1"), g2.alias("g2")).withColumn("tier", scalars.qc_tier(F.col("g1"), F.col("g2")))
