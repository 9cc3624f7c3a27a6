"""Queries of embeddings, mixed effects, classifiers and samples without near duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classify, embedding, mixed, sampling
from . import adapters as A
from .registry import query

_DIMS = [f"d{i}" for i in range(64)]
_PHENOTYPE = ["balance", "spent", "mean_order", "orders"]


def _r(df, *names, digits=5):
    return df.withColumns({n: F.round(n, digits) + F.lit(0.0) for n in names})


def _vectors(spark, sf):
    """All dimensions of all embeddings."""
    own = A.table(spark, sf, "embeddings")
    return own.select("vec_id", "label", *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(_DIMS)))


@query()
def umap_embedding(spark, sf):
    """ML7: every vector, all its dimensions, as frames are embedded."""
    return _r(embedding.umap(_vectors(spark, sf), ["vec_id"], _DIMS), "x", "y")


def _animals(spark, sf):
    """Animals are the segments of nations: mean phenotype of their customers; a region is a genotype."""
    wide = A.cohort(spark, sf).groupBy("animal", "group").pivot("feature", _PHENOTYPE).agg(F.first("value"))
    c = A.table(spark, sf, "customer").select(F.col("c_custkey").alias("animal"), "c_nationkey")
    n = A.table(spark, sf, "nation").join(F.broadcast(A.table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name")
    own = wide.join(c, "animal").join(F.broadcast(n), "c_nationkey")
    return own.groupBy("n_name", F.col("group").alias("segment"), "r_name").agg(*(F.coalesce(F.avg(x), F.lit(0.0)).alias(x) for x in _PHENOTYPE))


@query()
def animal_embedding(spark, sf):
    """ML7 by animal: five neighbours, 0.3 apart."""
    return _r(embedding.umap(_animals(spark, sf), ["n_name", "segment"], _PHENOTYPE, n_neighbors=5, min_dist=0.3), "x", "y")


@query()
def forest_importances(spark, sf):
    """ML10 by random forest: which features tell regions apart."""
    return _r(classify.forest_importances(_animals(spark, sf), "r_name", _PHENOTYPE), "importance")


def _studies(spark, sf):
    """Fifty vectors in a row are a study; whether their label is odd is the genotype."""
    return _vectors(spark, sf).withColumns({"study": F.expr("vec_id div 50"), "genotype": F.when(F.col("label") % 2 != 0, "odd").otherwise("even")})


@query()
def leave_one_out(spark, sf):
    """ML8: each animal's group by the other animals of its study, with the probability of the second one."""
    told = classify.leave_one_out(_studies(spark, sf), ["study"], "vec_id", "genotype", _DIMS)
    return told.select("study", F.col("animal").alias("vec_id"), "label", "predicted", F.round(F.col("shares")["odd"], 5).alias("score"))


@query()
def classifier_report(spark, sf):
    """ML8, ML9: how well the studies' animals were told apart, by study."""
    told = classify.leave_one_out(_studies(spark, sf), ["study"], "vec_id", "genotype", _DIMS)
    return _r(classify.metrics(told, ["study"]), "balanced_accuracy", "sensitivity", "specificity")


@query()
def classifier_importances(spark, sf):
    """ML10 by coefficients: the 20 first of each study."""
    return _r(classify.importances(_studies(spark, sf), ["study"], "genotype", _DIMS), "importance")


_Z = ", ".join(f"(coalesce({c}, 0) - avg(coalesce({c}, 0)) OVER ()) / stddev_pop(coalesce({c}, 0)) OVER () AS z{i}" for i, c in enumerate(_PHENOTYPE))


@query(f"""{A.with_('c')}, zs AS (SELECT animal, grp, {_Z} FROM w), v AS (SELECT animal, grp, unnest([z0, z1, z2, z3]) AS v FROM zs),
s AS (SELECT animal, grp, avg(v) AS m, var_pop(v) * 4 AS ssw FROM v GROUP BY ALL), g AS (SELECT *, avg(m) OVER (PARTITION BY grp) AS mu FROM s),
t AS (SELECT count(*) AS n, sum(ssw) / (3 * count(*)) AS msw, 4 * sum((m - mu) ** 2) / count(*) AS msb, sum(ssw) AS ssw FROM g),
p AS (SELECT n, CASE WHEN msb > msw THEN msw ELSE (ssw + msb * n) / (4 * n) END AS scale, CASE WHEN msb > msw THEN (msb - msw) / 4 ELSE 0 END AS group_var FROM t),
e AS (SELECT grp, avg(m) AS mu, count(*) AS k, row_number() OVER (ORDER BY grp) AS r FROM s GROUP BY grp), b AS (SELECT mu AS mu0, k AS k0 FROM e WHERE r = 1),
q AS (SELECT CASE WHEN r = 1 THEN 'Intercept' ELSE 'segment[' || grp || ']' END AS parameter, CASE WHEN r = 1 THEN mu ELSE mu - mu0 END AS estimate, sqrt((scale + 4 * group_var) / 4 * (1e0 / k + CASE WHEN r = 1 THEN 0 ELSE 1e0 / k0 END)) AS std_error, scale, group_var, n FROM e, b, p), y AS (SELECT *, abs(estimate / std_error) AS z FROM q)
SELECT 'phenotype' AS outcome, parameter, round(estimate, 5) + 0e0 AS estimate, round(std_error, 5) AS std_error, round(estimate / std_error, 4) + 0e0 AS z, round({A.normal_p('z')}, 4) AS p_value, round(group_var, 5) AS group_var, round(scale, 5) AS scale,
round(-2e0 * n * (ln(2 * pi()) + 1) - 3e0 * n / 2 * ln(scale) - n / 2e0 * ln(scale + 4 * group_var), 3) AS log_likelihood, 4 * n AS n_obs FROM y""")
def mixed_effects(spark, sf):
    """STA12: the scaled features of a customer are its repeated measures, the market segment is the fixed effect. All have four, so the SQL is closed."""
    own = A.cohort(spark, sf).select("animal", F.col("group").alias("segment"), "feature", F.coalesce("value", F.lit(0.0)).alias("value"))
    m = own.groupBy("feature").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    own = own.join(F.broadcast(m), "feature").withColumn("value", (F.col("value") - F.col("m")) / F.col("s")).withColumn("outcome", F.lit("phenotype"))
    told = mixed.mixed_effects(own, ["outcome"], "animal", "segment")
    return _r(_r(_r(told, "estimate", "std_error", "group_var", "scale"), "z", "p_value", digits=4), "log_likelihood", digits=3)


@query()
def diverse_sample(spark, sf):
    """SMP3, SNK11: 150 frames over genotype and session, no two of them alike. A frame's mark comes from its event: events in a row differ in a few bits."""
    own = A.frames(spark, sf, "event_id").where("ok")
    mark = F.xxhash64(F.expr("event_id div 8")).bitwiseXOR(F.expr("shiftleft(1L, cast(event_id % 8 as int))"))
    own = own.select("session_id", "frame_index", F.concat(F.lit("G"), (F.col("session_id") % 3).cast("string")).alias("genotype"), (F.col("session_id") % 7).cast("string").alias("session"), mark.alias("mark"))
    return sampling.diverse(own, 150, ["genotype", "session"], ["session_id", "frame_index"], "mark").drop("mark")
