"""Which group an animal belongs to, from its phenotype: leave-one-out predictions, metrics and importances.

A study is a few animals, a row each. All folds of a study are fitted at once: each fold's scaling follows from the
study's sums less one animal, and Newton's steps of all folds share one pass over the study, with sums that exclude the animal left
out. Studies are spread over the tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Animals of a study at most; folds times animals are held in memory, FOLDS folds at a time.
MOST_ANIMALS, FOLDS = 5000, 128


def _newton(x: np.ndarray, y: np.ndarray, kinds: int, out: np.ndarray, strength: float = 1.0, steps: int = 100) -> np.ndarray:
    """Weights (fold, class, feature + 1) of logistic regressions, one for each row in ``out`` that is left out (-1: none).

    Each minimises strength * (sum of log losses) + half the squared weights, intercepts free, on features scaled over its own rows.
    Two classes have one set of weights, of class 1; more have a set for each class.
    """
    n, d = x.shape
    f, own = len(out), np.maximum(out, 0)
    gone = (out >= 0).astype(float)
    count = n - gone
    mean = (x.sum(0) - gone[:, None] * x[own]) / count[:, None]
    # deviations about the study's mean first: squares keep their digits
    middle = x.mean(0)
    z, shift = x - middle, mean - middle
    var = ((z**2).sum(0) - gone[:, None] * z[own] ** 2) / count[:, None] - shift**2
    scale = np.sqrt(np.maximum(var, 0))
    scale[scale < 10 * np.finfo(float).eps * np.maximum(np.abs(mean), 1e-30)] = 1
    sets = 1 if kinds == 2 else kinds
    target = (y[:, None] == (np.arange(kinds) if sets > 1 else np.array([1]))).astype(float)
    keep = np.ones((f, n))
    keep[np.flatnonzero(out >= 0), out[out >= 0]] = 0
    w = np.zeros((f, sets, d + 1))
    p = sets * (d + 1)
    ridge = np.ones(d + 1)
    ridge[d] = 0
    rows = np.concatenate([(x[None] - mean[:, None]) / scale[:, None], np.ones((f, n, 1))], 2)

    def value(w, logit):
        loss = np.logaddexp(0, logit[:, :, 0]) - logit[:, :, 0] * target[:, 0] if sets == 1 else np.log(np.exp(logit - logit.max(2, keepdims=True)).sum(2)) + logit.max(2) - (logit * target).sum(2)
        return strength * (keep * loss).sum(1) + 0.5 * (w**2 * ridge).sum((1, 2))

    logit = rows @ w.transpose(0, 2, 1)
    now = value(w, logit)
    for _ in range(steps):
        if sets == 1:
            q = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
        else:
            q = np.exp(logit - logit.max(2, keepdims=True))
            q /= q.sum(2, keepdims=True)
        miss = keep[:, :, None] * (q - target)
        slope = strength * (miss.transpose(0, 2, 1) @ rows) + w * ridge
        curve = np.zeros((f, sets, d + 1, sets, d + 1))
        for a in range(sets):
            for b in range(sets):
                heat = keep * q[:, :, a] * ((a == b) - q[:, :, b])
                curve[:, a, :, b] = strength * (rows * heat[:, :, None]).transpose(0, 2, 1) @ rows
        curve = curve.reshape(f, p, p) + np.diag(np.tile(ridge, sets))
        curve += 1e-10 * np.eye(p)  # the intercepts of several classes are free up to a common number
        step = np.linalg.solve(curve, slope.reshape(f, p, 1)).reshape(f, sets, d + 1)
        size = np.ones(f)
        for _ in range(30):  # a step that doesn't lower the loss is halved
            tried = w - size[:, None, None] * step
            logit = rows @ tried.transpose(0, 2, 1)
            told = value(tried, logit)
            worse = told > now + 1e-12 * np.abs(now)
            if not worse.any():
                break
            size[worse] /= 2
        w, now = tried, told
        if np.abs(step).max() < 1e-9:
            break
    # back to unscaled features
    plain = w.copy()
    plain[:, :, :d] = w[:, :, :d] / scale[:, None]
    plain[:, :, d] -= (plain[:, :, :d] * mean[:, None]).sum(2)
    return plain if len(out) > 1 or out[0] >= 0 else w


def _shares(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Probabilities (fold, class) of one row of x for each fold."""
    logit = np.einsum("fkd,fd->fk", w[:, :, :-1], x) + w[:, :, -1]
    if logit.shape[1] == 1:
        one = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
        return np.concatenate([1 - one, one], 1)
    q = np.exp(logit - logit.max(1, keepdims=True))
    return q / q.sum(1, keepdims=True)


def _table(pdf: pd.DataFrame, features: list[str]):
    x = np.nan_to_num(pdf[features].to_numpy(float), nan=0.0)
    kinds, y = np.unique(pdf["label"].to_numpy(str), return_inverse=True)
    return x, kinds, y


def _own(rows: DataFrame, keys: list[str], label: str, features: list[str], animal: str | None = None) -> DataFrame:
    more = [F.col(animal).alias("animal")] if animal else []
    own = rows.where(F.col(label).isNotNull()).select(*keys, *more, F.col(label).cast("string").alias("label"), *(F.col(c).cast("double").alias(c) for c in features))
    large = own.groupBy(*keys).count().where(F.col("count") > MOST_ANIMALS).limit(1).collect()
    if large:
        raise ValueError(f"study {tuple(large[0][:-1])} has {large[0]['count']} animals; leave-one-out takes {MOST_ANIMALS} at most")
    return own


def leave_one_out(rows: DataFrame, keys: list[str], animal: str, label: str, features: list[str], strength: float = 1.0) -> DataFrame:
    """keys, animal, label, predicted and shares (class to probability) by logistic regression fitted without the animal.

    Scaling and fit see the study's other animals only. The penalty is half the squared weights against ``strength`` times
    the log loss; intercepts are free. Classes are those of the whole study, in the order of their names; with a class that a
    fold's other animals lack, its probability is near 0. A null or NaN feature counts as 0; rows without label are left out,
    and studies of fewer than four animals or two classes. A study has MOST_ANIMALS animals at most; more are an error.
    Equal probabilities go to the first class.
    """
    own = _own(rows, keys, label, features, animal)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x, kinds, y = _table(pdf, features)
        if len(x) < 4 or len(kinds) < 2:
            return pd.DataFrame(columns=[*keys, "animal", "label", "predicted", "shares"])
        shares = np.concatenate([_shares(_newton(x, y, len(kinds), out, strength), x[out]) for out in np.array_split(np.arange(len(x)), -(-len(x) // FOLDS))])
        return pdf[[*keys, "animal", "label"]].assign(predicted=kinds[shares.argmax(1)], shares=[dict(zip(kinds.tolist(), s.tolist())) for s in shares])

    kind = ", ".join(f"`{c}` {t}" for c, t in own.select(*keys, "animal", "label").dtypes)
    return own.groupBy(*keys).applyInPandas(one, f"{kind}, predicted string, shares map<string,double>")


def importances(rows: DataFrame, keys: list[str], label: str, features: list[str], strength: float = 1.0, most: int = 20) -> DataFrame:
    """keys, feature, importance and rank of the ``most`` first: coefficients of a fit to the whole study, scaled, by magnitude.

    Two classes: the coefficient itself, positive where it speaks for the second; more: the mean magnitude over the classes.
    Ties go to the feature given first. Rows and studies as in ``leave_one_out``.
    """
    own = _own(rows, keys, label, features)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x, kinds, y = _table(pdf, features)
        if len(x) < 4 or len(kinds) < 2:
            return pd.DataFrame(columns=[*keys, "feature", "importance", "rank"])
        w = _newton(x, y, len(kinds), np.array([-1]), strength)[0, :, :-1]
        told = w[0] if len(w) == 1 else np.abs(w).mean(0)
        best = np.argsort(-np.abs(told), kind="stable")[:most]
        out = pd.DataFrame({"feature": [features[i] for i in best], "importance": told[best], "rank": np.arange(1, len(best) + 1)})
        return out.assign(**{k: pdf[k].iloc[0] for k in keys})[[*keys, "feature", "importance", "rank"]]

    kind = ", ".join(f"`{c}` {t}" for c, t in own.select(*keys).dtypes)
    return own.groupBy(*keys).applyInPandas(one, f"{kind}, feature string, importance double, rank int")


def forest_importances(rows: DataFrame, label: str, features: list[str], trees: int = 200, seed: int = 42, most: int = 20) -> DataFrame:
    """feature, importance and rank by mean decrease of impurity in a random forest over all rows, which Spark grows."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    own = rows.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("label"), *(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in features))
    own = VectorAssembler(inputCols=features, outputCol="_x").transform(own)
    own = StringIndexer(inputCol="label", outputCol="_y", stringOrderType="alphabetAsc").fit(own).transform(own)
    told = RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=trees, maxDepth=30, minInstancesPerNode=1, seed=seed).fit(own).featureImportances.toArray()
    best = np.argsort(-told, kind="stable")[:most].tolist()
    return rows.sparkSession.createDataFrame([(features[i], float(told[i]), r + 1) for r, i in enumerate(best)], "feature string, importance double, rank int")


def metrics(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, n_correct, balanced_accuracy, and for two classes sensitivity and specificity (the second class is positive).

    From predictions(label, predicted). Balanced accuracy is the mean over the classes that occur of the share found.
    """
    per = predictions.groupBy(*keys, "label").agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("predicted")).alias("c"))
    all_ = per.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("c").alias("n_correct"), F.avg(F.col("c") / F.col("n")).alias("balanced_accuracy"), F.count("*").alias("_k"), F.max_by(F.col("c") / F.col("n"), "label").alias("_b"), F.min_by(F.col("c") / F.col("n"), "label").alias("_a"))
    two = lambda c: F.when(F.col("_k") == 2, F.col(c))
    return all_.select(*keys, "n", "n_correct", "balanced_accuracy", two("_b").alias("sensitivity"), two("_a").alias("specificity"))
