"""Learners under given folds: Spark ML models and a graph-regularised logistic model."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.evaluation import average_precision
from tessera.sources.workdir import written

#: Settings of the boosted trees and of the selection grid.
GBT = {"maxDepth": 6, "minInstancesPerNode": 10, "maxIter": 250, "stepSize": 0.05}
GRID = [{"maxDepth": d, "minInstancesPerNode": m, "maxIter": i, "stepSize": s} for d in (3, 6) for m in (5, 10) for i in (300, 500) for s in (0.05, 0.08)]


def _partial_sums(df: DataFrame, size: int, block) -> np.ndarray:
    """Sum ``block(matrix)`` (a vector of ``size``) over Arrow batches, first by partition, then in Spark."""

    def run(batches):
        total = np.zeros(size)
        for b in batches:
            total += block(np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["k", "v"])

    out = np.zeros(size)
    for k, v in df.mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v")).collect():
        out[k] = v
    return out


def laplacian_quadratic(edges: DataFrame, rows: DataFrame, columns: list[str]) -> np.ndarray:
    """The matrix of sums, over edges ``src, dst, weight``, of weight times the products of the ends' differences.

    Edges with an end that is not in ``rows`` do not count. Two joins on the ends; no vertex pair is built.
    """
    ends = lambda end: rows.select(F.col("app_id").alias(end), *[F.col(c).cast("double").alias(f"{end}_{c}") for c in columns])
    both = edges.select("src", "dst", "weight").join(ends("src"), "src").join(ends("dst"), "dst")
    diff = both.select(F.col("weight").cast("double"), *[(F.col(f"src_{c}") - F.col(f"dst_{c}")).alias(c) for c in columns])
    d = len(columns)
    return _partial_sums(diff, d * d, lambda m: ((m[:, 1:] * m[:, :1]).T @ m[:, 1:]).ravel()).reshape(d, d)


def graph_logistic(rows: DataFrame, columns: list[str], edges: DataFrame, lam: float = 0.5, c: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Weights (no intercept) of a balanced logistic model whose scores should agree along edges.

    Newton steps; each is one pass that sums a gradient and a curvature matrix, solved on the driver.
    """
    d, m = len(columns), (lam / c) * laplacian_quadratic(edges, rows, columns)
    n, pos = rows.agg(F.count("*"), F.sum("y")).first()
    if not n:
        return np.zeros(d)
    w_pos, w_neg = 0.5 * n / max(pos, 1), 0.5 * n / max(n - pos, 1)
    data, w = rows.select(*[F.col(x).cast("double") for x in columns], F.col("y").cast("double")), np.zeros(d)
    for _ in range(rounds):

        def block(a, w=w):
            x, y = a[:, :-1], a[:, -1]
            p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
            r = np.where(y == 1, w_pos, w_neg)
            return np.concatenate([x.T @ (r * (p - y)), (x.T @ (x * (r * p * (1 - p) + 1e-9)[:, None])).ravel()])

        sums = _partial_sums(data, d + d * d, block)
        step = np.linalg.lstsq(sums[d:].reshape(d, d) + m + 1e-6 * np.eye(d), sums[:d] + m @ w, rcond=None)[0]
        if not np.isfinite(step).all():
            break
        w = w - step
        if np.abs(step).max() < 1e-7:
            break
    return w


def _scaled(train: DataFrame, test: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both frames standardised with the training rows' mean and deviation; a constant column becomes 0."""
    stats = train.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    cols = [((F.col(c) - stats[f"m_{c}"]) / stats[f"s_{c}"] if stats[f"s_{c}"] else F.lit(0.0)).alias(c) for c in columns]
    return train.select("app_id", "fold", "y", *cols), test.select("app_id", "fold", "y", *cols)


def fit_score(train: DataFrame, test: DataFrame, columns: list[str], kind: str, edges: DataFrame | None = None, **params) -> DataFrame:
    """Fit ``kind`` (logistic, gbt, forest, graph) on ``train`` and score ``test``: ``app_id, fold, y, score``.

    Classes are balanced by weight; a training part with one class scores its base rate.
    """
    n, pos = train.agg(F.count("*"), F.sum("y")).first()
    if not n or pos in (None, 0, n):
        return test.select("app_id", "fold", "y", F.lit(float((pos or 0) / n) if n else 0.0).alias("score"))
    if kind == "graph":
        train, test = _scaled(train, test, columns)
        w = graph_logistic(train, columns, edges, **params)
        z = sum((F.col(c) * float(v) for c, v in zip(columns, w, strict=True)), F.lit(0.0))
        return test.select("app_id", "fold", "y", (1 / (1 + F.exp(-z))).alias("score"))
    put = VectorAssembler(inputCols=columns, outputCol="raw")
    w = F.when(F.col("y") == 1, n / (2 * pos)).otherwise(n / (2 * (n - pos)))
    train, test = put.transform(train.withColumn("w", w)), put.transform(test)
    if kind == "logistic":
        scale = StandardScaler(inputCol="raw", outputCol="x", withMean=True, withStd=True).fit(train)
        train, test = scale.transform(train), scale.transform(test)
        learner = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=1 / (params.get("c", 1.0) * n), maxIter=params.get("maxIter", 50))
    elif kind == "gbt":
        learner = GBTClassifier(featuresCol="raw", labelCol="y", weightCol="w", seed=0, **(GBT | params))
    elif kind == "forest":
        learner = RandomForestClassifier(featuresCol="raw", labelCol="y", weightCol="w", seed=0, **params)
    else:
        raise ValueError(f"unknown kind of model: {kind}")
    return learner.fit(train).transform(test).select("app_id", "fold", "y", vector_to_array("probability")[1].alias("score"))


def _over_folds(df: DataFrame, folds, one) -> DataFrame:
    parts = None
    for k in folds:
        out = one(df.where(F.col("fold") != k), df.where(F.col("fold") == k))
        parts = out if parts is None else parts.unionByName(out)
    return parts


def out_of_fold(df: DataFrame, columns: list[str], folds: int, kind: str = "logistic", edges: DataFrame | None = None, **params) -> DataFrame:
    """Scores ``app_id, fold, y, score`` of a model that has not seen the row's fold.

    Scaling is fitted on the training folds alone. The graph model uses ``edges`` (``src, dst, weight``) between training rows.
    """
    base = df.select("app_id", "fold", "y", *columns)
    return _over_folds(base, range(folds), lambda train, test: fit_score(train, test, columns, kind, edges, **params))


def nested(df: DataFrame, columns: list[str], folds: int, kind: str = "gbt", grid: list[dict] | None = None, edges: DataFrame | None = None) -> tuple[DataFrame, list[dict]]:
    """Out-of-fold scores with the settings picked inside each training part, and the settings picked.

    The training part's own folds are the inner folds; the setting with the highest average precision over them wins, the first on ties.
    """
    picked: list[dict] = []

    def one(train, test):
        held = [k for k in range(folds) if k != len(picked)]
        ap = []
        for params in GRID if grid is None else grid:
            inner = written(_over_folds(train, held, lambda a, b, params=params: fit_score(a, b, columns, kind, edges, **params)), "inner")
            ap.append((average_precision(inner).first()["ap"] or 0.0, params))
        picked.append(max(ap, key=lambda x: x[0])[1])
        return fit_score(train, test, columns, kind, edges, **picked[-1])

    return _over_folds(df.select("app_id", "fold", "y", *columns), range(folds), one), picked


def held_out_groups(df: DataFrame, columns: list[str], group: str, kind: str = "logistic", **params) -> DataFrame:
    """For each value of a categorical ``group`` (null: a row of no group, always trained on by fold), the average
    precision on its positives and one fold of the rest when its rows were not trained on: ``held, ap``.
    """
    parts = None
    for (g,) in df.where(F.col(group).isNotNull()).select(group).distinct().orderBy(group).collect():
        mine, rest = F.coalesce(F.col(group) == g, F.lit(False)), F.col(group).isNull()
        test = df.where(mine | (rest & (F.col("fold") == 0)))
        train = df.where(~mine & ~(rest & (F.col("fold") == 0)))
        out = fit_score(train, test, columns, kind, **params).withColumn("held", F.lit(g))
        parts = out if parts is None else parts.unionByName(out)
    return average_precision(parts, ["held"])
