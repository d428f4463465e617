"""Linear scoring of frozen features inside Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mean_difference_weights(df: DataFrame, features: str, label: str) -> DataFrame:
    """One row holding the class-mean difference per dimension.

    Sums are combined per (dimension, class) before the shuffle, so each task
    sends two rows per dimension and the last step orders that many rows.
    """
    cells = df.select(label, F.posexplode(features).alias("dim", "x"))
    x = F.col("x").cast("double")
    per_dim = cells.groupBy("dim").agg((
        F.avg(F.when(F.col(label) == 1, x)) - F.avg(F.when(F.col(label) == 0, x))).alias("d"))
    ordered = F.array_sort(F.collect_list(F.struct("dim", "d")))
    return per_dim.agg(F.transform(ordered, lambda s: s["d"]).alias("w"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x
    )


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def linear_score(df: DataFrame, features: str, weights: DataFrame, dims: int, scale: float = 1.0,
                 digits: int = 6, out: str = "prob") -> DataFrame:
    """Sigmoid of the scaled dot product; the weights row is a scalar subquery.

    The product is written out per dimension because generated code covers
    plain arithmetic but not array lambdas.
    """
    terms = [F.get(F.col(features), i).cast("double") * F.get(F.col("_w"), i) for i in range(dims)]
    logit = F.lit(scale) * sum(terms[1:], terms[0])
    return df.withColumn("_w", weights.scalar()).withColumn(
        out, F.round(sigmoid(logit), digits)).drop("_w")


def batch_score(df: DataFrame, make_model: Callable[[], Callable[[pd.DataFrame], pd.Series]],
                keep: list[str], out: str = "pred") -> DataFrame:
    """Score every row with a Python model loaded once per task.

    A batch that raises is retried row by row, so one bad row gets a null
    prediction and its error text while its neighbours keep their scores.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for pdf in batches:
            res = pdf[keep].copy()
            try:
                res[out], res["error"] = model(pdf).astype("float64"), None
            except Exception:
                preds, errors = [], []
                for i in range(len(pdf)):
                    try:
                        preds.append(float(model(pdf.iloc[i:i + 1]).iloc[0]))
                        errors.append(None)
                    except Exception as exc:
                        preds.append(None)
                        errors.append(f"{type(exc).__name__}: {exc}")
                res[out] = pd.array(preds, dtype="Float64")
                res["error"] = errors
            yield res

    return df.mapInPandas(run, schema=f"{schema}, `{out}` double, `error` string")


def fit_linear_probe(train: DataFrame, features: str, label: str, weight: str | None = None,
                     max_iter: int = 50, reg: float = 1e-3):
    """Standardized logistic regression on frozen features (``pyspark.ml``)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector

    cols = [array_to_vector(F.col(features)).alias("_raw"), F.col(label).cast("double").alias("_y")]
    if weight:
        cols.append(F.col(weight).cast("double").alias("_weight"))
    lr = LogisticRegression(
        featuresCol="_scaled", labelCol="_y", predictionCol="_class", rawPredictionCol="_margin",
        probabilityCol="_probability", maxIter=max_iter, regParam=reg)
    if weight:
        lr = lr.setWeightCol("_weight")
    scaler = StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True)
    return Pipeline(stages=[scaler, lr]).fit(train.select(*cols))


def apply_linear_probe(model, df: DataFrame, features: str, out: str = "prob", digits: int = 6) -> DataFrame:
    from pyspark.ml.functions import array_to_vector, vector_to_array

    scored = model.transform(df.withColumn("_raw", array_to_vector(F.col(features))))
    return scored.withColumn(
        out, F.round(F.get(vector_to_array("_probability"), 1), digits)
    ).drop("_raw", "_scaled", "_margin", "_probability", "_class")


def probe_gradient(model, train: DataFrame, features: str, label: str, reg: float = 1e-3) -> DataFrame:
    """(dim, gradient) of the fitted objective on its training rows: zero where the fit has converged."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    scored = model.transform(train.withColumn("_raw", array_to_vector(F.col(features))))
    miss = F.get(vector_to_array("_probability"), 1) - F.col(label)
    weights = F.array(*[F.lit(float(w)) for w in model.stages[-1].coefficients])
    cells = scored.select(miss.alias("miss"), F.posexplode(vector_to_array("_scaled")).alias("dim", "x"))
    return cells.groupBy("dim").agg(F.avg(F.col("miss") * F.col("x")).alias("g")).select(
        "dim", (F.col("g") + F.lit(reg) * F.get(weights, F.col("dim"))).alias("gradient"))


@dataclass
class NewtonFit:
    """Weights for features less ``mean`` over ``std``, and the bias; ``steps`` taken."""

    mean: np.ndarray
    std: np.ndarray
    weights: np.ndarray
    bias: float
    steps: int


def _summed(rows: DataFrame, dims: int, sums: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """``size`` sums over all rows: numpy within a task, one row per sum and task to the shuffle, ``size`` rows to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                total += sums(x, batch.column(1).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int64)), pa.array(total)], names=["k", "v"])

    got = rows.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()
    return np.array([r["v"] for r in got]) if got else np.zeros(size)


def newton_probe(train: DataFrame, features: str, label: str, *, reg: float = 1e-3, max_steps: int = 30, tolerance: float = 1e-10) -> NewtonFit:
    """Standardized logistic regression by Newton's method: one aggregate of gradient and Gram matrix per step.

    Minimizes the mean log loss plus reg / 2 times the squared weights; the
    bias is free. Rows whose features or label are null, or whose features
    have another length than the first row's, are left out. The driver gets
    (d + 1) (d + 2) numbers per step, whatever the rows.
    """
    first = train.where(F.col(features).isNotNull()).select(F.size(features).alias("d")).first()
    if first is None:
        raise ValueError("no rows to fit")
    d = first["d"]
    values = F.col(features).cast("array<double>")
    rows = train.where(F.col(features).isNotNull() & F.col(label).isNotNull() & (F.size(features) == d) & ~F.exists(values, lambda v: v.isNull())).select(
        values.alias("x"), F.col(label).cast("double").alias("y"))
    sums = _summed(rows, d, lambda x, y: np.concatenate([[len(x)], x.sum(axis=0)]), d + 1)
    n = sums[0]
    if n < 2:
        raise ValueError("no rows to fit")
    mean = sums[1:] / n
    std = np.sqrt(_summed(rows, d, lambda x, y: ((x - mean) ** 2).sum(axis=0), d) / (n - 1))
    scale = np.where(std > 0, std, 1.0)
    w, free = np.zeros(d + 1), np.append(np.full(d, reg), 0.0)
    step = 0
    for step in range(1, max_steps + 1):
        def sums_at(x: np.ndarray, y: np.ndarray, w: np.ndarray = w) -> np.ndarray:
            z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
            p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
            return np.concatenate([z.T @ (p - y), (z.T @ (z * (p * (1 - p))[:, None])).ravel()])

        got = _summed(rows, d, sums_at, (d + 1) * (d + 2)) / n
        move = np.linalg.lstsq(got[d + 1 :].reshape(d + 1, d + 1) + np.diag(free), got[: d + 1] + free * w, rcond=None)[0]
        w = w - move
        if np.abs(move).max() < tolerance:
            break
    return NewtonFit(mean, scale, w[:d], float(w[d]), step)


def score_newton(df: DataFrame, features: str, fit: NewtonFit, out: str = "prob") -> DataFrame:
    """The probability of every row, as a plain expression; null features give null."""
    per = fit.weights / fit.std
    weights = F.array(*[F.lit(float(v)) for v in per])
    return df.withColumn(out, sigmoid(dot(F.col(features), weights) + F.lit(float(fit.bias - fit.mean @ per))))
