"""Regressions by Newton's method: every step's sums are Spark aggregates, the driver solves systems as small as the terms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tropelens.operators.repositories import settled


def summed(rows: DataFrame, columns: list[Column]) -> np.ndarray:
    return np.array([float(x or 0.0) for x in rows.agg(*(F.sum(c).alias(f"s{k}") for k, c in enumerate(columns))).first()])


def outer(terms: list[Column], weight: Column) -> list[Column]:
    return [a * b * weight for i, a in enumerate(terms) for b in terms[: i + 1]]


def newton_sums(data: DataFrame, size: int, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the logistic likelihood at w over data (y, x0, x1, ..): tasks add up their batches as matrices, so
    many terms cost no longer expression, and a task sends a row a sum."""
    names = [f"x{k}" for k in range(size - 1)]

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            x = np.column_stack([np.ones(len(batch)), batch[names].to_numpy(dtype=np.float64)])
            p = 1 / (1 + np.exp(-x @ w))
            total[:, 0] += x.T @ (batch["y"].to_numpy() - p)
            total[:, 1:] += (x.T * (p * (1 - p))) @ x
        yield pd.DataFrame({"at": np.arange(total.size), "x": total.ravel()})

    total = np.zeros(size * (size + 1))
    for at, x in data.select("y", *names).mapInPandas(add, "at long, x double").groupBy("at").agg(F.sum("x")).collect():
        total[at] = x
    total = total.reshape(size, size + 1)
    return total[:, 0], total[:, 1:]


def symmetric(values: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((size, size))
    out[np.tril_indices(size)] = values
    return out + np.tril(out, -1).T


def product(terms: list[Column], w: np.ndarray) -> Column:
    return sum((t * float(a) for t, a in zip(terms, w, strict=True)), F.lit(0.0))


def logistic(rows: DataFrame, y: str, xs: list[str], cluster: str | None = None, ridge: float = 0.0, steps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (intercept first) and standard errors of P(y = 1); errors by cluster (sandwich, G / (G - 1)) if named.

    Rows with a null in y or xs are left out; without rows all are 0. Each step is one pass; what is shuffled are (terms + 1)^2 sums a task.
    """
    for c in [y, *xs]:  # one by one: a condition on all columns at once makes the optimizer derive one for each subset of them
        rows = rows.where(F.col(c).isNotNull())
    data = settled(rows.select(F.col(y).cast("double").alias("y"), *(F.col(x).cast("double").alias(f"x{k}") for k, x in enumerate(xs)), *([F.col(cluster).alias("g")] if cluster else [])))
    terms = [F.lit(1.0), *(F.col(f"x{k}") for k in range(len(xs)))]
    n, w = len(terms), np.zeros(len(terms))
    penalty = ridge * np.eye(n)
    if data.isEmpty():
        return w, w.copy()
    for _ in range(steps):
        gradient, hessian = newton_sums(data, n, w)
        step = np.linalg.solve(hessian + penalty, gradient - ridge * w)
        w = w + step
        if abs(step).max() < 1e-10:
            break
    p = 1 / (1 + F.exp(-product(terms, w)))
    cov = np.linalg.inv(newton_sums(data, n, w)[1] + penalty)
    if cluster:
        scores = data.groupBy("g").agg(*(F.sum(t * (F.col("y") - p)).alias(f"s{k}") for k, t in enumerate(terms)))
        got = summed(scores, outer([F.col(f"s{k}") for k in range(n)], F.lit(1.0)) + [F.lit(1.0)])
        groups = got[-1]
        cov = cov @ symmetric(got[:-1], n) @ cov * groups / max(1.0, groups - 1)
    return w, np.sqrt(np.diag(cov))


def conditional_logit(rows: DataFrame, differences: list[str], ridge: float = 1e-9, steps: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Preference model on differences chosen - rejected, without intercept. Both orders of a pair give the same gradient, so
    each pair counts once; errors are those of the pairs. Rows with a null are left out."""
    data = settled(rows.select(*(F.col(x).cast("double").alias(f"x{k}") for k, x in enumerate(differences))).dropna())
    terms = [F.col(f"x{k}") for k in range(len(differences))]
    n, w = len(terms), np.zeros(len(terms))
    if data.isEmpty():
        return w, w.copy()
    hessian = np.eye(n)
    for _ in range(steps):
        p = 1 / (1 + F.exp(-product(terms, w)))
        got = summed(data, [t * (1 - p) for t in terms] + outer(terms, p * (1 - p)))
        hessian = symmetric(got[n:], n) + ridge * np.eye(n)
        step = np.linalg.solve(hessian, got[:n])
        w = w + step
        if abs(step).max() < 1e-10:
            break
    return w, np.sqrt(np.diag(np.linalg.inv(hessian)))
