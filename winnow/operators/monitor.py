"""Instrument monitoring: control limits, T-squared, drift states."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions.exprs import level, state_name
from winnow.operators import primitives as N
from winnow.operators.aggregates import covariance
from winnow.settings import Settings


@dataclass(frozen=True)
class Baseline:
    """Some dozens of numbers that describe clean scans."""

    features: tuple[str, ...]
    n: int
    mean: tuple[float, ...]
    cov: tuple[tuple[float, ...], ...]
    inverse: tuple[tuple[float, ...], ...]
    t2_limit: float


def beta_share(x: float, a: float, b: float, terms: int = 300) -> float:
    """Regularised incomplete beta function: its continued fraction, evaluated from the far end.

    The fraction converges fast below the mean; above it the other tail is taken.
    """
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    if x * (a + b + 2) > a + 1:
        return 1.0 - beta_share(1.0 - x, b, a, terms)
    tail = 1.0
    for k in range(terms, 0, -1):
        m = k // 2
        step = (m * (b - m) / ((a + k - 1) * (a + k)) if k % 2 == 0
                else -(a + m) * (a + b + m) / ((a + k - 1) * (a + k)))
        tail = 1.0 + step * x / tail
    front = a * math.log(x) + b * math.log1p(-x) - math.log(a) + (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
    return math.exp(front) / tail


def f_quantile(d1: float, d2: float, share: float) -> float:
    """Quantile of the F distribution, by bisection of its beta variable."""
    low, high = 0.0, 1.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if beta_share(mid, d1 / 2, d2 / 2) < share else (low, mid)
    return d2 / d1 * low / (1.0 - low)


def fit_baseline(df: DataFrame, features: Sequence[str], s: Settings) -> Baseline:
    """Mean, covariance and T-squared limit from one aggregate over the clean scans."""
    p = len(features)
    row = covariance(df, features).first()
    n = row["n"]
    if n < max(s.min_baseline, p + 2):
        raise ValueError(f"need at least {max(s.min_baseline, p + 2)} clean scans, got {n}")
    cov = np.zeros((p, p))
    for i, a in enumerate(features):
        for j, b in enumerate(features[i:], start=i):
            cov[i, j] = cov[j, i] = row[f"cov_{a}_{b}"]
    ridge = cov + np.eye(p) * (1e-9 * np.trace(cov) / p)
    limit = p * (n + 1) * (n - 1) / (n * (n - p)) * f_quantile(p, n - p, s.t2_confidence)
    return Baseline(tuple(features), n, tuple(float(row[f"mean_{c}"]) for c in features),
                    tuple(map(tuple, cov.tolist())),
                    tuple(map(tuple, np.linalg.inv(ridge).tolist())), float(limit))


def hotelling_t2(b: Baseline) -> Column:
    """Squared distance of a scan from the baseline, as one expression of literals."""
    d = [F.col(c) - F.lit(m) for c, m in zip(b.features, b.mean)]
    total = F.lit(0.0)
    for i in range(len(d)):
        for j in range(i, len(d)):
            factor = b.inverse[i][j] * (1.0 if i == j else 2.0)
            total = total + F.lit(factor) * d[i] * d[j]
    return total


def drift_state(df: DataFrame, by: Sequence[str], order: str, ties: Sequence[str],
                exceed: str, undecided: str, reflector: str, reflector_base: float,
                s: Settings, rows_per_bucket: int | None = None) -> DataFrame:
    """Three moving averages per instrument and the worst of their states."""
    out = N.ewma(df, by, order, ties, {
        "exceed_rate": (exceed, 1.0 - s.t2_confidence), "undecided_rate": (undecided, 0.0),
        "_reflector": (reflector, reflector_base)}, s.ewma_lambda, rows_per_bucket)
    out = out.withColumn("reflector_drop", F.lit(reflector_base) - F.col("_reflector")).drop(
        "_reflector")
    rank = F.greatest(level(F.col("exceed_rate"), *s.exceed_limits),
                      level(F.col("undecided_rate"), *s.undecided_limits),
                      level(F.col("reflector_drop"), *s.reflector_limits))
    return out.withColumn("state", state_name(rank))


def alarm_before_error(states: DataFrame, by: Sequence[str], state: str, bad: Column,
                       step: str = "step") -> DataFrame:
    """First warning, first alarm and first bad accepted reading of every instrument."""
    def first(c: Column) -> Column:
        return F.min(F.when(c, F.col(step)))

    out = states.groupBy(*by).agg(
        first(F.col(state) == "Warning").alias("first_warning"),
        first(F.col(state) == "Alarm").alias("first_alarm"), first(bad).alias("first_bad"))
    verdict = (F.when(F.col("first_bad").isNull(), "no bad reading")
               .when(F.col("first_alarm") < F.col("first_bad"), "alarm first")
               .otherwise("error first"))
    return out.withColumn("verdict", verdict)
