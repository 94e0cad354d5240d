"""Functions over steps.  Rows reach these windows only as one aggregate per step."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from winnow.functions.exprs import level


def trailing(by: Sequence[str], n: int, order: str = "step"):
    """The last n steps up to this one.  Needs the step grid."""
    return W.partitionBy(*by).orderBy(order).rowsBetween(1 - n, 0)


def upto(by: Sequence[str], order: str = "step"):
    return W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)


def rolling_sum(c: str, by: Sequence[str], n: int) -> Column:
    return F.sum(c).over(trailing(by, n))


def trailing_slope(y: str, x: Column, by: Sequence[str], n: int, minimum: int = 3) -> Column:
    """Least-squares slope over the last n steps; NULL until ``minimum`` values are present."""
    w = trailing(by, n)
    return F.when(F.count(y).over(w) >= minimum, F.regr_slope(F.col(y), x).over(w))


def relative_growth(y: str, x: Column, by: Sequence[str], n: int) -> Column:
    """Slope over level of the recent step means, not below 0; 0 with under three means."""
    mean = F.avg(y).over(trailing(by, n))
    slope = trailing_slope(y, x, by, n)
    return F.coalesce(F.when(mean > 0, F.greatest(slope / mean, F.lit(0.0))), F.lit(0.0))


def trailing_mean(y: str, by: Sequence[str], n: int) -> Column:
    return F.avg(y).over(trailing(by, n))


def first_crossing(df: DataFrame, by: Sequence[str], hit: Column, name: str,
                   step: str = "step") -> DataFrame:
    """First step at which the predicate holds, NULL when it never does."""
    return df.groupBy(*by).agg(F.min(F.when(hit, F.col(step))).alias(name))


def smoothed_hit(y: str, by: Sequence[str], k: int, limit: float) -> Column:
    """The mean of the last k values reaches the limit; needs all k of them."""
    w = trailing(by, k)
    return (F.count(y).over(w) == k) & (F.avg(y).over(w) >= limit)


def baseline_ratio(df: DataFrame, by: Sequence[str], value: str, in_baseline: Column,
                   out: str) -> DataFrame:
    """Value over its mean in the group's baseline period."""
    base = df.groupBy(*by).agg(F.avg(F.when(in_baseline, F.col(value))).alias("_base"))
    return (df.join(base, list(by))
            .withColumn(out, F.when(F.col("_base") != 0, F.col(value) / F.col("_base")))
            .drop("_base"))


def eta(value: Column, slope: Column, goal: float) -> Column:
    """Time until the value reaches the goal at its present slope; NULL when it never will."""
    return F.when(value >= goal, 0.0).when(slope > 0, (F.lit(goal) - value) / slope)


def rolling_stats(n: str, s1: str, s2: str, by: Sequence[str], w: int) -> list[Column]:
    """Mean and standard error of a rolling window from additive step sums."""
    frame = trailing(by, w)
    total = F.sum(n).over(frame)
    count = F.greatest(total.cast("double"), F.lit(1.0))
    mean = F.sum(s1).over(frame) / count
    var = F.greatest(F.sum(s2).over(frame) / count - mean * mean, F.lit(0.0))
    return [F.when(total > 0, mean).alias("pooled"), F.sqrt(var / count).alias("pooled_se")]


def worst_recent(rank: str, by: Sequence[str], k: int) -> Column:
    return F.max(rank).over(trailing(by, k))


def rate_state(rate: Column, limits: tuple[float, float]) -> Column:
    return level(F.coalesce(rate, F.lit(0.0)), *limits)
