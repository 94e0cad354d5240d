"""Row-level operators: filters, labels, scores, thinning, bins and histograms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from winnow.functions.exprs import clamped_bin, closed_bin, equal_width_bin, uniform
from winnow.operators.primitives import exact_quantiles, row_positions, with_group_values


def event_label(gate: Column, true_single: Column) -> Column:
    """single / agglomerate / fines / held_back, the last for a twin verdict on a true single."""
    return (F.when(gate == 2, "fines")
            .when((gate == 1) & true_single, "held_back")
            .when(gate == 1, "agglomerate").otherwise("single"))


def reclassify(status: Column, score: Column, threshold: float) -> Column:
    """Scored, ungated rows are measured or undecided by the threshold; others keep theirs."""
    return (F.when((status != "gated") & score.isNotNull(),
                   F.when(score >= threshold, "measured").otherwise("undecided"))
            .otherwise(status))


def fused_confidence(seg: Column, residual: Column, spread: Column, old: Column,
                     residual_scale: float, spread_scale: float) -> Column:
    """Segmentation score damped by fit residual and spread; missing inputs keep the old one."""
    damp = (F.exp(-F.pow(residual / residual_scale, 2.0))
            * F.exp(-F.pow(spread / spread_scale, 2.0)))
    return F.coalesce(seg * damp, old)


def age_shift(h: Column, growth_per_s: Column, t_now: Column, t_seen: Column) -> Column:
    return h * (F.lit(1.0) + growth_per_s * (t_now - t_seen))


def stride_thin(df: DataFrame, by: Sequence[str], order: str, ties: Sequence[str], target: int,
                ceil: bool = False) -> DataFrame:
    """Every k-th row of each group in order, k chosen so that about ``target`` rows remain."""
    out = row_positions(df, by, order, ties, "pos")
    n = F.col("pos_n").cast("double")
    k = F.ceil(n / target) if ceil else F.greatest(F.lit(1).cast("bigint"), F.floor(n / target))
    return out.withColumn("stride", k.cast("bigint")).filter("pos % stride = 0").drop("pos_n")


def size_biased_thin(df: DataFrame, by: Sequence[str], size: str, m: float,
                     keys: Sequence[str], tag: str) -> DataFrame:
    """Keep an object with probability (size / largest size of its group) ** m."""
    top = df.groupBy(*by).agg(F.max(size).alias("_top"))
    return (with_group_values(df, top, by)
            .filter(uniform(*keys, F.lit(tag)) < F.pow(F.col(size) / F.col("_top"), F.lit(m)))
            .drop("_top"))


def hidden_thin(df: DataFrame, by: Sequence[str], size: str, hidden: str, m: float,
                gamma: float, keys: Sequence[str], tag: str) -> DataFrame:
    """Selection on size and on a hidden, standardised variable; adds its probability.

    Each row is kept on its own with probability proportional to the weight, which replaces a
    fixed number of draws by a Poisson sample of the same distribution.
    """
    by = list(by)
    stats = (df.groupBy(*by).agg(F.avg(hidden).alias("_mu"), F.stddev_pop(hidden).alias("_sd"))
             .join(exact_quantiles(df, by, size, {"_med": 0.5}), by))
    z = F.when(F.col("_sd") > 0, (F.col(hidden) - F.col("_mu")) / F.col("_sd")).otherwise(0.0)
    logw = F.lit(m) * F.log(F.col(size) / F.col("_med")) + F.lit(gamma) * z
    weighed = with_group_values(df, stats, by).withColumn("_logw", logw)
    top = weighed.groupBy(*by).agg(F.max("_logw").alias("_maxw"))
    return (with_group_values(weighed, top, by)
            .withColumn("p_keep", F.exp(F.col("_logw") - F.col("_maxw")))
            .filter(uniform(*keys, F.lit(tag)) < F.col("p_keep"))
            .drop("_mu", "_sd", "_med", "_logw", "_maxw"))


def range_violations(df: DataFrame, keys: Sequence[str],
                     ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """One row per (record, parameter) outside its allowed range."""
    limits = F.array(*[F.struct(F.lit(n).alias("parameter"), F.col(n).alias("value"),
                                F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
                       for n, (lo, hi) in ranges.items()])
    return (df.select(*keys, F.explode(limits).alias("r"))
            .select(*keys, "r.*").filter(~F.col("value").between(F.col("lo"), F.col("hi")))
            .withColumn("message", F.format_string(
                "%s: %.4f not in [%.1f, %.1f]",
                "parameter", "value", "lo", "hi")))


def histogram(df: DataFrame, by: Sequence[str], value: str, lo: float, width: float, n: int,
              weight: Column | None = None, closed: bool = False) -> DataFrame:
    """Counts (or weight sums) per bin; values outside drop out.

    ``closed`` puts the upper edge into the last bin and rejects everything below ``lo``;
    otherwise the truncating index also takes values less than a bin below ``lo``.
    """
    v = F.col(value)
    idx = (closed_bin(v, lo, width, n) if closed
           else equal_width_bin(v, lo, 1.0 / width))
    total = F.count("*") if weight is None else F.sum(weight)
    return (df.withColumn("bin", idx).filter((F.col("bin") >= 0) & (F.col("bin") < n))
            .groupBy(*by, "bin").agg(total.alias("n")))


def joint_classes(sample: DataFrame, reference: DataFrame, by: Sequence[str], x: str,
                  n: int) -> tuple[DataFrame, DataFrame]:
    """Both sides binned over their joint range, one range per group.

    Adds ``class``, ``lo`` and ``width``; a group missing on either side drops out.
    """
    by = list(by)
    a = sample.groupBy(*by).agg(F.min(x).alias("_la"), F.max(x).alias("_ha"))
    b = reference.groupBy(*by).agg(F.min(x).alias("_lb"), F.max(x).alias("_hb"))
    lo = F.least("_la", "_lb")
    width = F.greatest((F.greatest("_ha", "_hb") - lo) / n, F.lit(2.220446049250313e-16))
    span = a.join(b, by).select(*by, lo.alias("lo"), width.alias("width"))
    idx = clamped_bin(F.col(x), F.col("lo"), F.col("width"), n).alias("class")
    return (sample.join(span, by).select("*", idx), reference.join(span, by).select("*", idx))


def merge_bins(hist: DataFrame, by: Sequence[str], n_bins: int, m: int) -> DataFrame:
    """Sum m adjacent bins and drop the ragged tail."""
    return (hist.filter(F.col("bin") < m * (n_bins // m))
            .groupBy(*by, F.floor(F.col("bin") / m).alias("bin")).agg(F.sum("n").alias("n")))


def shares(hist: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts as shares of their group; an empty group keeps zeros."""
    total = F.sum("n").over(W.partitionBy(*by))
    return hist.withColumn("share", F.when(total > 0, F.col("n") / total).otherwise(0.0))
