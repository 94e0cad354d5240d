"""Ordered picks: nearest rows, last rows, even frames, thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from winnow.functions.exprs import clamped_bin
from winnow.operators.aggregates import rejoin
from winnow.operators.primitives import ROWS_PER_BUCKET, running_sums


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int,
          keys: Sequence[str]) -> DataFrame:
    """First k rows of each group in a full order.

    A first round keeps k rows of every hash part of a group, so no task sorts a whole hot
    group; the second round sees at most k rows per part.
    """
    by = list(by)
    # as if one group held all rows
    part = F.pmod(F.xxhash64(*keys), F.lit(max(1, -(-df.count() // ROWS_PER_BUCKET))))
    first = W.partitionBy(*by, "_part").orderBy(*order)
    final = W.partitionBy(*by).orderBy(*order) if by else W.orderBy(*order)
    return (df.withColumn("_part", part).withColumn("_r", F.row_number().over(first))
            .filter(F.col("_r") <= k)
            .withColumn("rank", F.row_number().over(final).cast("bigint"))
            .filter(F.col("rank") <= k).drop("_part", "_r"))


def row_nearest(df: DataFrame, by: Sequence[str], value: str, target: float,
                step: str = "step") -> DataFrame:
    """The step of each group whose value is closest to a target."""
    cols = [c for c in df.columns if c not in by]
    return (df.filter(F.col(value).isNotNull()).groupBy(*by)
            .agg(F.min_by(F.struct(*cols), F.struct(F.abs(F.col(value) - target), F.col(step)))
                 .alias("_r")).select(*by, "_r.*"))


def even_frames(steps: DataFrame, by: Sequence[str], every: int, stops: DataFrame) -> DataFrame:
    """Every n-th step, all stop steps and the last step, once each."""
    span = steps.groupBy(*by).agg(F.max("step").alias("_last"))
    regular = span.filter(F.col("_last") >= every - 1).select(*by, F.explode(F.sequence(
        F.lit(every - 1).cast("bigint"), F.col("_last"), F.lit(every).cast("bigint")))
        .alias("step"))
    last = span.select(*by, F.col("_last").alias("step"))
    return (regular.unionByName(last)
            .unionByName(stops.filter("step is not null").select(*by, "step")).distinct())


def spaced_frames(steps: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """About n evenly spaced steps from 0 to the last, rounded half to even, once each."""
    span = steps.groupBy(*by).agg(F.max("step").alias("_last"))
    i = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_i")
    at = F.bround(F.col("_i") * (F.col("_last") / F.lit(float(n - 1)))).cast("bigint")
    return span.select(*by, "_last", i).select(*by, at.alias("step")).distinct()


def tune_threshold(df: DataFrame, by: Sequence[str], score: str, bad: Column, limit: float,
                   rows_per_bucket: int | None = None) -> DataFrame:
    """Lowest score down to which the share of bad rows stays within the limit.

    Rows are accepted from the best score down; equal scores are accepted together.
    """
    ranked = running_sums(
        df.withColumn("_neg", -F.col(score)), by, "_neg",
        {"n": F.lit(1).cast("bigint"), "bad": bad.cast("bigint")},
        rows_per_bucket=rows_per_bucket)
    taken = F.col("n_before") + F.col("n")
    wrong = F.col("bad_before") + F.col("bad")
    ok = (wrong / taken) <= limit
    best = F.max(F.when(ok, F.struct(taken.alias("taken"), F.col("_neg"), wrong.alias("wrong"))))
    out = ranked.groupBy(*by).agg(best.alias("_b"), F.max("n_total").alias("_n"))
    return out.select(
        *by, F.coalesce(-F.col("_b._neg"), F.lit(1.0)).alias("threshold"),
        F.coalesce(1 - F.col("_b.taken") / F.col("_n"), F.lit(1.0)).alias("undecided_share"),
        F.coalesce(F.col("_b.wrong") / F.col("_b.taken"), F.lit(0.0)).alias("bad_share"))


def suffix_threshold(df: DataFrame, value: str, good: Column, rate: float,
                     bins: int) -> DataFrame:
    """Lower edge of the lowest log bin from which every higher bin clears the rate."""
    span = df.agg(F.log(F.min(value)).alias("_lo"),
                  (F.log(F.max(value)) + 1e-9).alias("_hi")).withColumn(
        "_w", (F.col("_hi") - F.col("_lo")) / bins)
    per = (rejoin(df, span, [])
           .withColumn("bin", clamped_bin(F.log(value), F.col("_lo"), F.col("_w"), bins))
           .groupBy("bin", "_lo", "_w").agg(F.avg(good.cast("double")).alias("_rate")))
    fail = F.max(F.when(F.col("_rate") < rate, F.col("bin")))
    out = per.groupBy("_lo", "_w").agg(F.coalesce(fail + 1, F.lit(0).cast("bigint"))
                                       .alias("first_bin"))
    edge = F.exp(F.col("_lo") + F.col("first_bin") * F.col("_w"))
    return out.select("first_bin", F.when(F.col("first_bin") < bins, edge).alias("threshold"))
