"""Aggregates: weighted moments, line fits, robust spread, quality metrics, error tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions.exprs import ratio
from winnow.operators.primitives import (
    exact_quantiles, running_sums, settle, with_group_values)


def rejoin(df: DataFrame, small: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per-group values back onto the rows; without keys ``small`` is a single row."""
    if by:
        return with_group_values(df, small, by)
    return df.withColumn("_one", F.lit(1)).join(
        F.broadcast(small.withColumn("_one", F.lit(1))), "_one").drop("_one")


def weighted_moments(df: DataFrame, by: Sequence[str], value: str, weight: str) -> DataFrame:
    """Weighted mean, population variance about it, and CV (NULL unless the mean is positive)."""
    x, w = F.col(value), F.col(weight)
    mean = df.groupBy(*by).agg(F.sum(w).alias("_sw"), (F.sum(w * x) / F.sum(w)).alias("mean"))
    var = (rejoin(df, mean, by).groupBy(*by, "mean", "_sw")
           .agg((F.sum(w * (x - F.col("mean")) * (x - F.col("mean"))) / F.col("_sw"))
                .alias("var")))
    return var.select(*by, "mean", "var",
                      F.when(F.col("mean") > 0, F.sqrt("var") / F.col("mean")).alias("cv"))


def kish_ess(weight: Column) -> Column:
    """Effective sample size of a set of weights, as an aggregate expression."""
    return ratio(F.sum(weight) * F.sum(weight), F.sum(weight * weight))


def class_moments(df: DataFrame, by: Sequence[str], value: str,
                  count: Column | None = None) -> DataFrame:
    """Count, sum and sum of squares per class: additive, so partial sums travel, not rows."""
    c, h = (F.lit(1.0) if count is None else count), F.col(value)
    return df.groupBy(*by).agg(F.sum(c).alias("n"), F.sum(c * h).alias("s1"),
                               F.sum(c * h * h).alias("s2"))


def weighted_line(df: DataFrame, by: Sequence[str], x: str, y: str, weight: str) -> DataFrame:
    """Weighted least squares; slope 0 when all x agree.  Centred first, then fitted."""
    w, cx, cy = F.col(weight), F.col(x), F.col(y)
    centre = df.groupBy(*by).agg((F.sum(w * cx) / F.sum(w)).alias("mx"),
                                 (F.sum(w * cy) / F.sum(w)).alias("my"))
    dx = cx - F.col("mx")
    fit = (rejoin(df, centre, by).groupBy(*by, "mx", "my")
           .agg(F.sum(w * dx * dx).alias("_sxx"),
                F.sum(w * dx * (cy - F.col("my"))).alias("_sxy")))
    slope = F.when(F.col("_sxx") > 0, F.col("_sxy") / F.col("_sxx")).otherwise(0.0)
    return (fit.withColumn("slope", slope)
            .withColumn("intercept", F.col("my") - F.col("slope") * F.col("mx"))
            .select(*by, "slope", "intercept"))


def size_trend(df: DataFrame, by: Sequence[str], size: str, h: str,
               min_rows: int = 10) -> DataFrame:
    """Slope of log h on log size, CV of what is left, and the large-to-small ratio."""
    by = list(by)
    ok = (df.filter(F.col(h) > 0)
          .withColumn("_x", F.log(size)).withColumn("_y", F.log(h)))
    fit = ok.groupBy(*by).agg(
        F.count("*").alias("n"), F.regr_slope("_y", "_x").alias("exponent"),
        F.avg("_x").alias("_mx"), F.avg("_y").alias("_my")).filter(F.col("n") > min_rows)
    rel = F.exp(F.col("_y") - F.col("_my") - F.col("exponent") * (F.col("_x") - F.col("_mx")))
    spread = (rejoin(ok, fit, by).groupBy(*by, "n", "exponent")
              .agg((F.stddev_pop(rel) / F.avg(rel)).alias("cv_within")))
    span = exact_quantiles(ok, by, "_x", {"_q10": 0.1, "_q90": 0.9})
    return rejoin(spread, span, by).select(
        *by, "n", "exponent", "cv_within",
        F.exp(F.col("exponent") * (F.col("_q90") - F.col("_q10"))).alias("growth_ratio"))


def population_summary(df: DataFrame, by: Sequence[str], h: str, kind: str,
                       spec: float) -> DataFrame:
    """True state of each population: mean, nearest-rank d10/d50/d90, CV, share below spec."""
    by = list(by)
    single = F.col(kind) == 0
    hs = F.when(single, F.col(h))
    base = df.groupBy(*by).agg(
        F.avg(hs).alias("mean_um"),
        ratio(F.stddev_pop(hs), F.avg(hs)).alias("cv"),
        F.avg((hs < spec).cast("double")).alias("frac_below_spec"),
        F.count_if(single).alias("n_single"),
        F.count_if(F.col(kind) == 1).alias("n_twin"))
    q = exact_quantiles(df.filter(single), by, h,
                        {"d10_um": 0.1, "d50_um": 0.5, "d90_um": 0.9}, kind="nearest")
    n = F.col("n_single") + F.col("n_twin")
    return base.join(q, by, "left").withColumn(
        "agglomerate_pct", ratio(F.lit(100.0) * F.col("n_twin"), n))


def robust_spread(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Median and 1.4826 times the median absolute deviation."""
    med = exact_quantiles(df, by, value, {"median": 0.5})
    dev = rejoin(df.filter(F.col(value).isNotNull()), med, by).withColumn(
        "_dev", F.abs(F.col(value) - F.col("median")))
    mad = exact_quantiles(dev, by, "_dev", {"_mad": 0.5})
    return rejoin(med, mad, by).select(*by, "median",
                                       (F.lit(1.4826) * F.col("_mad")).alias("spread"))


def pooled_median(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Median with a robust standard error; a group without finite values keeps count 0."""
    n = df.groupBy(*by).agg(F.count(value).alias("count"))
    out = n.join(robust_spread(df, by, value), list(by), "left")
    return out.select(*by, F.col("median").alias("value"),
                      (F.lit(1.2533) * F.col("spread") / F.sqrt("count")).alias("se"), "count")


def confusion(df: DataFrame, truth: str, predicted: str, classes: Sequence[int]) -> DataFrame:
    """Counts of (truth, predicted); pairs that never occur are 0."""
    listed = F.explode(F.array(*[F.lit(int(c)).cast("bigint") for c in classes]))
    rows = df.sparkSession.range(1).select(listed.alias(truth))
    table = (df.groupBy(truth).pivot(predicted, [int(c) for c in classes])
             .agg(F.count(F.lit(1))))
    named = table.select(truth, *[F.col(str(c)).alias(f"pred_{c}") for c in classes])
    return F.broadcast(rows).join(named, truth, "left").fillna(0)


def calibration_error(df: DataFrame, confidence: str, correct: Column, bins: int,
                      by: Sequence[str] = ()) -> DataFrame:
    """Share-weighted gap between mean confidence and accuracy over equal-width bins."""
    cell = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1).cast("bigint"))
    per = (df.withColumn("_bin", cell).groupBy(*by, "_bin")
           .agg(F.count("*").alias("_n"), F.avg(confidence).alias("_c"),
                F.avg(correct.cast("double")).alias("_a")))
    return per.groupBy(*by).agg(
        (F.sum(F.col("_n") * F.abs(F.col("_c") - F.col("_a"))) / F.sum("_n")).alias("ece"))


def gate_summary(df: DataFrame, truth: str, predicted: str, confidence: str, min_conf: float,
                 bins: int) -> DataFrame:
    """The rates a gate is judged on, classes 0 single, 1 twin, 2 touching."""
    t, p = F.col(truth), F.col(predicted)
    passes = ((p == 0) & (F.col(confidence) >= min_conf)).cast("double")
    wrong = p.isin(1, 2).cast("double")
    head = df.agg(
        F.avg((p == t).cast("double")).alias("accuracy"),
        (F.lit(1.0) - F.avg(F.when(t == 1, passes))).alias("twin_recall"),
        F.avg(F.when(t == 1, passes)).alias("twin_leak"),
        F.avg(F.when(t == 0, wrong)).alias("false_twin_rate"),
        F.avg(F.when(t == 0, passes)).alias("single_pass_rate"),
        F.avg(F.when(t != 0, passes)).alias("non_single_leak"))
    return rejoin(head, calibration_error(df, confidence, p == t, bins), [])


def dice(df: DataFrame, truth: str, predicted: str, classes: Sequence[int],
         mask: Column | None = None) -> DataFrame:
    """Dice coefficient per class under a mask; NULL for a class that never occurs."""
    if mask is not None:
        df = df.filter(mask)
    pairs = df.groupBy(truth, predicted).agg(F.count("*").alias("_n"))
    cls = F.explode(F.array(*[F.lit(int(c)).cast("bigint") for c in classes])).alias("class")
    t = (F.col(truth) == F.col("class")).cast("bigint")
    p = (F.col(predicted) == F.col("class")).cast("bigint")
    n = F.col("_n")
    return (pairs.select("*", cls).groupBy("class")
            .agg(ratio(F.lit(2.0) * F.sum(n * t * p), F.sum(n * (t + p))).alias("dice")))


def boundary_error(df: DataFrame, by: Sequence[str], found: str, truth: str, valid: str,
                   px_um: float) -> DataFrame:
    ok = F.col(valid) & F.col(truth).isNotNull()
    gap = F.when(ok, F.abs(F.col(found) - F.col(truth)))
    return df.groupBy(*by).agg(F.avg(gap).alias("mae_px"),
                               (F.avg(gap) * px_um).alias("mae_um"), F.count(gap).alias("n"))


def surfaces_separate(df: DataFrame, by: Sequence[str], found: Column, truth: Column, ok: Column,
                      min_px: float, tolerance: float) -> DataFrame:
    """Whether each scan's median gap is large enough and close enough to the true one."""
    by = list(by)
    kept = df.filter(ok).withColumn("_found", found).withColumn("_true", truth)
    gap = exact_quantiles(kept, by, "_found", {"gap": 0.5})
    true = exact_quantiles(kept, by, "_true", {"true_gap": 0.5})
    near = (F.abs(F.col("gap") - F.col("true_gap"))
            <= F.greatest(F.lit(min_px), F.lit(tolerance) * F.col("true_gap")))
    return (df.select(*by).distinct().join(gap, by, "left").join(true, by, "left")
            .withColumn("separate", F.coalesce((F.col("gap") >= min_px) & near, F.lit(False))))


def power_mean_db(db: Column) -> Column:
    return F.lit(10.0) * F.log10(F.avg(F.pow(F.lit(10.0), db / 10.0)))


def shape(value: Column) -> list[Column]:
    """Population skewness and excess kurtosis as aggregate expressions."""
    return [F.skewness(value).alias("skew"), F.kurtosis(value).alias("kurt")]


def ks_distance(df: DataFrame, by: Sequence[str], value: str,
                rows_per_bucket: int | None = None) -> DataFrame:
    """Largest gap between each member's empirical CDF and the pool's.

    The gap is extreme at a member's own values, just before or just after the jump, so the
    member's and the pool's prefix counts are joined on the value and never expanded.
    """
    one = {"n": F.lit(1).cast("bigint")}
    own = running_sums(df, by, value, one, rows_per_bucket=rows_per_bucket)
    pool = running_sums(df, [], value, one, rows_per_bucket=rows_per_bucket).select(
        value, F.col("n").alias("_pn"), F.col("n_before").alias("_pb"),
        F.col("n_total").alias("_pt"))
    both = own.join(pool, value)
    after = F.abs((F.col("n_before") + F.col("n")) / F.col("n_total")
                  - (F.col("_pb") + F.col("_pn")) / F.col("_pt"))
    before = F.abs(F.col("n_before") / F.col("n_total") - F.col("_pb") / F.col("_pt"))
    return both.groupBy(*by).agg(F.max("n_total").alias("n"),
                                 F.max(F.greatest(after, before)).alias("ks"))


def covariance(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: n, means and the upper triangle of the sample covariance."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    return df.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in cols],
                  *[F.covar_samp(a, b).alias(f"cov_{a}_{b}") for a, b in pairs])


def calibration_table(df: DataFrame, dims: Sequence[tuple[str, int]], error: str,
                      min_count: int) -> DataFrame:
    """Median error and robust spread of every cell of a dense grid, with fallback.

    A cell with fewer than ``min_count`` rows takes the value of its parent (one dimension
    less), then of that one's parent, and in the end of all rows, however few.
    """
    spark = df.sparkSession
    names = [d for d, _ in dims]
    levels = []
    for k in range(len(names), -1, -1):
        keyed = [F.col(n) if i < k else F.lit(-1).cast("bigint") for i, n in enumerate(names)]
        levels.append(F.struct(F.lit(k).alias("_level"),
                               *[c.alias(f"_{n}") for c, n in zip(keyed, names)]))
    # written once and narrow: every quantile pass below reads the cells again
    df = settle(df.select(*names, error))
    cells = (df.select(error, F.explode(F.array(*levels)).alias("_c"))
             .select(error, "_c.*"))
    keys = ["_level", *[f"_{n}" for n in names]]
    stats = cells.groupBy(*keys).agg(F.count(error).alias("_n")).join(
        robust_spread(cells, keys, error), keys)
    grid = spark.range(1)
    for n, size in dims:
        grid = grid.withColumn(n, F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                       F.lit(size - 1).cast("bigint"))))
    wanted = grid.select(*names, F.explode(F.array(*levels)).alias("_c")).select(*names, "_c.*")
    full = F.col("_level") == len(names)
    usable = (F.col("_level") == 0) | (F.col("_n") >= min_count)
    best = F.max_by(F.struct("median", "spread"), F.when(usable, F.col("_level")))
    return (F.broadcast(wanted).join(stats, keys, "left").groupBy(*names)
            .agg(F.coalesce(F.max(F.when(full, F.col("_n"))), F.lit(0)).alias("n"),
                 best.alias("_b"))
            .select(*names, "n", F.col("_b.median").alias("bias"), "_b.spread"))


def undecided_curve(df: DataFrame, features: Mapping[str, Column], label: Column,
                    c: float = 100.0) -> DataFrame:
    """Logistic curve of the undecided share; a constant when only one outcome occurs."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    spark = df.sparkSession
    names = list(features)
    data = df.select(*[x.cast("double").alias(n) for n, x in features.items()],
                     label.cast("double").alias("label"))
    seen = data.agg(F.count("*").alias("n"), F.avg("label").alias("p")).first()
    schema = "intercept double, " + ", ".join(f"{n} double" for n in names)
    if not 0.0 < seen["p"] < 1.0:
        import math

        p = min(max(seen["p"], 1e-4), 1 - 1e-4)
        return spark.createDataFrame([(math.log(p / (1 - p)), *[0.0] * len(names))], schema)
    packed = VectorAssembler(inputCols=names, outputCol="features").transform(data)
    model = LogisticRegression(regParam=1.0 / (c * seen["n"]), elasticNetParam=0.0, maxIter=1000,
                               tol=1e-9, standardization=False).fit(packed)
    return spark.createDataFrame(
        [(float(model.intercept), *[float(v) for v in model.coefficients])], schema)


def value_shares(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Normalised value counts, per group when keys are given."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    total = counts.groupBy(*by).agg(F.sum("n").alias("_total"))
    return rejoin(counts, total, by).select(*by, value, "n",
                                            (F.col("n") / F.col("_total")).alias("share"))


def scan_features(df: DataFrame, by: Sequence[str], db: str, mask: Column,
                  probs: Sequence[str]) -> DataFrame:
    """Level, peak, speckle contrast inside a mask and mean class entropy of each scan."""
    linear = F.when(mask, F.pow(F.lit(10.0), F.col(db) / 10.0))
    entropy = sum((-F.col(p) * F.log(F.col(p) + 1e-9) for p in probs), F.lit(0.0))
    return df.groupBy(*by).agg(
        F.avg(db).alias("mean_db"), F.max(db).alias("max_db"),
        F.coalesce(F.stddev_pop(linear) / F.avg(linear), F.lit(0.0)).alias("contrast"),
        F.avg(entropy).alias("entropy"))


def noise_floor(df: DataFrame, by: Sequence[str], power: str) -> DataFrame:
    """Mean of an exponential background from its median."""
    return exact_quantiles(df, by, power, {"_m": 0.5}).select(
        *by, (F.col("_m") / F.log(F.lit(2.0))).alias("noise_floor"))


def ranked_groups(df: DataFrame, rank: Mapping[str, int], key: str) -> Column:
    """Literal rank column of a fixed display order."""
    out = F.lit(len(rank))
    for name, i in rank.items():
        out = F.when(F.col(key) == name, F.lit(i)).otherwise(out)
    return out


