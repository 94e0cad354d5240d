"""Bias-corrected estimation of a population from a size-biased window.

All windows are estimated in one plan.  ``by`` names the window (batch, step, and a replicate
for the bootstrap).  Rows are reduced to at most ``size_classes`` class rows per window as early
as possible; whatever needs the class table afterwards (trend fit, mixture) works on one row per
window that carries it as a short array.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions.exprs import clamped_bin, col, ratio, uniform
from winnow.functions.mixture import smooth_cdf, smooth_root
from winnow.operators.primitives import (
    BROADCAST_ROWS,
    exact_quantiles,
    rows_up_to,
    running_sums,
    settle,
    small_side,
    weighted_quantiles,
    with_group_values,
)
from winnow.operators.replicates import (
    crossings,
    cut_parts,
    part_sums,
    poisson_terms,
    replicate_sums,
)
from winnow.settings import Settings

EPS = 2.220446049250313e-16
BLOCK = 16
QS = {"d10": 0.1, "d50": 0.5, "d90": 0.9}
STATS = ("mean", "d10", "d50", "d90", "cv")


def complete_schema(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every expected column exists; missing ones are NULL doubles."""
    return df.select("*", *[F.lit(None).cast("double").alias(c) for c in columns
                            if c not in df.columns])


# -- reference distributions: (by, log_size, weight[, n_effective]) ------------------------------


def reference_from_population(bed: DataFrame, by: Sequence[str], size: str,
                              edges: tuple[float, float, int]) -> DataFrame:
    """Exact size distribution of a population on log-spaced bins; empty bins are left out."""
    lo, hi, n = edges
    a = F.log(F.lit(float(lo)))
    width = (F.log(F.lit(float(hi))) - a) / n
    bin_ = F.floor((F.log(size) - a) / width)
    counts = bed.groupBy(*by, bin_.alias("bin")).agg(F.count("*").alias("_n"))
    total = counts.groupBy(*by).agg(F.sum("_n").alias("_total"))
    return counts.join(total, list(by)).select(
        *by, (a + (F.col("bin") + F.lit(0.5)) * width).alias("log_size"),
        (F.col("_n") / F.col("_total")).alias("weight"))


def reference_from_sample(bed: DataFrame, by: Sequence[str], size: str, n: int, noise_um: float,
                          keys: Sequence[str]) -> DataFrame:
    """At-line sizing of about n objects per group, drawn by hash, with camera noise."""
    total = bed.groupBy(*by).agg(F.count("*").alias("_total"))
    u1, u2 = uniform(*keys, F.lit("g1")), uniform(*keys, F.lit("g2"))
    noise = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u1)) * F.cos(F.lit(6.283185307179586) * u2)
    drawn = (bed.join(total, list(by))
             .filter(uniform(*keys, F.lit("al")) < F.lit(float(n)) / F.col("_total"))
             .select(*by, *keys, F.log(F.col(size) + F.lit(noise_um) * noise).alias("log_size")))
    kept = drawn.groupBy(*by).agg(F.count("*").alias("n_effective"))
    return drawn.join(kept, list(by)).withColumn("weight", F.lit(1.0) / F.col("n_effective"))


def reference_from_cores(cores: DataFrame, fit: DataFrame, by: Sequence[str],
                         core_by: Sequence[str]) -> DataFrame:
    """Certificate reference: core sizes plus twice the coat the window's own trend predicts.

    ``fit`` holds alpha, beta and mean_um per window, ``cores`` log_core and weight per batch.
    """
    core = F.exp("log_core")
    coat = F.exp(F.col("alpha") + F.col("beta") * F.log(core + F.lit(2.0) * F.col("mean_um")))
    return fit.join(cores, list(core_by)).select(
        *by, F.log(core + F.lit(2.0) * coat).alias("log_size"), "weight")


# -- size classes -----------------------------------------------------------------------------------


def size_classes(window: DataFrame, reference: DataFrame, by: Sequence[str],
                 n: int) -> tuple[DataFrame, DataFrame]:
    """(window rows with their class, class table) over the joint log-size range per window.

    ``window`` has columns x (log size), h and anything else; ``reference`` has log_size and
    weight.  Class table: n, s1, s2 (readings), f_true, x_ref, x_obs, lo, width.
    """
    by = list(by)
    a = window.groupBy(*by).agg(F.min("x").alias("_la"), F.max("x").alias("_ha"))
    b = reference.groupBy(*by).agg(F.min("log_size").alias("_lb"), F.max("log_size").alias("_hb"),
                                   F.sum("weight").alias("_wt"))
    lo = F.least("_la", "_lb")
    width = F.greatest((F.greatest("_ha", "_hb") - lo) / n, F.lit(EPS))
    # one row per window, written: the rows are joined to it where they are
    span = settle(a.join(b, by).select(*by, lo.alias("lo"), width.alias("width"), "_wt"))

    def cls(x: str) -> Column:
        return clamped_bin(F.col(x), F.col("lo"), F.col("width"), n).alias("class")

    rows = window.join(small_side(span.drop("_wt")), by).select("*", cls("x"))
    seen = rows.groupBy(*by, "class").agg(
        F.count("*").cast("double").alias("n"), F.sum("h").alias("s1"),
        F.sum(F.col("h") * F.col("h")).alias("s2"), F.sum("x").alias("_sx"))
    want = (reference.join(span, by).select("*", cls("log_size")).groupBy(*by, "class")
            .agg((F.sum("weight") / F.first("_wt")).alias("f_true"),
                 (F.sum(F.col("weight") * F.col("log_size")) / F.sum("weight")).alias("x_ref")))
    centre = F.col("lo") + (F.col("class") + F.lit(0.5)) * F.col("width")
    zero = F.lit(0.0)
    table = (seen.join(want, [*by, "class"], "full").join(span.drop("_wt"), by)
             .select(*by, "lo", "width", "class",
                     *[F.coalesce(c, zero).alias(c) for c in ("n", "s1", "s2", "f_true")],
                     F.coalesce("x_ref", centre).alias("x_ref"),
                     F.coalesce(F.col("_sx") / F.col("n"), centre).alias("x_obs")))
    return rows, table


def class_arrays(table: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per window with its class table as an array of at most ``size_classes`` cells."""
    return table.groupBy(*by).agg(
        F.first("lo").alias("lo"), F.first("width").alias("width"),
        F.sort_array(F.collect_list(F.struct("class", "n", "s1", "s2", "f_true", "x_ref",
                                             "x_obs"))).alias("cells"))


def _fold(cells: str, term: str) -> str:
    return f"aggregate({cells}, 0D, (a, c) -> a + {term})"


def fit_trend(arrays: DataFrame, sigma: float, size_noise: float = 0.0) -> DataFrame:
    """Power-law size trend on the class means, and the spread around it without noise.

    Adds alpha, beta, cv2 (clipped at 0) and cv2_unclipped.  Classes whose readings sum to zero
    or less stay out of the fit but keep their share of the residual.
    """
    s2, z2 = repr(float(sigma) ** 2) + "D", repr(float(size_noise) ** 2) + "D"
    y = "ln(c.s1/c.n)"
    t = "exp(alpha+beta*c.x_obs)"
    return (
        arrays.selectExpr("*", "filter(cells, c -> c.n > 0D and c.s1 > 0D) as _ok",
                          "filter(cells, c -> c.n > 0D) as _seen")
        .selectExpr("*", f"nullif({_fold('_ok', 'c.n')}, 0D) as _sw")
        .selectExpr("*", f"{_fold('_ok', 'c.n*c.x_obs')}/_sw as _mx",
                    f"{_fold('_ok', f'c.n*{y}')}/_sw as _my")
        .selectExpr("*", f"{_fold('_ok', 'c.n*(c.x_obs-_mx)*(c.x_obs-_mx)')} as _sxx",
                    f"{_fold('_ok', f'c.n*(c.x_obs-_mx)*({y}-_my)')} as _sxy")
        .selectExpr("*", "case when _sxx > 0D then _sxy/_sxx else 0D end as beta")
        .selectExpr("*", "_my-beta*_mx as alpha")
        .selectExpr("*", f"{_fold('_seen', f'(c.s2-2D*{t}*c.s1+c.n*{t}*{t})')} as _sse",
                    f"nullif({_fold('_seen', f'c.n*{t}*{t}')}, 0D) as _scale",
                    f"{_fold('_seen', f'c.n*{t}*{t}*exp(-2D*c.x_obs)')} as _cam",
                    f"{_fold('_seen', 'c.n')} as n_window")
        .selectExpr("*", f"(_sse-n_window*{s2})/_scale-beta*beta*width*width/12D"
                         f"-beta*beta*{z2}*_cam/_scale as cv2_unclipped")
        .selectExpr("*", "greatest(cv2_unclipped, 0D) as cv2")
        .drop("_ok", "_seen", "_sw", "_mx", "_my", "_sxx", "_sxy", "_sse", "_scale", "_cam"))


def shrink(h: Column, x: Column, alpha: Column, beta: Column, cv2: Column,
           sigma: float) -> Column:
    """Pull a reading toward the trend by the share of its scatter that is noise."""
    if sigma <= 0:
        return h
    trend = F.exp(alpha + beta * x)
    true_var = cv2 * trend * trend
    return trend + F.sqrt(true_var / (true_var + F.lit(sigma * sigma))) * (h - trend)


def with_components(fit: DataFrame, prior: float | None) -> DataFrame:
    """Adds ``comps``: mean, spread and weight of the smooth part of every class.

    ``prior`` is the pooling count of the hybrid method; None leaves everything to the trend.
    """
    lam = "0D" if prior is None else (
        f"case when c.n > 0D then c.n/(c.n+{float(prior)!r}D) else 0D end")
    return fit.selectExpr(
        "*", f"transform(cells, c -> struct(exp(alpha+beta*c.x_ref) as mu, "
             f"c.f_true*(1D-{lam}) as w)) as _mw").selectExpr(
        "*", "transform(_mw, c -> struct(c.mu as mu, c.mu*sqrt(cv2+beta*beta*width*width/12D) "
             "as sd, c.w as w)) as comps").drop("_mw")


def object_weight(n: Column, f_true: Column, prior: float) -> Column:
    """Share of the population one reading of a class stands for in the hybrid method."""
    return F.when(n > 0, f_true * (n / (n + prior)) / n).otherwise(0.0)


# -- mixture ------------------------------------------------------------------------------------------


def mixture_quantiles(points: DataFrame, smooth: DataFrame, by: Sequence[str],
                      qs: Mapping[str, float], rows_per_bucket: int | None = None) -> DataFrame:
    """Roots of "weights of readings up to x, plus class normals" = p, per window.

    ``points``: by, v, w.  ``smooth``: by, comps.  Readings are cut into blocks of their order;
    the smooth part is evaluated at block ends, then at the readings of the one block that
    holds the root, and in the end bisected between two readings.
    """
    by = list(by)
    ranked = settle(running_sums(points, by, "v", {"w": F.col("w"), "n": F.lit(1.0)},
                                 rows_per_bucket=rows_per_bucket)
                    .withColumn("_block", F.floor(F.col("n_before") / BLOCK)))
    smooth = smooth.select(*by, "comps")
    ends = (ranked.groupBy(*by, "_block")
            .agg(F.max("v").alias("v"), F.max(F.col("w_before") + F.col("w")).alias("cum"))
            .join(smooth, by).withColumn("_f", F.col("cum") + smooth_cdf(F.col("comps"),
                                                                         F.col("v"))))
    picks = ends.groupBy(*by).agg(
        F.max("v").alias("v_max"), F.max("cum").alias("w_all"),
        *[e for name, p in qs.items() for e in (
            F.min(F.when(F.col("_f") >= p, F.col("_block"))).alias(f"_b_{name}"),
            F.max(F.when(F.col("_f") < p, F.col("v"))).alias(f"_e_{name}"))])
    probe = F.explode(F.array(*[
        F.struct(F.lit(name).alias("q"), F.lit(float(p)).alias("p"),
                 F.col(f"_b_{name}").alias("_block"), F.col(f"_e_{name}").alias("v_end"))
        for name, p in qs.items()])).alias("_p")
    probes = smooth.join(picks, by, "left").select(*by, "comps", "v_max", "w_all", probe).select(
        *by, "comps", "v_max", "w_all", "_p.*")
    probes = settle(probes)
    near = (ranked.join(small_side(probes.filter(F.col("_block").isNotNull())), [*by, "_block"])
            .withColumn("_s", smooth_cdf(F.col("comps"), F.col("v")))
            .withColumn("_hit", F.col("w_before") + F.col("w") + F.col("_s") >= F.col("p")))
    hit = near.groupBy(*by, "q").agg(
        F.min(F.when(F.col("_hit"), F.struct("v", "w_before", "_s"))).alias("hit"),
        F.max(F.when(~F.col("_hit"), F.col("v"))).alias("below"))
    return _roots(probes.join(hit, [*by, "q"], "left").select(
        *by, "q", "p", "comps", "v_max", "w_all", "v_end", "below", F.col("hit.v").alias("v"),
        F.col("hit.w_before").alias("w_before"),
        (F.col("hit.w_before") + F.col("hit._s")).alias("_f_before")), by, qs)


def _roots(rows: DataFrame, by: Sequence[str], qs: Mapping[str, float]) -> DataFrame:
    """Roots between the last reading below p and the first reading ``v`` at which p is reached.

    ``_f_before`` is the mixture at ``v`` without the weight of the reading itself: where that is
    below p, the reading is its own root.
    """
    by = list(by)
    low = F.array_min(F.transform("comps", lambda c: c["mu"] - 8.0 * c["sd"]))
    high = F.array_max(F.transform("comps", lambda c: c["mu"] + 8.0 * c["sd"]))
    v, base = F.col("v"), F.coalesce("w_before", "w_all", F.lit(0.0))
    rows = settle(rows.select(
        *by, "q", "p", "comps", base.alias("base"), "v",
        (F.col("_f_before") < F.col("p")).alias("jump"),
        F.when(v.isNull(), F.coalesce("v_max", low))
        .otherwise(F.coalesce("below", "v_end", F.least(low, v))).alias("lo"),
        F.when(v.isNull(), F.greatest(high, "v_max")).otherwise(v).alias("hi")))

    # a jump is its own root, so only the rest is bisected
    jump = F.coalesce("jump", F.lit(False))
    flat = rows.filter(jump).select(*by, "q", F.col("v").alias("x"))
    root = smooth_root(F.col("comps"), F.col("base"), F.col("p"), F.col("lo"), F.col("hi"))
    solved = flat.unionByName(rows.filter(~jump).select(*by, "q", root.alias("x")))
    return solved.groupBy(*by).agg(*[
        F.max(F.when(F.col("q") == name, F.col("x"))).alias(name) for name in qs])


def mixture_moments(points: DataFrame, smooth: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean and CV of the same mixture in closed form."""
    by = list(by)
    own = points.groupBy(*by).agg(F.sum(F.col("w") * F.col("v")).alias("_m1"),
                                  F.sum(F.col("w") * F.col("v") * F.col("v")).alias("_m2"))
    rest = smooth.selectExpr(*by, "aggregate(comps, 0D, (a, c) -> a + c.w*c.mu) as _c1",
                             "aggregate(comps, 0D, (a, c) -> a + c.w*(c.mu*c.mu+c.sd*c.sd)) as _c2")
    zero = F.lit(0.0)
    m1 = F.coalesce("_m1", zero) + F.col("_c1")
    m2 = F.coalesce("_m2", zero) + F.col("_c2")
    return rest.join(own, by, "left").select(
        *by, m1.alias("mean"),
        F.when(m1 > 0, F.sqrt(F.greatest(m2 - m1 * m1, zero)) / m1).alias("cv"))


# -- estimates ----------------------------------------------------------------------------------------


def prefixed(df: DataFrame, by: Sequence[str], prefix: str) -> DataFrame:
    return df.select(*by, *[F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c not in by])


def class_weights(table: DataFrame, by: Sequence[str], trim: float) -> DataFrame:
    """Trimmed inverse-probability weight of each class.

    The trim level is a percentile over objects; all objects of a class share one weight, so it
    follows from the class counts.
    """
    by, table = list(by), settle(table)  # read three times
    total = table.groupBy(*by).agg(F.sum("n").alias("_nw"))
    raw = table.join(total, by).withColumn(
        "ratio", F.when(F.col("n") > 0, F.col("f_true") / (F.col("n") / F.col("_nw")))
        .otherwise(0.0))
    cap = exact_quantiles(raw.filter("n > 0"), by, "ratio", {"cap": trim}, count=F.col("n"))
    return raw.join(cap, by).withColumn("w_ipw", F.least("ratio", "cap")).drop("_nw", "cap")


def ipw_moments(weights: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean, CV, effective sample size and uncovered share from the class rows alone."""
    w, n = F.col("w_ipw"), F.col("n")
    one = weights.groupBy(*by).agg(
        F.sum(w * n).alias("_w"), (F.sum(w * F.col("s1")) / F.sum(w * n)).alias("mean"),
        ratio(F.sum(w * n) * F.sum(w * n), F.sum(w * w * n)).alias("ess"),
        F.sum(F.when(n == 0, F.col("f_true")).otherwise(0.0)).alias("uncovered"))
    two = weights.join(one, list(by)).groupBy(*by, "_w", "mean", "ess", "uncovered").agg(
        (F.sum(w * (F.col("s2") - 2.0 * F.col("mean") * F.col("s1")
                    + n * F.col("mean") * F.col("mean"))) / F.col("_w")).alias("_var"))
    return two.select(*by, "mean", F.when(F.col("mean") > 0, F.sqrt(F.greatest(
        F.col("_var"), F.lit(0.0))) / F.col("mean")).alias("cv"), "ess", "uncovered")


def raw_estimate(rows: DataFrame, by: Sequence[str], tie: Column,
                 rows_per_bucket: int | None = None) -> DataFrame:
    """What a naive system reports: unit weights.

    ``tie`` orders equal readings; as they weigh the same, it changes nothing and is not read.
    """
    m = rows.groupBy(*by).agg(F.avg("h").alias("mean"),
                              F.when(F.avg("h") > 0, F.stddev_pop("h") / F.avg("h")).alias("cv"))
    q = weighted_quantiles(rows.withColumn("_one", F.lit(1.0)), by, "h", "_one", F.lit(0), QS,
                           rows_per_bucket)
    return m.join(q, list(by))


class WindowModel:
    """Class table and trend fit of a set of windows, each stored once, and their weighed rows."""

    def __init__(self, window: DataFrame, reference: DataFrame, by: Sequence[str],
                 s: Settings) -> None:
        self.by, self.s = list(by), s
        window, reference = settle(window), settle(reference)
        rows, table = size_classes(window, reference, by, s.size_classes)
        self.table = settle(class_weights(table, by, s.trim_percentile))
        fit = fit_trend(class_arrays(self.table, by), s.sigma_um, s.size_noise_um)
        self.fit = settle(fit)
        self.per_class = settle(
            self.table.join(self.fit.select(*by, "alpha", "beta", "cv2"), self.by)
            .select(*by, "class", "alpha", "beta", "cv2", "w_ipw",
                    object_weight(F.col("n"), F.col("f_true"), s.prior_count).alias("w")))
        weighed = self._weighed(rows.drop("lo", "width"))
        # made again from the stored window by every reader, unless that takes a shuffle
        few = rows_up_to(self.per_class, BROADCAST_ROWS) <= BROADCAST_ROWS
        self.rows = weighed if few else settle(weighed)

    def _weighed(self, rows: DataFrame) -> DataFrame:
        """Rows with their class, and with it their weights and the shrunk reading ``v``."""
        return (rows.join(small_side(self.per_class), [*self.by, "class"])
                .withColumn("v", shrink(F.col("h"), F.col("x"), F.col("alpha"), F.col("beta"),
                                        F.col("cv2"), self.s.sigma_um))
                .drop("alpha", "beta", "cv2"))

    def weigh(self, window: DataFrame) -> DataFrame:
        """The rows of a window the model was made of, with columns that it does not hold."""
        span = settle(self.fit.select(*self.by, "lo", "width"))
        cls = clamped_bin(F.col("x"), F.col("lo"), F.col("width"), self.s.size_classes)
        return self._weighed(window.join(small_side(span), self.by).withColumn(
            "class", cls).drop("lo", "width"))

    @property
    def hybrid(self) -> DataFrame:
        return with_components(self.fit, self.s.prior_count)

    @property
    def model(self) -> DataFrame:
        return with_components(self.fit, None)

    def raw(self, tie: Column) -> DataFrame:
        return raw_estimate(self.rows, self.by, tie)

    def ipw(self, tie: Column) -> DataFrame:
        q = weighted_quantiles(self.rows, self.by, "h", "w_ipw", tie, QS)
        return ipw_moments(self.table, self.by).join(q, self.by)

    def hybrid_estimate(self, qs: Mapping[str, float] = QS) -> DataFrame:
        smooth = self.hybrid
        return mixture_moments(self.rows, smooth, self.by).join(
            mixture_quantiles(self.rows, smooth, self.by, qs), self.by)

    def model_estimate(self, qs: Mapping[str, float] = QS) -> DataFrame:
        smooth, none = self.model, self.rows.filter(F.lit(False))
        return mixture_moments(none, smooth, self.by).join(
            mixture_quantiles(none, smooth, self.by, qs), self.by)

    def summary(self) -> DataFrame:
        return self.fit.select(
            *self.by, F.col("n_window").cast("bigint").alias("n"),
            F.col("beta").alias("fit_beta"), F.sqrt("cv2").alias("cv_within"),
            F.col("cv2_unclipped").alias("cv2_within_unclipped"))


def corrected_histogram(model: WindowModel, lo: float, width: float, n: int) -> DataFrame:
    """Hybrid estimate of the distribution as shares per bin, summing to one per window."""
    from winnow.operators.project import histogram

    by = model.by
    seen = histogram(model.rows, by, "v", lo, width, n, F.col("w"), closed=True)
    a = F.lit(lo) + F.col("bin") * F.lit(width)
    b = F.lit(lo) + (F.col("bin") + 1) * F.lit(width)
    comps = F.col("comps")
    grid = model.hybrid.select(*by, "comps", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("bin"))
    mass = grid.join(seen, [*by, "bin"], "left").select(
        *by, "bin", (F.coalesce("n", F.lit(0.0)) + smooth_cdf(comps, b) - smooth_cdf(comps, a))
        .alias("_mass"))
    total = mass.groupBy(*by).agg(F.sum("_mass").alias("_total"))
    return mass.join(total, by).select(*by, "bin", ratio(F.col("_mass"), F.col("_total"))
                                       .alias("share"))


def class_display(table: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """All classes of each window with size, observed and true share and weight."""
    by = list(by)
    total = table.groupBy(*by).agg(F.sum("n").alias("_nw"), F.first("lo").alias("lo"),
                                   F.first("width").alias("width"))
    dense = total.select("*", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("class"))
    out = dense.join(table.select(*by, "class", "n", "f_true"), [*by, "class"], "left")
    f_obs = F.coalesce("n", F.lit(0.0)) / F.col("_nw")
    f_true = F.coalesce("f_true", F.lit(0.0))
    return out.select(
        *by, "class",
        F.exp(F.col("lo") + (F.col("class") + F.lit(0.5)) * F.col("width")).alias("size_um"),
        f_obs.alias("f_obs"), f_true.alias("f_true"),
        F.when(f_obs > 0, f_true / f_obs).alias("weight"))


#: fixed values: nine equally likely points of a standard normal
NINE_POINTS = (-1.593, -0.967, -0.589, -0.282, 0.0, 0.282, 0.589, 0.967, 1.593)


def class_mean_d10(rows: DataFrame, table: DataFrame, by: Sequence[str], sigma: float,
                   min_count: int, p: float = 0.1) -> DataFrame:
    """Lighter correction: readings pulled to class means, sparse classes taken from the trend.

    The answer is the first value whose running weight reaches p.
    """
    by = list(by)
    centre = "(lo+(c.class+0.5D)*width)"
    y = "ln(c.s1/c.n)"
    t = f"exp(alpha+beta*{centre})"
    fit = (
        class_arrays(table, by)
        .selectExpr("*", "filter(cells, c -> c.n > 0D and c.s1 > 0D) as _ok",
                    "filter(cells, c -> c.n > 0D) as _seen")
        .selectExpr("*", f"{_fold('_ok', 'c.n')} as _sw", f"{_fold('_seen', 'c.n')} as _n")
        .selectExpr("*", f"{_fold('_ok', f'c.n*{centre}')}/_sw as _mx",
                    f"{_fold('_ok', f'c.n*{y}')}/_sw as _my")
        .selectExpr("*", f"{_fold('_ok', f'c.n*({centre}-_mx)*({centre}-_mx)')} as _sxx",
                    f"{_fold('_ok', f'c.n*({centre}-_mx)*({y}-_my)')} as _sxy")
        .selectExpr("*", "_sxy/greatest(_sxx, 1e-12D) as beta")
        .selectExpr("*", "_my-beta*_mx as alpha")
        .selectExpr("*", f"{_fold('_seen', f'(c.s2-2D*{t}*c.s1+c.n*{t}*{t})/({t}*{t})')} as _res")
        .selectExpr(*by, "alpha", "beta",
                    f"sqrt(greatest(0D, _res/_n-pow({float(sigma)!r}D/exp(alpha+beta*_mx), 2D)))"
                    " as _cv"))
    # stored: a later null filter would otherwise be pushed down with every fold inlined
    fit = settle(fit)
    mean = F.col("s1") / F.col("n")
    var = F.col("s2") / F.col("n") - mean * mean
    keep = F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - F.lit(sigma * sigma)
                             / F.greatest(var, F.lit(1e-12))))
    dense = rows.select(*by, "class", "h").join(
        table.filter(F.col("n") >= min_count)
        .select(*by, "class", "n", "s1", "s2", "f_true"), [*by, "class"])
    items = dense.select(*by, (mean + keep * (F.col("h") - mean)).alias("v"),
                         (F.col("f_true") / F.col("n")).alias("w"))
    sparse = table.filter((F.col("n") < min_count) & (F.col("f_true") > 0)).join(fit, by)
    trend = F.exp(F.col("alpha") + F.col("beta")
                  * (F.col("lo") + (F.col("class") + F.lit(0.5)) * F.col("width")))
    z = F.explode(F.array(*[F.lit(v) for v in NINE_POINTS])).alias("_z")
    drawn = sparse.select("*", z).select(
        *by, (trend * (F.lit(1.0) + F.col("_cv") * F.col("_z"))).alias("v"),
        (F.col("f_true") / len(NINE_POINTS)).alias("w"))
    ranked = running_sums(items.unionByName(drawn), by, "v", {"w": F.col("w")})
    # running weights are sums of shares: leave room for the order of their additions
    reached = F.col("w_before") + F.col("w") >= p - 1e-12
    return ranked.groupBy(*by).agg(
        F.coalesce(F.min(F.when(reached, F.col("v"))), F.max("v")).alias("d10"))


# -- bootstrap ----------------------------------------------------------------------------------------


def poisson_count(u: Column) -> Column:
    """Poisson(1) count by its inverse distribution function, to the last bit of a uniform."""
    import math

    out, cum = F.lit(0.0), 0.0
    for k in range(poisson_terms()):
        cum += math.exp(-1.0) / math.factorial(k)
        out = out + (u >= cum).cast("double")
    return out


def resampled_rows(rows: DataFrame, reps: int, keys: Sequence[str | Column]) -> DataFrame:
    """Every row once per replicate in which it occurs, with its count ``c``.

    One digest per row and four replicates; lambda arguments are evaluated once, so neither the
    digest nor a uniform is computed again for each comparison.  Rows are spread by their own
    key first: adaptive execution sizes partitions by bytes before the explode, not after.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    quad = rows.repartition(parts, *keys).select("*", F.explode(F.sequence(
        F.lit(0), F.lit((reps - 1) // 4))).alias("_q"))
    digest = F.md5(F.concat_ws(":", *[col(k).cast("string") for k in [*keys, "_q"]]))

    def words(d: Column) -> Column:
        return F.array(*[F.conv(F.substring(d, 1 + 8 * w, 8), 16, 10).cast("bigint")
                         / F.lit(4294967296.0) for w in range(4)])

    uniforms = F.flatten(F.transform(F.array(digest), words))
    counts = F.transform(uniforms, lambda u: poisson_count(u))
    return (quad.select(*rows.columns, "_q", F.posexplode(counts).alias("_w", "c"))
            .withColumn("rep", (F.col("_q") * 4 + F.col("_w")).cast("bigint"))
            .filter((F.col("c") > 0) & (F.col("rep") < reps)).drop("_q", "_w"))


def resampled_shares(model: WindowModel, sample: DataFrame, keys: Sequence[str],
                     reps: int) -> DataFrame:
    """Class shares of a finite reference, resampled like the window itself."""
    by = model.by
    span = model.fit.select(*by, "lo", "width")
    cls = clamped_bin(F.col("log_size"), F.col("lo"), F.col("width"), model.s.size_classes)
    drawn = resampled_rows(sample.join(span, by).select(*by, *keys, cls.alias("class")), reps,
                           [F.lit("ref"), *keys])
    own = drawn.groupBy(*by, "rep", "class").agg(F.sum("c").alias("_c"))
    total = own.groupBy(*by, "rep").agg(F.sum("_c").alias("_t"))
    return own.join(total, [*by, "rep"]).select(*by, "rep", "class",
                                                (F.col("_c") / F.col("_t")).alias("_f"))


def binomial_draws(n: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Exact binomial counts by inversion: the first count whose distribution exceeds u.

    The smaller of p and 1 - p is drawn, so the sum starts where there is mass; terms run in
    logarithms, so large n do not underflow.
    """
    n, flip = n.astype(np.int64), p > 0.5
    q = np.where(flip, 1.0 - p, p)
    u = np.where(flip, 1.0 - u, u)
    with np.errstate(divide="ignore"):
        log_odds, term = np.log(q) - np.log1p(-q), n * np.log1p(-q)
    out, total = np.zeros(len(n), np.int64), np.exp(term)
    open_ = (total <= u) & (n > 0) & (q > 0)
    while open_.any():
        k = out[open_]
        term[open_] += np.log((n[open_] - k) / (k + 1.0)) + log_odds[open_]
        out[open_] += 1
        total[open_] += np.exp(term[open_])
        open_ &= (total <= u) & (out < n)
    return np.where(flip, n - out, out)


def multinomial_shares(table: DataFrame, by: Sequence[str], n_effective: int, reps: int
                       ) -> DataFrame:
    """Class shares of a reference that is known by its shares and its size alone, such as a
    certificate or a histogram: (by, rep, class, _f), ``reps`` times ``n_effective`` objects dealt out.

    A class takes a binomial share of what the classes before it have left.
    """
    by = list(by)
    arrays = table.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("class", "f_true")))
                                    .alias("_cells"))  # as many as size classes
    rows = arrays.select(*by, "_cells", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    rows = rows.repartition(*by, "rep").withColumn("_u", F.transform("_cells", lambda c: uniform(
        F.lit("mn"), *by, "rep", c["class"])))

    def deal(shares: pd.Series, us: pd.Series) -> pd.Series:
        out = np.empty(len(shares), object)
        lengths = shares.map(len).to_numpy()
        for size in np.unique(lengths):
            at = np.flatnonzero(lengths == size)
            f, u = np.stack(shares.iloc[at].tolist()), np.stack(us.iloc[at].tolist())
            left, rest = np.full(len(at), n_effective, np.int64), f.sum(axis=1)
            counts = np.zeros_like(f)
            for k in range(size):
                p = np.divide(f[:, k], rest, out=np.zeros(len(at)), where=rest > 0)
                last = np.full(len(at), k == size - 1)
                counts[:, k] = np.where(last | (p >= 1.0), left, binomial_draws(
                    left, np.clip(p, 0.0, 1.0), u[:, k]))
                left = left - counts[:, k].astype(np.int64)
                rest = rest - f[:, k]
            for i, row in zip(at, counts / n_effective):
                out[i] = row
        return pd.Series(out)

    dealt = F.pandas_udf(deal, "array<double>")(F.transform("_cells", lambda c: c["f_true"]), F.col("_u"))
    return rows.select(*by, "rep", F.explode(F.arrays_zip(
        F.transform("_cells", lambda c: c["class"]).alias("class"), dealt.alias("_f"))).alias("_c")
                       ).select(*by, "rep", F.col("_c.class").alias("class"), F.col("_c._f").alias("_f"))


def bootstrap_d10(model: WindowModel, keys: Sequence[str], reps: int,
                  sample: tuple[DataFrame, Sequence[str]] | None = None,
                  rows_per_bucket: int | None = None,
                  n_effective: int | None = None) -> DataFrame:
    """Hybrid d10 of every replicate of every window in ``model``.

    Readings keep the class and the shrinkage of the full window, as counts change only the
    class sums, the fit and the weights.  ``sample`` (rows, keys) is a finite reference, whose
    class shares are resampled too; ``n_effective`` is the size of one known by its shares only.
    """
    by, s = model.by, model.s
    rep = [*by, "rep"]
    parted = cut_parts(model.rows.select(*by, *keys, "class", "h", "v"), by, keys, "v",
                       rows_per_bucket)
    parts = part_sums(parted, by, "v", reps, moment="h")
    sums = settle(replicate_sums(parts, by, ("n", "s1", "s2")))
    seen = sums.select(*rep).distinct()
    fixed = model.table.select(*by, "class", "lo", "width", "f_true", "x_ref", "x_obs")
    full = (seen.join(fixed, by).join(sums, [*rep, "class"], "left")
            .fillna(0.0, subset=["n", "s1", "s2"]))
    if sample is not None or n_effective is not None:
        shares = (multinomial_shares(model.table, by, n_effective, reps) if sample is None
                  else resampled_shares(model, sample[0], sample[1], reps))
        full = full.drop("f_true").join(shares, [*rep, "class"], "left").withColumn(
            "f_true", F.coalesce("_f", F.lit(0.0))).drop("_f")
    full = settle(full)
    fit = settle(fit_trend(class_arrays(full, rep), s.sigma_um, s.size_noise_um))
    weights = full.filter("n > 0").select(*rep, "class", object_weight(
        F.col("n"), F.col("f_true"), s.prior_count).alias("_w"))
    smooth = with_components(fit, s.prior_count).select(*rep, "comps")
    goals = seen.select(*rep, F.lit("d10").alias("q"), F.lit(0.1).alias("p"))
    found = crossings(parted, parts, weights, goals, by, "v", reps, smooth)
    rows = smooth.withColumn("q", F.lit("d10")).withColumn("p", F.lit(0.1)).join(
        found.drop("p"), [*rep, "q"], "left")
    return _roots(rows.withColumn("v_end", F.col("below")).withColumn(
        "_f_before", F.when(F.col("v").isNotNull(), F.col("w_before") + smooth_cdf(
            F.col("comps"), F.coalesce("v", F.lit(0.0))))), rep, {"d10": 0.1})


def bootstrap_raw_d10(rows: DataFrame, by: Sequence[str], keys: Sequence[str], reps: int,
                      p: float = 0.1, rows_per_bucket: int | None = None) -> DataFrame:
    """Plain quantile of the readings of every replicate; a drawn reading stays one row with
    its count."""
    rep = [*by, "rep"]
    rows = rows.filter("h is not null").select(*by, *keys, "h", F.lit(0).alias("class"))
    parted = cut_parts(rows, by, keys, "h", rows_per_bucket)
    parts = part_sums(parted, by, "h", reps)
    total = settle(replicate_sums(parts, by))
    weights = total.select(*rep, "class", F.lit(1.0).alias("_w"))
    at = F.lit(float(p)) * (F.col("n") - 1)
    # the reading of rank r is the first at which r + 1 are counted
    goals = total.select(*rep, F.explode(F.array(*[
        F.struct(F.lit(q).alias("q"), (f(at).cast("double") + 0.5).alias("p"))
        for q, f in (("lo", F.floor), ("hi", F.ceil))])).alias("_g")).select(*rep, "_g.*")
    found = crossings(parted, parts, weights, goals, by, "h", reps).groupBy(*rep).agg(*[
        F.max(F.when(F.col("q") == q, F.col("v"))).alias(f"_{q}") for q in ("lo", "hi")])
    lo, hi = F.col("_lo"), F.col("_hi")
    return found.join(total.select(*rep, "n"), rep).select(
        *rep, (lo + (hi - lo) * (at - F.floor(at))).alias("d10"))


def bootstrap_ipw_d10(rows: DataFrame, table: DataFrame, by: Sequence[str], keys: Sequence[str],
                      reps: int, p: float = 0.1, shares: DataFrame | None = None,
                      rows_per_bucket: int | None = None) -> DataFrame:
    """First reading at which the untrimmed weights of a replicate reach ``p`` of their sum.

    ``table`` has the true share of each class; ``shares`` (by, rep, class, _f) replaces it where
    the reference is a finite sample and is resampled too.
    """
    rep = [*by, "rep"]
    rows = rows.filter("h is not null")
    parted = cut_parts(rows.select(*by, *keys, "class", "h"), by, keys, "h", rows_per_bucket)
    parts = part_sums(parted, by, "h", reps)
    per = settle(replicate_sums(parts, by))
    if shares is None:
        per = per.join(table.select(*by, "class", F.col("f_true").alias("_f")), [*by, "class"])
    else:
        per = per.join(shares, [*rep, "class"], "left").fillna(0.0, subset=["_f"])
    weights = settle(per.select(*rep, "class", (F.col("_f") / F.col("n")).alias("_w"), "_f"))
    # running weights are sums of shares: leave room for the order of their additions
    goals = weights.groupBy(*rep).agg((p * F.sum("_f") - 1e-12).alias("p")).select(
        *rep, F.lit("d10").alias("q"), "p")
    found = crossings(parted, parts, weights.drop("_f"), goals, by, "h", reps)
    return found.select(*rep, F.col("v").alias("d10"))


def bootstrap_interval(d10: DataFrame, by: Sequence[str], interval: float,
                       spec: float) -> DataFrame:
    """Interval of the replicates and the share of them that meets the specification."""
    tail, d10 = 0.5 * (1.0 - interval), settle(d10)  # read twice
    q = exact_quantiles(d10, by, "d10", {"d10_lo": tail, "d10_hi": 1.0 - tail})
    p = d10.groupBy(*by).agg(F.avg((F.col("d10") >= spec).cast("double")).alias("p_spec"))
    return q.join(p, list(by))


