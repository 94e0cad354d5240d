"""Queries: aggregates and quality metrics."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from winnow.functions.exprs import edge_bin, r6
from winnow.operators import aggregates as A
from winnow.operators import primitives as N
from winnow.plans import fixtures as X
from winnow.plans.basics import _EDGES, edge_sql
from winnow.plans.fixtures import u_duck, u_spark
from winnow.plans.registry import query
from winnow.plans.sqlparts import interp, weighted_points
from winnow.settings import DEFAULTS as S

BS = ["batch_id", "step"]


def _rounded(df, *names):
    for n in names:
        df = df.withColumn(n, r6(n))
    return df


def _weighted(spark, sf):
    return X.win(spark, sf).filter("accepted").withColumn(
        "w", F.lit(1e9) / F.pow("size_um", F.lit(3.0)))


_WSQL = {"wsample": "SELECT *, 1e9/power(size_um,3e0) AS w FROM win WHERE accepted"}


@query("a1_weighted_moments", """
SELECT batch_id, step, round(mean,6) AS mean, round(var,6) AS var,
  CASE WHEN mean>0 THEN round(sqrt(var)/mean,6) END AS cv
FROM (SELECT batch_id, step, mean, sum(w*(thickness_um-mean)*(thickness_um-mean))/sum(w) AS var
  FROM (SELECT *, sum(w*thickness_um) OVER g/sum(w) OVER g AS mean FROM wsample
        WINDOW g AS (PARTITION BY batch_id, step)) GROUP BY 1,2,3)""", _WSQL)
def _(spark, sf):
    return _rounded(A.weighted_moments(_weighted(spark, sf), BS, "thickness_um", "w"),
                    "mean", "var", "cv")


@query("a2_weighted_quantile", f"""
SELECT batch_id, step, round({interp('', '', 0.1)},6) AS d10, round({interp('', '', 0.5)},6)
  AS d50, round({interp('', '', 0.9)},6) AS d90
FROM ({weighted_points('wsample', 'batch_id, step', 'thickness_um', 'w', 'rid, w')})
GROUP BY 1,2""", _WSQL)
def _(spark, sf):
    out = N.weighted_quantiles(_weighted(spark, sf), BS, "thickness_um", "w",
                               F.struct("rid", "w"), {"d10": 0.1, "d50": 0.5, "d90": 0.9})
    return _rounded(out, "d10", "d50", "d90")


@query("a2_weighted_quantile_global", f"""
SELECT round({interp('', '', 0.1)},6) AS d10, round({interp('', '', 0.5)},6) AS d50
FROM (SELECT v, c FROM ({weighted_points("(SELECT 1 AS g, * FROM wsample)", 'g',
                                         'thickness_um', 'w', 'rid, w')}))""", _WSQL)
def _(spark, sf):
    out = N.weighted_quantiles(_weighted(spark, sf), [], "thickness_um", "w",
                               F.struct("rid", "w"), {"d10": 0.1, "d50": 0.5}, 10_000)
    return _rounded(out, "d10", "d50")


@query("a3_linear_quantile", """
SELECT batch_id, step, round(quantile_cont(thickness_um,0.1),6) AS q10,
  round(quantile_cont(thickness_um,0.5),6) AS q50, round(quantile_cont(thickness_um,0.9),6) AS q90
FROM win WHERE accepted GROUP BY 1,2""")
def _(spark, sf):
    out = N.exact_quantiles(X.win(spark, sf).filter("accepted"), BS, "thickness_um",
                            {"q10": 0.1, "q50": 0.5, "q90": 0.9})
    return _rounded(out, "q10", "q50", "q90")


@query("a3_linear_quantile_global", """
SELECT round(quantile_cont(h_um,0.1),6) AS q10, round(quantile_cont(h_um,0.5),6) AS q50 FROM bed
""")
def _(spark, sf):
    out = N.exact_quantiles(X.bed(spark, sf), [], "h_um", {"q10": 0.1, "q50": 0.5},
                            rows_per_bucket=10_000)
    return _rounded(out, "q10", "q50")


@query("a4_nearest_rank_quantile", """
SELECT batch_id, step, round(max(h_um) FILTER (r=least(n-1,floor(0.1e0*n))),6) AS d10,
  round(max(h_um) FILTER (r=least(n-1,floor(0.5e0*n))),6) AS d50,
  round(max(h_um) FILTER (r=least(n-1,floor(0.9e0*n))),6) AS d90
FROM (SELECT *, row_number() OVER (PARTITION BY batch_id, step ORDER BY h_um)-1 AS r,
  count(*) OVER (PARTITION BY batch_id, step) AS n FROM bed WHERE true_class=0) GROUP BY 1,2""")
def _(spark, sf):
    out = N.exact_quantiles(X.bed(spark, sf).filter("true_class=0"), BS, "h_um",
                            {"d10": 0.1, "d50": 0.5, "d90": 0.9}, kind="nearest")
    return _rounded(out, "d10", "d50", "d90")


@query("a5_robust_spread", """
SELECT truth, round(med,6) AS median, round(1.4826e0*median(abs(error_um-med)),6) AS spread
FROM (SELECT p.truth, error_um, med FROM pred p JOIN (SELECT truth, median(error_um) AS med
      FROM pred GROUP BY 1) USING (truth)) GROUP BY truth, med""")
def _(spark, sf):
    return _rounded(A.robust_spread(X.pred(spark, sf), ["truth"], "error_um"),
                    "median", "spread")


@query("a6_kish_ess", """
SELECT batch_id, step, round(sum(w)*sum(w)/sum(w*w),6) AS ess FROM wsample GROUP BY 1,2""",
       _WSQL)
def _(spark, sf):
    return _weighted(spark, sf).groupBy(*BS).agg(r6(A.kish_ess(F.col("w"))).alias("ess"))


@query("a7_class_moments", """
SELECT batch_id, step, floor((size_um-500e0)/50e0)::BIGINT AS class, count(*)::DOUBLE AS n,
  round(sum(thickness_um),6) AS s1, round(sum(thickness_um*thickness_um),5) AS s2
FROM win WHERE accepted GROUP BY 1,2,3""")
def _(spark, sf):
    df = X.win(spark, sf).filter("accepted").withColumn(
        "class", F.floor((F.col("size_um") - 500.0) / 50.0))
    out = A.class_moments(df, [*BS, "class"], "thickness_um")
    return out.withColumn("s1", r6("s1")).withColumn("s2", r6("s2", 5))


@query("a8_weighted_line", """
SELECT batch_id, step, round(slope,6) AS slope, round(my-slope*mx,6) AS intercept FROM (
 SELECT batch_id, step, mx, my, CASE WHEN sum(w*(x-mx)*(x-mx))>0 THEN
   sum(w*(x-mx)*(y-my))/sum(w*(x-mx)*(x-mx)) ELSE 0e0 END AS slope FROM (
  SELECT *, sum(w*x) OVER g/sum(w) OVER g AS mx, sum(w*y) OVER g/sum(w) OVER g AS my
  FROM (SELECT batch_id, step, w, ln(size_um) AS x, thickness_um AS y FROM wsample)
  WINDOW g AS (PARTITION BY batch_id, step)) GROUP BY 1,2,3,4)""", _WSQL)
def _(spark, sf):
    df = _weighted(spark, sf).withColumn("x", F.log("size_um"))
    return _rounded(A.weighted_line(df, BS, "x", "thickness_um", "w"), "slope", "intercept")


@query("a9_ordinary_line", """
SELECT batch_id, round(regr_slope(ln(h_um), ln((step+1)*60e0)),6) AS loglog_slope,
  round(regr_intercept(ln(h_um), ln((step+1)*60e0)),6) AS loglog_intercept
FROM bed WHERE true_class=0 AND step BETWEEN 10 AND 70 GROUP BY 1""")
def _(spark, sf):
    df = X.bed(spark, sf).filter("true_class=0 and step between 10 and 70").select(
        "batch_id", F.log("h_um").alias("y"), F.log((F.col("step") + 1) * 60.0).alias("x"))
    return df.groupBy("batch_id").agg(r6(F.regr_slope("y", "x")).alias("loglog_slope"),
                                      r6(F.regr_intercept("y", "x")).alias("loglog_intercept"))


@query("a10_size_trend", """
SELECT b.batch_id, b.step, n, round(exponent,6) AS exponent,
  round(stddev_pop(exp(ln(h_um)-my-exponent*(ln(core_um)-mx)))
        /avg(exp(ln(h_um)-my-exponent*(ln(core_um)-mx))),6) AS cv_within,
  round(exp(exponent*(q90-q10)),6) AS growth_ratio
FROM bed b JOIN (SELECT batch_id, step, count(*) AS n,
   regr_slope(ln(h_um), ln(core_um)) AS exponent, avg(ln(core_um)) AS mx, avg(ln(h_um)) AS my,
   quantile_cont(ln(core_um),0.1) AS q10, quantile_cont(ln(core_um),0.9) AS q90
   FROM bed WHERE true_class=0 AND h_um>0 GROUP BY 1,2 HAVING count(*)>10) USING (batch_id, step)
WHERE true_class=0 AND h_um>0 GROUP BY b.batch_id, b.step, n, exponent, q10, q90""")
def _(spark, sf):
    out = A.size_trend(X.bed(spark, sf).filter("true_class=0"), BS, "core_um", "h_um")
    return _rounded(out, "exponent", "cv_within", "growth_ratio")


TRUTH_SQL = {"truth0": """
SELECT batch_id, step, avg(h_um) FILTER (true_class=0) AS mean_um,
  stddev_pop(h_um) FILTER (true_class=0)/avg(h_um) FILTER (true_class=0) AS cv,
  avg((h_um<12e0)::INT) FILTER (true_class=0) AS frac_below_spec,
  count(*) FILTER (true_class=0) AS n_single, count(*) FILTER (true_class=1) AS n_twin,
  100e0*count(*) FILTER (true_class=1)/count(*) AS agglomerate_pct FROM bed GROUP BY 1,2""",
             "truthq": """
SELECT batch_id, step, max(h_um) FILTER (r=least(n-1,floor(0.1e0*n))) AS d10_um,
  max(h_um) FILTER (r=least(n-1,floor(0.5e0*n))) AS d50_um,
  max(h_um) FILTER (r=least(n-1,floor(0.9e0*n))) AS d90_um
FROM (SELECT *, row_number() OVER (PARTITION BY batch_id, step ORDER BY h_um)-1 AS r,
  count(*) OVER (PARTITION BY batch_id, step) AS n FROM bed WHERE true_class=0) GROUP BY 1,2""",
             "truthline": "SELECT * FROM truth0 LEFT JOIN truthq USING (batch_id, step)"}


def truth_timeline(spark, sf):
    return A.population_summary(X.bed(spark, sf), BS, "h_um", "true_class", S.spec_d10_um)


@query("a11_population_summary", """
SELECT batch_id, step, round(mean_um,6) AS mean_um, round(cv,6) AS cv,
 round(frac_below_spec,6) AS frac_below_spec, n_single, n_twin,
 round(agglomerate_pct,6) AS agglomerate_pct, round(d10_um,6) AS d10_um,
 round(d50_um,6) AS d50_um, round(d90_um,6) AS d90_um FROM truthline""", TRUTH_SQL)
def _(spark, sf):
    return _rounded(truth_timeline(spark, sf), "mean_um", "cv", "frac_below_spec",
                    "agglomerate_pct", "d10_um", "d50_um", "d90_um")


@query("a12_grouped_mean", """
SELECT gamma, m, k, round(avg(bias),6) AS bias, round(avg(below_pct),6) AS below_pct,
  round(avg(stopped::INT),6) AS stopped FROM grid GROUP BY 1,2,3""")
def _(spark, sf):
    return X.grid(spark, sf).groupBy("gamma", "m", "k").agg(
        r6(F.avg("bias")).alias("bias"), r6(F.avg("below_pct")).alias("below_pct"),
        r6(F.avg(F.col("stopped").cast("double"))).alias("stopped"))


_ORDER = {"5-LOW": 0, "4-NOT SPECIFIED": 1, "3-MEDIUM": 2, "2-HIGH": 3, "1-URGENT": 4}


@query("a12_scenario_mean", """
SELECT CASE scenario WHEN '5-LOW' THEN 0 WHEN '4-NOT SPECIFIED' THEN 1 WHEN '3-MEDIUM' THEN 2
  WHEN '2-HIGH' THEN 3 WHEN '1-URGENT' THEN 4 ELSE 5 END AS rank, scenario,
  round(avg(bias),6) AS bias, round(avg(below_pct),6) AS below_pct FROM grid GROUP BY 1,2
ORDER BY 1""")
def _(spark, sf):
    df = X.grid(spark, sf)
    return (df.groupBy(A.ranked_groups(df, _ORDER, "scenario").alias("rank"), "scenario")
            .agg(r6(F.avg("bias")).alias("bias"), r6(F.avg("below_pct")).alias("below_pct"))
            .orderBy("rank"))


@query("a13_worst_cell", """
SELECT gamma, m, k, round(bias,6) AS bias FROM (
 SELECT *, row_number() OVER (PARTITION BY gamma ORDER BY abs(bias) DESC, m DESC, k DESC) AS r
 FROM (SELECT gamma, m, k, avg(bias) AS bias FROM grid GROUP BY 1,2,3)) WHERE r=1""")
def _(spark, sf):
    cells = X.grid(spark, sf).groupBy("gamma", "m", "k").agg(F.avg("bias").alias("bias"))
    return (cells.groupBy("gamma")
            .agg(F.max_by(F.struct("m", "k", "bias"), F.struct(F.abs("bias"), "m", "k"))
                 .alias("w"))
            .select("gamma", "w.m", "w.k", r6("w.bias").alias("bias")))


@query("a14_pivot", """
SELECT k, round(avg(bias) FILTER (m=0e0),6) AS m0, round(avg(bias) FILTER (m=1e0),6) AS m1,
 round(avg(bias) FILTER (m=2e0),6) AS m2, round(avg(bias) FILTER (m=3e0),6) AS m3,
 round(avg(bias) FILTER (m=4e0),6) AS m4 FROM grid WHERE gamma=0e0 GROUP BY 1""")
def _(spark, sf):
    wide = (X.grid(spark, sf).filter("gamma = 0e0").groupBy("k")
            .pivot("m", [0.0, 1.0, 2.0, 3.0, 4.0]).agg(r6(F.avg("bias"))))
    return wide.toDF("k", "m0", "m1", "m2", "m3", "m4")


@query("a15_status_shares", """
SELECT truth, status, n, round(n/sum(n) OVER (PARTITION BY truth),6) AS share
FROM (SELECT truth, status, count(*) AS n FROM pred GROUP BY 1,2)""")
def _(spark, sf):
    return _rounded(A.value_shares(X.pred(spark, sf), ["truth"], "status"), "share")


@query("a16_confusion_matrix", """
SELECT truth, count(*) FILTER (predicted=0) AS pred_0, count(*) FILTER (predicted=1) AS pred_1,
 count(*) FILTER (predicted=2) AS pred_2 FROM pred GROUP BY 1""")
def _(spark, sf):
    return A.confusion(X.pred(spark, sf), "truth", "predicted", [0, 1, 2])


@query("a17_calibration_error", """
SELECT round(sum(n*abs(c-a))/sum(n),6) AS ece FROM (
 SELECT least(floor(confidence*10),9) AS b, count(*) AS n, avg(confidence) AS c,
  avg((truth=predicted)::INT) AS a FROM pred GROUP BY 1)""")
def _(spark, sf):
    return _rounded(A.calibration_error(X.pred(spark, sf), "confidence",
                                        F.col("truth") == F.col("predicted"), 10), "ece")


@query("a18_gate_summary", """
SELECT round(avg((truth=predicted)::INT),6) AS accuracy,
 round(1e0-avg(pass) FILTER (truth=1),6) AS twin_recall,
 round(avg(pass) FILTER (truth=1),6) AS twin_leak,
 round(avg((predicted IN (1,2))::INT) FILTER (truth=0),6) AS false_twin_rate,
 round(avg(pass) FILTER (truth=0),6) AS single_pass_rate,
 round(avg(pass) FILTER (truth<>0),6) AS non_single_leak,
 (SELECT round(sum(n*abs(c-a))/sum(n),6) FROM (
  SELECT least(floor(confidence*10),9) AS b, count(*) AS n, avg(confidence) AS c,
  avg((truth=predicted)::INT) AS a FROM pred GROUP BY 1)) AS ece
FROM (SELECT *, (predicted=0 AND confidence>=0.6e0)::INT AS pass FROM pred)""")
def _(spark, sf):
    out = A.gate_summary(X.pred(spark, sf), "truth", "predicted", "confidence", 0.6, 10)
    return _rounded(out, *out.columns)


@query("a19_dice_per_class", """
SELECT c AS class, round(2e0*count(*) FILTER (truth=c AND predicted=c)/
 nullif(count(*) FILTER (truth=c)+count(*) FILTER (predicted=c),0),6) AS dice
FROM pred, (SELECT unnest([0,1,2])::BIGINT AS c) WHERE fouling<0.8e0 GROUP BY 1""")
def _(spark, sf):
    return _rounded(A.dice(X.pred(spark, sf), "truth", "predicted", [0, 1, 2],
                           F.col("fouling") < 0.8), "dice")


@query("a20_boundary_error", """
SELECT scan_id, round(avg(abs(found_outer-tr)) FILTER (valid AND tr IS NOT NULL),6) AS mae_px,
 round(avg(abs(found_outer-tr)) FILTER (valid AND tr IS NOT NULL)*2e0,6) AS mae_um,
 count(*) FILTER (valid AND tr IS NOT NULL) AS n
FROM (SELECT *, CASE WHEN l_tax>0.01e0 THEN outer_um END AS tr FROM asc2) GROUP BY 1""")
def _(spark, sf):
    df = X.asc(spark, sf).withColumn("tr", F.when(F.col("l_tax") > 0.01, F.col("outer_um")))
    return _rounded(A.boundary_error(df, ["scan_id"], "found_outer", "tr", "valid", 2.0),
                    "mae_px", "mae_um")


@query("a21_surfaces_separate", """
SELECT scan_id, round(gap,6) AS gap, round(true_gap,6) AS true_gap,
 coalesce(gap>=0.05e0 AND abs(gap-true_gap)<=greatest(0.05e0,0.005e0*true_gap),false) AS separate
FROM (SELECT scan_id, median(found_inner-found_outer) FILTER (valid) AS gap,
 median(inner_um-outer_um) FILTER (valid) AS true_gap FROM asc2 GROUP BY 1)""")
def _(spark, sf):
    out = A.surfaces_separate(
        X.asc(spark, sf), ["scan_id"], F.col("found_inner") - F.col("found_outer"),
        F.col("inner_um") - F.col("outer_um"), F.col("valid"), 0.05, 0.005)
    return _rounded(out, "gap", "true_gap")


@query("a22_label_boundaries", """
SELECT scan_id, k, round(avg(abs(found-want)),6) AS mean_gap FROM (
 SELECT scan_id, k, count(*) FILTER ((d>=found_outer/10e0)::INT+(d>=found_inner/10e0)::INT<k)
   AS found, count(*) FILTER ((d>=outer_um/10e0)::INT+(d>=inner_um/10e0)::INT<k) AS want
 FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY x_um, outer_um, found_outer,
   found_inner) AS n FROM asc2), (SELECT unnest(range(40)) AS d),
   (SELECT unnest([1,2])::BIGINT AS k)
 GROUP BY scan_id, rid, n, k) GROUP BY 1,2""")
def _(spark, sf):
    from winnow.operators.geometry import boundary_positions, masks

    # a key may repeat: its few rows are told apart by their number
    order = W.partitionBy("rid").orderBy("x_um", "outer_um", "found_outer", "found_inner")
    df = X.asc(spark, sf).withColumn("n", F.row_number().over(order))
    found = boundary_positions(masks(df, F.col("found_outer") / 10.0, F.col("found_inner") / 10.0,
                                     40), ["scan_id", "rid", "n"], 2)
    true = boundary_positions(masks(df, F.col("outer_um") / 10.0, F.col("inner_um") / 10.0, 40),
                              ["scan_id", "rid", "n"], 2)
    both = found.join(true.withColumnRenamed("position", "truth"), ["scan_id", "rid", "n", "k"])
    return both.groupBy("scan_id", "k").agg(
        r6(F.avg(F.abs(F.col("position") - F.col("truth")))).alias("mean_gap"))


@query("a23_pooled_median", """
SELECT batch_id, round(med,6) AS value,
 round(1.2533e0*1.4826e0*median(abs(v-med))/sqrt(count(*)),6) AS se, count(*) AS count
FROM (SELECT batch_id, thickness_um/size_um AS v, median(thickness_um/size_um)
      OVER (PARTITION BY batch_id) AS med FROM win WHERE accepted) GROUP BY batch_id, med""")
def _(spark, sf):
    df = X.win(spark, sf).withColumn("v", F.col("thickness_um") / F.col("size_um"))
    return _rounded(A.pooled_median(df, ["batch_id"], "v"), "value", "se")


@query("a24_ratio_of_sums", """
SELECT batch_id, round(sum(1.48e0*h_um)/sum(thickness_um),6) AS anchor_index,
 CASE WHEN 0.5e0*(avg(size_um)-avg(core_um))>0 THEN
  round(avg(1.48e0*h_um)/(0.5e0*(avg(size_um)-avg(core_um))),6) END AS fusion_index
FROM win WHERE accepted GROUP BY 1""")
def _(spark, sf):
    phys = F.lit(0.5) * (F.avg("size_um") - F.avg("core_um"))
    opt = F.lit(1.48) * F.col("h_um")
    return X.win(spark, sf).filter("accepted").groupBy("batch_id").agg(
        r6(F.sum(opt) / F.sum("thickness_um")).alias("anchor_index"),
        r6(F.when(phys > 0, F.avg(opt) / phys)).alias("fusion_index"))


_PIX = {"pix": f"""SELECT scan_id, rid, snr_db+20e0*{u_duck('b')}-10e0 AS db,
 0.5e0*{u_duck('g1')} AS p0, 0.5e0*{u_duck('g2')} AS p1, valid FROM asc2"""}


def _pix(spark, sf):
    return X.asc(spark, sf).selectExpr(
        "scan_id", "rid", f"snr_db+20e0*{u_spark('b')}-10e0 as db",
        f"0.5e0*{u_spark('g1')} as p0", f"0.5e0*{u_spark('g2')} as p1", "valid").withColumn(
            "p2", F.lit(1.0) - F.col("p0") - F.col("p1"))


@query("a25_power_mean_db", """
SELECT scan_id, round(10e0*log10(avg(power(10e0,db/10e0))),6) AS mean_db FROM pix GROUP BY 1""",
       _PIX)
def _(spark, sf):
    return _pix(spark, sf).groupBy("scan_id").agg(
        r6(A.power_mean_db(F.col("db"))).alias("mean_db"))


@query("a26_scan_features", """
SELECT scan_id, round(avg(db),6) AS mean_db, round(max(db),6) AS max_db,
 round(coalesce(stddev_pop(power(10e0,db/10e0)) FILTER (valid)
   /avg(power(10e0,db/10e0)) FILTER (valid),0e0),6) AS contrast,
 round(avg(-p0*ln(p0+1e-9)-p1*ln(p1+1e-9)-(1e0-p0-p1)*ln((1e0-p0-p1)+1e-9)),6) AS entropy
FROM pix GROUP BY 1""", _PIX)
def _(spark, sf):
    out = A.scan_features(_pix(spark, sf), ["scan_id"], "db", F.col("valid"), ["p0", "p1", "p2"])
    return _rounded(out, "mean_db", "max_db", "contrast", "entropy")


@query("a27_noise_floor", """
SELECT scan_id, round(median(power(10e0,db/10e0))/ln(2e0),5) AS noise_floor FROM pix
WHERE NOT valid GROUP BY 1""", _PIX)
def _(spark, sf):
    df = _pix(spark, sf).filter("not valid").withColumn(
        "power", F.pow(F.lit(10.0), F.col("db") / 10.0))
    return A.noise_floor(df, ["scan_id"], "power").withColumn("noise_floor",
                                                              r6("noise_floor", 5))


@query("a28_shape_statistics", """
SELECT label, round(m3/power(m2,1.5e0),6) AS skew, round(m4/(m2*m2)-3e0,6) AS kurt,
 round(med,6) AS median, round(lo,6) AS min, round(hi,6) AS max,
 med BETWEEN (SELECT min(f1) FROM feat WHERE baseline) AND
  (SELECT max(f1) FROM feat WHERE baseline) AS inside
FROM (SELECT label, avg(power(f1-mu,2)) AS m2, avg(power(f1-mu,3)) AS m3,
  avg(power(f1-mu,4)) AS m4, median(f1) AS med, min(f1) AS lo, max(f1) AS hi
 FROM (SELECT label, f1, avg(f1) OVER (PARTITION BY label) AS mu FROM feat) GROUP BY 1)""")
def _(spark, sf):
    df = X.feat(spark, sf)
    base = df.filter("baseline").agg(F.min("f1").alias("_lo"), F.max("f1").alias("_hi"))
    stats = df.groupBy("label").agg(*A.shape(F.col("f1")), F.min("f1").alias("min"),
                                    F.max("f1").alias("max"))
    stats = stats.join(N.exact_quantiles(df, ["label"], "f1", {"median": 0.5}), "label")
    out = A.rejoin(stats, base, []).withColumn(
        "inside", F.col("median").between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
    return _rounded(out, "skew", "kurt", "median", "min", "max")


@query("a29_ks_distance", """
SELECT instrument, max(n) AS n, round(max(abs(fi-fp)),6) AS ks FROM (
 SELECT i.instrument, i.n, v.value,
  (SELECT count(*) FROM ev e WHERE e.instrument=i.instrument AND e.value<=v.value)/i.n AS fi,
  v.c/t.n AS fp
 FROM (SELECT instrument, count(*)::DOUBLE AS n FROM ev GROUP BY 1) i,
  (SELECT value, sum(count(*)) OVER (ORDER BY value) AS c FROM ev GROUP BY 1) v,
  (SELECT count(*)::DOUBLE AS n FROM ev) t) GROUP BY 1""".replace("max(n) AS n",
                                                               "max(n)::BIGINT AS n"))
def _(spark, sf):
    return _rounded(A.ks_distance(X.ev(spark, sf), ["instrument"], "value"), "ks")


_F7 = [f"f{i}" for i in range(1, 8)]
_PAIRS = [(a, b) for i, a in enumerate(_F7) for b in _F7[i:]]


@query("a30_mean_covariance", "SELECT count(*) AS n, "
       + ", ".join(f"round(avg({c}),6) AS mean_{c}" for c in _F7) + ", "
       + ", ".join(f"round(covar_samp({a},{b}),6) AS cov_{a}_{b}" for a, b in _PAIRS)
       + " FROM feat WHERE baseline")
def _(spark, sf):
    out = A.covariance(X.feat(spark, sf).filter("baseline"), _F7)
    return out.select("n", *[r6(c).alias(c) for c in out.columns if c != "n"])


CAL_SQL = {
    "calrows": f"""SELECT {edge_sql('fouling')} AS f, {edge_sql('snr_db')} AS s,
 {edge_sql('true_um')} AS t, error_um FROM pred WHERE truth=0 AND status='measured'""",
    "calroll": """SELECT f, s, t, count(*) AS n, median(error_um) AS med FROM calrows
 GROUP BY ROLLUP (f,s,t)""",
    "caldev": """SELECT r.f, r.s, r.t, r.n, r.med, 1.4826e0*median(abs(error_um-med)) AS spread
 FROM calroll r JOIN calrows c ON (r.f IS NULL OR r.f=c.f) AND (r.s IS NULL OR r.s=c.s)
  AND (r.t IS NULL OR r.t=c.t) GROUP BY ALL""",
    "caltable": """SELECT a.f, b.s, c.t, coalesce(l3.n,0) AS n,
 CASE WHEN l3.n>=15 THEN l3.med WHEN l2.n>=15 THEN l2.med WHEN l1.n>=15 THEN l1.med
  ELSE l0.med END AS bias,
 CASE WHEN l3.n>=15 THEN l3.spread WHEN l2.n>=15 THEN l2.spread WHEN l1.n>=15 THEN l1.spread
  ELSE l0.spread END AS spread
 FROM (SELECT unnest([0,1,2,3])::BIGINT AS f) a, (SELECT unnest([0,1,2])::BIGINT AS s) b,
  (SELECT unnest([0,1,2,3])::BIGINT AS t) c
 LEFT JOIN caldev l3 ON l3.f=a.f AND l3.s=b.s AND l3.t=c.t
 LEFT JOIN caldev l2 ON l2.f=a.f AND l2.s=b.s AND l2.t IS NULL
 LEFT JOIN caldev l1 ON l1.f=a.f AND l1.s IS NULL AND l1.t IS NULL
 LEFT JOIN caldev l0 ON l0.f IS NULL AND l0.s IS NULL AND l0.t IS NULL"""}


def cal_rows(spark, sf):
    return X.pred(spark, sf).select(
        edge_bin(F.col("fouling"), _EDGES["fouling"]).alias("f"),
        edge_bin(F.col("snr_db"), _EDGES["snr_db"]).alias("s"),
        edge_bin(F.col("true_um"), _EDGES["true_um"]).alias("t"),
        "truth", "status", "error_um")


def cal_table(spark, sf):
    rows = cal_rows(spark, sf).filter("truth=0 and status='measured'")
    return A.calibration_table(rows, [("f", 4), ("s", 3), ("t", 4)], "error_um",
                               S.min_cell_count)


@query("a31_calibration_table", """SELECT f, s, t, n, round(bias,6) AS bias,
 round(spread,6) AS spread FROM caltable""", CAL_SQL)
def _(spark, sf):
    return _rounded(cal_table(spark, sf), "bias", "spread")


_CURVE = ("fouling", "pigment", "snr_per_10db")
_STEPS = 40


def _curve_sql() -> dict[str, str]:
    """Newton steps of the penalised logistic fit, four unknowns, solved by Cholesky written out."""
    x = ["1e0", "fouling", "pigment", "snr_per_10db"]
    b = [f"b{i}" for i in range(4)]
    p = f"(1e0/(1e0+exp(-({'+'.join(f'{w}*{v}' for w, v in zip(b, x))}))))"
    grad = [f"sum(({p}-y)*{x[i]})" + (f"+any_value(b{i})/100e0" if i else "") for i in range(4)]
    hess = {(i, j): f"sum({p}*(1e0-{p})*{x[i]}*{x[j]})" + ("+1e0/100e0" if i == j and i else "")
            for i in range(4) for j in range(i + 1)}
    sums = ", ".join([*[f"any_value(b{i}) AS b{i}" for i in range(4)],
                      *[f"{g} AS g{i}" for i, g in enumerate(grad)],
                      *[f"{h} AS h{i}{j}" for (i, j), h in hess.items()]])
    inner = f"SELECT i, {sums} FROM anewton, aund WHERE i<{_STEPS} GROUP BY i"
    for j in range(4):
        cols = []
        for i in range(j, 4):
            s = "".join(f"-l{i}{k}*l{j}{k}" for k in range(j))
            cols.append(f"sqrt(h{j}{j}{s}) AS l{j}{j}" if i == j
                        else f"(h{i}{j}{s})/sqrt(h{j}{j}"
                        + "".join(f"-l{j}{k}*l{j}{k}" for k in range(j)) + f") AS l{i}{j}")
        inner = f"SELECT *, {', '.join(cols)} FROM ({inner})"
    for i in range(4):
        s = "".join(f"-l{i}{k}*y{k}" for k in range(i))
        inner = f"SELECT *, (g{i}{s})/l{i}{i} AS y{i} FROM ({inner})"
    for i in reversed(range(4)):
        s = "".join(f"-l{k}{i}*d{k}" for k in range(i + 1, 4))
        inner = f"SELECT *, (y{i}{s})/l{i}{i} AS d{i} FROM ({inner})"
    return {"aund": """SELECT fouling, pigment, snr_db/10e0 AS snr_per_10db,
 (status<>'measured')::INT AS y FROM pred WHERE status<>'gated'""",
            "anewton": "SELECT 0 AS i, 0e0 AS b0, 0e0 AS b1, 0e0 AS b2, 0e0 AS b3 UNION ALL SELECT i+1, "
                       + ", ".join(f"b{i}-d{i}" for i in range(4)) + f" FROM ({inner})"}


@query("a32_undecided_curve", "SELECT round(b0,3) AS intercept, "
       + ", ".join(f"round(b{i + 1},3) AS {c}" for i, c in enumerate(_CURVE))
       + f" FROM anewton WHERE i={_STEPS}", _curve_sql(), recursive=True)
def _(spark, sf):
    df = X.pred(spark, sf).filter("status <> 'gated'")
    out = A.undecided_curve(df, {"fouling": F.col("fouling"), "pigment": F.col("pigment"),
                                 "snr_per_10db": F.col("snr_db") / 10.0},
                            F.col("status") != "measured")
    return out.select(*[F.round(c, 3).alias(c) for c in out.columns])


@query("a33_leak_and_reject", """
SELECT coalesce(round(avg((status<>'gated')::INT) FILTER (predicted=1),6),0e0) AS twin_leak,
 round(avg((status='gated')::INT) FILTER (predicted=0),6) AS single_reject FROM pred""")
def _(spark, sf):
    gated = F.col("status") == "gated"
    return X.pred(spark, sf).agg(
        F.coalesce(r6(F.avg(F.when(F.col("predicted") == 1, (~gated).cast("double")))),
                   F.lit(0.0)).alias("twin_leak"),
        r6(F.avg(F.when(F.col("predicted") == 0, gated.cast("double")))).alias("single_reject"))


@query("a35_headline", """
SELECT round(avg(bias) FILTER (abs(m-3e0)<1e-8 AND abs(k-1e0)<1e-8 AND gamma=0e0),6)
  AS default_bias,
 round(avg(below_pct) FILTER (stopped AND gamma=0e0)/avg(below_pct)
  FILTER (NOT stopped AND gamma=0e0),6) AS below_ratio,
 round(avg(abs(bias)) FILTER (gamma=0e0),6) AS mean_abs_bias,
 round(max(abs(bias)) FILTER (gamma=0e0),6) AS worst_abs_bias,
 round(avg(bias) FILTER (gamma>0e0),6) AS hidden_bias,
 round(max(below_pct) FILTER (gamma>0e0),6) AS hidden_worst_below FROM grid""")
def _(spark, sf):
    def where(c, cond):
        return F.when(F.expr(cond), F.col(c))

    default = "abs(m-3e0)<1e-8 and abs(k-1e0)<1e-8 and gamma=0e0"
    return X.grid(spark, sf).agg(
        r6(F.avg(where("bias", default))).alias("default_bias"),
        r6(F.avg(where("below_pct", "stopped and gamma=0e0"))
           / F.avg(where("below_pct", "not stopped and gamma=0e0"))).alias("below_ratio"),
        r6(F.avg(F.abs(where("bias", "gamma=0e0")))).alias("mean_abs_bias"),
        r6(F.max(F.abs(where("bias", "gamma=0e0")))).alias("worst_abs_bias"),
        r6(F.avg(where("bias", "gamma>0e0"))).alias("hidden_bias"),
        r6(F.max(where("below_pct", "gamma>0e0"))).alias("hidden_worst_below"))


@query("a36_solver_tables_by_snr", """
SELECT snr_db, pellets, round(m0-1.48e0,6) AS pooled_err, round(m1-1.48e0,6) AS pooled_err_minus,
 round(m2-1.48e0,6) AS pooled_err_plus, round(fusion-1.48e0,6) AS fusion_err FROM (
 SELECT snr_db, count(*) AS pellets, median(n0) AS m0, median(n0*0.9e0) AS m1,
  median(n0*1.1e0) AS m2, avg(optical)/avg(thick) AS fusion
 FROM (SELECT snr_db, (found_inner-found_outer)/(optical_um/1.48e0) AS n0,
   found_inner-found_outer AS optical, optical_um/1.48e0 AS thick FROM asc2) GROUP BY 1)""")
def _(spark, sf):
    df = X.asc(spark, sf).select(
        "snr_db", (F.col("found_inner") - F.col("found_outer")).alias("optical"),
        (F.col("optical_um") / 1.48).alias("thick"))
    # written: its hashes are made once for the shares, the counts, the median and the spread
    df = N.settle(df.withColumn("n0", F.col("optical") / F.col("thick")))
    out = df.groupBy("snr_db").agg(F.count("*").alias("pellets"),
                                   (F.avg("optical") / F.avg("thick")).alias("fusion_err"))
    scaled = df.select("snr_db", "n0", F.explode(F.array(*map(F.lit, (1.0, 0.9, 1.1))))
                       .alias("cal")).withColumn("v", F.col("n0") * F.col("cal"))
    pooled = A.pooled_median(scaled, ["snr_db", "cal"], "v")
    wide = pooled.groupBy("snr_db").agg(*[
        F.max(F.when(F.col("cal") == c, F.col("value"))).alias(n)
        for n, c in (("pooled_err", 1.0), ("pooled_err_minus", 0.9), ("pooled_err_plus", 1.1))])
    out = out.join(wide, "snr_db")
    names = ["pooled_err", "pooled_err_minus", "pooled_err_plus", "fusion_err"]
    return out.select("snr_db", "pellets", *[r6(F.col(n) - 1.48).alias(n) for n in names])


@query("a36_solver_tables_by_thickness", """
SELECT thickness, count(*) AS columns, round(avg(gap/1.48e0-thickness),6) AS error,
 round(avg(abs(gap/1.48e0-thickness)),6) AS abs_error,
 round(avg(gap/1.5e0-thickness),6) AS assumed_error,
 round(avg(gap/1.48e0-thickness) FILTER (abs(x_um)<=60e0),6) AS error_apex,
 round(avg(gap/1.48e0-thickness) FILTER (abs(x_um)>60e0 AND abs(x_um)<=120e0),6) AS error_slope
FROM (SELECT optical_um/1.48e0 AS thickness, found_inner-found_outer AS gap, x_um FROM asc2)
GROUP BY 1""")
def _(spark, sf):
    df = X.asc(spark, sf).select(
        (F.col("optical_um") / 1.48).alias("thickness"), "x_um",
        (F.col("found_inner") - F.col("found_outer")).alias("gap"))
    err = F.col("gap") / 1.48 - F.col("thickness")
    x = F.abs("x_um")
    return df.groupBy("thickness").agg(
        F.count("*").alias("columns"), r6(F.avg(err)).alias("error"),
        r6(F.avg(F.abs(err))).alias("abs_error"),
        r6(F.avg(F.col("gap") / 1.5 - F.col("thickness"))).alias("assumed_error"),
        r6(F.avg(F.when(x <= 60, err))).alias("error_apex"),
        r6(F.avg(F.when((x > 60) & (x <= 120), err))).alias("error_slope"))
