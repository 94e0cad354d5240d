"""Queries: projections, filters, thinning and bins."""

from __future__ import annotations

from pyspark.sql import functions as F

from winnow.functions.exprs import edge_bin, no_nan, r6
from winnow.operators import project as P
from winnow.operators.primitives import microbins
from winnow.plans import fixtures as X
from winnow.plans.fixtures import u_duck, u_spark
from winnow.plans.registry import query
from winnow.settings import DEFAULTS as S


@query("prj1_accepted_filter", """
SELECT batch_id, step, count(*) FILTER (accepted) AS n_accepted,
       count(*) FILTER (gate_class=0 AND NOT accepted) AS n_undecided
FROM win GROUP BY 1,2""")
def _(spark, sf):
    return X.win(spark, sf).groupBy("batch_id", "step").agg(
        F.count_if("accepted").alias("n_accepted"),
        F.count_if(F.expr("gate_class=0 and not accepted")).alias("n_undecided"))


@query("prj2_event_label", f"""
SELECT batch_id, CASE WHEN gate=2 THEN 'fines' WHEN gate=1 AND real_single THEN 'held_back'
       WHEN gate=1 THEN 'agglomerate' ELSE 'single' END AS label, count(*) AS n
FROM (SELECT batch_id, CASE WHEN {u_duck('z')}<0.05e0 THEN 2 ELSE gate_class END AS gate,
             {u_duck('y')}<0.3e0 AS real_single FROM win) GROUP BY 1,2""")
def _(spark, sf):
    df = X.win(spark, sf).selectExpr(
        "batch_id", f"case when {u_spark('z')}<0.05e0 then 2 else gate_class end as gate",
        f"{u_spark('y')}<0.3e0 as real_single")
    return (df.withColumn("label", P.event_label(F.col("gate"), F.col("real_single")))
            .groupBy("batch_id", "label").agg(F.count("*").alias("n")))


@query("prj3_reclassify_status", """
SELECT status, new_status, count(*) AS n FROM (SELECT status,
  CASE WHEN status<>'gated' AND confidence IS NOT NULL
       THEN CASE WHEN confidence>=0.7e0 THEN 'measured' ELSE 'undecided' END
       ELSE status END AS new_status FROM pred) GROUP BY 1,2""")
def _(spark, sf):
    new = P.reclassify(F.col("status"), F.col("confidence"), 0.7).alias("new_status")
    return X.pred(spark, sf).select("status", new).groupBy("status", "new_status").agg(
        F.count("*").alias("n"))


@query("prj4_confidence_score", """
SELECT truth, round(avg(score),6) AS mean_score, round(min(score),6) AS min_score,
       round(max(score),6) AS max_score
FROM (SELECT truth, coalesce(seg*(exp(-power(defect/0.1e0,2e0))*exp(-power(error_um/2.0e0,2e0))),
                             confidence) AS score
      FROM (SELECT *, CASE WHEN status='measured' THEN solidity END AS seg FROM pred))
GROUP BY 1""")
def _(spark, sf):
    seg = F.when(F.col("status") == "measured", F.col("solidity"))
    score = P.fused_confidence(seg, F.col("defect"), F.col("error_um"), F.col("confidence"),
                               0.1, 2.0)
    return (X.pred(spark, sf).select("truth", score.alias("score")).groupBy("truth")
            .agg(r6(F.avg("score")).alias("mean_score"), r6(F.min("score")).alias("min_score"),
                 r6(F.max("score")).alias("max_score")))


@query("prj6_index_rescale", """
SELECT batch_id, round(avg(thickness_um*(1.48e0/1.5e0)),6) AS mean_rescaled,
       round(1.48e0/1.5e0-1e0,6) AS index_error FROM win WHERE accepted GROUP BY 1""")
def _(spark, sf):
    return (X.win(spark, sf).filter("accepted").groupBy("batch_id").agg(
        r6(F.avg(F.col("thickness_um") * F.lit(1.48 / 1.5))).alias("mean_rescaled"))
        .withColumn("index_error", r6(F.lit(1.48 / 1.5 - 1.0))))


@query("prj7_stride_thin", """
SELECT batch_id, rid, t_s, pos, stride FROM (
 SELECT *, greatest(1, n // 300) AS stride FROM (
  SELECT batch_id, rid, t_s, row_number() OVER (PARTITION BY batch_id ORDER BY t_s, u, rid, h_um)
         - 1 AS pos, count(*) OVER (PARTITION BY batch_id) AS n
  FROM (SELECT *, ('0x'||substr(md5(rid),1,8))::UBIGINT/4294967296.0e0 AS u FROM win)))
WHERE pos % stride = 0""")
def _(spark, sf):
    return (P.stride_thin(X.win(spark, sf), ["batch_id"], "t_s", ["rid"], 300)
            .select("batch_id", "rid", "t_s", "pos", "stride"))


@query("prj8_size_biased_thin", f"""
SELECT batch_id, count(*) AS n, round(avg(size_um),6) AS mean_size, round(avg(h_um),6) AS mean_h
FROM (SELECT *, max(size_um) OVER (PARTITION BY batch_id) AS top FROM bed)
WHERE {u_duck('w8')} < power(size_um/top, 3e0) GROUP BY 1""")
def _(spark, sf):
    return (P.size_biased_thin(X.bed(spark, sf), ["batch_id"], "size_um", 3.0, ["rid"], "w8")
            .groupBy("batch_id").agg(F.count("*").alias("n"),
                                     r6(F.avg("size_um")).alias("mean_size"),
                                     r6(F.avg("h_um")).alias("mean_h")))


@query("prj9_hidden_thin", f"""
SELECT batch_id, count(*) AS n, round(avg(size_um),6) AS mean_size,
       round(avg(l_discount),6) AS mean_hidden
FROM (SELECT *, exp(lw - max(lw) OVER (PARTITION BY batch_id)) AS p FROM (
  SELECT b.*, 3e0*ln(size_um/med)+0.5e0*((l_discount-mu)/sd) AS lw
  FROM bed b JOIN (SELECT batch_id, avg(l_discount) AS mu, stddev_pop(l_discount) AS sd,
                   quantile_cont(size_um, 0.5) AS med FROM bed GROUP BY 1) s USING (batch_id)))
WHERE {u_duck('w9')} < p GROUP BY 1""")
def _(spark, sf):
    return (P.hidden_thin(X.bed(spark, sf), ["batch_id"], "size_um", "l_discount", 3.0, 0.5,
                          ["rid"], "w9")
            .groupBy("batch_id").agg(F.count("*").alias("n"),
                                     r6(F.avg("size_um")).alias("mean_size"),
                                     r6(F.avg("l_discount")).alias("mean_hidden")))


@query("prj10_range_violations", """
SELECT rid, parameter, round(value,6) AS value, lo, hi,
  parameter||': '||printf('%.4f', value)||' not in ['||printf('%.1f', lo)||', '
  ||printf('%.1f', hi)||']' AS message
FROM (SELECT rid, 'thickness_um' AS parameter, thickness_um AS value, 2e0 AS lo, 22e0 AS hi
      FROM win
      UNION ALL SELECT rid, 'size_um', size_um, 520e0, 980e0 FROM win)
WHERE NOT (value BETWEEN lo AND hi)""")
def _(spark, sf):
    out = P.range_violations(X.win(spark, sf), ["rid"],
                             {"thickness_um": (2.0, 22.0), "size_um": (520.0, 980.0)})
    return out.withColumn("value", r6("value"))


@query("prj11_missing_values", f"""
SELECT batch_id, count(*) AS n, count(v) AS n_finite, round(avg(v),6) AS mean_finite,
       round(avg(coalesce(v,0e0)),6) AS mean_zero_filled
FROM (SELECT batch_id, CASE WHEN {u_duck('m')}<0.1e0 THEN NULL ELSE thickness_um END AS v
      FROM win) GROUP BY 1""")
def _(spark, sf):
    gap = F.expr(f"case when {u_spark('m')}<0.1e0 then double('NaN') else thickness_um end")
    return (X.win(spark, sf).select("batch_id", no_nan(gap).alias("v")).groupBy("batch_id").agg(
        F.count("*").alias("n"), F.count("v").alias("n_finite"),
        r6(F.avg("v")).alias("mean_finite"),
        r6(F.avg(F.coalesce("v", F.lit(0.0)))).alias("mean_zero_filled")))


@query("bin1_equal_width_drop", """
SELECT batch_id, step, bin, count(*) AS n FROM (
  SELECT batch_id, step, trunc((h_um-2e0)*2e0)::BIGINT AS bin FROM bed WHERE true_class=0)
WHERE bin>=0 AND bin<60 GROUP BY 1,2,3""")
def _(spark, sf):
    return P.histogram(X.bed(spark, sf).filter("true_class=0"), ["batch_id", "step"], "h_um",
                       2.0, 0.5, 60)


@query("bin2_joint_range_classes", """
SELECT batch_id, step, least(greatest(floor((x-lo)/width),0),29)::BIGINT AS class,
       count(*) FILTER (is_win) AS n_win, count(*) FILTER (NOT is_win) AS n_bed
FROM (SELECT *, (max(x) OVER g - min(x) OVER g)/30 AS width, min(x) OVER g AS lo,
        count(*) FILTER (is_win) OVER g AS nw
  FROM (SELECT batch_id, step, ln(size_um) AS x, true AS is_win FROM win WHERE accepted
        UNION ALL SELECT batch_id, step, ln(size_um), false FROM bed WHERE true_class=0)
  WINDOW g AS (PARTITION BY batch_id, step)) WHERE nw > 0 GROUP BY 1,2,3""")
def _(spark, sf):
    x = F.log("size_um").alias("x")
    by = ["batch_id", "step"]
    a, b = P.joint_classes(X.win(spark, sf).filter("accepted").select(*by, x),
                           X.bed(spark, sf).filter("true_class=0").select(*by, x), by, "x",
                           S.size_classes)
    both = a.select(*by, "class", F.lit(True).alias("w")).union(
        b.select(*by, "class", F.lit(False)))
    return both.groupBy(*by, "class").agg(F.count_if("w").alias("n_win"),
                                          F.count_if(~F.col("w")).alias("n_bed"))


_EDGES = {"fouling": (0.0, 0.25, 0.5, 0.75, 1.0), "snr_db": (15.0, 25.0, 35.0, 45.0),
          "true_um": (2.0, 6.0, 12.0, 20.0, 40.0)}


def edge_sql(v: str) -> str:
    edges = _EDGES[v]
    arms = " ".join(f"WHEN {v}>={e!r}e0 THEN {i}" for i, e in reversed(
        list(enumerate(edges))[1:-1]))
    return f"(CASE {arms} ELSE 0 END)::BIGINT"


@query("bin3_explicit_edges", f"""
SELECT {edge_sql('fouling')} AS f, {edge_sql('snr_db')} AS s, {edge_sql('true_um')} AS t,
       count(*) AS n FROM pred GROUP BY 1,2,3""")
def _(spark, sf):
    return X.pred(spark, sf).groupBy(
        edge_bin(F.col("fouling"), _EDGES["fouling"]).alias("f"),
        edge_bin(F.col("snr_db"), _EDGES["snr_db"]).alias("s"),
        edge_bin(F.col("true_um"), _EDGES["true_um"]).alias("t")).agg(F.count("*").alias("n"))


@query("bin4_histogram_closed", """
SELECT batch_id, bin, round(sum(size_um),6) AS n FROM (
  SELECT batch_id, size_um, least(floor((thickness_um-0e0)/0.5e0),49)::BIGINT AS bin
  FROM win WHERE accepted AND thickness_um BETWEEN 0e0 AND 25e0) GROUP BY 1,2""")
def _(spark, sf):
    out = P.histogram(X.win(spark, sf).filter("accepted"), ["batch_id"], "thickness_um", 0.0,
                      0.5, 50, F.col("size_um"), closed=True)
    return out.withColumn("n", r6("n"))


_HIST = """SELECT batch_id, step, bin, count(*) AS n FROM (
  SELECT batch_id, step, trunc(h_um*2e0)::BIGINT AS bin FROM bed WHERE true_class=0)
  WHERE bin>=0 AND bin<50 GROUP BY 1,2,3"""


def _hist(spark, sf):
    return P.histogram(X.bed(spark, sf).filter("true_class=0"), ["batch_id", "step"], "h_um",
                       0.0, 0.5, 50)


@query("bin5_merge_bins", f"""
SELECT batch_id, step, bin//3 AS bin, sum(n)::BIGINT AS n FROM ({_HIST}) WHERE bin < 48
GROUP BY ALL""")
def _(spark, sf):
    return P.merge_bins(_hist(spark, sf), ["batch_id", "step"], 50, 3)


@query("bin6_shares", f"""
SELECT batch_id, step, bin, n, round(n/sum(n) OVER (PARTITION BY batch_id, step),6) AS share
FROM ({_HIST})""")
def _(spark, sf):
    return P.shares(_hist(spark, sf), ["batch_id", "step"]).withColumn("share", r6("share"))


@query("p2_uniform_moments", f"""
SELECT batch_id, count(*) AS n, round(avg(u),6) AS mean_u, round(var_pop(u),6) AS var_u
FROM (SELECT batch_id, {u_duck('q')} AS u FROM bed) GROUP BY 1""")
def _(spark, sf):
    return (X.bed(spark, sf).selectExpr("batch_id", f"{u_spark('q')} as u").groupBy("batch_id")
            .agg(F.count("*").alias("n"), r6(F.avg("u")).alias("mean_u"),
                 r6(F.var_pop("u")).alias("var_u")))


@query("p5_microbins", """
SELECT batch_id, step, round((cell+0.5e0)*0.001e0,6) AS h_um, n FROM (
  SELECT batch_id, step, floor(h_um/0.001e0) AS cell, count(*) AS n FROM bed GROUP BY 1,2,3)""")
def _(spark, sf):
    out = microbins(X.bed(spark, sf), ["batch_id", "step"], "h_um", 0.001,
                    {"n": F.lit(1).cast("bigint")})
    return out.withColumn("h_um", r6("h_um")).select("batch_id", "step", "h_um", "n")
