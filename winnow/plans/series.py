"""Queries: joins, functions over steps, picks and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from winnow.functions.exprs import edge_bin, r6
from winnow.operators import aggregates as A
from winnow.operators import joins as J
from winnow.operators import picks as K
from winnow.operators import primitives as N
from winnow.operators import windows as V
from winnow.plans import fixtures as X
from winnow.plans.basics import _EDGES, edge_sql
from winnow.plans.fixtures import u_duck, u_spark
from winnow.plans.measures import BS, CAL_SQL, TRUTH_SQL, _rounded, cal_table, truth_timeline
from winnow.plans.registry import cte, query
from winnow.settings import DEFAULTS as S

# -- per-step aggregates on the full grid ----------------------------------------------------
cte("wstep0", """SELECT batch_id, step, count(*) FILTER (accepted) AS n_acc,
 count(*) FILTER (gate_class=0) AS n_single, count(*) FILTER (gate_class=1) AS n_twin,
 count(*) FILTER (gate_class=2) AS n_fines, sum(thickness_um) AS s1, sum(thickness_um*thickness_um) AS s2, avg(thickness_um) AS mean_um
 FROM win GROUP BY 1,2""")
cte("wgrid", """SELECT batch_id, unnest(range(min(step), max(step)+1)) AS step FROM win
 GROUP BY 1""")
cte("wstep", """SELECT g.batch_id, g.step, coalesce(n_acc,0) AS n_acc,
 coalesce(n_single,0) AS n_single, coalesce(n_twin,0) AS n_twin,
 coalesce(n_fines,0) AS n_fines, coalesce(s1,0e0) AS s1,
 coalesce(s2,0e0) AS s2, mean_um FROM wgrid g LEFT JOIN wstep0 USING (batch_id, step)""")
cte("estep0", """SELECT instrument, step, count(*) AS n, count(*) FILTER (accepted) AS n_acc,
 count(*) FILTER (gate_class=0) AS n_single, count(*) FILTER (gate_class=1) AS n_twin,
 count(*) FILTER (gate_class=2) AS n_fines,
 count(*) FILTER (gate_class=0 AND NOT accepted) AS n_undecided,
 coalesce(sum(value) FILTER (accepted),0e0) AS s1,
 coalesce(sum(value*value) FILTER (accepted),0e0) AS s2 FROM ev GROUP BY 1,2""")
cte("egrid", """SELECT instrument, unnest(range(min(step), max(step)+1)) AS step FROM ev
 GROUP BY 1""")
cte("estep", "SELECT g.instrument, g.step, " + ", ".join(
    f"coalesce({c},0) AS {c}" for c in ("n", "n_acc", "n_single", "n_twin", "n_fines",
                                        "n_undecided", "s1", "s2"))
    + " FROM egrid g LEFT JOIN estep0 USING (instrument, step)")


def win_steps(spark, sf):
    per = X.win(spark, sf).groupBy(*BS).agg(
        F.count_if("accepted").alias("n_acc"),
        F.count_if(F.col("gate_class") == 0).alias("n_single"),
        F.count_if(F.col("gate_class") == 1).alias("n_twin"),
        F.count_if(F.col("gate_class") == 2).alias("n_fines"),
        F.sum("thickness_um").alias("s1"),
        F.sum(F.col("thickness_um") * F.col("thickness_um")).alias("s2"),
        F.avg("thickness_um").alias("mean_um"))
    return N.on_step_grid(per, ["batch_id"], ["n_acc", "n_single", "n_twin", "n_fines", "s1",
                                                "s2"])


def ev_steps(spark, sf):
    ok = F.col("accepted")
    per = X.ev(spark, sf).groupBy("instrument", "step").agg(
        F.count("*").alias("n"), F.count_if(ok).alias("n_acc"),
        F.count_if(F.col("gate_class") == 0).alias("n_single"),
        F.count_if(F.col("gate_class") == 1).alias("n_twin"),
        F.count_if(F.col("gate_class") == 2).alias("n_fines"),
        F.count_if((F.col("gate_class") == 0) & ~ok).alias("n_undecided"),
        F.sum(F.when(ok, F.col("value"))).alias("s1"),
        F.sum(F.when(ok, F.col("value") * F.col("value"))).alias("s2"))
    return N.on_step_grid(per, ["instrument"], [c for c in per.columns
                                                if c not in ("instrument", "step")])


# -- joins -------------------------------------------------------------------------------------
WMEM_SQL = """SELECT w.*, unnest(range(step, least(step+4, last)+1)) AS window_step
 FROM (SELECT *, max(step) OVER (PARTITION BY batch_id) AS last FROM win) w"""


@query("j1_window_members", f"""
SELECT batch_id, window_step, count(*) AS n, count(thickness_um) AS n_accepted,
 round(median(thickness_um),6) AS median_um FROM ({WMEM_SQL}) GROUP BY 1,2""")
def _(spark, sf):
    rows = J.window_members(X.win(spark, sf), ["batch_id"], S.window_steps)
    by = ["batch_id", "window_step"]
    n = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count("thickness_um").alias("n_accepted"))
    med = N.exact_quantiles(rows, by, "thickness_um", {"median_um": 0.5})
    return _rounded(n.join(med, by, "left"), "median_um")


@query("j2_asof_interpolate", f"""
SELECT batch_id, count(*) AS n, round(sum(lvl),4) AS total, round(min(lvl),6) AS lo,
 round(max(lvl),6) AS hi FROM (
 SELECT r.batch_id, CASE WHEN b.t IS NULL THEN a.v WHEN a.t IS NULL THEN b.v
  WHEN b.t=a.t THEN b.v ELSE b.v+(a.v-b.v)*(r.t-b.t)/(a.t-b.t) END AS lvl
 FROM (SELECT batch_id, t_s-30e0+100e0*{u_duck('j')} AS t FROM win) r
 ASOF LEFT JOIN (SELECT batch_id, 60e0*(step+1) AS t, mean_um AS v FROM wstep
   WHERE mean_um IS NOT NULL) b ON r.batch_id=b.batch_id AND r.t>=b.t
 ASOF LEFT JOIN (SELECT batch_id, 60e0*(step+1) AS t, mean_um AS v FROM wstep
   WHERE mean_um IS NOT NULL) a ON r.batch_id=a.batch_id AND r.t<=a.t)
GROUP BY 1""")
def _(spark, sf):
    records = X.win(spark, sf).selectExpr("batch_id", "rid",
                                          f"t_s-30e0+100e0*{u_spark('j')} as t")
    series = win_steps(spark, sf).selectExpr(
        "batch_id", "60e0*(step+1) as t", "mean_um")
    out = J.asof_interpolate(records, series, ["batch_id"], "t", "mean_um", "lvl",
                             rows_per_bucket=10_000)
    return out.groupBy("batch_id").agg(
        F.count("*").alias("n"), r6(F.sum("lvl"), 4).alias("total"),
        r6(F.min("lvl")).alias("lo"), r6(F.max("lvl")).alias("hi"))


@query("j3_nearest_scan", f"""
SELECT batch_id, step, rid, arg_min(scan_id, (cost, scan_id)) AS scan_id FROM (
 SELECT w.k, w.batch_id, w.step, w.rid, l.scan_id,
  3e0*abs(lh-ln(l.lib_thickness_um))+0.0025e0*abs(w.size_um-l.lib_size_um)
  +4e0*abs(w.fouling-l.lib_fouling) AS cost
 FROM (SELECT row_number() OVER () AS k, batch_id, step, rid, size_um,
   ln(greatest(coalesce(thickness_um,h_um),0.5e0)) AS lh, round({u_duck('fo')},2) AS fouling
   FROM win) w, library l) GROUP BY k,1,2,3""")
def _(spark, sf):
    records = X.win(spark, sf).selectExpr(
        "batch_id", "step", "rid", "size_um",
        "ln(greatest(coalesce(thickness_um,h_um),0.5e0)) as lh",
        f"round({u_spark('fo')},2) as fouling")
    lib = X.library(spark, sf).withColumn("lib_lh", F.log("lib_thickness_um"))
    out = J.weighted_nearest(records, lib, [("lh", "lib_lh"), ("size_um", "lib_size_um"),
                                            ("fouling", "lib_fouling")], (3.0, 0.0025, 4.0),
                             "scan_id")
    return out.select("batch_id", "step", "rid", F.col("nearest").alias("scan_id"))


@query("j4_bin_lookup", f"""
SELECT truth, count(*) AS n, round(avg(bias),6) AS bias, round(avg(spread),6) AS spread,
 round(sum(abs(error_um-bias)/spread),3) AS scaled
FROM (SELECT *, {edge_sql('fouling')} AS f, {edge_sql('snr_db')} AS s, {edge_sql('true_um')} AS t
      FROM pred) JOIN caltable USING (f, s, t) GROUP BY 1""", CAL_SQL)
def _(spark, sf):
    rows = X.pred(spark, sf).select(
        "truth", "error_um", edge_bin(F.col("fouling"), _EDGES["fouling"]).alias("f"),
        edge_bin(F.col("snr_db"), _EDGES["snr_db"]).alias("s"),
        edge_bin(F.col("true_um"), _EDGES["true_um"]).alias("t"))
    # 48 literal cells: the size of the table is fixed by its edges
    table = F.broadcast(cal_table(spark, sf).drop("n"))
    return rows.join(table, ["f", "s", "t"]).groupBy("truth").agg(
        F.count("*").alias("n"), r6(F.avg("bias")).alias("bias"),
        r6(F.avg("spread")).alias("spread"),
        r6(F.sum(F.abs(F.col("error_um") - F.col("bias")) / F.col("spread")), 3).alias("scaled"))


_DONE = "md5(concat_ws(':',seed,'done')) < '8'"


@query("j6_unfinished_cases", f"""
SELECT gamma, m, k, count(*) AS n, min(seed) AS first_seed FROM grid g
WHERE NOT EXISTS (SELECT 1 FROM grid d WHERE d.seed=g.seed AND {_DONE.replace('seed', 'd.seed')})
GROUP BY 1,2,3""")
def _(spark, sf):
    cases = X.grid(spark, sf)
    return (J.unfinished(cases, cases.filter(_DONE).select("seed"), ["seed"])
            .groupBy("gamma", "m", "k").agg(F.count("*").alias("n"),
                                            F.min("seed").alias("first_seed")))


@query("j7_wanted_results", f"""
SELECT gamma, m, k, count(*) AS n FROM grid WHERE seed IN (SELECT seed FROM grid
 WHERE gamma=0.5e0 AND {_DONE}) GROUP BY 1,2,3""")
def _(spark, sf):
    cells = X.grid(spark, sf)
    wanted = cells.filter("gamma = 0.5e0").filter(_DONE).select("seed")
    return J.wanted_results(cells, wanted, ["seed"]).groupBy("gamma", "m", "k").agg(
        F.count("*").alias("n"))


@query("j8_case_grid", """
SELECT g.m, g.k, g.gamma, count(c.seed) AS n, round(avg(bias),6) AS bias
FROM (SELECT m, k, gamma FROM (SELECT unnest([0e0,1e0,2e0,3e0,4e0]) AS m),
 (SELECT unnest([0e0,0.5e0,1e0,1.5e0,2e0]) AS k), (SELECT unnest([0e0,0.5e0]) AS gamma)) g
LEFT JOIN grid c USING (m, k, gamma) GROUP BY 1,2,3""")
def _(spark, sf):
    cases = J.case_grid(spark, {"m": (0.0, 1.0, 2.0, 3.0, 4.0), "k": (0.0, 0.5, 1.0, 1.5, 2.0),
                                "gamma": (0.0, 0.5)})
    # the table becomes one row per cell before it meets the cases
    cells = X.grid(spark, sf).groupBy("m", "k", "gamma").agg(
        F.count("seed").alias("n"), r6(F.avg("bias")).alias("bias"))
    return cases.join(N.small_side(cells), ["m", "k", "gamma"], "left").select(
        "m", "k", "gamma", F.coalesce("n", F.lit(0)).alias("n"), "bias")


_RUNS = {"runa": """SELECT batch_id, step, avg(thickness_um) AS v FROM win WHERE accepted
  GROUP BY 1,2""",
         "runb": f"""SELECT batch_id, step, avg(h_um) AS v FROM win WHERE {u_duck('rb')}<0.9e0
  GROUP BY 1,2""",
         "stops": """SELECT a.batch_id, b.batch_id AS bb, a.s AS sa, b.s AS sb FROM
  (SELECT batch_id, min(step) FILTER (v>=14e0) AS s FROM runa GROUP BY 1) a FULL JOIN
  (SELECT batch_id, min(step) FILTER (v>=14e0) AS s FROM runb GROUP BY 1) b USING (batch_id)"""}


@query("j9_two_run_alignment", """
SELECT n, round(median_gap,6) AS median_abs_gap, round(mean_gap,6) AS mean_gap, worst_stop_gap,
 (worst_stop_gap<=1 AND median_gap<=0.3e0) AS passed FROM
 (SELECT count(*) AS n, median(abs(a.v-b.v)) AS median_gap, avg(a.v-b.v) AS mean_gap
  FROM runa a JOIN runb b USING (batch_id, step)),
 (SELECT max(CASE WHEN sa IS NULL AND sb IS NULL THEN 0 WHEN sa IS NULL OR sb IS NULL THEN 999
   ELSE abs(sa-sb) END)::BIGINT AS worst_stop_gap FROM stops)""", _RUNS)
def _(spark, sf):
    win = X.win(spark, sf)
    a = win.filter("accepted").groupBy(*BS).agg(F.avg("thickness_um").alias("v"))
    b = win.filter(f"{u_spark('rb')}<0.9e0").groupBy(*BS).agg(F.avg("h_um").alias("v"))
    both = J.align_runs(a, b, BS, "v").withColumn("abs_gap", F.abs("gap"))
    head = A.rejoin(both.agg(F.count("*").alias("n"), r6(F.avg("gap")).alias("mean_gap")),
                    N.exact_quantiles(both, [], "abs_gap", {"median_gap": 0.5}), [])
    hit = F.col("v") >= 14.0
    sa = V.first_crossing(a, ["batch_id"], hit, "sa")
    sb = V.first_crossing(b, ["batch_id"], hit, "sb")
    worst = sa.join(sb, "batch_id", "full").agg(
        F.max(J.stop_gap(F.col("sa"), F.col("sb"))).alias("worst_stop_gap"))
    return A.rejoin(head, worst, []).select(
        "n", r6("median_gap").alias("median_abs_gap"), "mean_gap", "worst_stop_gap",
        ((F.col("worst_stop_gap") <= 1) & (F.col("median_gap") <= 0.3)).alias("passed"))


@query("j10_truth_at_decision", """
SELECT s.batch_id, stop IS NOT NULL AS stopped, t.step, round(t.d10_um,6) AS d10_um,
 round(t.frac_below_spec,6) AS frac_below_spec
FROM (SELECT batch_id, min(step) FILTER (mean_um>=16e0) AS stop, max(step) AS last
 FROM wstep GROUP BY 1) s JOIN truthline t ON t.batch_id=s.batch_id
 AND t.step=coalesce(stop, last)""", TRUTH_SQL)
def _(spark, sf):
    stops = win_steps(spark, sf).groupBy("batch_id").agg(
        F.min(F.when(F.col("mean_um") >= S.target_mean_um, F.col("step"))).alias("stop"),
        F.max("step").alias("last"))
    at = stops.select("batch_id", F.col("stop").isNotNull().alias("stopped"),
                      F.coalesce("stop", "last").alias("step"))
    out = at.join(truth_timeline(spark, sf), BS)
    return out.select("batch_id", "stopped", "step", r6("d10_um").alias("d10_um"),
                      r6("frac_below_spec").alias("frac_below_spec"))


_DOM = """CASE WHEN {m}<0.1e0 THEN 'guess' WHEN {m}<0.5e0 THEN 'approve' ELSE 'reject' END
 AS meaning;CASE WHEN {r}<0.1e0 THEN 'R9' WHEN {r}<0.6e0 THEN 'R1' ELSE 'R2' END AS reason"""


@query("j11_domain_validation", f"""
SELECT coalesce(problem,'ok') AS problem, count(*) AS n FROM (
 SELECT CASE WHEN meaning NOT IN ('approve','reject') THEN 'meaning: '||meaning
  WHEN reason NOT IN ('R1','R2') THEN 'reason: '||reason
  WHEN role NOT IN ('assistant') THEN 'role: '||role END AS problem
 FROM (SELECT role, {_DOM.format(m=u_duck('mean', 'log_id,seq'), r=u_duck('reas', 'log_id,seq')).replace(';', ',')}
  FROM logs)) GROUP BY 1""")
def _(spark, sf):
    acts = X.log(spark, sf).selectExpr("role", *_DOM.format(
        m=u_spark("mean", "log_id,seq"), r=u_spark("reas", "log_id,seq")).split(";"))

    def domain(values):
        return spark.range(1).select(F.explode(F.array(*map(F.lit, values))).alias("key"))

    out = J.domain_check(acts, [
        ("meaning", domain(["approve", "reject"]), "key",
         F.concat(F.lit("meaning: "), F.col("meaning"))),
        ("reason", domain(["R1", "R2"]), "key",
         F.concat(F.lit("reason: "), F.col("reason"))),
        ("role", domain(["assistant"]), "key", F.concat(F.lit("role: "), F.col("role")))])
    return out.groupBy(F.coalesce("problem", F.lit("ok")).alias("problem")).agg(
        F.count("*").alias("n"))


# -- windows over steps ------------------------------------------------------------------------
_I = ["instrument"]


@query("w1_rolling_counts", """
SELECT instrument, step, n_window,
 CASE WHEN s>0 THEN round(1e0-n_window/s::DOUBLE,6) END AS undecided_rate,
 CASE WHEN s+t>0 THEN round(100e0*t/(s+t),6) END AS twin_pct,
 round(f/(360e0*span),6) AS fines_per_min
FROM (SELECT instrument, step, sum(n_acc) OVER w::BIGINT AS n_window, sum(n_single) OVER w AS s,
  sum(n_twin) OVER w AS t, sum(n_fines) OVER w AS f, count(*) OVER w AS span FROM estep
  WINDOW w AS (PARTITION BY instrument ORDER BY step ROWS 4 PRECEDING))""".replace(
    "sum(n_acc) OVER w::BIGINT", "(sum(n_acc) OVER w)::BIGINT"))
def _(spark, sf):
    s, t = V.rolling_sum("n_single", _I, 5), V.rolling_sum("n_twin", _I, 5)
    n = V.rolling_sum("n_acc", _I, 5)
    span = F.count("*").over(V.trailing(_I, 5))
    return ev_steps(spark, sf).select(
        "instrument", "step", n.alias("n_window"),
        r6(F.when(s > 0, F.lit(1.0) - n / s)).alias("undecided_rate"),
        r6(F.when(s + t > 0, F.lit(100.0) * t / (s + t))).alias("twin_pct"),
        r6(V.rolling_sum("n_fines", _I, 5) / (F.lit(360.0) * span)).alias("fines_per_min"))


_W30 = "PARTITION BY batch_id ORDER BY step ROWS 29 PRECEDING"
_SLOPE = f"""CASE WHEN count(mean_um) OVER ({_W30})>=3 THEN
 regr_slope(mean_um, (step-40)*60e0) OVER ({_W30}) END"""


@query("w2_trailing_slope", f"""
SELECT batch_id, step, round({_SLOPE},8) AS slope FROM wstep""")
def _(spark, sf):
    t = (F.col("step") - 40) * 60.0
    return win_steps(spark, sf).select(
        *BS, r6(V.trailing_slope("mean_um", t, ["batch_id"], 30), 8).alias("slope"))


cte("wgrowth", f"""SELECT batch_id, step, coalesce(CASE WHEN avg(mean_um) OVER ({_W30})>0 THEN
 greatest({_SLOPE}/avg(mean_um) OVER ({_W30}),0e0) END,0e0) AS growth FROM wstep""")


def growth_series(spark, sf):
    t = (F.col("step") - 40) * 60.0
    return win_steps(spark, sf).select(
        *BS, V.relative_growth("mean_um", t, ["batch_id"], S.growth_steps).alias("growth"))


@query("w3_relative_growth", "SELECT batch_id, step, round(growth,8) AS growth FROM wgrowth")
def _(spark, sf):
    return growth_series(spark, sf).withColumn("growth", r6("growth", 8))


@query("prj5_age_shift", f"""
SELECT batch_id, window_step, count(*) AS n, round(avg(shifted),6) AS mean_shifted FROM (
 SELECT m.batch_id, window_step, thickness_um*(1e0+growth*(60e0*(window_step+1)-t_s)) AS shifted
 FROM ({WMEM_SQL}) m JOIN wgrowth g ON g.batch_id=m.batch_id AND g.step=m.window_step
 WHERE accepted) GROUP BY 1,2""")
def _(spark, sf):
    from winnow.operators.project import age_shift

    rows = J.window_members(X.win(spark, sf).filter("accepted"), ["batch_id"], S.window_steps)
    growth = growth_series(spark, sf).withColumnRenamed("step", "window_step")
    now = F.lit(60.0) * (F.col("window_step") + 1)
    h = age_shift(F.col("thickness_um"), F.col("growth"), now, F.col("t_s"))
    return (rows.join(growth, ["batch_id", "window_step"]).groupBy("batch_id", "window_step")
            .agg(F.count("*").alias("n"), r6(F.avg(h)).alias("mean_shifted")))


@query("w4_trailing_mean", """
SELECT batch_id, step, round(avg(mean_um) OVER (PARTITION BY batch_id ORDER BY step
 ROWS 9 PRECEDING),6) AS level FROM wstep""")
def _(spark, sf):
    return win_steps(spark, sf).select(
        *BS, r6(V.trailing_mean("mean_um", ["batch_id"], 10)).alias("level"))


@query("w5_cumulative_counts", """
SELECT instrument, step, (sum(n_acc) OVER w)::BIGINT AS accepted,
 (sum(n_twin) OVER w)::BIGINT AS twins, (sum(n_undecided) OVER w)::BIGINT AS undecided,
 (sum(n_fines) OVER w)::BIGINT AS fines,
 round((sum(n_acc) OVER w)/(sum(n_acc) OVER (PARTITION BY instrument)),6) AS share
FROM estep WINDOW w AS (PARTITION BY instrument ORDER BY step ROWS UNBOUNDED PRECEDING)""")
def _(spark, sf):
    from pyspark.sql import Window as W

    w = V.upto(_I)
    return ev_steps(spark, sf).select(
        "instrument", "step", F.sum("n_acc").over(w).alias("accepted"),
        F.sum("n_twin").over(w).alias("twins"), F.sum("n_undecided").over(w).alias("undecided"),
        F.sum("n_fines").over(w).alias("fines"),
        r6(F.sum("n_acc").over(w) / F.sum("n_acc").over(W.partitionBy(*_I))).alias("share"))


@query("w6_rolling_stats", """
SELECT instrument, step, CASE WHEN n>0 THEN round(s/greatest(n,1),6) END AS pooled,
 round(sqrt(greatest(q/greatest(n,1)-(s/greatest(n,1))*(s/greatest(n,1)),0e0)/greatest(n,1)),6)
  AS pooled_se
FROM (SELECT instrument, step, sum(n_acc) OVER w AS n, sum(s1) OVER w AS s, sum(s2) OVER w AS q
 FROM estep WINDOW w AS (PARTITION BY instrument ORDER BY step ROWS 4 PRECEDING))""")
def _(spark, sf):
    out = ev_steps(spark, sf).select("instrument", "step",
                                     *V.rolling_stats("n_acc", "s1", "s2", _I, 5))
    return _rounded(out, "pooled", "pooled_se")


@query("w7_rates_and_lags", """
SELECT instrument, step, round(n/360e0,6) AS detections_per_min,
 round((n-lag(n) OVER w)/6e0,6) AS growth_per_h
FROM estep WINDOW w AS (PARTITION BY instrument ORDER BY step)""")
def _(spark, sf):
    from pyspark.sql import Window as W

    w = W.partitionBy(*_I).orderBy("step")
    return ev_steps(spark, sf).select(
        "instrument", "step", r6(F.col("n") / 360.0).alias("detections_per_min"),
        r6((F.col("n") - F.lag("n").over(w)) / 6.0).alias("growth_per_h"))


EWMA_SQL = {"evseq": """SELECT instrument, us, event_id, value, accepted,
  (gate_class=0 AND NOT accepted) AS undecided,
  row_number() OVER (PARTITION BY instrument ORDER BY us, u, event_id) AS r
  FROM (SELECT *, ('0x'||substr(md5(event_id::VARCHAR),1,8))::UBIGINT/4294967296.0e0 AS u FROM ev)
  """,
            "evew": """SELECT instrument, r, 0.02e0*value+0.98e0*10e0 AS level FROM evseq WHERE r=1
  UNION ALL SELECT e.instrument, e.r, 0.02e0*e.value+0.98e0*w.level FROM evew w JOIN evseq e
  ON e.instrument=w.instrument AND e.r=w.r+1"""}


@query("w8_ewma", """
SELECT instrument, count(*) AS n, round(sum(level),4) AS total, round(min(level),6) AS lo,
 round(max(level),6) AS hi FROM evew GROUP BY 1""", EWMA_SQL, recursive=True)
def _(spark, sf):
    out = N.ewma(X.ev(spark, sf), _I, "us", ["event_id"], {"level": ("value", 10.0)},
                 S.ewma_lambda)
    return out.groupBy("instrument").agg(
        F.count("*").alias("n"), r6(F.sum("level"), 4).alias("total"),
        r6(F.min("level")).alias("lo"), r6(F.max("level")).alias("hi"))


# time between readings decides how much of the level is kept; the first reading starts it
_TAU = 6 * 3600e6
IRREGULAR = {**EWMA_SQL,
             "evgap": f"""SELECT *, coalesce(exp(-(us-lag(us) OVER (PARTITION BY instrument
  ORDER BY r))/{_TAU!r}),0e0) AS keep FROM evseq""",
             "evdec": """SELECT instrument, r, value AS level FROM evgap WHERE r=1
  UNION ALL SELECT e.instrument, e.r, e.keep*w.level+(1e0-e.keep)*e.value FROM evdec w
  JOIN evgap e ON e.instrument=w.instrument AND e.r=w.r+1"""}


@query("p4_affine_scan", """
SELECT instrument, count(*) AS n, round(sum(level),4) AS total, round(min(level),6) AS lo,
 round(max(level),6) AS hi, round(arg_max(level,r),6) AS latest FROM evdec GROUP BY 1""",
       IRREGULAR, recursive=True)
def _(spark, sf):
    rows = N.settle(N.row_positions(X.ev(spark, sf).select("instrument", "us", "event_id", "value"),
                                    _I, "us", ["event_id"], "pos"))
    rows = N.with_previous(rows, _I, "pos", "us", "before_us")
    keep = F.coalesce(F.exp(-(F.col("us") - F.col("before_us")) / F.lit(_TAU)), F.lit(0.0))
    rows = rows.withColumn("keep", keep)
    out = N.affine_scan(rows, _I, None, (), {"level": (
        F.col("keep"), (1 - F.col("keep")) * F.col("value"), 0.0)}, pos="pos")
    return out.groupBy("instrument").agg(
        F.count("*").alias("n"), r6(F.sum("level"), 4).alias("total"),
        r6(F.min("level")).alias("lo"), r6(F.max("level")).alias("hi"),
        r6(F.max_by("level", "pos")).alias("latest"))


@query("w9_first_crossing", """
SELECT batch_id, min(step) FILTER (mean_um>=12e0) AS first_12,
 min(step) FILTER (mean_um>=99e0) AS first_99 FROM wstep GROUP BY 1""")
def _(spark, sf):
    steps = win_steps(spark, sf)
    return (V.first_crossing(steps, ["batch_id"], F.col("mean_um") >= 12.0, "first_12")
            .join(V.first_crossing(steps, ["batch_id"], F.col("mean_um") >= 99.0, "first_99"),
                  "batch_id"))


@query("w10_smoothed_crossing", """
SELECT batch_id, min(step) FILTER (c=3 AND a>=12e0) AS first_smoothed FROM (
 SELECT batch_id, step, count(mean_um) OVER w AS c, avg(mean_um) OVER w AS a FROM wstep
 WINDOW w AS (PARTITION BY batch_id ORDER BY step ROWS 2 PRECEDING)) GROUP BY 1""")
def _(spark, sf):
    steps = win_steps(spark, sf).withColumn(
        "hit", V.smoothed_hit("mean_um", ["batch_id"], S.smooth_steps, 12.0))
    return V.first_crossing(steps, ["batch_id"], F.col("hit"), "first_smoothed")


@query("w11_baseline_ratio", """
SELECT instrument, step, CASE WHEN base<>0 THEN round(n_fines/base,6) END AS fines_ratio
FROM (SELECT *, avg(n_fines) FILTER (step<4) OVER (PARTITION BY instrument) AS base FROM estep)
""")
def _(spark, sf):
    out = V.baseline_ratio(ev_steps(spark, sf), _I, "n_fines", F.col("step") < 4, "fines_ratio")
    return out.select("instrument", "step", r6("fines_ratio").alias("fines_ratio"))


@query("w12_time_to_spec", f"""
SELECT batch_id, step, CASE WHEN mean_um>=12e0 THEN 0e0 WHEN slope>0 THEN
 round((12e0-mean_um)/slope,4) END AS eta_s FROM (SELECT *, {_SLOPE} AS slope FROM wstep)""")
def _(spark, sf):
    t = (F.col("step") - 40) * 60.0
    df = win_steps(spark, sf).withColumn(
        "slope", V.trailing_slope("mean_um", t, ["batch_id"], S.eta_steps))
    return df.select(*BS, r6(V.eta(F.col("mean_um"), F.col("slope"), 12.0), 4).alias("eta_s"))


@query("w13_tune_threshold", """
SELECT coalesce(round(max({'r':r,'s':score,'b':bad}) FILTER (bad/r<=0.2e0).s,6),1e0) AS threshold,
 coalesce(round(1e0-(max({'r':r,'s':score,'b':bad}) FILTER (bad/r<=0.2e0)).r/max(r),6),1e0)
  AS undecided_share,
 coalesce(round((max({'r':r,'s':score,'b':bad}) FILTER (bad/r<=0.2e0)).b
  /(max({'r':r,'s':score,'b':bad}) FILTER (bad/r<=0.2e0)).r,6),0e0) AS bad_share
FROM (SELECT confidence AS score, row_number() OVER w AS r,
 (sum((error_um>0.9e0+2e0*(confidence-0.5e0))::INT) OVER w)::BIGINT AS bad
 FROM pred WINDOW w AS (ORDER BY confidence DESC, rid))""".replace(
    "max({'r':r,'s':score,'b':bad}) FILTER (bad/r<=0.2e0).s",
    "(max({'r':r,'s':score,'b':bad}) FILTER (bad/r<=0.2e0)).s"))
def _(spark, sf):
    bad = F.col("error_um") > 0.9 + F.lit(2.0) * (F.col("confidence") - 0.5)
    out = K.tune_threshold(X.pred(spark, sf), [], "confidence", bad, 0.2,
                           rows_per_bucket=10_000)
    return _rounded(out, "threshold", "undecided_share", "bad_share")


@query("w14_suffix_threshold", """
SELECT first_bin, CASE WHEN first_bin<12 THEN round(exp(lo+first_bin*w),6) END AS threshold
FROM (SELECT coalesce(max(bin) FILTER (rate<0.9e0)+1,0)::BIGINT AS first_bin, lo, w FROM (
 SELECT least(greatest(floor((ln(true_um)-lo)/w),0),11) AS bin, lo, w,
  avg((true_um>5e0 OR fouling<0.3e0)::INT) AS rate FROM pred, (
  SELECT ln(min(true_um)) AS lo, (ln(max(true_um))+1e-9-ln(min(true_um)))/12 AS w FROM pred)
 GROUP BY ALL) GROUP BY lo, w)""")
def _(spark, sf):
    good = (F.col("true_um") > 5.0) | (F.col("fouling") < 0.3)
    return _rounded(K.suffix_threshold(X.pred(spark, sf), "true_um", good, 0.9, 12), "threshold")


@query("w15_worst_recent", """
SELECT instrument, step, ['OK','Warning','Alarm'][max(rank) OVER (PARTITION BY instrument
 ORDER BY step ROWS 9 PRECEDING)+1] AS state FROM (SELECT instrument, step,
 CASE WHEN r>=0.35e0 THEN 2 WHEN r>=0.3e0 THEN 1 ELSE 0 END AS rank FROM (
 SELECT *, coalesce(n_undecided/nullif(n_single,0),0e0) AS r FROM estep))""")
def _(spark, sf):
    from winnow.functions.exprs import ratio, state_name

    rank = V.rate_state(ratio(F.col("n_undecided").cast("double"), F.col("n_single")),
                        (0.3, 0.35))
    return ev_steps(spark, sf).withColumn("rank", rank).select(
        "instrument", "step", state_name(V.worst_recent("rank", _I, 10)).alias("state"))


@query("p1_step_grid", "SELECT batch_id, step, n_acc, n_twin FROM wstep")
def _(spark, sf):
    return win_steps(spark, sf).select(*BS, "n_acc", "n_twin")


# -- picks ----------------------------------------------------------------------------------------
@query("t1_total_sort", """
SELECT gamma, m, k, seed, bias FROM grid ORDER BY gamma, m, k, seed""")
def _(spark, sf):
    return X.grid(spark, sf).select("gamma", "m", "k", "seed", "bias").orderBy(
        "gamma", "m", "k", "seed")


@query("t2_nearest_in_time", """
SELECT instrument, event_id, rank FROM (SELECT instrument, event_id, row_number() OVER (
 PARTITION BY instrument ORDER BY abs(us-1705000000000000), event_id) AS rank FROM ev)
WHERE rank<=5""")
def _(spark, sf):
    return K.top_k(X.ev(spark, sf), _I,
                   [F.abs(F.col("us") - F.lit(1705000000000000)), F.col("event_id")], 5,
                   ["event_id"]).select("instrument", "event_id", "rank")


@query("t3_last_rows", """
SELECT log_id, seq, role, rank FROM (SELECT *, row_number() OVER (PARTITION BY log_id
 ORDER BY seq DESC) AS rank FROM logs) WHERE rank<=10""")
def _(spark, sf):
    return K.top_k(X.log(spark, sf), ["log_id"], [F.col("seq").desc()], 10, ["seq"]).select(
        "log_id", "seq", "role", "rank")


@query("t4_nearest_level", """
SELECT batch_id, arg_min(step, (abs(mean_um-10e0), step)) AS step,
 round(arg_min(mean_um, (abs(mean_um-10e0), step)),6) AS mean_um FROM wstep
WHERE mean_um IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    out = K.row_nearest(win_steps(spark, sf).select(*BS, "mean_um"), ["batch_id"], "mean_um",
                        10.0)
    return _rounded(out, "mean_um")


@query("t5_first_qualifying", """
SELECT rid, scan_id, snr_db, rank FROM (SELECT *, row_number() OVER (ORDER BY scan_id, rid, x_um,
 outer_um) AS rank FROM asc2 WHERE snr_db>=35e0) WHERE rank<=30""")
def _(spark, sf):
    return K.top_k(X.asc(spark, sf).filter("snr_db >= 35"), [],
                   [F.col(c) for c in ("scan_id", "rid", "x_um", "outer_um")], 30,
                   ["rid"]).select("rid", "scan_id", "snr_db", "rank")


@query("t6_even_frames", """
SELECT batch_id, step FROM (SELECT batch_id, unnest(range(9, max(step)+1, 10)) AS step FROM wstep
 GROUP BY 1 UNION SELECT batch_id, max(step) FROM wstep GROUP BY 1
 UNION SELECT batch_id, min(step) FILTER (mean_um>=12e0) FROM wstep GROUP BY 1)
WHERE step IS NOT NULL""")
def _(spark, sf):
    steps = win_steps(spark, sf)
    stops = V.first_crossing(steps, ["batch_id"], F.col("mean_um") >= 12.0, "step")
    return K.even_frames(steps, ["batch_id"], 10, stops)


@query("s2_spaced_frames", """
SELECT DISTINCT batch_id, round_even(i*(last/35e0),0)::BIGINT AS step FROM (
 SELECT batch_id, max(step) AS last, unnest(range(36)) AS i FROM wstep GROUP BY 1)""")
def _(spark, sf):
    return K.spaced_frames(win_steps(spark, sf), ["batch_id"], 36)


@query("s1_union_of_sources", """
SELECT source, count(*) AS n, count(thickness_um) AS n_thickness, count(instrument) AS n_instr,
 round(avg(value),6) AS mean_value FROM (
 SELECT 'events' AS source, instrument, value, NULL::DOUBLE AS thickness_um FROM ev
 UNION ALL SELECT 'window', NULL, size_um, thickness_um FROM win) GROUP BY 1""")
def _(spark, sf):
    a = X.ev(spark, sf).select(F.lit("events").alias("source"), "instrument", "value")
    b = X.win(spark, sf).select(F.lit("window").alias("source"),
                                F.col("size_um").alias("value"), "thickness_um")
    return a.unionByName(b, allowMissingColumns=True).groupBy("source").agg(
        F.count("*").alias("n"), F.count("thickness_um").alias("n_thickness"),
        F.count("instrument").alias("n_instr"), r6(F.avg("value")).alias("mean_value"))


@query("s4_schema_completion", """
SELECT batch_id, step, n_acc, mean_um IS NOT NULL AS has_mean, NULL::DOUBLE AS p_spec,
 NULL::DOUBLE AS d10_lo FROM wstep""")
def _(spark, sf):
    from winnow.operators.estimate import complete_schema

    steps = win_steps(spark, sf).select(*BS, "n_acc",
                                        F.col("mean_um").isNotNull().alias("has_mean"))
    return complete_schema(steps, ["p_spec", "d10_lo"])
